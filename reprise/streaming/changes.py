"""A stream of document events that keeps clones up to date.

Each micro-batch is one detection: a document's events are applied in the order of their versions (whole texts, ranged edits of
the text so far, deletions), documents whose text did not change are left out, and the clone state is refreshed and written as
the next version of its tables. The tables' folder names the batch, so a batch that runs again after a failure writes the
same version again. Of the versions before, the last one stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reprise.operators import documents as docs
from reprise.operators.fragments import line_fragments
from reprise.operators.incremental import State, build, refresh
from reprise.storage import remove

EVENTS = "uri string, text string, version bigint"
#: The same with ranged edits, which may be missing.
RANGED_EVENTS = f"{EVENTS}, edits array<struct<start_line:int,start_char:int,end_line:int,end_char:int,text:string>>"
_TABLES = {
    "fragments": "uri string, frag_id int, toks array<string>",
    "nodes": "uri string, frag_id int, off int, clone_size int, class_id string",
    "documents": "uri string, text string",
}


@dataclass
class CloneStore:
    """Versions of documents and clone state under a folder. Fragments are lines, tokens words."""

    spark: SparkSession
    root: str
    threshold: int

    def _path(self, version: int, name: str) -> str:
        return f"{self.root}/v{version}/{name}"

    def _read(self, version: int, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(self._path(version, name))

    def versions(self) -> list[int]:
        """Complete versions: those with the table that is written last."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/v*/documents/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(str(x.getPath()).split("/")[-3].removeprefix("v")) for x in found or [])

    def state(self, version: int) -> State:
        return State(self._read(version, "fragments"), self._read(version, "nodes"), self.threshold)

    def documents(self) -> DataFrame:
        found = self.versions()
        return self._read(found[-1], "documents") if found else self.spark.createDataFrame([], _TABLES["documents"])

    def clones(self) -> DataFrame:
        """The clones after the last batch."""
        return self.state(self.versions()[-1]).clones()

    def _write(self, version: int, state: State, documents: DataFrame) -> None:
        for name in ("fragments", "nodes"):
            getattr(state, name).write.mode("overwrite").parquet(self._path(version, name))
        documents.write.mode("overwrite").parquet(self._path(version, "documents"))

    def apply(self, events: DataFrame, batch: int) -> None:
        """One batch of events (uri, text, version, edits if there are any); without a text and edits they delete."""
        if "edits" not in events.columns:
            events = events.withColumn("edits", F.lit(None).cast(RANGED_EVENTS.split("edits ")[1]))
        before = [v for v in self.versions() if v < batch]
        for old_version in before[:-1]:
            remove(self.spark, f"{self.root}/v{old_version}")
        if not before:
            new = docs.folded(self.spark.createDataFrame([], _TABLES["documents"]), events)
            self._write(batch, build(line_fragments(new), self.threshold), new)
            return
        old = self._read(before[-1], "documents")
        new = docs.folded(old, events)
        changes = docs.changed(old.join(events.select("uri"), "uri", "left_semi"), new.join(events.select("uri"), "uri", "left_semi"))
        come = line_fragments(new.join(changes.where(F.col("change") != "deleted"), "uri", "left_semi"))
        self._write(batch, refresh(self.state(before[-1]), changes.select("uri"), come), new)

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Maintains the store from a streaming table of events."""
        query = events.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number)).option("checkpointLocation", checkpoint)
        return query.trigger(**(trigger or {"availableNow": True})).start()


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A stream over parquet files of events, so many files a batch, or all that are there."""
    stream = spark.readStream.schema(RANGED_EVENTS)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(path)
