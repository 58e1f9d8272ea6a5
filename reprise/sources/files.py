"""Source files as document tables, and their fragments.

Files are read by Spark, so a root may be in any file system that Spark reads.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.config import CloneConfig
from reprise.functions import lexers
from reprise.functions.text import drop_unterminated_line, extension

TOKEN = pa.struct([("type", pa.string()), ("text", pa.string()), ("leaf", pa.bool_()), ("start_line", pa.int32()), ("start_char", pa.int32()), ("end_line", pa.int32()), ("end_char", pa.int32())])
_TOKENS = "tokens array<struct<type:string,text:string,leaf:boolean,start_line:int,start_char:int,end_line:int,end_char:int>>"


def _texts(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("text"))


def scan_files(spark: SparkSession, root: str, filetype: str) -> DataFrame:
    """uri, text of the files with an extension under a folder, at any depth; the extension is pushed into the listing."""
    return _texts(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{filetype}").option("recursiveFileLookup", "true").load(root))


def git_files(root: str, filetype: str | None = None) -> list[str]:
    """Absolute paths of the files that git tracks in a repository on the driver."""
    listed = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, check=True).stdout.decode().split("\0")
    return [f"{root.rstrip('/')}/{p}" for p in listed if p and (filetype is None or p.rpartition(".")[2] == filetype)]


def scan_git(spark: SparkSession, root: str, filetype: str | None = None) -> DataFrame:
    """uri, text of the files that git tracks."""
    paths = git_files(root, filetype)
    if not paths:
        return spark.createDataFrame([], "uri string, text string")
    return _texts(spark.read.format("binaryFile").load([f"file://{p}" for p in paths]))


def scan(spark: SparkSession, root: str, config: CloneConfig) -> DataFrame:
    """The documents that the options ask for."""
    if config.index_git_files_only:
        return scan_git(spark, root.removeprefix("file://"), config.language)
    return scan_files(spark, root, config.language)


def with_extension(documents: DataFrame, filetype: str) -> DataFrame:
    return documents.where(extension(F.col("uri")) == filetype)


def normalized(documents: DataFrame, drop_unterminated: bool = False) -> DataFrame:
    """With drop_unterminated a last line without a line feed goes."""
    return documents.withColumn("text", drop_unterminated_line(F.col("text"))) if drop_unterminated else documents


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """version (the folder's name), op, path of the files `changes` in version folders."""
    from reprise.operators.documents import change_lines

    lines = spark.read.text(f"{root.rstrip('/')}/*/changes").select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("version"), F.col("value").alias("line"))
    return change_lines(lines)


def _lex(config: CloneConfig):
    lang, types = lexers.language(config.language), config.fragment_types
    known = lexers.node_types(lang)
    if unknown := [t for t in types if t not in known]:
        raise ValueError(f"no {lang.name} nodes of type {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    extra = tuple(t for t in config.extra_nodes if t in known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, text in zip(batch.column("uri").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                tokens, starts = lexers.tokenize(text, lang), lexers.line_starts(text)

                def place(kind: str, start: int, end: int, leaf: bool) -> dict:
                    a, b = lexers.position(starts, start), lexers.position(starts, end)  # noqa: B023
                    return {"type": kind, "text": text[start:end], "leaf": leaf, "start_line": a[0], "start_char": a[1], "end_line": b[0], "end_char": b[1]}  # noqa: B023

                places = [place(t.type, t.start, t.end, True) for t in tokens]
                inner: dict[int, list[tuple[int, dict]]] = {}  # by first token, outer ones first
                for kind, i, j in lexers.found(text, tokens, lang, extra) if extra else []:
                    inner.setdefault(i, []).append((j, place(kind, tokens[i].start, tokens[j].end, False)))
                for n, (kind, i, j) in enumerate(lexers.found(text, tokens, lang, types)):
                    own = [x for k in range(i, j + 1) for x in (*(node for last, node in inner.get(k, ()) if last <= j), places[k])] if inner else places[i : j + 1]
                    rows.append((uri, n, kind, tokens[i].start, tokens[j].end, own))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(TOKEN)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uri", "frag_id", "frag_type", "start", "end", "tokens"])

    return run


def code_fragments(documents: DataFrame, config: CloneConfig) -> DataFrame:
    """uri, frag_id, frag_type, start, end (offsets), tokens: every node of the asked types, nested ones too. Inner nodes of
    the types in `extra_nodes` are tokens as well, in front of what is in them. Asking for an unknown type is an error.

    Lexing is the one step without a native form; texts go to Python in Arrow batches, and tokens come back.
    """
    return documents.select("uri", "text").mapInArrow(_lex(config), f"uri string, frag_id int, frag_type string, start int, end int, {_TOKENS}")


def versions_with_deletions(documents: DataFrame, fragments: DataFrame, chosen: DataFrame) -> DataFrame:
    """version, uri, text: for each version of `chosen` (version, uri, frag_id) all documents, without the
    fragments chosen for it and the versions before."""
    cuts = chosen.join(fragments.select("uri", "frag_id", "start", "end"), ["uri", "frag_id"])
    last = chosen.agg(F.max("version")).first()[0]
    if last is None:
        return documents.select(F.lit(0).alias("version"), "uri", "text")
    every = documents.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(int(last)))))
    joined = every.join(cuts.select("uri", F.col("version").alias("since"), "start", "end"), "uri", "left")
    gone = F.col("since").isNotNull() & (F.col("since") <= F.col("version"))
    without = F.concat(F.expr("substring(text, 1, start)"), F.expr("substring(text, end + 1)"))
    return joined.select("version", "uri", F.when(gone, without).otherwise(F.col("text")).alias("text"))
