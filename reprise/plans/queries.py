"""The registered queries: each operator applied to whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise import detector
from reprise.config import CloneConfig
from reprise.functions import text as tx
from reprise.operators import documents as dc
from reprise.operators import edits, incremental, reports, suffix
from reprise.operators import fragments as fr
from reprise.operators import tokens as tk
from reprise.plans.oracles import THRESHOLD
from reprise.sources import files
from reprise.storage import new_path
from reprise.streaming.changes import EVENTS, CloneStore, read_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, uri, text of the documents table."""
    uri = F.concat(F.lit("file:///corpus/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", uri.alias("uri"), F.coalesce("text", F.lit("")).alias("text"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("file:///bench/"), F.col("item_id").cast("string"), F.lit(".txt"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(uri.alias("uri"), F.coalesce("text", F.lit("")).alias("text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.line_fragments(docs(spark, sf_dir))


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.chained(lines(spark, sf_dir), THRESHOLD)


def clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.clones(lines(spark, sf_dir), THRESHOLD)


def ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.detect_lines(docs(spark, sf_dir), THRESHOLD)


def _digest(c: Column) -> Column:
    return F.md5(c.cast("binary")).alias("digest")


def _size(c: str = "toks") -> Column:
    return F.size(c).cast("bigint").alias("n_tokens")


@query
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_extension(docs(spark, sf_dir), "txt").select("uri", F.length("text").cast("bigint").alias("n_chars"))


@query
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.normalized(docs(spark, sf_dir), drop_unterminated=True)
    return out.select("uri", _digest(F.col("text")), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: of ten one is new, one gone and one different."""
    d = docs(spark, sf_dir)
    was = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return d.where("doc_id % 10 <> 3").select("uri", was.alias("text")), d.where("doc_id % 10 <> 2").select("uri", "text")


@query
def changed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.changed(*_old_new(spark, sf_dir))


@query
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    some = d.where("doc_id % 10 IN (1, 2)")
    event = lambda word, version: some.select("uri", F.concat("text", F.lit(word)).alias("text"), F.lit(version).alias("version"))
    last = event(" second", 2).join(some.where("doc_id % 10 = 2").select("uri", F.lit(True).alias("gone")), "uri", "left")
    last = last.select("uri", F.when(F.col("gone").isNull(), F.col("text")).alias("text"), "version")
    return dc.upsert(d.select("uri", "text"), event(" first", 1).unionByName(last)).select("uri", _digest(F.col("text")))


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("uri", "frag_id", _size(), _digest(F.array_join("toks", " ")))


@query
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter("toks", lambda w: ~w.isin("the", "of", "and", "de", "la"))
    return lines(spark, sf_dir).groupBy("uri").agg(F.sum(F.size(kept)).alias("n_tokens"))


@query
def blind_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("uri", "frag_id", _digest(F.array_join(fr.blind_words(F.col("toks")), " ")))


@query
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(F.size("toks") > 0).select("uri", "frag_id", _size())


@query
def fragment_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.size_filter(lines(spark, sf_dir), 20, 50).select("uri", "frag_id", _size())


@query
def outermost_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("toks")
    spans = lines(spark, sf_dir).select("uri", "frag_id", (n % 3).alias("frag_type"), (F.col("frag_id") * 3).alias("start"), (F.col("frag_id") * 3 + n % 11).alias("end"))
    return fr.outermost(spans).select("uri", "frag_id")


@query
def token_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_dictionary(lines(spark, sf_dir))


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_counts(lines(spark, sf_dir))


@query
def token_cumcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_cumcounts(tk.token_counts(lines(spark, sf_dir)))


@query
def merged_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the old documents, kept up with the fragments that come and go."""
    old, new = _old_new(spark, sf_dir)
    changes = dc.changed(old, new)
    come = fr.line_fragments(new.join(changes.where("change <> 'deleted'"), "uri", "left_semi"))
    gone = fr.line_fragments(old.join(changes.where("change <> 'added'"), "uri", "left_semi"))
    return tk.merge_counts(tk.token_counts(fr.line_fragments(old)), come, gone)


@query
def token_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    largest = tk.token_counts(lines(spark, sf_dir)).agg((F.count(F.lit(1)) + 1).alias("largest_id"))
    return largest.withColumn("bits", F.length(F.bin("largest_id")).cast("bigint"))


@query
def corpus_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.corpus_positions(lines(spark, sf_dir))


@query
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lines(spark, sf_dir)
    out = tk.fingerprints(f, tk.token_dictionary(f))
    return out.select("uri", "frag_id", _digest(F.array_join(F.col("ids").cast("array<string>"), " ")), F.size("ids").cast("bigint").alias("n_ids"))


@query
def pos_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions of the corpus."""
    corpus = tk.corpus_positions(lines(spark, sf_dir))
    return tk.pos_to_source(corpus.select(F.explode(F.sequence("pos_start", "pos_end")).alias("pos")), corpus, 64)


@query
def suffix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.places(chained(spark, sf_dir)).select(*suffix.PLACE, F.col("rk").cast("bigint").alias("rk"))


@query
def lcp_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.places(chained(spark, sf_dir)).where("lcp IS NOT NULL").select(*suffix.PLACE, F.col("lcp").cast("bigint").alias("lcp"))


@query
def repeated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_ngrams(lines(spark, sf_dir), 5)


@query
def clone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.edges(suffix.emitted(chained(spark, sf_dir))).withColumn("lcp", F.col("lcp").cast("bigint"))


@query
def maximal_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.emitted(chained(spark, sf_dir)).where("emitted").select(*suffix.PLACE, F.col("lcp").cast("bigint").alias("lcp"))


@query
def clone_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones(spark, sf_dir).select(*suffix.PLACE, F.col("clone_size").cast("bigint").alias("clone_size"))


@query
def clone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = (F.max("clone_size") + 1).cast("bigint").alias("tokens")
    return clones(spark, sf_dir).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_clones"), tokens)


@query
def clone_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranged(spark, sf_dir).select("uri", *[F.col(c).cast("bigint").alias(c) for c in reports.RANGE], "class_id")


@query
def clones_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.clones_per_document(docs(spark, sf_dir), ranged(spark, sf_dir))


@query
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.diagnostics(ranged(spark, sf_dir))


@query
def published_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.published(docs(spark, sf_dir), ranged(spark, sf_dir))
    each = F.array_sort(F.transform("diagnostics", lambda d: F.concat_ws(" ", d["range"], d["n_related"].cast("string"))))
    return out.select("uri", F.size("diagnostics").cast("bigint").alias("n_diagnostics"), _digest(F.array_join(each, ",")))


@query
def related_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.related_locations(ranged(spark, sf_dir))


@query
def related_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related locations of all diagnostics."""
    return reports.related(ranged(spark, sf_dir), docs(spark, sf_dir))


@query
def clone_pairs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pairs(ranged(spark, sf_dir))


@query
def clone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report(ranged(spark, sf_dir))


@query
def clone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(ranged(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (F.col("doc_id") % 7).cast("int")
    return docs(spark, sf_dir).select("uri", line.alias("from_line"), line.alias("to_line"))


@query
def clones_at_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.requested(ranged(spark, sf_dir), _requests(spark, sf_dir))
    return out.select("uri", reports.range_text().alias("range"), F.col("from_line").alias("line"))


@query
def jump_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.jump_targets(ranged(spark, sf_dir), _requests(spark, sf_dir)).select("from_uri", "from_line", "title", "uri", "range_json")


@query
def largest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest_classes(clones(spark, sf_dir), 25).withColumn("tokens", F.col("tokens").cast("bigint"))


@query
def cross_table_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = docs(spark, sf_dir).select("uri", "text").unionByName(bench(spark, sf_dir))
    item = F.col("uri").startswith("file:///bench/")
    found = suffix.clones(fr.line_fragments(both), THRESHOLD).groupBy("class_id").agg(F.count_if(item).alias("n_bench"), F.count_if(~item).alias("n_docs"))
    return found.where("n_bench > 0 AND n_docs > 0")


@query
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    changes = dc.changed(old, new)
    state = incremental.build(fr.line_fragments(old), THRESHOLD)
    come = fr.line_fragments(new.join(changes.where("change <> 'deleted'"), "uri", "left_semi"))
    out = incremental.refresh(state, changes.select("uri"), come).clones()
    return out.withColumn("clone_size", F.col("clone_size").cast("bigint"))


@query
def streaming_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    root = new_path(spark, "stream")
    kind = dict(x.split() for x in EVENTS.split(", "))
    typed = lambda df: df.select(*[F.col(c).cast(t).alias(c) for c, t in kind.items()])
    gone = old.join(new, "uri", "left_anti").select("uri", F.lit(None).alias("text"), F.lit(2).alias("version"))
    store = CloneStore(spark, f"{root}/store", THRESHOLD)
    # one micro-batch a version: the second one's files come when the first is done
    for version, events in ((1, old.withColumn("version", F.lit(1))), (2, gone.unionByName(new.withColumn("version", F.lit(2))))):
        typed(events).write.parquet(f"{root}/events/{version}")
        store.start(read_events(spark, f"{root}/events/*", None), f"{root}/checkpoint").awaitTermination()
    return store.clones().withColumn("clone_size", F.col("clone_size").cast("bigint"))


def _bench_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench(spark, sf_dir).select(F.col("uri").alias("doc"), tx.words(F.translate("text", "\n", " ")).alias("toks"))


@query
def rank_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents."""
    toks = docs(spark, sf_dir).select(F.col("uri").alias("doc"), tx.words(F.translate("text", "\n", " ")).alias("toks"))
    return tk.rank_select(toks.select("doc", F.posexplode("toks").alias("pos", "token")))


@query
def bwt_lf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.bwt_lf(_bench_tokens(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation and the next one."""
    turn = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.words(F.coalesce("text", F.lit(""))).alias("old"))
    after = turn.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("old").alias("new"))
    return turn.join(after, ["conv_id", "turn"])


@query
def edit_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edits.edit_trim(_turns(spark, sf_dir))
    joined = [F.array_join(c, " ").alias(c) for c in ("deleted", "inserted")]
    return out.select("conv_id", "turn", F.col("start").cast("bigint").alias("shared_start"), F.col("end").cast("bigint").alias("shared_end"), *joined)


@query
def edit_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script applied to the old sequence, which has to give the new one."""
    out = edits.edit_script(_turns(spark, sf_dir))
    return out.select("conv_id", "turn", F.array_join(edits.applied(F.col("old"), F.col("ops")), " ").alias("applied"))


@query
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits: the first three characters give way to a word; if there is a second line, another is put in front of it."""
    at = lambda a, b, c, d, t: F.struct(a.alias("start_line"), b.alias("start_char"), c.alias("end_line"), d.alias("end_char"), F.lit(t).alias("text"))
    zero = F.lit(0)
    # the third character's position, where a line may have ended before
    head = F.substring("text", 1, 3)
    row = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    column = F.length(F.element_at(F.split(head, "\n"), -1))
    two = F.array(at(zero, zero, row, column, "HEAD"), at(F.lit(1), zero, F.lit(1), zero, "SECOND "))
    more = F.instr(F.concat(F.lit("HEAD"), F.substring("text", 4, 1 << 30)), "\n") > 0
    edited = tx.apply_edits(F.col("text"), F.when(more, two).otherwise(F.slice(two, 1, 1)))
    return docs(spark, sf_dir).select("uri", _digest(edited))


@query
def changes_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(F.lit("M"), F.lit("A"), F.lit("D")), (F.col("doc_id") % 3 + 1).cast("int"))
    line = F.when(F.col("doc_id") % 5 == 4, F.lit("# a remark")).otherwise(F.concat(op, F.lit(' "'), "uri", F.lit('"')))
    return dc.change_lines(docs(spark, sf_dir).select(F.expr("doc_id div 100").alias("version"), line.alias("line")))


@query
def sample_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.sample_fragments(lines(spark, sf_dir), 20, 50, 40, "s")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return ids.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("version"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"))


@query
def minimized_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    return dc.minimized(v, v.where("doc_id % 7 = version AND version > 0")).select("version", "path")


@query
def reversed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).where("doc_id % 3 >= version").withColumn("was", F.col("version"))
    return dc.reversed_versions(v).select("version", "path", "was")


@query
def versions_with_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in which documents lose their first line."""
    d = docs(spark, sf_dir)
    first = fr.line_fragments(d).where("frag_id = 0").select("uri", "frag_id", F.lit(0).alias("start"), F.length("line").alias("end"))
    chosen = d.where("doc_id % 5 BETWEEN 1 AND 3").select((F.col("doc_id") % 5).cast("int").alias("version"), "uri", F.lit(0).alias("frag_id"))
    return files.versions_with_deletions(d.select("uri", "text"), first, chosen).select("version", "uri", F.length("text").cast("bigint").alias("n_chars"))


@query
def averaged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return reports.averaged(events.select((F.col("user_id") % 10).alias("place"), F.floor("value").alias("value"))).withColumn("mean", F.round("mean", 6))


@query
def run_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of values for each run, in order of their places."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = reports.timings_line(events.select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), F.floor("value").cast("bigint").alias("value")))
    return out.select("run", _digest(F.col("line")))


@query
def code_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods of a class that differ in names and literals only, found with names and literals blind."""
    code = (
        "class A {\n\n"
        "    public int first(int[] xs) {\n        int total = 0;\n        for (int x : xs) total += x;\n        return total;\n    }\n\n"
        "    public int another(int[] ys) {\n        int amount = 7;\n        for (int y : ys) amount += y;\n        return amount;\n    }\n}\n"
    )
    config = CloneConfig(fragment_query="(method_declaration) @method", clone_token_threshold=20, blind_nodes=("identifier", "type_identifier", "decimal_integer_literal"))
    found = detector.detect(spark.createDataFrame([("file:///src/A.java", code)], "uri string, text string"), config)
    return found.select("uri", "start_line", "start_char", "end_line", "end_char", (F.col("clone_size") + 1).alias("tokens"))


@query
def config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = '{"language": "py", "fragment_query": "(function_definition) @f", "clone_token_threshold": 50, "indexGitFilesOnly": false, "blind_nodes": ["identifier"], "other": 1}'
    found = json.loads(CloneConfig.from_json(given).to_json())
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(found.items())], "name string, value string")
