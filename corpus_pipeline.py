"""A corpus pipeline of five stages; each is written and read again as the next one's documents.

The first four stages return the columns of `documents` for the rows that stay; the last one returns the
mix. Learned stages are fitted on what they are given, with the labels of the whole corpus.

Defined cases, of every stage unless it says otherwise: null, empty and wordless texts are judged like others by the first stage
and go in the second, as they have no letter; very long texts are judged whole; ties are those of the stage's operator; repeated
rows are judged each; a null doc_id is like any other, but is never learned from; an empty table gives an empty one; extra
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.llm import decontaminate, langid, mixing, neardup, quality_mil
from reprise.llm.common import bitmap_cells, materialize, may_match, table

#: Documents whose language has less than this score, or that have no letter, go.
MIN_LANGUAGE_SCORE = 0.5


#: Bits of the bitmaps that keep rows which are sure to stay out of a shuffle, as a power of two.
BITS = 25

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filtering(stage: Stage) -> Stage:
    """Other columns than the operators' inputs get names of their own for the stage, as theirs may clash with what it adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in ("doc_id", "text", "lang", "source") else f"extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


def without(keyed: DataFrame, goes: DataFrame) -> DataFrame:
    """The rows of keyed (doc_id, text_key) whose id and key are not in goes (of_id, of_key).

    What goes grows with the documents, so it is never broadcast; a bitmap of fixed size tells which rows need the join at all.
    """
    cells = bitmap_cells(goes, F.xxhash64("of_id", "of_key"), BITS)
    some = lambda whether: may_match(keyed, F.xxhash64("doc_id", "text_key"), cells, BITS, whether)
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    return some(False).unionByName(some(True).join(goes.hint("merge"), same, "left_anti"))


@filtering
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_mil.score(docs, model, docs.columns)
    return scored.where(F.col("score") >= quality_mil.THRESHOLD).select(*docs.columns)


@filtering
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a letter and those in no language that was learned well."""
    named = langid.predict(docs, langid.train(docs), docs.columns)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


@filtering
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: one with the smallest doc_id, and of its rows with equal ids and texts
    the first by the other columns. Documents without words have no near duplicates and stay."""
    classes = materialize(neardup.jaccard_classes(docs).where("grams > 0"), "classes")
    chosen = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_text"))
    ids = [F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")]
    per_row = classes.groupBy(*ids).agg(F.bool_and(chosen).alias("stays"), F.count(F.lit(1)).alias("rows"))
    # rows that go, and rows that repeat the chosen id and text, of which one stays
    special = materialize(per_row.where("NOT stays OR rows > 1"), "special")
    again = materialize(special.where("stays"), "again")
    keyed = docs.withColumn("text_key", neardup.text_key())
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    once = without(keyed, special.select("of_id", "of_key"))
    first = W.partitionBy("of_id", "of_key").orderBy(*[F.col(c) for c in docs.columns if c != "text"])
    repeated = may_match(keyed, F.xxhash64("doc_id", "text_key"), bitmap_cells(again, F.xxhash64("of_id", "of_key"), BITS), BITS).join(again, same).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns))


@filtering
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are contaminated by benchmark items."""
    keyed = docs.withColumn("text_key", neardup.text_key())
    judged = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), ["doc_id", "text_key"])
    goes = judged.where("contaminated").select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).distinct()
    goes = materialize(goes, "contaminated")
    return without(keyed, goes).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the documents that are left."""
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, weights).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Trained classifiers and sketches have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
