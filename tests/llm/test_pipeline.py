"""The pipeline's stages against what their operators say of the same rows."""

import corpus_pipeline as cp
import pytest
from data import awkward, bag, frame
from test_counting import ITEMS, brute_hits
from test_op2_neardup import brute, corpus

FOLDER = "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows, items=((1, "alpha beta"),), labels=()):
        frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(items), ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
        spark.createDataFrame(list(labels), LABELS).write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "language_id", "near_duplicates", "benchmark_decontamination", "source_mixing"]


def test_one_document_of_each_class_stays(spark, folder):
    rows = corpus(3, 40)
    rows.append(rows[1])
    d = folder(rows)
    docs = frame(spark, rows)
    kept = bag(cp.near_duplicates(spark, docs, d), "doc_id")
    classes = brute(rows)
    wordless = [r[0] for r in rows if not (r[1] or "").strip()]
    chosen = {c for i, c, _ in classes if i not in wordless}
    assert kept == sorted([(i,) for i in [*chosen, *wordless]], key=repr)


def test_contaminated_documents_go(spark, folder):
    items = [(1, "alpha beta"), (2, " ".join(f"t{i}" for i in range(20)))]
    rows = awkward() + [(900, "x " * 30 + items[1][1], "en", "a", 1), (901, "x " * 800 + items[1][1], "en", "a", 1)]
    d = folder(rows, items)
    got = bag(cp.benchmark_decontamination(spark, frame(spark, rows), d), "doc_id")
    left = [(h[0],) for h in brute_hits(rows, items) if not h[5]]
    assert got == sorted(left, key=repr)


def test_stages_on_awkward_and_empty_tables(spark, folder, tmp_path):
    rows = awkward()
    d = folder(rows, labels=[(i, i % 2, 0) for i in range(30)])
    for _, stage in cp.STAGES:
        for given in (rows, []):
            out = stage(spark, frame(spark, given, extra=True), d)
            assert out.count() <= len(given)
    assert cp.run(spark, d).count() <= len(rows)


def test_run_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = cp.quality_classifier(spark, docs, FOLDER)
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    out = cp.run(spark, FOLDER)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and 0 < out.count() < docs.count()
    assert out.select("doc_id").distinct().count() == out.count()
