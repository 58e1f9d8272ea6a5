"""Plans: what the scans read and which joins there are."""

import re

import pytest

from reprise import registry

FOLDER = "/root/testdata/sf0.001"
#: Queries that join tables of one row each.
ONE_ROW = {"clone_summary"}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_pair_is_made_without_a_key(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    if name not in ONE_ROW:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name, columns", [("tokenize", {"doc_id", "text", "source"}), ("edit_trim", {"conv_id", "turn", "text"}), ("averaged_results", {"user_id", "value"}), ("minimized_versions", {"doc_id"})])
def test_scans_read_what_is_asked_for(spark, name, columns):
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan(registry.queries()[name](spark, FOLDER))):
        assert {c.split(":")[0] for c in schema.split(",") if c} <= columns


def test_filters_reach_the_scan(spark):
    df = registry.queries()["scan_documents"](spark, FOLDER)
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan(df)
    fit = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id > 5").select("doc_id")
    assert "GreaterThan(doc_id,5)" in plan(fit)


def test_clones_sort_by_seed_and_fragment_only(spark):
    """One shuffle for each key that rows meet on; none to a single partition."""
    assert "SinglePartition" not in plan(registry.queries()["clone_classes"](spark, FOLDER))


def test_cells_of_positions_are_not_broadcast(spark):
    """By the size of the corpus's file, which is small, they would be."""
    text = plan(registry.queries()["pos_to_source"](spark, FOLDER))
    assert re.search(r"SortMergeJoin \[cell", text) and not re.search(r"BroadcastHashJoin \[cell", text)
