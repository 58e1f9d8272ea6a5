"""Clone detection from documents to ranges. Clones are written once, as reports read them several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reprise.config import CloneConfig
from reprise.operators import fragments as fr
from reprise.operators import suffix
from reprise.sources import files
from reprise.storage import materialize


def prepared(documents: DataFrame, config: CloneConfig) -> DataFrame:
    """The fragments of code documents (uri, text) with what clones compare in toks."""
    found = fr.outermost(files.code_fragments(documents, config))
    return fr.token_values(found, config.ignore_nodes, config.extra_nodes, config.blind_nodes)


def detect(documents: DataFrame, config: CloneConfig) -> DataFrame:
    """uri, frag_id, off, clone_size, class_id, start_line, start_char, end_line, end_char of every clone."""
    ready = prepared(documents, config)
    return materialize(fr.code_ranges(suffix.clones(ready, config.clone_token_threshold), ready), "clones")


def detect_lines(documents: DataFrame, threshold: int, text: str = "text") -> DataFrame:
    """The same for prose: fragments are lines, tokens are words."""
    lines = suffix.prepared(fr.line_fragments(documents, text), threshold)  # with their texts: all clones are in these
    return materialize(fr.line_ranges(suffix.clones(lines, threshold), lines), "clones")


def detect_folder(spark: SparkSession, root: str, config: CloneConfig) -> DataFrame:
    return detect(files.scan(spark, root, config), config)
