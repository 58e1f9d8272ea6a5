"""Clones kept up to date as documents come, change and go, equal to a rebuild after every batch.

The state is two tables: fragments (uri, frag_id, toks) and nodes (the clones). A batch replaces its documents' fragments.
Fragments that share a repeated seed share a repeated print, so what a batch can change lies in the fragments that prints link,
over any number of fragments, to one that it removes or adds. Their clones are found anew, among themselves; those of all
others stay. Where HOPS steps do not end the links, all fragments with a repeated print are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.functions.bitmaps import bitmap_cells, may_match
from reprise.operators.suffix import FRAGMENT_BITS, clones, fragment_key, repeated_prints
from reprise.storage import materialize

#: Steps from fragment to fragment, each a pass over the repeated prints.
HOPS = 3


@dataclass
class State:
    fragments: DataFrame
    nodes: DataFrame
    threshold: int

    def clones(self) -> DataFrame:
        return self.nodes


def build(fragments: DataFrame, threshold: int) -> State:
    fragments = fragments.select("uri", "frag_id", "toks")
    return State(fragments, materialize(clones(fragments, threshold), "nodes", release=True), threshold)


def linked(links: DataFrame, hops: int) -> DataFrame:
    """fragment of every one linked to a print with `hit`. links: fragment, h, hit."""
    reached = materialize(links.where("hit").select("fragment").distinct(), "reached")
    n = reached.count()
    for _ in range(hops):
        prints = links.join(reached, "fragment", "left_semi").select("h").distinct()
        reached = materialize(links.join(prints, "h", "left_semi").select("fragment").distinct(), "reached", release=True)
        before, n = n, reached.count()
        if n == before:
            return reached
    return links.select("fragment").distinct() if n else reached


def refresh(state: State, gone: DataFrame, come: DataFrame) -> State:
    """gone: the uris that are replaced or deleted; come: the fragments of those that are replaced or new."""
    come = come.select("uri", "frag_id", "toks")
    uris = gone.select("uri").unionByName(come.select("uri")).distinct()
    marked = state.fragments.join(uris.withColumn("dirty", F.lit(True)), "uri", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    links = materialize(repeated_prints(marked.unionByName(come.withColumn("dirty", F.lit(True))), state.threshold, "dirty"), "links", release=True)
    reached = linked(links, HOPS)
    fragments = state.fragments.join(uris, "uri", "left_anti").unionByName(come)
    # the bitmap lets others through; they share no print with the reached ones, and their clones are dropped behind
    anew = may_match(fragments.where(F.size("toks") >= state.threshold), fragment_key(), bitmap_cells(reached, F.col("fragment"), FRAGMENT_BITS), FRAGMENT_BITS)
    anew = clones(materialize(anew.withColumn("nr", F.monotonically_increasing_id()), "candidates", release=True), state.threshold)
    of = lambda nodes, how: nodes.withColumn("fragment", fragment_key()).join(reached, "fragment", how).drop("fragment")
    kept = of(state.nodes.join(uris, "uri", "left_anti"), "left_anti")
    return State(fragments, materialize(kept.unionByName(of(anew, "left_semi")), "nodes", release=True), state.threshold)
