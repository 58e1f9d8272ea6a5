"""Maximal repeated token runs, without a global suffix array.

Two neighbours in suffix order that share `threshold` tokens have the same first `threshold` tokens (the
seed), so sorting within each seed finds the same neighbours as sorting all suffixes. Four steps keep the
rows few before suffixes are made:

1. Prints: of the windows of hashes that make up a seed only the smallest is kept, about two for each
   `threshold` / 2 tokens. A seed that occurs twice has a print that occurs twice, so fragments without
   such a print go (a bitmap of fixed size says which; what it lets through too, the next step drops).
2. Seeds of what is left are hashed and counted; seeds that occur once go.
3. If all places of a seed go on with the same next seed, and that has no other places, the places of both are
   in the same order. So only the last seed of such a chain is sorted, and the chain is one row.
4. Places that share the token behind a chain are in the same next chain, and share all up to its end. So of a
   suffix only the tokens behind its chains are compared, as ranks among those behind the same chain (branches), up to
   the end of its run of repeated seeds, one past which no common prefix can pass: first a fixed number of
   branches, then ranks of what follows (`_ranks`). How much neighbours share is compared only where it does not
   follow from the chain before (`_ends`).

A fragments table has uri, frag_id, toks (an array of strings, or of anything that can be ordered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reprise.functions import rolling
from reprise.functions.bitmaps import bitmap_cells, may_match
from reprise.functions.text import common_prefix, let
from reprise.storage import discard, materialize

KEY = ("seed_hi", "seed_lo")
PLACE = ("uri", "frag_id", "off")
#: Bits (log2) of the bitmap of fragments with a repeated print: 8 MB.
FRAGMENT_BITS = 26
#: Of the second hash of a seed 24 bits tell seeds apart (88 with the first hash); 40 of the next seed's tell whether it is the same.
NEXT_BITS = 40
#: Branches, or ranks of what follows them, that are compared in a round.
STEPS = 32


def _hashes(toks: Column) -> Column:
    """A hash of each token: what follows hashes runs of these, not of texts."""
    return F.transform(toks, lambda t: F.xxhash64(t))


def fragment_key() -> Column:
    return F.xxhash64("uri", "frag_id")


def repeated_prints(fragments: DataFrame, threshold: int, mark: str | None = None) -> DataFrame:
    """fragment, h of each print that occurs twice, and hit: whether a fragment with it has the boolean column `mark`."""
    marks = [F.col(mark).alias("hit")] if mark else []
    # the size is not asked for here: a filter would make the tokens once more
    hashed = fragments.select(fragment_key().alias("fragment"), *marks, _hashes(F.col("toks")).alias("hashes"))
    keep = [c for c in hashed.columns if c != "hashes"]
    prints = hashed.mapInArrow(rolling.prints(threshold, keep), f"fragment bigint, {'hit boolean, ' if mark else ''}h bigint")
    same = W.partitionBy("h")
    twice = prints.withColumn("n", F.count(F.lit(1)).over(same))
    return (twice.withColumn("hit", F.max("hit").over(same)) if mark else twice).where("n > 1").drop("n")


def candidates(fragments: DataFrame, threshold: int) -> DataFrame:
    """The fragments that may have a print which occurs twice, and all that have one."""
    return may_match(fragments, fragment_key(), bitmap_cells(repeated_prints(fragments, threshold), F.col("fragment"), FRAGMENT_BITS), FRAGMENT_BITS)


def prepared(fragments: DataFrame, threshold: int) -> DataFrame:
    """The candidates with a number each (nr), written once: what follows reads them, not all fragments."""
    return materialize(candidates(fragments, threshold).withColumn("nr", F.monotonically_increasing_id()), "candidates", release=True)


def _pairs_of_hashes(toks: Column) -> Column:
    """128 bits of each token."""
    return F.transform(toks, lambda t: F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("token"), t).alias("b")))


def _key(hashes: Column, off: Column, threshold: int) -> Column:
    seed = F.slice(hashes, off + 1, threshold)
    return F.struct(off.alias("off"), F.xxhash64(seed).alias("hi"), F.xxhash64(F.lit("seed"), seed).alias("lo"))


def seeds(fragments: DataFrame, threshold: int) -> DataFrame:
    """uri, frag_id, off, seed_hi, seed_lo of every seed."""
    long, toks = fragments.where(F.size("toks") >= threshold), F.col("toks")
    offs = F.sequence(F.lit(0), F.size(toks) - threshold)
    keyed = let(_pairs_of_hashes(toks), lambda t: F.transform(offs, lambda i: _key(t, i, threshold)))
    return long.select("uri", "frag_id", F.explode(keyed).alias("s")).select(
        "uri", "frag_id", "s.off", F.col("s.hi").alias("seed_hi"), F.col("s.lo").alias("seed_lo")
    )


def _chains(ready: DataFrame, threshold: int) -> DataFrame:
    """nr, chains of `prepared` fragments: off and last of each chain of repeated seeds, and reach, where its run of repeated seeds ends.

    A chain goes on while all places of a seed have the same next seed, which has as many places.
    """
    hashes = _pairs_of_hashes(F.col("toks"))
    same_tokens = let(hashes, lambda t: F.struct(F.xxhash64(F.transform(t, lambda x: x["a"])).alias("a"), F.xxhash64(F.transform(t, lambda x: x["b"])).alias("b")))
    whole = ready.where(F.size("toks") >= threshold).select("nr", "toks", same_tokens.alias("whole")).select("nr", "toks", "whole.*")
    # of copies one stands for all, so a seed's places are the sum of theirs
    folded = whole.groupBy("a", "b").agg(F.min("nr").alias("nr"), F.count(F.lit(1)).alias("copies"), F.first("toks").alias("toks"))
    folded = materialize(folded, "folded", release=True)
    pairs = folded.select("nr", "copies", hashes.alias("t")).select("nr", "copies", F.col("t.a").alias("first"), F.col("t.b").alias("second"))
    places = pairs.mapInArrow(rolling.seeds(threshold, ["nr", "copies"], NEXT_BITS), "nr bigint, copies bigint, off int, hi bigint, more bigint")
    following = F.col("more").bitwiseAND(F.lit((1 << NEXT_BITS) - 1))
    same = W.partitionBy("hi", F.shiftrightunsigned("more", NEXT_BITS))
    least, most = F.min(following).over(same), F.max(following).over(same)
    # how many places the seed has; below 0 where they do not all go on alike
    counted = places.select("nr", "off", F.sum("copies").over(same).alias("n"), (least.eqNullSafe(most) & (least != 0)).alias("alike"))
    counted = counted.where("n > 1").select("nr", "off", F.when(F.col("alike"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    back = W.partitionBy("nr").orderBy(F.col("off").desc())
    so_far = back.rowsBetween(W.unboundedPreceding, 0)
    adjacent = F.coalesce(F.lag("off").over(back) == F.col("off") + 1, F.lit(False))
    goes_on = adjacent & F.coalesce(F.abs(F.lag("n").over(back)) == F.col("n"), F.lit(False))
    ends = counted.select("nr", "off", adjacent.alias("adjacent"), goes_on.alias("goes_on")).select(
        "nr", "off",
        F.last(F.when(~F.col("goes_on"), F.col("off")), True).over(so_far).alias("last"),
        F.last(F.when(~F.col("adjacent"), F.col("off")), True).over(so_far).alias("reach"),
    )
    chains = ends.groupBy("nr", "last").agg(F.min("off").alias("off"), F.max("reach").alias("reach"))
    chains = chains.groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("off", "last", "reach"))).alias("chains"))
    chains = chains.join(folded.select("nr", "a", "b"), "nr").drop("nr")
    chains = materialize(whole.select("nr", "a", "b").join(chains, ["a", "b"]).select("nr", "chains"), "chains", release=True)
    discard(folded)
    return chains


def _runs(ready: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The runs of repeated seeds, and the fragments they are in.

    Runs: at, reach, links (off, last, seed and branch of its chains, in order); a branch is the rank of the token behind a chain
    among those behind the same chain. Fragments: nr, at, uri, frag_id; at has the order of uri and frag_id.
    """
    chains = _chains(ready, threshold)
    order = ready.select("nr", "uri", "frag_id").join(chains.select("nr"), "nr", "left_semi").orderBy("uri", "frag_id")
    order = materialize(order.withColumn("at", F.monotonically_increasing_id()), "order", release=True)
    # arrays do not go through a generator, which holds them once for each row it makes of a fragment

    def end(hashes: Column, x: Column) -> Column:
        key = _key(hashes, x["last"], threshold)
        behind = F.get("toks", x["last"] + threshold)
        return F.struct(*[x[c].alias(c) for c in ("off", "last", "reach")], key["hi"].alias("seed_hi"), key["lo"].alias("seed_lo"), behind.alias("behind"))

    ends = let(_pairs_of_hashes(F.col("toks")), lambda h: F.transform("chains", lambda x: end(h, x)))
    ends = ready.select("nr", "toks").join(chains, "nr").select("nr", F.inline(ends))
    # no token, the least, ends a suffix
    branch = F.dense_rank().over(W.partitionBy(*KEY).orderBy(F.col("behind").asc_nulls_first()))
    links = ends.select("nr", "reach", F.struct("off", "last", *KEY, branch.alias("branch")).alias("link")).groupBy("nr", "reach")
    runs = links.agg(F.array_sort(F.collect_list("link")).alias("links")).join(order.select("nr", "at"), "nr").drop("nr")
    runs = materialize(runs, "runs", release=True)
    discard(chains)
    return runs, order


def _ranks(runs: DataFrame) -> DataFrame:
    """at, reach, i (its place in the run), off, last, seed and r of every chain: how many chains of the seed have a lesser suffix, and 1.

    A suffix is compared by its next STEPS branches, then, where these are equal and it goes on, by the ranks of what
    follows them STEPS by STEPS, and so on with STEPS times as many: a run of n chains makes STEPS * n numbers in each
    of log(n) rounds, and not n * n.
    """

    def first(b: Column, x: Column, i: Column) -> Column:
        left = F.size("links") - i
        return F.struct(i.alias("i"), *[x[c].alias(c) for c in ("off", "last", *KEY)], F.lit(1).alias("r"), left.alias("left"), F.slice(b, i + 1, STEPS).alias("suf"))

    def later(r: Column, x: Column, step: int) -> Column:
        further = F.sequence(F.lit(1), F.least(F.lit(STEPS - 1), F.floor((x["left"] - 1) / step).cast("int")))
        suf = F.transform(further, lambda j: F.get(r, x["i"] + j * step))
        return F.struct(*[x[c].alias(c) for c in ("i", "off", "last", *KEY, "r", "left")], suf.alias("suf"))

    each = let(F.transform("links", lambda x: x["branch"]), lambda b: F.transform("links", lambda x, i: first(b, x, i)))
    each = runs.select("at", "reach", F.inline(each))
    step, state = STEPS, materialize(_refined(each, STEPS), "ranks", release=True)
    while state.where("open").limit(1).count():
        in_run = F.array_sort(F.collect_list(F.struct("i", "off", "last", *KEY, "r", "left", "open"))).alias("c")
        held = state.groupBy("at", "reach").agg(in_run, F.max("open").alias("any")).where("any")
        rest = let(F.transform("c", lambda x: x["r"]), lambda r: F.transform(F.filter("c", lambda x: x["open"]), lambda x: later(r, x, step)))  # noqa: B023
        held = held.select("at", "reach", F.inline(rest))
        step *= STEPS
        again = _refined(held, step)
        before, state = state, materialize(state.where("NOT open").unionByName(again), "ranks", release=True)
        discard(before)
    return state.drop("left", "open")


def _refined(ranks: DataFrame, step: int) -> DataFrame:
    """Chains of one rank ranked by suf; open: whether others still have its rank and its suffix goes on behind `step` branches."""
    order = W.partitionBy(*KEY, "r").orderBy("suf")
    out = ranks.withColumn("_more", F.rank().over(order) - 1).withColumn("_peers", F.count(F.lit(1)).over(order.rangeBetween(W.currentRow, W.currentRow)))
    out = out.withColumn("r", F.col("r") + F.col("_more")).withColumn("open", (F.col("_peers") > 1) & (F.col("left") > step))
    return out.drop("suf", "_more", "_peers")


def _ends(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """at, reach, i and end: the last place that the chain and the one before it in rank (p_at, p_reach, p_i) have in common."""
    held = runs.select("at", "reach", F.transform("links", lambda x: x["branch"]).alias("b"), F.transform("links", lambda x: x["last"]).alias("lasts"))
    other = held.select(F.col("at").alias("p_at"), F.col("reach").alias("p_reach"), F.col("b").alias("p_b"))
    width, found, left = STEPS, [], pairs.withColumn("d", F.lit(0))
    while True:
        part = lambda b, i: F.slice(b, F.col(i) + F.col("d") + 1, width)  # noqa: B023, E731
        one = left.join(held, ["at", "reach"]).select(*left.columns, part("b", "i").alias("suf"), F.slice("lasts", F.col("i") + F.col("d") + 1, width + 1).alias("lasts"))
        both = one.join(other, ["p_at", "p_reach"]).withColumn("p_suf", part("p_b", "p_i")).withColumn("same", common_prefix(F.col("suf"), F.col("p_suf")))
        # of suffixes that are equal to their ends the last chain has no token behind it
        end = F.get("lasts", F.least(F.col("same"), F.size("lasts") - 1))
        goes_on = (F.col("same") == width) & (F.size("lasts") > width)
        both = both.select(*left.columns, end.alias("end"), goes_on.alias("goes_on"), "same")
        both = materialize(both, "ends", release=True)
        found.append(both.where("NOT goes_on").select("at", "reach", "i", "end"))
        left = both.where("goes_on").select(*pairs.columns, (F.col("d") + F.col("same")).alias("d"))
        if not left.limit(1).count():
            out = found[0]
            for f in found[1:]:
                out = out.unionByName(f)
            return out
        width *= 8


def _sorted(fragments: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `chained` with at for uri and frag_id, and p_at and p_off for prev; and the fragments of `_runs`."""
    ready = fragments if "nr" in fragments.columns else prepared(fragments, threshold)
    runs, order = _runs(ready, threshold)
    if "nr" not in fragments.columns:
        discard(ready)
    ranks = _ranks(runs)
    by_rank = W.partitionBy(*KEY).orderBy("r", "at", "last")
    before = F.lag(F.struct("at", "reach", "i", "last")).over(by_rank)
    ranks = ranks.withColumn("rk", F.row_number().over(by_rank)).withColumn("p", before).drop("r")
    in_run = W.partitionBy("at", "reach").orderBy("i")
    was = F.lag("p").over(in_run)
    # where the chain before goes on to this one, and its neighbour to this one's neighbour, both have the same end in common
    alike = (was["at"] == F.col("p.at")) & (was["reach"] == F.col("p.reach")) & (was["i"] + 1 == F.col("p.i"))
    ranks = materialize(ranks.withColumn("first", F.col("p").isNotNull() & ~F.coalesce(alike, F.lit(False))), "order_of_ranks", release=True)
    pairs = ranks.where("first").select("at", "reach", "i", F.col("p.at").alias("p_at"), F.col("p.reach").alias("p_reach"), F.col("p.i").alias("p_i"))
    out = ranks.join(_ends(pairs, runs), ["at", "reach", "i"], "left")
    end = F.last("end", True).over(in_run.rowsBetween(W.unboundedPreceding, 0))
    more = F.col("last") - F.col("off")
    lcp = F.when(F.col("p").isNotNull(), end - F.col("off") + threshold).cast("int")
    out = out.select("at", "off", *KEY, "rk", lcp.alias("lcp"), F.col("p.at").alias("p_at"), (F.col("p.last") - more).alias("p_off"), more.alias("more"))
    out = materialize(out, "neighbours", release=True)
    discard(runs)
    discard(ranks)
    return out, order


def chained(fragments: DataFrame, threshold: int, prev: bool = True) -> DataFrame:
    """The neighbours of all repeated seeds, a row for each chain of places that are in one order.

    off, lcp and prev are those of the chain's first place; `more` places follow it with one token less of lcp
    each. The seed is that of its last place. Without `prev` that column is left out.
    """
    out, order = _sorted(fragments, threshold)
    out = out.join(order.select("at", "uri", "frag_id"), "at")
    if not prev:
        return out.select(*PLACE, *KEY, "rk", "lcp", "more")
    other = order.select(F.col("at").alias("p_at"), F.col("uri").alias("p_uri"), F.col("frag_id").alias("p_frag_id"))
    place = F.when(F.col("p_at").isNotNull(), F.struct(F.col("p_uri").alias("uri"), F.col("p_frag_id").alias("frag_id"), F.col("p_off").alias("off")))
    return out.join(other, "p_at", "left").select(*PLACE, *KEY, "rk", "lcp", place.alias("prev"), "more")


def places(chains: DataFrame) -> DataFrame:
    """uri, frag_id, off, rk, lcp, prev of every place of `chained`."""
    each = chains.select("*", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("_at"))
    return each.select(
        "uri", "frag_id", (F.col("off") + F.col("_at")).alias("off"), "rk", (F.col("lcp") - F.col("_at")).alias("lcp"),
        F.col("prev").withField("off", F.col("prev.off") + F.col("_at")).alias("prev"),
    )


def repeated_seeds(all_seeds: DataFrame) -> DataFrame:
    again = all_seeds.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return all_seeds.join(again, list(KEY), "left_semi")


def suffixes(repeated: DataFrame, fragments: DataFrame, threshold: int) -> DataFrame:
    """Adds suf: the tokens from off to one past what any repeat can reach.

    With a boolean column `new`, rows where it is false only show how far runs of repeats go.
    """
    in_fragment = W.partitionBy("uri", "frag_id").orderBy("off")
    run = W.partitionBy("uri", "frag_id", "run")
    ends = repeated.withColumn("run", F.col("off") - F.row_number().over(in_fragment)).withColumn("last", F.max("off").over(run))
    if "new" in repeated.columns:
        ends = ends.where("new")
    return ends.join(fragments.select("uri", "frag_id", "toks"), ["uri", "frag_id"]).select(
        *PLACE, *KEY, F.slice("toks", F.col("off") + 1, F.col("last") - F.col("off") + threshold + 1).alias("suf")
    )


def neighbours(with_suffixes: DataFrame) -> DataFrame:
    """uri, frag_id, off, seed, rk (rank in the seed), lcp with the suffix before (null for the first)
    and prev (that suffix's place)."""
    order = W.partitionBy(*KEY).orderBy("suf", *PLACE)
    before = F.lag("suf").over(order)
    out = with_suffixes.withColumn("before", before).withColumn("rk", F.row_number().over(order)).withColumn("prev", F.lag(F.struct(*PLACE)).over(order))
    differ = F.array_position(F.zip_with("suf", "before", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    lcp = F.when(F.col("before").isNotNull(), F.when(differ > 0, differ - 1).otherwise(F.least(F.size("suf"), F.size("before"))))
    return out.select(*PLACE, *KEY, "rk", lcp.cast("int").alias("lcp"), "prev", *[c for c in out.columns if c in ("more", "steps")])


def emitted(ranked: DataFrame) -> DataFrame:
    """Adds emitted: whether the match is not contained in the one that starts a token earlier.

    Of a chain only the first place can be emitted, as all others' matches are contained in the one before.
    """
    order = W.partitionBy("uri", "frag_id").orderBy("off")
    more = F.col("more") if "more" in ranked.columns else F.lit(0)
    follows = F.coalesce(F.lag(F.col("off") + more).over(order) == F.col("off") - 1, F.lit(False))
    contained = follows & F.coalesce(F.lag(F.col("lcp") - more).over(order) > F.col("lcp"), F.lit(False))
    return ranked.withColumn("emitted", F.col("lcp").isNotNull() & ~contained)


def nodes(marked: DataFrame) -> DataFrame:
    """uri, frag_id, off, clone_size (tokens less one) and class_id of every clone.

    A class is a run of ranks that emitted matches link; its id is its first place as text.
    """
    order = W.partitionBy(*KEY).orderBy("rk")
    own = F.when(F.col("emitted"), F.col("lcp"))
    runs = (
        marked.withColumn("island", F.sum(F.when(F.col("emitted"), 0).otherwise(1)).over(order))
        .withColumn("longest", F.greatest(own, F.lead(own).over(order)))
        .where("longest IS NOT NULL")
    )
    first = F.min(F.struct(*PLACE)).over(W.partitionBy(*KEY, "island"))
    return runs.withColumn("first", first).select(
        *PLACE, (F.col("longest") - 1).alias("clone_size"), F.concat_ws("#", "first.uri", "first.frag_id", "first.off").alias("class_id")
    )


def ranked(fragments: DataFrame, threshold: int, prune: bool = True) -> DataFrame:
    """Neighbours of all repeated seeds, with the seed of each; fragments may be `prepared` already."""
    if not prune:
        return neighbours(suffixes(repeated_seeds(seeds(fragments, threshold)), fragments, threshold))
    ready = fragments if "nr" in fragments.columns else prepared(fragments, threshold)
    return places(chained(ready, threshold)).join(seeds(ready, threshold), list(PLACE)).select(*PLACE, *KEY, "rk", "lcp", "prev")


def clones(fragments: DataFrame, threshold: int) -> DataFrame:
    """The clones of a fragments table: uri, frag_id, off, clone_size, class_id."""
    return nodes(emitted(chained(fragments, threshold, prev=False)))


def edges(marked: DataFrame) -> DataFrame:
    """Each emitted match and the place it matches."""
    return marked.where("emitted").select(
        *PLACE, "lcp", F.col("prev.uri").alias("prev_uri"), F.col("prev.frag_id").alias("prev_frag_id"), F.col("prev.off").alias("prev_off")
    )


def matches(clone_nodes: DataFrame) -> DataFrame:
    """Every ordered pair of different clones of a class, the second one's columns with `match_` in front."""
    other = clone_nodes.select("class_id", *[F.col(c).alias(f"match_{c}") for c in clone_nodes.columns if c != "class_id"])
    same = F.lit(True)
    for c in PLACE:
        same = same & (F.col(c) == F.col(f"match_{c}"))
    return clone_nodes.join(other, "class_id").where(~same)


def repeated_ngrams(fragments: DataFrame, size: int) -> DataFrame:
    """Every n-gram that occurs twice or more: gram (its tokens joined by a blank) and n."""
    grams = let(F.col("toks"), lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, size), " ")))
    return fragments.where(F.size("toks") >= size).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
