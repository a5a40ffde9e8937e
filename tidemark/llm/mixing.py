"""Mixing sources to target weights along a curriculum that changes with time.

Every source has a weight schedule over the run, from 0 to 1: a line through evenly spaced knots. Its integral, scaled to the
source's target, is the cumulative demand for its words. The words of a source lie in hash order, pass after pass; a document whose
words begin at ``c`` gets the position where the cumulative demand reaches ``c``. Sorting by position gives the run.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``budget`` times all words; a target stops
at ``most`` times the source's words and the excess is shared anew by weight until none is above.

A document is taken whole or not at all in each pass: in the last pass, those that end below the target, and of all documents after
them, in order, each that still fits. If a gap is left, the least document not yet taken is added where that comes nearer to the target
without passing ``most`` times the source's words. So a source misses its target by at most half of its least document not taken, or,
at the ceiling, by less than that document. Documents of the last pass that are taken out of turn get the position of the words they stand for.

Defined results: a null or empty text has size 0 and takes nothing; equal rows are interchangeable; a null source is a source of
its own; no rows give no rows. Rerunning gives the same result on any layout, since the order is a hash of the row.

Running sums use two levels, slices of a source and rows of a slice, both about the square root of the rows, so a source that holds a
third of all rows spreads over many tasks. The table of sources itself is small (one row a source).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import WORD, whole
from tidemark.session import stored

WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2
#: Relative weight at evenly spaced times, by the same cycle as WEIGHTS: the heaviest sources lead, the lightest close the run.
SCHEDULES = ((1.5, 1.0, 0.5), (0.75, 1.5, 0.75), (0.5, 1.0, 1.5))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``origin, source, source_size`` to ``origin, source, source_size, rank, target``: shares by weight under a ceiling for each source."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ceiling = F.col("source_size") * float(most)
    # Sources reach their ceiling in the order of ceiling over weight; `level` is the words a unit of weight gets if all
    # sources before this one stand at their ceiling.
    filled = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    rows = (ranked.withColumn("weight", weight).withColumn("ratio", ceiling / weight)
            .withColumn("all_words", F.sum("source_size").over(everything) * float(budget))
            .withColumn("all_weight", F.sum("weight").over(everything))
            .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum(ceiling).over(filled), F.lit(0.0)))
            .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
            .withColumn("level", F.col("left_words") / F.col("left_weight")))
    open_level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return rows.withColumn("open", open_level).select(
        "origin", "source", "source_size", "rank",
        F.when(F.col("open").isNull(), ceiling).otherwise(F.least(ceiling, F.col("open") * weight)).alias("target"))


def position(share: Column, knots: Sequence[float]) -> Column:
    """Time at which a schedule through ``knots`` has used ``share`` of its integral."""
    width = 1 / (len(knots) - 1)
    areas = [(a + b) / 2 * width for a, b in zip(knots, knots[1:])]
    total, reached, out = sum(areas), sum(areas), F.lit(1.0)
    for i in reversed(range(len(areas))):
        a, slope = knots[i], (knots[i + 1] - knots[i]) / width
        reached -= areas[i]
        rest = F.greatest(share * total - reached, F.lit(0.0))
        # The area under a line: a*t + slope*t*t/2 = rest.
        t = rest / a if slope == 0 else 2 * rest / (a + F.sqrt(F.greatest(a * a + 2 * slope * rest, F.lit(0.0))))
        here = F.least(i * width + t, F.lit((i + 1) * width))
        out = here if i == len(areas) - 1 else F.when(share * total < reached + areas[i], here).otherwise(out)
    return out


def _begins(rows: DataFrame, starts: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the place of each row's first word on its source's line, and the columns of its source."""
    within = W.partitionBy("origin", "slice").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, ["origin", "slice"]).join(sources.drop("source"), "origin")
    # The target ends inside this pass; all passes before it are taken whole.
    return rows.withColumn("begin", F.col("slice_start") + F.col("inside")).withColumn(
        "last", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))


def _last_end(rows: DataFrame) -> Column:
    return F.col("begin") + F.col("size") + F.col("last") * F.col("source_size")


def _fillers(rows: DataFrame, most: float) -> DataFrame:
    """``origin, begin, place``: the documents that fill the gap between the last whole document and the target, and the words before each.

    In order, each remaining document that still fits is taken. A round takes the documents up to the first that does not fit; what fits
    the rest of the gap after that one is the next round. The rest is less than the document that did not fit, so in hash order it
    shrinks by a factor each round. Running sums use the slices of ``rows``.
    """
    goal = F.col("target") - F.col("last") * F.col("source_size")
    rest = stored(rows.where((F.col("size") > 0) & (_last_end(rows) > F.col("target"))).select(
        "origin", "slice", "begin", "size", goal.alias("goal"), (F.col("source_size") * float(most) - F.col("target")).alias("room")), "rest")
    gaps = rest.groupBy("origin").agg(
        F.min("begin").alias("through"), (F.first("goal") - F.min("begin")).alias("free"), F.first("goal").alias("goal"), F.first("room").alias("room"))
    gaps = first = stored(gaps.where("free > 0"), "gaps")
    rest = rest.drop("goal", "room")
    before = W.partitionBy("origin").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("origin", "slice").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    fill = rest.select("origin", "begin", "size", F.lit(0.0).alias("place")).where(F.lit(False))
    while not gaps.isEmpty():
        fit = rest.join(gaps.select("origin", "through", "free", "goal"), "origin").where((F.col("size") <= F.col("free")) & (F.col("begin") > F.col("through")))
        heads = fit.groupBy("origin", "slice").agg(F.sum("size").alias("words"), F.first("free").alias("limit"))
        heads = heads.withColumn("head", F.coalesce(F.sum("words").over(before), F.lit(0))).where(F.col("head") < F.col("limit"))
        heads = stored(heads.select("origin", "slice", "head"), "heads")
        step = fit.join(heads, ["origin", "slice"]).withColumn("head", F.col("head") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        step = stored(step.select("origin", "begin", "size", "free", "goal", (F.col("head") + F.col("size") <= F.col("free")).alias("fits"),
                                  (F.col("goal") - F.col("free") + F.col("head")).alias("place")), "fill")
        fill = fill.unionByName(step.where("fits").select("origin", "begin", "size", "place"))
        gaps = stored(step.groupBy("origin").agg(
            F.min(F.when(~F.col("fits"), F.col("begin"))).alias("through"), F.first("goal").alias("goal"),
            (F.first("free") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("free")).where("through IS NOT NULL AND free > 0"), "gaps")
    # What is left of each gap, and the least document that could close it.
    filled = fill.groupBy("origin").agg(F.sum("size").alias("filled"))
    left = first.join(filled, "origin", "left").withColumn("free", F.col("free") - F.coalesce("filled", F.lit(0))).where("free > 0")
    least = (rest.join(left.select("origin"), "origin", "left_semi").join(fill.select("origin", "begin"), ["origin", "begin"], "left_anti")
             .groupBy("origin").agg(F.min(F.struct("size", "begin")).alias("least")))
    over = F.col("least.size") - F.col("free")
    closing = left.join(least, "origin").where((over < F.col("free")) & (over <= F.col("room")))
    closing = closing.select("origin", "least.begin", (F.col("goal") - F.col("free")).alias("place"))
    return stored(fill.select("origin", "begin", "place").unionByName(closing), "fillers")


def placed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES,
           budget: float = BUDGET, most: float = MOST, keep: Sequence[str] | None = None) -> DataFrame:
    """Each document as ``row`` with ``size, source_size, target`` and ``takes``: the positions at which it is taken.

    ``row`` holds the columns ``keep``, or all; only these are shuffled.
    """
    key = F.xxhash64(F.lit(17), docs["doc_id"], docs["text"], docs["source"])
    # A name of the source that is never null, so that joins and windows on it share one partitioning.
    origin = F.when(docs["source"].isNull(), "-").otherwise(F.concat(F.lit("+"), docs["source"])).alias("origin")
    row = whole(docs) if keep is None else F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row")
    sized = docs.select(row, docs["source"].alias("source"), origin, size_of(docs["text"]).alias("size"), key.alias("key"))
    narrow = stored(sized.drop("row"), "sizes")
    # The number of slices is a statistic of all rows: about the square root of their number.
    bits = max(1, math.ceil(math.log2(max(1, narrow.count())) / 2))
    slice_of = F.shiftrightunsigned("key", 64 - bits)
    narrow, sized = narrow.withColumn("slice", slice_of), sized.withColumn("slice", slice_of)
    # Written, so that the joins know their sizes: they are sent around only while they are small.
    slices = stored(narrow.groupBy("origin", "source", "slice").agg(F.sum("size").alias("words")), "slices")
    sources = targets(slices.groupBy("origin", "source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    sources = stored(sources, "targets")
    ordered = W.partitionBy("origin").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(slices.select("origin", "slice", F.coalesce(F.sum("words").over(ordered), F.lit(0)).alias("slice_start")), "starts")
    fill = _fillers(_begins(narrow, starts, sources), most)
    rows = _begins(sized, starts, sources).join(fill, ["origin", "begin"], "left")
    # An empty document begins where the next one does.
    filling = F.col("place").isNotNull() & (F.col("size") > 0)
    begin = lambda p: F.when(filling & (F.col("last") == p), F.col("place")).otherwise(F.col("begin"))
    passes = F.array(*[F.struct(F.lit(p).alias("p"), (begin(p) + F.col("source_size") * p).alias("c")) for p in range(math.ceil(most))])
    taken = F.filter(passes, lambda x: (F.col("size") > 0) & (
        (x["c"] + F.col("size") <= F.col("target")) | ((x["p"] == F.col("last")) & filling)))
    pick = (F.col("rank") % len(schedules)).cast("int")

    def when(x: Column) -> Column:
        share = F.least(x["c"] / F.col("target"), F.lit(1.0))
        out = position(share, schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            out = F.when(pick == i, position(share, knots)).otherwise(out)
        return out

    return rows.select("row", "key", "size", "source_size", "target", F.transform(taken, when).alias("takes"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The training order: each document once for each time it is taken, range-sorted by position, columns unchanged."""
    rows = placed(docs, **how).select("row", "key", F.explode("takes").alias("position"))
    return rows.orderBy("position", "key").select("row.*")
