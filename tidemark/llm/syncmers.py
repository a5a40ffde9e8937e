"""Document fingerprints from closed syncmers.

A text is a sequence of pieces: its words, cut after every ``PIECE`` code points. Of every ``k`` consecutive pieces the ``k - s + 1``
inner runs of ``s`` pieces are hashed; the k-mer is a closed syncmer if the least of these hashes is the first or the last. Whether a
k-mer is chosen depends on itself only, so equal passages give equal anchors at equal distances wherever they stand, and of any
``k - s + 1`` consecutive k-mers at least one is chosen.

All anchors of the whole text are kept with their positions. Two texts are matched by ``links``: an anchor, the
distance to the next one and that one, so that a match means two anchors at the same offset between both texts, wherever the passage
stands. The fingerprint is the list of all links in the order of the text, written as 16 hex digits each; the likeness of two
fingerprints is the exact Jaccard index of their distinct links, so that equal fingerprints have likeness 1.

Beside it, a digest lists the ``SKETCH`` least distinct hashes of the anchors; the ``likeness`` of two digests estimates the Jaccard index
of the hashes alone (exactly, if there are no more).

Defined results: a null text is the empty one; a text without a word has the empty fingerprint, and two empty ones have likeness 1; a text
without anchors, being shorter than ``k`` pieces, has the hash of its pieces as its only anchor; null ids come last in the order of
documents; ties of ids are ordered by text; an only document is followed by itself.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import let

PIECE, K, S, SKETCH = 4, 6, 2, 64


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """``at`` (number of the first piece) and ``hash`` of every closed syncmer of a text; ``k`` is a multiple of ``s``."""
    width = k - s + 1

    def chosen(inner: Column) -> Column:
        def closed(i: Column) -> Column:
            low = F.least(*[F.get(inner, i + j) for j in range(width)])
            return (F.get(inner, i) == low) | (F.get(inner, i + width - 1) == low)

        def anchor(i: Column) -> Column:
            return F.struct(i.alias("at"), F.xxhash64(*[F.get(inner, i + j) for j in range(0, k, s)]).alias("hash"))

        starts = F.when(F.size(inner) >= width, F.sequence(F.lit(0), F.size(inner) - width))
        return F.transform(F.filter(starts, closed), anchor)

    def of_pieces(pieces: Column) -> Column:
        runs = F.when(F.size(pieces) >= s, F.sequence(F.lit(0), F.size(pieces) - s))
        inner = F.transform(runs, lambda i: F.xxhash64(*[F.get(pieces, i + j) for j in range(s)]))
        own = F.when(F.size(pieces) > 0, F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(pieces).alias("hash"))))
        return let(let(inner, chosen), lambda a: F.when(F.size(a) > 0, a).otherwise(own))

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    return F.coalesce(let(pieces, of_pieces), F.lit([]).cast("array<struct<at:int,hash:bigint>>"))


def digest(found: Column, size: int = SKETCH) -> Column:
    """The ``size`` least distinct hashes of anchors."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda a: a["hash"]))), 1, size)


def links(found: Column) -> Column:
    """For each anchor a hash of it, the distance to the next one and that one; for the last, of it alone."""
    def link(a: Column, i: Column) -> Column:
        after = F.get(found, i + 1)
        return F.xxhash64(a["hash"], after["at"] - a["at"], after["hash"])

    return F.transform(found, link)


def shared(a: Column, b: Column) -> Column:
    """Share of common links among all distinct links of two fingerprints; 1 for two empty ones."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def agreement(left: Column, right: Column) -> Column:
    """``shared`` of two lists of anchors."""
    return let(F.struct(links(left).alias("a"), links(right).alias("b")), lambda both: shared(both["a"], both["b"]))


def likeness(left: Column, right: Column, size: int = SKETCH) -> Column:
    """Share of common hashes among the least hashes of both sketches; 1 for two empty ones."""
    least = F.slice(F.sort_array(F.array_union(left, right)), 1, size)
    both = F.size(F.array_intersect(F.array_intersect(least, left), right))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def written(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``derive(docs)`` with ``next``: a struct of ``columns`` of the document of the next id (after the last, the first).

    The ids are cut into slices at quantiles, and each slice also gets the first row of the slice after it. One shuffle of the rows, before
    ``derive``, which keeps their order.
    """
    spark = docs.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / wanted for i in range(1, wanted)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 50 * wanted)).first()[0] or []
    bounds = sorted(set(bounds))
    steps = [1 << b for b in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]

    def slice_of(doc_id: Column) -> Column:
        """Number of bounds up to the id, by bisection."""
        if not bounds:
            return F.when(doc_id.isNull(), 1).otherwise(0)
        edges = F.lit(bounds).cast("array<bigint>")
        at = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda a, step: F.when(
            F.get(edges, a + step - 1) <= doc_id, a + step).otherwise(a))
        return F.when(doc_id.isNull(), len(bounds) + 1).otherwise(at)

    rows = docs.select("*", slice_of(docs["doc_id"]).alias("slice"), F.lit(False).alias("guest"))
    # One row a slice: its least id, and the slice before it, whose last row it follows.
    heads = rows.groupBy("slice").agg(F.min("doc_id").alias("head"))
    order = W.orderBy("slice")
    heads = heads.withColumn("host", F.coalesce(F.lag("slice").over(order), F.max("slice").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    # As many rows of three numbers as there are slices.
    first = docs.join(F.broadcast(heads), docs["doc_id"].eqNullSafe(heads["head"])).withColumn(
        "nth", F.row_number().over(W.partitionBy("slice").orderBy("text"))).where("nth = 1")
    guests = first.select(*[docs[c] for c in docs.columns], F.col("host").alias("slice"), F.lit(True).alias("guest"))
    order = ["guest", "none", "doc_id", "text"]
    every = rows.unionByName(guests).withColumn("none", F.col("doc_id").isNull())
    every = derive(every.repartition("slice").sortWithinPartitions("slice", *order))
    found = every.withColumn("next", F.lead(F.struct(*columns)).over(W.partitionBy("slice").orderBy(*order)))
    return found.where(~F.col("guest")).drop("slice", "guest", "none")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """``doc_id, text, edited`` of every document, and ``anchors, links, marks`` of its text (those of the edited and of the next
    text with ``edited_`` and ``next_`` before their names)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "anchors"], lambda d: d.withColumn("anchors", anchors(F.col("text"))))
    rows = rows.select("doc_id", "text", "anchors", edited(F.col("text"), F.col("next.text")).alias("edited"), F.col("next.anchors").alias("next_anchors"))
    rows = rows.withColumn("edited_anchors", anchors(F.col("edited")))
    return rows.select("*", *[of(F.col(f"{x}anchors")).alias(f"{x}{name}") for x in ("", "edited_", "next_")
                              for name, of in (("links", links), ("marks", digest))])
