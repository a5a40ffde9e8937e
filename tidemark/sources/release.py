"""Inventory of a release that comes in several archive parts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import row_numbers
from tidemark.session import stored

NAME = r"^([^-]+)-(\d{4}_\d{2}_\d{2}_[^-]+)-(video|resting)"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below ``root``; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path", "length"))


def parsed(files: DataFrame) -> DataFrame:
    """Add name, subject, date, kind from the path; unmatched names are kind 'unknown'."""
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    kind = F.regexp_extract("name", NAME, 3)
    return named.withColumns({
        "subject": F.regexp_extract("name", NAME, 1), "date": F.regexp_extract("name", NAME, 2),
        "kind": F.when(kind == "", "unknown").otherwise(kind)})


def first_paths(files: DataFrame) -> DataFrame:
    """One path per file name (the first in path order) and how many copies there were."""
    return files.groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def duplicate_counts(files: DataFrame, by: str) -> DataFrame:
    per = files.groupBy(by, "name").agg(F.count("*").alias("copies"))
    return per.groupBy(by).agg(
        F.sum("copies").alias("candidate_files"), F.count("*").alias("unique_files"),
        (F.sum("copies") - F.count("*")).alias("duplicate_filenames"),
        F.count_if(F.col("copies") > 1).alias("duplicate_groups"))


def date_key(date) -> F.Column:
    """YYYY_MM_DD… → YYYY.MM.DD"""
    return F.array_join(F.slice(F.split(date, "_"), 1, 3), ".")


def leaf_digest(path: Column, length: Column) -> Column:
    """Digest of one file's name and size; unknown parts are empty."""
    return F.sha2(F.concat(F.coalesce(path, F.lit("")), F.lit(":"), F.coalesce(length.cast("string"), F.lit(""))), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def hash_tree(files: DataFrame, fan: int = 1024) -> list[DataFrame]:
    """Levels of a hash tree over a listing, leaves first, one node in the last: (node, digest), leaves also (path, length).

    Files are numbered in (path, length) order by ranges; a node of the next level digests ``fan`` neighbouring digests,
    so no task gathers more than ``fan`` of them whatever the number of files, and there are as many levels as it takes.
    Empty listings have leaves only.
    """
    if fan < 2:
        raise ValueError("a node needs at least two children")
    leaves = files.select("path", "length", leaf_digest(F.col("path"), F.col("length")).alias("digest"))
    levels = [stored(row_numbers(leaves, [], ["path", "length"], "node").withColumn("node", F.col("node") - 1), "leaves")]
    count = levels[0].count()
    while count > 1 or (count == 1 and len(levels) == 1):
        below = levels[-1].groupBy(F.floor(F.col("node") / fan).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("c"))
        levels.append(stored(below.select(F.col("parent").alias("node"), _joined(F.transform("c", lambda x: x["digest"])).alias("digest")), "nodes"))
        count = -(-count // fan)
    return levels


def fingerprint(files: DataFrame, fan: int = 1024) -> DataFrame:
    """(fingerprint, n_files, n_levels): order-independent digest of (path, length); an empty listing has the digest of nothing."""
    levels = hash_tree(files, fan)
    top = levels[-1].agg(F.max("digest").alias("d")) if len(levels) > 1 else levels[0].agg(F.sha2(F.lit(""), 256).alias("d"))
    return top.crossJoin(levels[0].agg(F.count("*").alias("n_files"))).select(
        F.col("d").alias("fingerprint"), "n_files", F.lit(len(levels) - 1).alias("n_levels"))


def branches(levels: list[DataFrame], paths: DataFrame, fan: int = 1024) -> DataFrame:
    """(path, length, steps): for the first leaf of each wanted path the digests beside it, level by level up to the root.

    ``steps`` holds structs (level, at, siblings); with the root's digest alone they prove a file's name and size.
    """
    first = levels[0].join(paths.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min("node").alias("leaf"), F.min_by("length", "node").alias("length"))
    first = stored(first, "wanted")
    steps = None
    for k, below in enumerate(levels[:-1], start=1):
        at = first.select("path", F.floor(F.col("leaf") / fan ** (k - 1)).alias("child")).withColumn("parent", F.floor(F.col("child") / fan))
        inside = below.withColumn("parent", F.floor(F.col("node") / fan)).join(at.select("parent").distinct(), "parent", "left_semi")
        beside = inside.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("c"))
        step = at.join(beside, "parent").select("path", F.struct(F.lit(k).alias("level"), (F.col("child") % fan + 1).cast("int").alias("at"),
                                                                 F.transform("c", lambda x: x["digest"]).alias("siblings")).alias("step"))
        steps = step if steps is None else steps.unionByName(step)
    if steps is None:
        return first.select("path", "length", F.array().cast("array<struct<level:int,at:int,siblings:array<string>>>").alias("steps"))
    return first.select("path", "length").join(steps.groupBy("path").agg(F.array_sort(F.collect_list("step")).alias("steps")), "path")


def proven(path: Column, length: Column, steps: Column, root: Column) -> Column:
    """Whether a file's name and size lead to ``root`` along a branch; only digests are needed, not the listing."""
    start = F.struct(leaf_digest(path, length).alias("d"), F.lit(True).alias("fine"))
    end = F.aggregate(steps, start, lambda s, x: F.struct(
        _joined(x["siblings"]).alias("d"), (s["fine"] & F.coalesce(F.get(x["siblings"], x["at"] - 1) == s["d"], F.lit(False))).alias("fine")))
    return end["fine"] & (end["d"] == root)


def preferred_match(sessions: DataFrame, meta: DataFrame, key: str, session_date: str,
                    meta_date: str, order: str) -> DataFrame:
    """Each session's metadata row: the one of its date, else the subject's first; flagged.

    Metadata is first reduced to one row per (subject, date) and one per subject, so both joins
    have a unique right side and a subject with very many rows does not multiply.
    """
    cols = [c for c in meta.columns if c != key]
    row = F.min_by(F.struct(*cols), F.col(order)).alias
    exact = meta.groupBy(key, F.col(meta_date).alias("__d")).agg(row("__exact"))
    first = meta.groupBy(key).agg(row("__first"))
    out = (sessions.withColumn("__d", F.col(session_date)).join(first, key)
           .join(exact, [key, "__d"], "left"))
    best = F.coalesce("__exact", "__first")
    return out.select(*sessions.columns, F.col("__exact").isNotNull().alias("matched"),
                      *[best[c].alias(c) for c in cols])
