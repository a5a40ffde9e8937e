"""Label semantics: vocabularies, flags, tag taxonomy, contrasts, masks and corpus checks."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import dims


def strict_map(value: Column, mapping: Mapping[str, str], what: str = "label") -> Column:
    """Mapped value; an unmapped one stops the job, naming it."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(table, value)
    return F.coalesce(hit, F.raise_error(
        F.concat(F.lit(f"unmapped {what} "), F.coalesce(value, F.lit("null")))).cast("string"))


def normalise_labels(df: DataFrame, col: str, name: str = "label") -> DataFrame:
    return df.withColumn(name, strict_map(F.col(col), dims.LABELS))


def tag_set(tags: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in tags])


def assign_class(tags: Column) -> Column:
    """Class by priority over a tag set, EXCL where the taxonomy has no place for it."""
    has = lambda ts: F.arrays_overlap(tags, tag_set(ts))
    mci = F.exists(tags, lambda x: x.startswith("mci"))
    vascular = has(dims.VASCULAR_TAGS)
    return F.coalesce(
        F.when(has(dims.FTD_TAGS), F.when(vascular, "EXCL").otherwise("FTD"))
        .when(has(dims.AD_TAGS) & ~mci, F.when(vascular, "EXCL").otherwise("AD"))
        .when(mci, "MCI")
        .when(has(dims.NORMAL_TAGS), "CN"), F.lit("EXCL"))


def recover_class(tags: Column, cls: Column) -> Column:
    """Extra class of a row the taxonomy drops, else the class it has."""
    extra = (F.when(F.arrays_overlap(tags, tag_set(dims.VASCULAR_TAGS)), "VAD")
             .when(F.arrays_overlap(tags, tag_set(dims.TGA_TAGS)), "TGA"))
    return F.when(cls == "EXCL", F.coalesce(extra, cls)).otherwise(cls)


def has_tag(subtype: Column, tag: str | Column) -> Column:
    """Whole-tag match in a ';'-joined list; never a substring."""
    return F.array_contains(F.split(F.coalesce(subtype, F.lit("")), ";"), tag)


def exclusion(df: DataFrame, condition: Column, reason: str) -> DataFrame:
    return df.withColumn("excluded", F.when(condition, F.lit(reason)).otherwise(F.lit("")))


def canonical_channel(raw: Column, suffix: str = r"-(AVG|REF)") -> Column:
    """Suffix stripped and aliases mapped; the site name as the montages spell it."""
    base = F.trim(F.regexp_replace(raw, suffix, ""))
    alias = F.create_map(*[F.lit(x) for kv in dims.SITE_ALIAS.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, base), F.try_element_at(alias, F.upper(base)), base)


def site_order(channel: Column) -> Column:
    """Place in the canonical order, null for a channel that is not a site."""
    at = F.array_position(tag_set(dims.CANON), channel)
    return F.when(at > 0, at)


def missing_sites(df: DataFrame, rec: str, channel: str, sites: Sequence[str] = tuple(dims.CANON)) -> DataFrame:
    """(rec, channel) for every required site a recording lacks; empty when complete."""
    have = df.groupBy(rec).agg(F.collect_set(F.when(F.col(channel).isin(list(sites)), F.col(channel))).alias("__have"))
    return have.select(rec, F.explode(F.array_except(tag_set(sites), F.col("__have"))).alias(channel))


def usable_features(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Groups (condition, feature) measured for every subject: no null anywhere."""
    return (df.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("__null"))
            .filter("__null = 0").drop("__null"))


def jointly_usable(df: DataFrame, arm: str, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Keys usable in every arm present."""
    per = df.groupBy(*keys, arm).agg((F.count_if(F.col(value).isNull()) == 0).alias("__ok"))
    return per.groupBy(*keys).agg(F.bool_and("__ok").alias("__ok")).filter("__ok").drop("__ok")


def banded(x: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed band (lo, hi] holding x; null outside the edges."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def min_max_scaled(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rescale to [0, 1] inside the group; a constant group becomes 0.5."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(lim, list(keys)).withColumn(
        name, F.when(F.col(value).isNull(), F.lit(None))
        .when(span > 0, (F.col(value) - F.col("__lo")) / span).otherwise(0.5)).drop("__lo", "__hi")


def check_counts(actual: DataFrame, expected: DataFrame, key: str, halt: bool = True) -> DataFrame:
    """Expected against actual counts per key; a mismatch stops the job unless ``halt`` is off."""
    both = (expected.withColumnRenamed("n", "expected")
            .join(actual.withColumnRenamed("n", "actual"), key, "full_outer"))
    ok = F.col("expected").eqNullSafe(F.col("actual"))
    if not halt:
        return both.withColumn("ok", ok)
    msg = F.concat(F.lit("count mismatch for "), F.col(key).cast("string"))
    return both.withColumn("ok", F.when(ok, True).otherwise(F.raise_error(msg).cast("boolean")))
