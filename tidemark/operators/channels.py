"""Channel algebra: subsets, re-referencing, bipolar signals, faults; every montage at once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.draws import hash32
from tidemark.operators.ordered import same_group

#: Instants of a recording that are shuffled together.
RUN = 4096


def measurable(samples: DataFrame, montage_channel: DataFrame) -> DataFrame:
    """(rec, montage) whose sites the recording all carries."""
    have = samples.select("rec", "channel").distinct()
    need = montage_channel.groupBy("montage").agg(F.count("*").alias("__need"))
    return (have.join(F.broadcast(montage_channel), "channel").groupBy("rec", "montage")
            .agg(F.count("*").alias("__have")).join(F.broadcast(need), "montage")
            .filter("__have = __need").select("rec", "montage"))


def subset(samples: DataFrame, montage_channel: DataFrame) -> DataFrame:
    """Samples of every montage's channels, keyed by montage."""
    return samples.join(F.broadcast(montage_channel), "channel")


def _centred(df: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract the mean over the channels of one instant.

    The channels of an instant are gathered in one row (at most a montage's sites), centred there
    and unfolded again: one shuffle, and the group is bounded by the electrode count.
    """
    g = df.groupBy(*keys).agg(F.collect_list(F.struct("channel", "x")).alias("__c"),
                              F.avg("x").alias("__m"))
    return g.select(*keys, "__m", F.explode("__c").alias("__s")).select(
        *keys, F.col("__s.channel").alias("channel"), (F.col("__s.x") - F.col("__m")).alias("x"))


def average_referenced(samples: DataFrame) -> DataFrame:
    """Common-average reference of the whole recording."""
    return _centred(samples.select("rec", "t", "channel", "x"), ["rec", "t"])


def subset_referenced(samples: DataFrame, montage_channel: DataFrame) -> DataFrame:
    """Common average over each montage's own channels.

    Samples are shuffled once, not once a montage: by runs of instants, so that the channels of an instant meet in one row (bounded by
    the electrode count) and every montage is read off that row. Neighbouring instants share a task, where sums over time collapse.
    """
    car = montage_channel.filter("ref = 'subset_car'")
    # One row with the registry, a design list.
    sites = car.groupBy("montage").agg(F.collect_set("channel").alias("sites")).agg(F.collect_list(F.struct("montage", "sites")).alias("__montages"))
    runs = samples.filter("channel IS NOT NULL").select("rec", "t", F.struct("channel", "x").alias("s"), F.floor(F.col("t") / RUN).alias("run"))
    inst = runs.repartition("rec", "run").groupBy("rec", "run", "t").agg(F.collect_list("s").alias("c"))
    rows = inst.crossJoin(F.broadcast(sites)).select("rec", "t", "c", F.explode("__montages").alias("m"))
    rows = rows.select("rec", "t", F.col("m.montage").alias("montage"), F.filter("c", lambda s: F.array_contains("m.sites", s["channel"])).alias("c"))
    known = F.filter(F.transform("c", lambda s: s["x"]), lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0))
    return rows.withColumn("mean", mean).select("montage", "rec", "t", "mean", F.explode("c").alias("s")).select(
        "montage", "rec", "t", F.col("s.channel").alias("channel"), (F.col("s.x") - F.col("mean")).alias("x"))


def bipolar(samples: DataFrame, montage_pair: DataFrame) -> DataFrame:
    """a − b for every pair; the signal is named a-b.

    Each sample is sent to the pairs it belongs to with its sign and summed, so the samples are
    read once instead of being joined to themselves.
    """
    signed = montage_pair.select(
        "montage", F.concat_ws("-", "a", "b").alias("signal"),
        F.explode(F.create_map(F.col("a"), F.lit(1.0), F.col("b"), F.lit(-1.0)))
        .alias("channel", "sign"))
    rows = samples.join(F.broadcast(signed), "channel")
    return (rows.groupBy("montage", "rec", "t", "signal")
            .agg(F.sum(F.col("sign") * F.col("x")).alias("x"), F.count("*").alias("__k"))
            .filter("__k = 2").drop("__k").withColumnRenamed("signal", "channel"))


def montage_specs(spark) -> DataFrame:
    """(montage, ref, channels, pairs): the registry with its sites and pairs as arrays."""
    ch = dims.montage_channel(spark).groupBy("montage", "ref").agg(F.collect_list("channel").alias("channels"))
    pr = dims.montage_pair(spark).groupBy("montage").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    return ch.join(pr, "montage", "left")


def all_montages(samples: DataFrame) -> DataFrame:
    """Every montage in one plan: (montage, rec, t, channel, x).

    The samples are read and shuffled once: the channels of an instant meet in one row (bounded by
    the electrode count) and every montage whose sites are all there is derived from that row.
    """
    inst = samples.groupBy("rec", "t").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "x"))).alias("m"))
    rows = inst.crossJoin(F.broadcast(montage_specs(samples.sparkSession))).filter(
        F.forall("channels", lambda c: F.map_contains_key("m", c)))
    at = lambda c: F.try_element_at(F.col("m"), c)
    mean = F.aggregate("channels", F.lit(0.0), lambda s, c: s + at(c)) / F.size("channels")
    rows = rows.withColumn("mean", F.when(F.col("ref") == "subset_car", mean).otherwise(0.0))
    single = F.transform("channels", lambda c: F.struct(c.alias("channel"), (at(c) - F.col("mean")).alias("x")))
    double = F.transform("pairs", lambda p: F.struct(
        F.concat_ws("-", p["a"], p["b"]).alias("channel"), (at(p["a"]) - at(p["b"])).alias("x")))
    sig = F.when(F.col("ref") == "bipolar", double).otherwise(single)
    return rows.select("montage", "rec", "t", F.explode(sig).alias("s")).select(
        "montage", "rec", "t", "s.channel", "s.x")


def reachable_neighbours(spark, sites: list[str] | None = None) -> DataFrame:
    """Neighbour lists; with ``sites`` only edges inside a recording's own sites."""
    edges = dims.neighbour_edge(spark)
    if sites is not None:
        edges = edges.filter(F.col("channel").isin(sites) & F.col("neighbour").isin(sites))
    return edges.groupBy("channel").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "neighbour"))),
                    lambda s: s["neighbour"]).alias("neighbours"))


def chosen_neighbour(samples: DataFrame, lists: DataFrame, tag: str) -> DataFrame:
    """One hash-chosen neighbour per (recording, channel): a small edge table."""
    rc = samples.select("rec", "channel").distinct().join(F.broadcast(lists), "channel")
    pick = hash32(F.col("rec"), F.lit(tag), F.col("channel")) % F.size("neighbours")
    return rc.select("rec", "channel", F.element_at("neighbours", (pick + 1).cast("int")).alias("neighbour"))


def displaced(samples: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """(1 − share)·x + share·x of the chosen neighbour at the same instant; channels whose neighbour has no sample there have no row.

    The channels of an instant meet in one row, so the samples are shuffled once and not joined to themselves. A recording's
    edges are one small row.
    """
    inst = samples.filter("channel IS NOT NULL").groupBy("rec", "t").agg(F.collect_list(F.struct("channel", "x")).alias("c"))
    moves = edges.groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct("channel", "neighbour"))).alias("to"))
    rows = same_group(inst, moves, ["rec"]).select("rec", "t", "to", F.map_from_entries("c").alias("m"), F.explode("c").alias("s"))
    near = F.try_element_at("to", F.col("s.channel"))
    return (rows.withColumns({"channel": F.col("s.channel"), "neighbour": near}).filter(F.map_contains_key("m", near))
            .withColumn("x", (1 - share) * F.col("s.x") + share * F.element_at("m", F.col("neighbour")))
            .select("rec", "channel", "t", "x", "neighbour"))


def lost_channel(samples: DataFrame, sites: list[str], tag: str) -> DataFrame:
    """One hash-chosen lost site per recording."""
    arr = F.array(*[F.lit(s) for s in sites])
    pick = hash32(F.col("rec"), F.lit(tag)) % len(sites)
    return samples.select("rec").distinct().select(
        "rec", F.element_at(arr, (pick + 1).cast("int")).alias("lost"))


def dropped_lead(samples: DataFrame, sites: list[str], tag: str) -> DataFrame:
    """Sites without the lost one, re-referenced to what is left."""
    lost = lost_channel(samples, sites, tag)
    rows = samples.filter(F.col("channel").isin(sites)).join(lost, "rec").filter("channel <> lost")
    return _centred(rows.select("rec", "t", "channel", "x"), ["rec", "t"])
