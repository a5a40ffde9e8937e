"""Adapters: views of the given tables in the roles the operators expect."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dims import values_sql
from tidemark.operators.ordered import row_numbers
from tidemark.plans.registry import Tables

SITES = ["T5", "T6", "O1", "O2", "Fp1", "Fp2", "Cz"]          # line number 1..7
DEVICE_SITES = ["F3", "F4", "C3", "C4", "T5", "T6", "O1", "O2"]  # window position mod 8
SEGMENT_LABEL = {"FURNITURE": "CN", "MACHINERY": "AD", "BUILDING": "MCI",
                 "AUTOMOBILE": "FTD", "HOUSEHOLD": "VAD"}
NAMES = ["f_n", "f_total", "f_open", "f_final", "f_mean", "f_sd"]


def case_map(col: F.Column, mapping: dict) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[col]


def signal(t: Tables) -> DataFrame:
    """samples(rec, channel, t, x): one series per supplier and line number."""
    li = t.lineitem.select("l_suppkey", "l_linenumber", "l_shipdate", "l_orderkey", "l_partkey",
                           "l_extendedprice")
    hot = t.hot("lineitem")
    if hot is None and not t.one_hot("lineitem", "l_suppkey"):
        # Dealt by recording, so that what groups by recording later on finds its rows together.
        li, hot = li.repartition("l_suppkey"), False
    seq = row_numbers(li, ["l_suppkey", "l_linenumber"], ["l_shipdate", "l_orderkey", "l_partkey"], hot=hot)
    return seq.select(F.col("l_suppkey").alias("rec"),
                      case_map(F.col("l_linenumber"), dict(enumerate(SITES, 1))).alias("channel"),
                      (F.col("rn") - 1).alias("t"), F.col("l_extendedprice").alias("x"))


SIGNAL = f"""signal AS (
  SELECT rec, site AS channel, t, x FROM (
    SELECT l_suppkey AS rec, l_linenumber AS ln, l_extendedprice AS x,
      row_number() OVER (PARTITION BY l_suppkey, l_linenumber
                         ORDER BY l_shipdate, l_orderkey, l_partkey) - 1 AS t FROM lineitem) q
  JOIN {values_sql(list(enumerate(SITES, 1)))} s(n, site) ON s.n = q.ln)"""


def window_vectors(t: Tables) -> DataFrame:
    """windows(rec, win, channel, x ARRAY): 64 samples at a nominal 64 Hz per vector."""
    seq = row_numbers(t.embeddings, ["label"], ["vec_id"], "pos", t.hot("embeddings"))
    pos = F.col("pos") - 1
    rows = seq.select(F.col("label").alias("rec"), F.floor(pos / 8).alias("win"),
                      (pos % 8).alias("slot"), F.col("embedding").cast("array<double>").alias("x"))
    full = rows.groupBy("rec", "win").agg(F.count("*").alias("n")).filter("n = 8").drop("n")
    sites = F.array(*[F.lit(s) for s in DEVICE_SITES])
    return rows.join(full, ["rec", "win"]).select(
        "rec", "win", F.element_at(sites, (F.col("slot") + 1).cast("int")).alias("channel"), "x")


WINDOWS = f"""wvec AS (
  SELECT rec, win, site AS channel, x FROM (
    SELECT label AS rec, CAST(floor(pos / 8) AS BIGINT) AS win, pos % 8 AS slot, x,
           count(*) OVER (PARTITION BY label, CAST(floor(pos / 8) AS BIGINT)) AS n8
    FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                 CAST(embedding AS DOUBLE[]) AS x FROM embeddings) p) q
  JOIN {values_sql(list(enumerate(DEVICE_SITES)))} s(k, site) ON s.k = q.slot WHERE n8 = 8)"""


def long_windows(t: Tables) -> DataFrame:
    """windows(rec, win, channel, x ARRAY): five vectors of a site in a row, 320 samples at a nominal 96 Hz."""
    seq = row_numbers(t.embeddings, ["label"], ["vec_id"], "pos", t.hot("embeddings"))
    pos = F.col("pos") - 1
    rows = seq.select(F.col("label").alias("rec"), F.floor(pos / 40).alias("win"), (pos % 8).alias("slot"),
                      F.struct(F.floor((pos % 40) / 8).alias("k"), F.col("embedding").cast("array<double>").alias("x")).alias("part"))
    joined = rows.groupBy("rec", "win", "slot").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.count("*").alias("n"))
    full = rows.groupBy("rec", "win").agg(F.count("*").alias("all")).filter("all = 40").drop("all")
    sites = F.array(*[F.lit(s) for s in DEVICE_SITES])
    return joined.join(full, ["rec", "win"]).select(
        "rec", "win", F.element_at(sites, (F.col("slot") + 1).cast("int")).alias("channel"),
        F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"))


LONG_WINDOWS = f"""smp AS (
  SELECT rec, win, site AS channel, k * 64 + unnest(range(0, 64)) AS t, unnest(x) AS x FROM (
    SELECT label AS rec, pos // 40 AS win, pos % 8 AS slot, (pos % 40) // 8 AS k, x, count(*) OVER (PARTITION BY label, pos // 40) AS n40
    FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                 CAST(embedding AS DOUBLE[]) AS x FROM embeddings) p) q
  JOIN {values_sql(list(enumerate(DEVICE_SITES)))} s(j, site) ON s.j = q.slot WHERE n40 = 40)"""


def scalp(t: Tables) -> DataFrame:
    """samples(rec, channel, t, x) of all 19 sites: every 19 vectors of a label in a row are 64 samples of each site."""
    from tidemark.dims import CANON
    seq = row_numbers(t.embeddings, ["label"], ["vec_id"], "pos", t.hot("embeddings"))
    pos = F.col("pos") - 1
    rows = seq.select(F.col("label").alias("rec"), F.floor(pos / 19).alias("round"), (pos % 19).cast("int").alias("site"), "embedding")
    full = rows.groupBy("rec", "round").agg(F.count("*").alias("n")).filter("n = 19").drop("n")
    sites = F.array(*[F.lit(s) for s in CANON])
    cells = rows.join(full, ["rec", "round"]).select(
        "rec", F.element_at(sites, F.col("site") + 1).alias("channel"), "round", F.posexplode("embedding").alias("i", "v"))
    return cells.select("rec", "channel", (F.col("round") * 64 + F.col("i")).alias("t"), F.col("v").cast("double").alias("x"))


def raw_scalp(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The same recordings before artefact removal, started a few samples earlier; and where the cleaned ones begin in them."""
    early = (F.col("rec") % 5).cast("bigint")
    s = scalp(t)
    raw = s.select("rec", "channel", (F.col("t") + early).alias("t"), (1.1 * F.col("x") + 0.01 * (F.col("t") % 2)).alias("x"))
    return raw, t.embeddings.select(F.col("label").alias("rec")).distinct().withColumn("offset", early)


def _scalp_sql() -> str:
    from tidemark.dims import CANON
    return f"""signal AS (
  SELECT rec, site AS channel, round * 64 + unnest(range(0, 64)) AS t, unnest(x) AS x FROM (
    SELECT label AS rec, pos // 19 AS round, pos % 19 AS j, x, count(*) OVER (PARTITION BY label, pos // 19) AS n19
    FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                 CAST(embedding AS DOUBLE[]) AS x FROM embeddings) p) q
  JOIN {values_sql(list(enumerate(CANON)))} s(k, site) ON s.k = q.j WHERE n19 = 19)"""


SCALP = _scalp_sql()


def subject(t: Tables) -> DataFrame:
    """spine(subject, cohort, site, label, age, subtype): one row per customer."""
    geo = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    return (t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("subject"), F.col("r_name").alias("cohort"),
                    F.col("n_name").alias("site"),
                    case_map(F.col("c_mktsegment"), SEGMENT_LABEL).alias("label"),
                    F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("age")))


SUBJECT = f"""subject AS (
  SELECT c_custkey AS subject, r_name AS cohort, n_name AS site, lab AS label,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS age
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN {values_sql(list(SEGMENT_LABEL.items()))} m(seg, lab) ON seg = c_mktsegment)"""


def features_wide(t: Tables) -> DataFrame:
    """(cond, subject, f_*): order measures per customer and order priority.

    Orders are reduced to one row per customer and condition before the customers are joined.
    """
    o = t.orders.select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    price = F.col("o_totalprice") / 100000
    per = o.groupBy(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("cond")).agg(
        F.count("*").cast("double").alias("n"), F.sum(price).alias("total"),
        F.sum((F.col("o_orderstatus") == "O").cast("double")).alias("open"),
        F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("final"),
        F.avg(price).alias("mean"), F.stddev_samp(price).alias("sd"))
    # The conditions are a design list: one row holding them all is attached and unfolded.
    conds = o.agg(F.collect_set("o_orderpriority").alias("conds"))
    frame = t.customer.select(F.col("c_custkey").alias("subject")).crossJoin(F.broadcast(conds)).select(
        "subject", F.explode("conds").alias("cond"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return frame.join(per, ["subject", "cond"], "left").select(
        "cond", "subject", zero("n").alias("f_n"), zero("total").alias("f_total"),
        zero("open").alias("f_open"), zero("final").alias("f_final"),
        F.col("mean").alias("f_mean"), F.col("sd").alias("f_sd"))


def to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, feature, value) rows; one pass, no shuffle."""
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])).alias("fv")
    ).select(*keys, "fv.feature", "fv.value")


def cube(t: Tables) -> DataFrame:
    return to_long(features_wide(t), ["cond", "subject"], NAMES)


CUBE = """fwide AS (
  SELECT d.cond, c_custkey AS subject, coalesce(n, 0.0) AS f_n, coalesce(total, 0.0) AS f_total,
         coalesce(op, 0.0) AS f_open, coalesce(fin, 0.0) AS f_final, mean AS f_mean, sd AS f_sd
  FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS cond FROM orders) d
  LEFT JOIN (SELECT o_custkey, o_orderpriority AS cond, CAST(count(*) AS DOUBLE) AS n,
      sum(o_totalprice / 100000) AS total,
      sum(CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS op,
      sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fin,
      avg(o_totalprice / 100000) AS mean, stddev_samp(o_totalprice / 100000) AS sd
    FROM orders GROUP BY 1, 2) p ON p.o_custkey = c_custkey AND p.cond = d.cond),
cube AS (
  SELECT cond, subject, 'f_n' AS feature, f_n AS value FROM fwide
  UNION ALL SELECT cond, subject, 'f_total', f_total FROM fwide
  UNION ALL SELECT cond, subject, 'f_open', f_open FROM fwide
  UNION ALL SELECT cond, subject, 'f_final', f_final FROM fwide
  UNION ALL SELECT cond, subject, 'f_mean', f_mean FROM fwide
  UNION ALL SELECT cond, subject, 'f_sd', f_sd FROM fwide)"""


def score(t: Tables) -> DataFrame:
    """scores(id, cohort, source, y, quality, a, b, c): labelled documents with three scores."""
    d = t.documents.join(t.labels, "doc_id")
    return d.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("cohort"), "source",
        F.col("toxic").alias("y"), "quality",
        F.size(F.split("text", " ")).cast("double").alias("a"),
        F.col("n_chars").cast("double").alias("b"),
        F.size(F.split("text", "\n")).cast("double").alias("c"))


SCORE = """score AS (
  SELECT d.doc_id AS id, d.lang AS cohort, d.source, l.toxic AS y, l.quality,
         CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS a, CAST(d.n_chars AS DOUBLE) AS b,
         CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS c
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def contrast_rows(t: Tables) -> DataFrame:
    """(contrast, subject, cohort, label, y, age): every contrast at once, covariate present."""
    from tidemark import dims
    return (subject(t).filter(F.col("age").isNotNull())
            .join(F.broadcast(dims.contrast(t.spark)), "label")
            .select("contrast", "subject", "cohort", "label", "y", "age"))


def _contrast_values() -> str:
    from tidemark import dims
    rows = [(k, l, 1) for k, ls in dims.CONTRASTS.items() for l in ls]
    return values_sql(rows + [(k, dims.CONTROL, 0) for k in dims.CONTRASTS])


CONTRAST = f"""contr AS (
  SELECT k.contrast, s.subject, s.cohort, s.label, k.y, s.age FROM subject s
  JOIN {_contrast_values()} k(contrast, label, y) ON k.label = s.label WHERE s.age IS NOT NULL)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
