"""Sources and sinks, driven with files that Spark first writes from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import r
from tidemark.session import scratch_path
from tidemark.sources import metadata, release, sinks
from tidemark.tables import CUBE, SUBJECT, cube, signal, SIGNAL, subject, with_views

FILES = """files AS (SELECT 'release/' || event_type || '/' || CAST(user_id AS VARCHAR) || '-'
    || strftime(ts, '%Y_%m_%d') || '_00-' || CASE WHEN event_type = 'view' THEN 'video'
       WHEN event_type = 'error' THEN 'other' ELSE 'resting' END || '.npz' AS path,
    CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y_%m_%d') || '_00-' || CASE WHEN event_type = 'view'
       THEN 'video' WHEN event_type = 'error' THEN 'other' ELSE 'resting' END || '.npz' AS name,
    CASE WHEN event_type = 'view' THEN 'video' WHEN event_type = 'error' THEN 'unknown' ELSE 'resting' END AS kind,
    CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END AS subject,
    CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y_%m_%d') || '_00' END AS date,
    CAST(floor(value * 100) AS BIGINT) AS length FROM events)"""


def release_files(t: Tables):
    """A release listing: one file per event, several parts, repeated names across parts."""
    kind = (F.when(F.col("event_type") == "view", "video")
            .when(F.col("event_type") == "error", "other").otherwise("resting"))
    name = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy_MM_dd"),
                    F.lit("_00-"), kind, F.lit(".npz"))
    return t.events.select(F.concat(F.lit("release/"), F.col("event_type"), F.lit("/"), name).alias("path"),
                           F.floor(F.col("value") * 100).alias("length"))


@query("src01_sidecar_scan", """
SELECT 'D' || CAST(d.doc_id AS VARCHAR) AS subject, d.source AS cohort, d.lang AS "group",
  CAST(2 AS BIGINT) AS n_channels, (round(d.n_chars / 256.0e0, 6) + 0.0e0) AS duration_s
FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)""")
def src01(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "sidecars")
    t.documents.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("subject"),
        F.col("source").alias("cohort"), F.col("lang").alias("group"),
        F.array(F.col("lang"), F.col("source")).alias("channels"),
        F.struct((F.col("n_chars") / 256.0).alias("duration_s")).alias("qc")).write.json(path)
    have = t.labels.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("subject"))
    js = metadata.sidecars(spark, [path], have)
    return js.select("subject", "cohort", "group", F.size("channels").cast("bigint").alias("n_channels"),
                     rounded(F.col("qc.duration_s")).alias("duration_s"))


@query("src02_annotations", """
SELECT CAST(user_id AS VARCHAR) AS serial, CAST(count(*) AS DOUBLE) AS age,
  string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS subtype FROM events GROUP BY user_id""")
def src02(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "annotation")
    rec = t.events.groupBy(F.col("user_id").cast("string").alias("serial")).agg(
        F.count("*").cast("double").alias("age"), F.array_sort(F.collect_set("event_type")).alias("symptom"))
    rec.select(F.array(F.struct("serial", "age", "symptom")).alias("data")).write.json(path)
    return metadata.annotations(spark, path, multiline=False)


GROUP_OF = {"MACHINERY": "A", "AUTOMOBILE": "F", "FURNITURE": "C"}


@query("src03_participants", f"""
SELECT CAST(c_custkey AS VARCHAR) AS participant_id, {r('c_acctbal / 100')} AS age,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'A' WHEN 'AUTOMOBILE' THEN 'F' WHEN 'FURNITURE' THEN 'C' ELSE 'X' END AS "group",
  CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'FURNITURE' THEN 2 END AS code,
  {r('c_nationkey / 30.0e0')} AS mmse_norm, CAST(c_nationkey < 12 AS INT) AS sex_code,
  {r('least(greatest((c_acctbal / 100 - 40) / 50, 0.0e0), 1.0e0)')} AS age_norm FROM customer""")
def src03(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "participants")
    grp = F.lit("X")
    for k, v in GROUP_OF.items():
        grp = F.when(F.col("c_mktsegment") == k, v).otherwise(grp)
    t.customer.select(
        F.col("c_custkey").alias("participant_id "), F.when(F.col("c_nationkey") < 12, "M").otherwise("F").alias("Gender"),
        (F.col("c_acctbal") / 100).alias(" Age"), grp.alias("Group"), F.col("c_nationkey").alias("MMSE ")
    ).write.csv(path, sep="\t", header=True)
    p = metadata.participants(spark, path)
    return p.select("participant_id", rounded(F.col("age")).alias("age"), "group", "code",
                    rounded(F.col("mmse_norm")).alias("mmse_norm"), "sex_code",
                    rounded(F.col("age_norm")).alias("age_norm"))


@query("src04_demographics", """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS diagnosis,
  (round(c_acctbal, 6) + 0.0e0) AS age, CAST(c_nationkey AS VARCHAR) AS sex FROM customer
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier
  WHERE s_nationkey <> 3""")
def src04(spark, sf):
    t = Tables(spark, sf)
    a, b = scratch_path(spark, "demo-a"), scratch_path(spark, "demo-b")
    sid, tag = F.concat(F.lit("c"), F.col("c_custkey")).alias("id EEG"), F.col("c_mktsegment").alias("Diagnosis ")
    age, sex = F.col("c_acctbal").alias("Age"), F.col("c_nationkey").alias("SEX")
    # Two files of one glob with the same columns in another order.
    for half, columns in ((0, (sid, tag, age, sex)), (1, (tag, sid, sex, F.lit("x, y").alias("note"), age))):
        t.customer.where(F.col("c_custkey") % 2 == half).select(*columns).write.option(
            "encoding", "ISO-8859-1").mode("append").csv(a, header=True)
    sid = F.when(F.col("s_nationkey") != 3, F.concat(F.lit(" s"), F.col("s_suppkey")))
    t.supplier.select(sid.alias("ID_EEG"), F.col("s_name").alias("diagnosis"),
                      F.lit("n/a").alias("age"), F.col("s_nationkey").alias("sex")
                      ).write.option("encoding", "ISO-8859-1").csv(b, header=True)
    d = metadata.demographics(spark, [f"{a}/*.csv", f"{b}/*.csv"])
    return d.select("id", "diagnosis", rounded(F.col("age")).alias("age"), "sex")


@query("src05_workbook", """
SELECT CAST(o_custkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y.%m.%d') AS "Date", count(*) AS n,
  max(o_orderpriority) AS disease FROM orders GROUP BY 1, 2""")
def src05(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "workbook")
    t.orders.select(F.concat(F.lit(" "), F.col("o_custkey")).alias(" id"),
                    F.concat(F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(" ")).alias("Date "),
                    F.col("o_orderpriority").alias("Disease")).write.csv(path, header=True)
    w = metadata.workbook(spark, [f"{path}-absent", path])
    return w.groupBy("id", "Date").agg(F.count("*").alias("n"), F.max("Disease").alias("disease"))


@query("src06_release_inventory", with_views(FILES) + """
SELECT kind, CAST(sum(c) AS BIGINT) AS candidate_files, count(*) AS unique_files,
  CAST(sum(c) - count(*) AS BIGINT) AS duplicate_filenames, count(*) FILTER (c > 1) AS duplicate_groups,
  count(DISTINCT subject) AS subjects, min(p) AS first_path, max(dk) AS last_date FROM (
  SELECT kind, name, subject, count(*) AS c, min(path) AS p, replace(substr(max(date), 1, 10), '_', '.') AS dk
  FROM files GROUP BY 1, 2, 3) GROUP BY kind""")
def src06(spark, sf):
    files = release.parsed(release_files(Tables(spark, sf)))
    dup = release.duplicate_counts(files, "kind")
    who = files.groupBy("kind").agg(F.count_distinct("subject").alias("subjects"), F.min("path").alias("first_path"),
                                    F.max(release.date_key(F.col("date"))).alias("last_date"))
    return dup.join(who, "kind")


@query("src06_first_path", with_views(FILES) + """
SELECT name, min(path) AS path, count(*) AS copies FROM files GROUP BY name""")
def src06_first(spark, sf):
    return release.first_paths(release.parsed(release_files(Tables(spark, sf))))


# A small fan, so that the given tables already make several levels.
FAN, LEVELS = 16, 7


def _tree_sql() -> str:
    """Level after level, each only while the one below has more than one node (the first always)."""
    out = ["l0 AS (SELECT row_number() OVER (ORDER BY path, length) - 1 AS node, sha256(path || ':' || CAST(length AS VARCHAR)) AS d FROM listing)"]
    for k in range(1, LEVELS + 1):
        more = "" if k == 1 else f" WHERE (SELECT count(*) FROM l{k - 1}) > 1"
        out.append(f"l{k} AS (SELECT node // {FAN} AS node, sha256(string_agg(d, '' ORDER BY node)) AS d FROM l{k - 1}{more} GROUP BY node // {FAN})")
    return ",\n".join(out)


@query("src07_release_fingerprint", with_views("listing AS (SELECT url AS path, length(html) AS length FROM pages)", _tree_sql()) + f"""
SELECT d AS fingerprint, (SELECT count(*) FROM listing) AS n_files, CAST(k AS INT) AS n_levels
FROM ({' UNION ALL '.join(f'SELECT {k} AS k, d, count(*) OVER () AS c FROM l{k}' for k in range(1, LEVELS + 1))}) WHERE c = 1""")
def src07(spark, sf):
    p = Tables(spark, sf).pages
    return release.fingerprint(p.select(F.col("url").alias("path"), F.length("html").alias("length")), FAN)


@query("src07_branch_proof", with_views(FILES) + f"""
, pos AS (SELECT kind, path, row_number() OVER (ORDER BY path, length) - 1 AS leaf, count(*) OVER () AS n FROM files),
 want AS (SELECT kind, min(path) AS path, arg_min(leaf, leaf) AS leaf, max(n) AS n FROM (SELECT * FROM pos QUALIFY path = min(path) OVER (PARTITION BY kind)) GROUP BY kind),
 lev AS (SELECT kind, path, leaf, k, CAST(ceil(n / pow({FAN}.0e0, k - 1)) AS BIGINT) AS below FROM want CROSS JOIN (SELECT unnest(range(1, {LEVELS + 1})) AS k))
SELECT kind, path, CAST(count(*) AS INT) AS n_levels, CAST(sum(least({FAN}, below - {FAN} * (leaf // CAST(pow({FAN}, k) AS BIGINT)))) AS BIGINT) AS n_siblings,
  true AS proven, false AS other_size_proven FROM lev WHERE below > 1 OR k = 1 GROUP BY kind, path""")
def src07_proof(spark, sf):
    """The first file of each kind is proven by its branch, and is not with another size."""
    files = release.parsed(release_files(Tables(spark, sf)))
    levels = release.hash_tree(files, FAN)
    want = files.groupBy("kind").agg(F.min("path").alias("path"))
    b = release.branches(levels, want, FAN).crossJoin(levels[-1].select(F.col("digest").alias("root"))).join(want, "path")
    sizes = F.aggregate("steps", F.lit(0), lambda s, x: s + F.size(x["siblings"]))
    return b.select("kind", "path", F.size("steps").alias("n_levels"), sizes.cast("bigint").alias("n_siblings"),
                    release.proven(F.col("path"), F.col("length"), F.col("steps"), F.col("root")).alias("proven"),
                    release.proven(F.col("path"), F.col("length") + 1, F.col("steps"), F.col("root")).alias("other_size_proven"))


@query("src08_split_partition", """
SELECT DISTINCT lpad(CAST(doc_id AS VARCHAR), 5, '0') AS serial,
  CASE WHEN lang = 'en' THEN 'train' ELSE 'held' END AS part FROM documents""")
def src08(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "split")
    one = F.array(F.struct(F.col("doc_id").cast("string").alias("serial")))
    none = F.array().cast("array<struct<serial:string>>")
    t.documents.select(
        F.when(F.col("lang") == "en", one).otherwise(none).alias("train_split"),
        F.when(F.col("lang") == "de", one).otherwise(none).alias("validation_split"),
        F.when(~F.col("lang").isin("en", "de"), one).otherwise(none).alias("test_split")).write.json(path)
    return metadata.split_partition(spark, path, multiline=False)


@query("src09_cube_roundtrip", with_views(CUBE) + f"""
SELECT cond, feature, count(*) AS n, count(*) FILTER (value IS NULL) AS n_null, {r('sum(value)', 3)} AS total
FROM cube GROUP BY cond, feature""")
def src09(spark, sf):
    path = scratch_path(spark, "cube")
    sinks.write_cube(cube(Tables(spark, sf)), path)
    return sinks.read_cube(spark, path).groupBy("cond", "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"),
        rounded(F.sum("value"), 3).alias("total"))


@query("src10_spine_roundtrip", with_views(SUBJECT) + f"""
SELECT subject, cohort, label, {r('age')} AS age, CAST(label IN ('AD', 'FTD', 'MCI', 'VAD') AS INT) AS impaired,
  CAST(label IN ('CN', 'AD', 'FTD', 'MCI', 'VAD') AS INT) AS in_screening FROM subject""")
def src10(spark, sf):
    path = scratch_path(spark, "spine")
    sinks.write_spine(subject(Tables(spark, sf)).withColumn("impaired", F.lit(9)), path)
    return sinks.load_spine(spark, path).select(
        "subject", "cohort", "label", rounded(F.col("age")).alias("age"), "impaired", "in_screening")


@query("src11_report_json", f"""
SELECT source, n, {r('CASE WHEN v >= 0 THEN sqrt(v) END')} AS spread FROM (
  SELECT source, count(*) AS n, avg(n_chars) - 2500 AS v FROM documents GROUP BY source)""")
def src11(spark, sf):
    d = Tables(spark, sf).documents.groupBy("source").agg(
        F.count("*").alias("n"), F.sqrt(F.avg("n_chars") - 2500).alias("spread"))
    doc = sinks.as_json(d, ["source"])
    return doc.select("source", F.get_json_object("report", "$.n").cast("bigint").alias("n"),
                      rounded(F.get_json_object("report", "$.spread")).alias("spread"))


@query("src12_resumable_append", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS run, n_chars FROM documents""")
def src12(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "resume")
    docs = t.documents.select("doc_id", "n_chars")
    docs.join(t.labels, "doc_id", "left_semi").select(
        "doc_id", F.lit(1).alias("run"), "n_chars").write.parquet(path)
    return sinks.append_new(spark, docs, path, "doc_id",
                            lambda d: d.select("doc_id", F.lit(2).alias("run"), "n_chars"))


@query("src13_class_manifest", with_views(SUBJECT) + f"""
SELECT subject, label AS class, {r('age')} AS age FROM subject""")
def src13(spark, sf):
    s = subject(Tables(spark, sf)).select("subject", F.col("label").alias("class"), rounded(F.col("age")).alias("age"))
    return sinks.write_classes(s, scratch_path(spark, "classes"), "class", "subject")


@query("src14_header_info", with_views(SIGNAL) + f"""
SELECT rec, CAST(floor(n * 64.0e0 / 50) AS BIGINT) AS n_times, {r('n / 50.0e0')} AS duration_s FROM (
  SELECT rec, max(t) + 1 AS n FROM signal GROUP BY rec)""")
def src14(spark, sf):
    n = signal(Tables(spark, sf)).groupBy("rec").agg((F.max("t") + 1).alias("n"))
    return n.select("rec", F.floor(F.col("n") * 64.0 / 50).alias("n_times"),
                    rounded(F.col("n") / 50.0).alias("duration_s"))


@query("src15_merge_results", f"""
SELECT o_custkey AS k, o_orderpriority AS cond, {r('sum(CASE WHEN late THEN -o_totalprice ELSE o_totalprice END)', 2)} AS v
FROM (SELECT *, max(o_orderstatus = 'F') OVER (PARTITION BY o_custkey, o_orderpriority) AS late FROM orders)
WHERE NOT late OR o_orderstatus = 'F' GROUP BY 1, 2""")
def src15(spark, sf):
    o = Tables(spark, sf).orders
    keys = [F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("cond")]
    old = o.groupBy(*keys).agg(F.sum("o_totalprice").alias("v"))
    new = o.filter("o_orderstatus = 'F'").groupBy(*keys).agg((-F.sum("o_totalprice")).alias("v"))
    return sinks.merged(old, new, ["k", "cond"]).select("k", "cond", rounded(F.col("v"), 2).alias("v"))
