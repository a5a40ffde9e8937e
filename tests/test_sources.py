import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as jn
from tidemark.operators import labels as lb
from tidemark.sources import metadata, release, sinks


def test_sidecars_need_a_payload(spark, tmp_path):
    for s, payload in (("s1", True), ("s2", False)):
        (tmp_path / f"{s}.json").write_text(json.dumps({"subject": s, "cohort": "c", "group": "AD", "channels": ["T5"],
                                                        "qc": {"duration_s": 3.5}}))
        if payload:
            (tmp_path / f"{s}.npy").write_bytes(b"x")
    js = tmp_path / "*.json"
    out = metadata.sidecars(spark, [str(js)], metadata.payload_listing(spark, [str(tmp_path)])).collect()
    assert [(r["subject"], r["qc"]["duration_s"]) for r in out] == [("s1", 3.5)]


def test_annotations_and_splits(spark, tmp_path):
    a = tmp_path / "annotation.json"
    a.write_text(json.dumps({"data": [{"serial": "1", "age": 70, "symptom": ["mci", "mci_ad"]}, {"serial": "2", "age": 50}]}, indent=1))
    out = {r["serial"]: r for r in metadata.annotations(spark, str(a)).collect()}
    assert out["1"]["subtype"] == "mci;mci_ad" and out["2"]["subtype"] == "" and out["1"]["age"] == 70.0
    s = tmp_path / "split.json"
    s.write_text(json.dumps({"train_split": [{"serial": "7"}], "validation_split": [{"serial": "8"}], "test_split": [{"serial": "123456"[:5]}]}, indent=1))
    parts = {(r["serial"], r["part"]) for r in metadata.split_partition(spark, str(s)).collect()}
    assert parts == {("00007", "train"), ("00008", "held"), ("12345", "held")}


def test_participants_with_and_without_scale(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("participant_id \t Gender\tAge \tGroup\nsub-1\tM\t90\tA\nsub-2\tF\t30\tC\n")
    out = {r["participant_id"]: r for r in metadata.participants(spark, str(p)).collect()}
    assert out["sub-1"]["code"] == 0 and out["sub-1"]["mmse_norm"] == 0.5 and out["sub-1"]["age_norm"] == 1.0
    assert out["sub-2"]["sex_code"] == 0 and out["sub-2"]["age_norm"] == 0.0
    p2 = tmp_path / "q.tsv"
    p2.write_text("participant_id\tAge\nx\t1\n")
    with pytest.raises(KeyError, match="Group"):
        metadata.participants(spark, str(p2))


def test_demographics_and_workbook(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id EEG,Diagnosis,Age,Sex\n s1 ,AD\xe9,71,1\n,CN,60,0\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"ID_EEG,diagnosis,age,sex\ns2,CN,n/a,0\n")
    out = {r["id"]: r for r in metadata.demographics(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert set(out) == {"s1", "s2"} and out["s1"]["diagnosis"] == "AD\xe9" and out["s2"]["age"] is None
    (tmp_path / "w.csv").write_text(" id ,Date , Age\n 5 , 2020.01.02 ,60\n")
    w = metadata.workbook(spark, [str(tmp_path / "none.csv"), str(tmp_path / "w.csv")]).first()
    assert (w["id"], w["Date"]) == ("5", "2020.01.02")


def test_release_inventory(spark):
    rows = [("p1/5-2020_01_02_a-resting.npz", 1), ("p2/5-2020_01_02_a-resting.npz", 1), ("p1/5-2020_01_02_a-video.npz", 2), ("p1/readme.md", 3)]
    files = spark.createDataFrame(rows, "path string, length bigint")
    inv = {r["kind"]: r for r in release.duplicate_counts(release.parsed(files), "kind").collect()}
    assert inv["resting"]["duplicate_filenames"] == 1 and inv["resting"]["duplicate_groups"] == 1 and inv["unknown"]["unique_files"] == 1
    a = release.fingerprint(files).first()[0]
    assert a == release.fingerprint(files.orderBy(F.desc("path")).repartition(5)).first()[0]
    assert a != release.fingerprint(files.withColumn("length", F.col("length") + 1)).first()[0]


def test_hash_tree_against_a_loop(spark, small_limits):
    import hashlib
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    rows = [(f"p{i * 7 % 23:02d}", i) for i in range(23)] + [("p05", 99), ("p05", 99), (None, 3), ("px", None)]
    files = spark.createDataFrame(rows, "path string, length bigint")
    key = lambda r: tuple((v is not None, v or "") if i == 0 else (v is not None, v or 0) for i, v in enumerate(r))
    level = [sha(f"{p or ''}:{'' if n is None else n}") for p, n in sorted(rows, key=key)]
    depth = 0
    while len(level) > 1:
        level, depth = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)], depth + 1
    assert tuple(release.fingerprint(files, 3).first()) == (level[0], len(rows), depth)
    tree = release.hash_tree(files, 3)
    root = F.lit(level[0])
    b = release.branches(tree, files, 3)
    got = b.select("path", "length", release.proven(F.col("path"), F.col("length"), F.col("steps"), root).alias("yes"),
                   release.proven(F.concat("path", F.lit("x")), F.col("length"), F.col("steps"), root).alias("no")).collect()
    assert len(got) == 24 and all(r["yes"] and not r["no"] for r in got)  # distinct known paths
    one = release.fingerprint(files.limit(1), 3).first()
    assert one["n_levels"] == 1 and one["n_files"] == 1
    assert tuple(release.fingerprint(files.limit(0), 3).first()) == (sha(""), 0, 0)


def test_cube_reads_only_the_condition_asked_for(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1, 0.5), ("c2", 1, None)], "cond string, subject int, value double")
    sinks.write_cube(df, str(tmp_path / "cube"))
    one = sinks.read_cube(spark, str(tmp_path / "cube"), ["c1"])
    assert one.count() == 1 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(cond" in one._jdf.queryExecution().toString()


def test_report_has_no_nan(spark):
    df = spark.createDataFrame([("a", float("nan"), float("inf"), 1.0)], "k string, x double, y double, z double")
    assert json.loads(sinks.as_json(df, ["k"]).first()["report"]) == {"x": None, "y": None, "z": 1.0}


def test_unmapped_label_stops(spark):
    df = spark.createDataFrame([("AD",), ("Alien",)], "g string")
    with pytest.raises(Exception, match="unmapped label Alien"):
        lb.normalise_labels(df, "g").collect()


def test_whole_tag_only(spark):
    df = spark.createDataFrame([("mci_ad",), ("ad;load",), (None,)], "s string")
    assert [r[0] for r in df.select(lb.has_tag(F.col("s"), "ad")).collect()] == [False, True, False]


def test_count_mismatch_stops(spark):
    a = spark.createDataFrame([("x", 3)], "cohort string, n bigint")
    b = spark.createDataFrame([("x", 3), ("y", 1)], "cohort string, n bigint")
    assert lb.check_counts(a, a, "cohort").first()["ok"]
    assert {r["cohort"]: r["ok"] for r in lb.check_counts(a, b, "cohort", halt=False).collect()} == {"x": True, "y": False}
    with pytest.raises(Exception, match="count mismatch for y"):
        lb.check_counts(a, b, "cohort").collect()


def test_preferred_match_falls_back_to_the_first_row(spark):
    ses = spark.createDataFrame([("s", "2020.01.02"), ("s", "2021.05.05")], "subject string, day string")
    meta = spark.createDataFrame([("s", "2019.01.01", 1, 60.0), ("s", "2020.01.02", 2, 61.0)], "subject string, mdate string, ord int, age double")
    out = {r["day"]: (r["matched"], r["age"]) for r in release.preferred_match(ses, meta, "subject", "day", "mdate", "ord").collect()}
    assert out == {"2020.01.02": (True, 61.0), "2021.05.05": (False, 60.0)}


def test_parity_reports_both_sides(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (2, 2.0), (4, 3.0)], "k int, v double")
    r = jn.parity(a, b, ["k"], "v").first()
    assert (r["n"], r["only_a"], r["only_b"], r["max_abs_diff"], r["same_nulls"]) == (4, 1, 1, 0.5, False)
