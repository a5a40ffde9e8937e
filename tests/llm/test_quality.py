import random

import numpy as np
from conftest import make_docs, prose
from pyspark.sql import functions as F

from tidemark.llm import quality


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("quality", quality.score(model, F.col("text")).alias("s")).toPandas()
    right = (rows["s"] >= quality.CUT) == (rows["quality"] == 1)
    assert right.mean() > 0.95 and right[rows["quality"] == 0].mean() > 0.85


def test_pairs_are_ranked():
    draw = random.Random(1)
    good = [prose(k, draw.randrange(5, 200)) + "." for k in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(k, draw.randrange(5, 200)).split()) for k in range(40)]
    x, y = quality.features(good + bad), np.array([1] * 150 + [0] * 40)
    scores = quality.fit_pairs(x, y).scores(x)
    assert ((scores >= quality.CUT) == (y == 1)).mean() > 0.98


def test_edges(edge_docs, edge_rows, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0, ""), (2, 0, 0, ""), (2, 0, 0, ""), (4, None, 0, ""), (None, 1, 0, ""), (7, 1, None, "")],
                                   "doc_id long, quality int, toxic int, text string")
    model = quality.train(edge_docs, labels)
    scores = [r[0] for r in edge_docs.select(quality.score(model, edge_docs["text"])).collect()]
    assert len(scores) == len(edge_rows) and all(0 <= s <= 1 for s in scores)
    kept = quality.accepted(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(s >= quality.CUT for s in scores)
    for none in (labels.where("false"), labels.where("quality = 1")):
        flat = quality.train(edge_docs, none)
        assert {r[0] for r in edge_docs.select(quality.score(flat, edge_docs["text"])).collect()} == {0.5}
    assert quality.accepted(no_docs, model).collect() == []


def test_sample_is_bounded(spark):
    docs = make_docs(spark, [(k, prose(k, 5), "s") for k in range(200)])
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = quality.training_rows(docs, labels, 50)
    assert rows.count() == 50 and rows.where(quality.held_out(F.col("id"))).count() == 0


def brute_ranker(x, y, partners, ridge=1e-3):
    """Pair after pair: the weights where the summed gradient of the logistic loss vanishes, and the cut of the widest gap."""
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.clip((x - mean) / sd, -8, 8)
    good, bad = [i for i, c in enumerate(y) if c == 1], [i for i, c in enumerate(y) if c == 0]
    draw = np.random.default_rng(17)
    winners = [g for g in good for _ in range(partners)] + list(draw.choice(good, len(bad) * partners))
    losers = list(draw.choice(bad, len(good) * partners)) + [b for b in bad for _ in range(partners)]
    pairs = [z[a] - z[b] for a, b in zip(winners, losers)]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        gradient, hessian = -ridge * w, ridge * np.eye(len(w))
        for d in pairs:
            p = 1 / (1 + np.exp(d @ w))
            gradient = gradient + d * p / len(pairs)
            hessian = hessian + np.outer(d, d) * (p * (1 - p)) / len(pairs)
        w = w + np.linalg.solve(hessian, gradient)
        if np.abs(gradient).max() < 1e-13:
            break
    s = z @ w
    q = np.quantile(s, np.linspace(0.002, 0.998, 499))
    gain = [np.mean([s[i] < c for i in bad]) - np.mean([s[i] < c for i in good]) for c in q]
    best = [c for c, g in zip(q, gain) if g >= max(gain) - 1e-12]
    cut = (best[0] + best[-1]) / 2
    raw = np.log(quality.CUT / (1 - quality.CUT)) + (s - cut) / (max(1e-6, s.std()) / 4)
    return w, 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query: its own training rows, weights, scores and verdicts, one document after the other."""
    import zlib

    from tidemark.llm.queries import QUERIES

    draw = random.Random(3)
    rows = [(k, prose(k, draw.randrange(4, 80)) + "." if k % 3 else " ".join(w.upper() + "##" for w in prose(k, draw.randrange(4, 60)).split()), "s")
            for k in range(90)]
    labels = [(k, int(k % 3 > 0) if k % 11 else int(k % 2), 0) for k, *_ in rows]  # some labels are wrong
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, str(tmp_path)).collect()}

    learn = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5]
    x = quality.features([rows[k][1] for k in learn])
    w, scores = brute_ranker(x, [labels[k][1] for k in learn], quality.PARTNERS)
    assert np.allclose(quality.fit_pairs(x, np.array([labels[k][1] for k in learn])).weights, w, atol=1e-6)
    assert len(got) == len(rows) and all(got[k].held_out == (k not in learn) for k in got)
    assert all(abs(got[k].score - s) < 1e-6 for k, s in zip(learn, scores))
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
