import collections
import random
import re

import numpy as np
from conftest import make_docs, prose
from pyspark.sql import functions as F

from tidemark.llm import quality, rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(covered), failed)


def labelled(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_base_against_brute_force(spark, edge_docs, edge_rows, no_docs):
    docs, labels = labelled(spark)
    model = rules.train(docs, labels)
    for some, texts in ((docs, {r.doc_id: r.text for r in docs.collect()}), (edge_docs, {i: t for i, t, _ in edge_rows})):
        rows = some.select("doc_id", rules.judged(model, some["text"]).alias("v")).select("doc_id", "v.*").collect()
        assert len(rows) == some.count()
        for r in rows:
            assert (*[r[c] for c in rules.BASE], r.base_failed) == brute(texts[r.doc_id])
            assert 0 <= r.score <= 1 and r.kept == (not r.base_failed and r.score >= rules.CUT)
    kept = rules.accepted(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert rules.accepted(no_docs, model).collect() == []


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = rules.train(docs, labels)
    v = rules.judged(model, F.col("text"))
    rows = docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("quality", v.alias("v")).select("quality", "v.*").toPandas()
    right = (rows["score"] >= rules.CUT) == (rows["quality"] == 1)
    assert right.mean() > 0.95 and right[rows["quality"] == 0].mean() > 0.85


def test_one_class_and_ties(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, None), (None, 0)], "doc_id long, quality int")
    model = rules.train(edge_docs, labels)
    assert {r[0] for r in edge_docs.select(rules.judged(model, edge_docs["text"])["score"]).collect()} == {0.5}


def sample(n=3_000):
    draw = np.random.default_rng(2)
    x = draw.random((n, len(rules.FEATURES)))
    y = (x[:, 0] + 0.5 * np.sin(6 * x[:, 5]) - 0.3 * x[:, 2] + draw.normal(size=n) * 0.2 < 0.5).astype(float)
    return x, y


def test_monotonic():
    x, y = sample()
    y = np.where(np.random.default_rng(5).random(len(y)) < 0.3, 1 - y, y)
    model = rules.fit(x, y)
    for name in rules.FALLING:
        j = rules.FEATURES.index(name)
        grid = np.repeat(x[:200], 30, axis=0)
        grid[:, j] = np.tile(np.linspace(-0.1, 1.1, 30), 200)
        assert (np.diff(model.margins(grid).reshape(200, 30), axis=1) <= 1e-12).all(), name


def test_flat_trees_like_recursion():
    x, y = sample(800)
    model = rules.fit(x, y, trees=12)

    def walk(row, node):
        if model.left[node] == node:
            return model.value[node]
        return walk(row, model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node])

    want = [model.start + sum(walk(row, r) for r in model.roots) for row in x]
    assert np.allclose(model.margins(x), want)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_repeats():
    draw = random.Random(7)
    for _ in range(300):
        words = [draw.choice("abcd") for _ in range(draw.randrange(0, 30))]
        assert rules.repeated_words(words) == brute(" ".join(words))[4]
    assert rules.repeated_words(prose(1, 50_000, 10**9).split()) == 0


def test_null_row_kept_out(spark):
    docs = make_docs(spark, [(1, None, None), (2, "", "a")])
    model = rules.fit(*sample(500))
    assert {r[0] for r in docs.select(rules.judged(model, docs["text"])["kept"]).collect()} == {False}
