import re

import xxhash
from conftest import make_docs, prose
from pyspark.sql import functions as F

from tidemark.llm import syncmers


def chained(parts, seed=42):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_anchors(text, k=6, s=2):
    pieces = [p.encode() for p in re.findall(r"[^\x20\x09-\x0D]{1,4}", text or "")]
    inner = [chained(pieces[i:i + s]) for i in range(len(pieces) - s + 1)]
    out = []
    for i in range(len(pieces) - k + 1):
        window = [signed(h) for h in inner[i:i + k - s + 1]]
        if min(window) in (window[0], window[-1]):
            out.append((i, signed(chained(inner[i:i + k - s + 1:s]))))
    return out or ([(0, signed(chained(pieces)))] if pieces else [])


def likeness(a, b):
    least = sorted(set(a) | set(b))[:64]
    return sum(x in a and x in b for x in least) / len(least) if least else 1.0


def sketch(text):
    return sorted({h for _, h in brute_anchors(text)})[:64]


def check(docs, rows):
    got = {}
    for r in syncmers.compared(docs).select("*", syncmers.likeness(F.col("marks"), F.col("edited_marks")).alias("near"),
                                            syncmers.likeness(F.col("marks"), F.col("next_marks")).alias("next")).collect():
        got.setdefault((r.doc_id, r.text), []).append(r)
    order = sorted(((i is None, i or 0, t or "") for i, t, _ in rows))
    assert sum(map(len, got.values())) == len(order)
    for n, (none, i, text) in enumerate(order):
        following = order[(n + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        near, nxt = likeness(sketch(text), sketch(edited)), likeness(sketch(text), sketch(following))
        assert any(r.edited == edited and r.marks == sketch(text) and r.edited_marks == sketch(edited)
                   and abs(r.near - near) < 1e-12 and abs(r.next - nxt) < 1e-12 for r in got[None if none else i, text]), (i, n)


def test_edges(edge_docs, edge_rows, no_docs):
    check(edge_docs, edge_rows)
    assert syncmers.compared(no_docs).collect() == []


def test_random(spark):
    rows = [(k * 7 - 300, prose(k, k % 70), "s") for k in range(150)]
    check(make_docs(spark, rows), rows)
    check(make_docs(spark, rows[:1]), rows[:1])


def test_anchors_do_not_depend_on_context(spark):
    inside = prose(1, 200)
    rows = spark.createDataFrame([(inside,), (prose(2, 50) + " " + inside + " " + prose(3, 50),)], "text string")
    own, far = [r[0] for r in rows.select(syncmers.anchors(F.col("text"))).collect()]
    assert [(a["at"], a["hash"]) for a in own] == brute_anchors(inside)
    assert {a["hash"] for a in own} <= {a["hash"] for a in far}
    gaps = [b["at"] - a["at"] for a, b in zip(own, own[1:])]
    assert max(gaps) <= syncmers.K - syncmers.S + 1


def brute_agreement(a, b):
    a, b = [{(h, q - p, g) for (p, h), (q, g) in zip(x, x[1:])} | {("end", h) for _, h in x[-1:]} for x in (a, b)]
    return len(a & b) / len(a | b) if a | b else 1.0


def test_all_anchors_and_positional_matching(spark):
    words, passage = prose(5, 5000).split(), prose(6, 50)
    changed = " ".join(words[:2500] + ["changed"] + words[2501:])
    texts = [" ".join(words), changed, " ".join(words[:100]) + " " + passage + " " + " ".join(words[100:]),
             prose(7, 3000) + " " + passage + " " + prose(8, 2000), "", "one", "x" * 20_000]
    rows = spark.createDataFrame([(i, j, texts[i], texts[j]) for i in range(len(texts)) for j in range(i, len(texts))], "i int, j int, a string, b string")
    rows = rows.select("i", "j", syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    near = {(r.i, r.j): r.near for r in rows.select("i", "j", syncmers.agreement(F.col("a"), F.col("b")).alias("near")).collect()}
    found = [brute_anchors(t) for t in texts]
    assert all(abs(x - brute_agreement(found[i], found[j])) < 1e-12 for (i, j), x in near.items())
    # One changed word shows, and a shared passage at different places is found.
    assert 0.99 < near[0, 1] < 1 and near[2, 3] > 0.003 and near[0, 3] == 0


def test_query_returns_every_anchor(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rows = [(k, prose(20 + k, 600), "s") for k in range(3)]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, str(tmp_path)).collect()}
    for k, text, _ in rows:
        following = rows[(k + 1) % 3][1]
        edited = brute_anchors(text[:len(text) - len(text) // 2] + following[:len(text) // 2])
        assert [tuple(a) for a in got[k].anchors] == brute_anchors(text) and [tuple(a) for a in got[k].edited_anchors] == edited
        assert abs(got[k].near_edited - brute_agreement(brute_anchors(text), edited)) < 1e-12
        assert abs(got[k].near_next - brute_agreement(brute_anchors(text), brute_anchors(following))) < 1e-12


def test_likeness_is_that_of_the_returned_fingerprints(spark, tmp_path):
    """The fingerprint as written decides the likeness; a text with one word changed has another one."""
    from tidemark.llm.queries import QUERIES

    words = prose(40, 900).split()
    rows = [(1, " ".join(words), "s"), (2, " ".join(words[:400] + ["changed"] + words[401:]), "s"), (3, " ".join(words), "s"), (4, "", "s"),
            (5, None, "s"), (6, "one", "s"), (7, prose(41, 30), "s")]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, str(tmp_path)).collect()}

    def near(a, b):
        a, b = [{x[i:i + 16] for i in range(0, len(x), 16)} for x in (a, b)]
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, r in got.items():
        assert abs(r.near_edited - near(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - near(r.fingerprint, got[k % 7 + 1].fingerprint)) < 1e-12
        assert len(r.fingerprint) == 16 * len(r.anchors) and len(r.edited_fingerprint) == 16 * len(r.edited_anchors)
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[4].fingerprint == got[5].fingerprint == ""
