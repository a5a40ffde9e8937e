import random

from conftest import make_docs  # noqa: F401  (tests/llm/conftest.py)
from tidemark.llm import lines


def brute(rows, width=3):
    order = sorted({(i is None, i or 0, t) for i, t, _ in rows if t is not None})
    first, gone = {}, {}
    for none, i, t in order:
        cut = t.split("\n")
        for p in range(len(cut) - width + 1):
            w = tuple(cut[p:p + width])
            if any(x.strip(" \t\n\x0b\x0c\r") for x in w):
                first.setdefault(w, []).append((none, i, p))
    for none, i, t in order:
        cut, covered = t.split("\n"), set()
        for p in range(len(cut) - width + 1):
            w = tuple(cut[p:p + width])
            if w in first and (none, i, p) > min(first[w]):
                covered.update(range(p, p + width))
        gone[None if none else i, t] = "\n".join(x for p, x in enumerate(cut) if p not in covered)
    return sorted((i is None, i or 0, gone.get((i, t)) or "", t is None) for i, t, _ in rows)


def result(docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in lines.replaced(docs).collect())


def test_edges(edge_docs, edge_rows, no_docs):
    out = lines.replaced(edge_docs)
    assert out.columns == edge_docs.columns
    assert result(edge_docs) == brute(edge_rows)
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())
    assert lines.replaced(no_docs).collect() == []


def test_random(spark):
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(60)]), "\n".join(draw.choice("abc ") for _ in range(draw.randrange(9))), "s") for _ in range(80)]
    rows += [(i, "\n".join(["p", "q", "r", "s", *[f"own {i} {k}" for k in range(3)]]), "s") for i in range(100, 130)]
    assert result(make_docs(spark, rows)) == brute(rows)
