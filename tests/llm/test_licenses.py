import random
import re

from conftest import make_docs, prose

from tidemark.llm import licenses


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(text, catalogue=licenses.CATALOGUE):
    """Licenses with a stretch of the text that holds enough shingles of a template."""
    own, found = words(text), set()
    for name, template in catalogue:
        t = words(template)
        width = min(5, len(t))
        wanted = {tuple(t[i:i + width]) for i in range(len(t) - width + 1)}
        room = max(2, len(t) // 4)
        has = [tuple(own[i:i + width]) for i in range(len(own) - width + 1)]
        for start in range(-len(t), len(own)):
            low, high = max(0, start - room), start + len(t) + room - width + 1
            if len(wanted & set(has[low:max(low, high)])) / len(wanted) >= 0.8:
                found.add(name)
                break
    return found


def test_copies_and_edits(spark):
    draw, rows = random.Random(6), []
    for k in range(120):
        name, text = licenses.CATALOGUE[k % len(licenses.CATALOGUE)]
        cut = text.split()
        for _ in range(k // 40):
            cut[draw.randrange(len(cut))] = "changed"
        body = prose(k, draw.randrange(0, 60)) + draw.choice([" ", "\n", ".\n"]) + " ".join(cut) + " " + prose(k + 500, draw.randrange(0, 60))
        rows.append((k, body, "s"))
    rows += [(200, "All rights", "s"), (201, "ALL RIGHTS RESERVED", "s"), (202, " ".join(t for _, t in licenses.CATALOGUE), "s"), (203, prose(9, 900), "s")]
    got = {(r.doc_id, r.license) for r in licenses.scan(make_docs(spark, rows)).collect()}
    assert got == {(i, name) for i, text, _ in rows for name in brute(text)}


def test_edges(edge_docs, no_docs, spark):
    assert licenses.scan(edge_docs).collect() == [] and licenses.scan(no_docs).collect() == []
    docs = make_docs(spark, [(None, "All rights reserved.", "s"), (1, "Released under the MIT License.", "s"), (1, "Released under the MIT License.", "s"),
                             (2, prose(1, 20_000) + " Licensed under CC BY-NC 4.0.", "s"), (3, "All rights reserved. " * 3_000, "s")])
    got = sorted((r.doc_id or -1, r.license, r.containment, r.first_word) for r in licenses.scan(docs).collect())
    assert got == [(-1, "All-rights-reserved", 1.0, 0), (1, "MIT", 1.0, 0), (2, "CC-BY-NC-4.0", 1.0, 20_000), (3, "All-rights-reserved", 1.0, 0)]
    assert licenses.scan(docs, ()).collect() == []
