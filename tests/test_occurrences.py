"""Occurrences of many values in texts against str.count, and what an occurrence costs."""
import random
import sys
from collections import Counter

import pandas as pd
import pytest

from tidemark.operators import operating as op


def counted(rows, values):
    """{(name, key): [n, n_texts]} by one task."""
    out = {}
    for pdf in op._counter(values, ["k"])(iter([pd.DataFrame(rows, columns=["k", "t"])])):
        for name, key, n, n_texts in pdf.itertuples(index=False, name=None):
            held = out.setdefault((name, None if pd.isna(key) else key), [0, 0])
            held[0] += n
            held[1] += n_texts
    return out


def brute(rows, values):
    out = {}
    for key, text in rows:
        for name, value in values:
            if value in text:
                held = out.setdefault((name, key), [0, 0])
                held[0] += text.count(value)
                held[1] += 1
    return out


@pytest.mark.parametrize("name, limit", [("CHARS_AT_ONCE", 150), ("TOGETHER", 100), ("TABLE_CELLS", 4_000_000), ("TABLE_CELLS", 0), ("SHORT_VALUE", 1)])
def test_like_str_count(monkeypatch, name, limit):
    """Values that overlap themselves and each other, shared values, an unknown key, long runs; by table, by search, by automaton."""
    monkeypatch.setattr(op, name, limit)
    draw = random.Random(4)
    rows = [(draw.choice(["x", "y", None]), "".join(draw.choices("ab\u00e9 ", k=draw.randint(0, 60)))) for _ in range(300)]
    rows += [("x", "a" * 101), ("y", "ab" * 50 + "a"), (None, ""), ("x", "\U0001f600ab\U0001f600ab\U0001f600")]
    rows += [("y", "ab" * 150), ("x", "a"), ("x", "b\na\nb\n\n")]
    words = ["a", "ab", "aba", "aa", "aaa", "b\u00e9", "\u00e9 \u00e9", "\U0001f600ab\U0001f600", "ababab", "b", "\n", "a\nb", "zzz"]
    values = [(w, w) for w in words] + [("again", "aba")]
    assert counted(rows, values) == brute(rows, values)
    values.append(("long", "ab" * 40))
    assert counted(rows, values) == brute(rows, values)
    assert counted(rows, []) == {}


def test_an_occurrence_costs_no_step_of_python():
    """Texts that are full of values: lines run do not grow with the occurrences."""
    text, steps = "abc xyz " * 5000, Counter()

    def trace(frame, event, arg):
        if "operating" in frame.f_code.co_filename:
            steps[event] += 1
            return trace

    old = sys.gettrace()
    sys.settrace(trace)
    try:
        got = counted([("k", text)], [("abc", "abc"), ("xyz", "xyz"), ("bc ", "bc ")])
    finally:
        sys.settrace(old)
    assert got == {("abc", "k"): [5000, 1], ("xyz", "k"): [5000, 1], ("bc ", "k"): [5000, 1]}
    assert steps["line"] < 1000
