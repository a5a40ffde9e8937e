import numpy as np
from conftest import make_docs, prose
from pyspark.sql import functions as F

from tidemark.llm import mixing


def brute_targets(sizes):
    """Sources in order (null last); what is over a ceiling is shared anew until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def rows_of(docs):
    return mixing.placed(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "takes").collect()


def check(docs, near):
    rows = rows_of(docs)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.takes)
        assert len(r.takes) <= 2 and all(0 <= t <= 1 for t in r.takes) and (r.size or not r.takes)
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= near(s, t), (s, taken[s], t)
    return rows


def test_edges(edge_docs, edge_rows, no_docs):
    largest = {}
    for _, t, s in edge_rows:
        largest[s] = max(largest.get(s, 0), len((t or "").split()))
    rows = check(edge_docs, lambda s, t: largest[s])
    assert len(rows) == len(edge_rows)
    mixed = mixing.mix(edge_docs)
    assert mixed.columns == edge_docs.columns and mixed.count() == sum(len(r.takes) for r in rows)
    assert rows_of(no_docs) == [] and mixing.mix(no_docs).collect() == []


def test_near_target_and_reruns(spark):
    draw = np.random.default_rng(1)
    rows = [(k, prose(k, int(draw.lognormal(4, 1)) + 1), "hot" if k % 3 else f"s{k % 17}") for k in range(900)]
    docs = make_docs(spark, rows)
    first = check(docs, lambda s, t: max(40, 0.02 * t))
    again = rows_of(docs.repartition(13))
    key = lambda r: (r.doc_id, tuple(r.takes))
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_one_source_and_positions(spark):
    docs = make_docs(spark, [(k, prose(k, 50), "s") for k in range(64)])
    rows = check(docs, lambda s, t: 50)
    times = np.sort([t for r in rows for t in r.takes])
    # The integral of the schedule up to each position is the share of words before it.
    knots = np.interp(np.linspace(0, 1, 2001), np.linspace(0, 1, 3), mixing.SCHEDULES[0])
    used = np.concatenate([[0], np.cumsum((knots[1:] + knots[:-1]) / 2)])
    share = np.interp(times, np.linspace(0, 1, 2001), used / used[-1])
    assert np.allclose(share, np.arange(len(times)) / len(times), atol=1e-4)
    ordered = mixing.mix(docs).select("doc_id").toPandas()["doc_id"].tolist()
    first = {}
    for r in rows:
        for t in r.takes:
            first.setdefault(t, set()).add(r.doc_id)
    assert ordered == [next(iter(first[t])) for t in sorted(first)]


def test_position_of_flat_schedule(spark):
    row = spark.range(1).select(*[mixing.position(F.lit(x), (1.0, 1.0)).alias(f"p{i}") for i, x in enumerate((0.0, 0.25, 1.0))]).first()
    assert np.allclose(list(row), [0, 0.25, 1])


def gap_and_least(docs):
    """Words over the target of each source, and the least document that the last pass has not taken."""
    over, least, last = {}, {}, {}
    for r in rows_of(docs):
        last[r.source] = int(r.target // r.source_size)
        over[r.source] = over.get(r.source, -r.target) + r.size * len(r.takes)
        if len(r.takes) == last[r.source]:
            least[r.source] = min(r.size, least.get(r.source, r.size))
    return over, least


def test_gap_before_a_long_document_is_filled(spark):
    """The long document straddles the target; short ones after it, more than a task would list, fill the gap."""
    rows = [(k, "w " * (1 + k % 9), "s") for k in range(4000)] + [(-1, "long " * 20_000, "s")]
    over, least = gap_and_least(make_docs(spark, rows))
    assert abs(over["s"]) <= least["s"] / 2
    taken = [r for r in rows_of(make_docs(spark, rows)) if r.doc_id >= 0 and len(r.takes) == 2]
    # Words that fill the gap keep to the schedule instead of piling up at the end.
    assert max(sum(t == x for r in taken for t in r.takes) for x in {t for r in taken for t in r.takes}) == 1


def test_long_document_is_placed_whole_where_nearer(spark):
    rows = [(0, "long " * 20_000, "a"), (1, "w " * 300, "a"), (2, "w " * 40_000, "b"), (3, "w", "b"), (4, "w " * 9000, "c")]
    docs = make_docs(spark, rows)
    over, least = gap_and_least(docs)
    for s, x in over.items():
        size = sum(len(t.split()) for _, t, o in rows if o == s)
        target = next(r.target for r in rows_of(docs) if r.source == s)
        assert target + x <= 2 * size
        assert abs(x) <= least.get(s, 1) / 2
