import collections
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from conftest import make_docs, prose
from tokenizers import Tokenizer

from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["It's THE end!! don't 123 4,5", "a b c　d", "<|endoftext|> x<s> </s><unk> <0x41>", "  \t tab\r\nline ", "x ", " ", "   ", "\n \n  a  \n",
       "\x1c\x1d\x85 weird\x00 nul", "ﬁ ǅ İst①", "漢字 かな😀👍🏽 한국어", "block ▁ sign▁x", "...!!!???", "a  b  c　 d", "'s 'S can'T", "tail \n",
       "a\n  b\n c   d"]


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = alignment.Reader(A, B).a_bytes

    def tokens(text):
        """Ids and end offsets of a whole text."""
        want = (" " + text).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        own = [[byte_of[i] for i in ids[0]],
               [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], map(b.id_to_piece, ids[1]))]]
        if not text or any(b"".join(x) != want for x in own):
            return None
        return [(i, np.cumsum([len(x) for x in o]).tolist()) for i, o in zip(ids, own)]

    return tokens


def expected(texts, tokens):
    links, rows = [], []
    for text in texts:
        got = tokens(text) if text else None
        if got is None:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        (a, ae), (b, be) = got
        cuts = sorted(set(ae) & set(be))
        groups, at = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(a, ae) if at < e <= c) + "|" + ",".join(str(x) for x, e in zip(b, be) if at < e <= c))
            at = c
        rows.append((len(a), len(b), len(groups), ";".join(groups)))
        links.append([(x, y) for x, xe, xs in zip(a, ae, [0, *ae]) for y, ye, ys in zip(b, be, [0, *be]) if xs < ye and ys < xe])
    n = collections.Counter(p for row in links for p in row)
    best = collections.defaultdict(int)
    for (_, y), c in n.items():
        best[y] = max(best[y], c)
    return [(*r[:3], len(ln), sum(n[p] == best[p[1]] for p in ln), sum(n[p] for p in ln), r[3]) for r, ln in zip(rows, links)]


def check(docs, rows, tokens, **options):
    got = alignment.aligned(docs, A, B, **options).collect()
    want = expected([t for _, t, _ in rows], tokens)
    assert sorted((r.doc_id or -1, *tuple(r)[1:]) for r in got) == sorted((i or -1, *w) for (i, _, _), w in zip(rows, want))


def short(rows):
    # Brute force pairs all tokens of a text.
    return [(i, t and t[:3_000], s) for i, t, s in rows]


def test_edges(edge_rows, spark, brute, no_docs):
    rows = short(edge_rows)
    check(make_docs(spark, rows), rows, brute)
    assert alignment.aligned(no_docs, A, B).collect() == []


@pytest.mark.parametrize("options", [{"chunk": 40, "fanout": 2}, {"chunk": 7, "fanout": 3, "frequent": 10}, {"frequent": 50}])
def test_ranges_and_rare_pairs(spark, brute, options):
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choice([*ODD, prose(k, 3), "comma,joined.words!here"]) for _ in range(draw.randrange(1, 9))), "s") for k in range(60)]
    rows += [(100 + k, t, "s") for k, t in enumerate(ODD)] + [(7, rows[7][1], "s"), (None, "<|endoftext|>", None), (200, None, "s"), (201, "y" * 300, "s")]
    check(make_docs(spark, rows).repartition(5), rows, brute, **options)


def test_very_long_text(edge_docs, edge_rows, brute):
    got = {r.doc_id: r for r in alignment.aligned(edge_docs, A, B).collect()}
    for i, text, _ in edge_rows:
        if i in (7, 8):
            (a, ae), (b, be) = brute(text)
            assert (got[i].n_a, got[i].n_b, got[i].n_groups) == (len(a), len(b), len(set(ae) & set(be)))
            ids = [[x.split(",") for x in g.split("|")] for g in got[i].groups.split(";")]
            assert [int(x) for g in ids for x in g[0]] == a and [int(x) for g in ids for x in g[1]] == b


def test_product_is_associative(brute):
    draw, reader = random.Random(9), alignment.Reader(A, B)
    none = np.empty(0, np.int64)
    for _ in range(200):
        text = "".join(draw.choice(["the ", "dog", ",", " run", "ning", "é", "漢", "\n", " of"]) for _ in range(30))
        got = brute(text)
        (a, ae), (b, be) = got
        at = [sorted(draw.sample(range(len(x) + 1), 3)) for x in (a, b)]
        leaves, closed = [], []

        def times(x, y):
            product, closing = alignment.compose(x, y)
            closed.extend([closing] if closing else [])
            return product

        for i, j, k, m in zip([0, *at[0]], [*at[0], len(a)], [0, *at[1]], [*at[1], len(b)]):
            own = alignment.Fragment(*[np.array(x, np.int64) for x in (a[i:j], ae[i:j], b[k:m], be[k:m])])
            leaves.append(times(alignment.Fragment(none, none, none, none), own))
        p, q, r, s = leaves
        p = times(alignment.Fragment.start(), p)
        root = draw.choice([lambda: times(times(times(p, q), r), s), lambda: times(p, times(q, times(r, s))),
                            lambda: times(times(p, q), times(r, s)), lambda: times(p, times(times(q, r), s))])()
        groups = [g for c in sorted(closed) for g in c[1]]
        assert groups == expected([text], brute)[0][-1].split(";") and not len(root.a) and not len(root.b)
    assert reader.ids("", "") == ([], [], True)


def test_pairs_are_counted_by_few_documents():
    """A batch of many long documents is never unfolded as a whole."""
    batch = pa.RecordBatch.from_pydict({"pairs": [np.arange(i % 9, dtype=np.int32).tobytes() for i in range(1000)], "i": list(range(1000))})
    parts = list(alignment._few([batch.slice(0, 0), batch]))
    assert max(p.num_rows for p in parts) <= alignment.DOCS_AT_ONCE and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_later_stages_hold_no_reader(spark):
    """What a worker has read with is dropped before pairs are counted or looked up."""
    links = spark.createDataFrame([(1, b"\x01\x00\x00\x00", b"\x02\x00\x00\x00")], "key int, pairs binary, ns binary")
    alignment._READERS["a", "b"] = None
    alignment._forget()
    assert not alignment._READERS
    held = spark.sparkContext.broadcast((np.array([1], np.int32), np.array([5]), np.array([1])))
    assert [(r.count_sum, r.n_best) for r in alignment._looked_up(links, held).collect()] == [(10, 2)]
    assert [(r.pair, r.n) for r in alignment._counts(links).collect()] == [(1, 2)]
