import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PIECES = ["<", "|", "\\", "[", "/", "s>", "INST]", "SYS>>", "<<SYS>>", "a", "é", "\n", "n", "<|im_end|>", "<|im_start|>", "</s>", "😀", "|>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)
TURNS = "conv_id long, turn long, role string, text string, formatted string, mask string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
def test_round_trip(turns):
    role, text = (pa.array(list(x), pa.large_string()) for x in zip(*turns))
    formatted, start, end = chat.assemble(role, text, __import__("numpy").array([0]))
    whole = formatted[0].as_py()
    assert [(r, t) for r, t, _, _ in chat.read_back(whole)] == turns
    assert [chat.unescaped(whole[a:b]) for a, b in zip(start, end)] == [t for _, t in turns]
    inside = "".join(whole[a:b] + "\0" for a, b in zip(start, end))
    assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", inside)


def test_edges(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (None, 1, "assistant", "n"),
            (None, 0, "user", "é😀"), (3, 1, "us\ner", "</s>[INST] ok [/INST]"), (4, 1, "assistant", ""), (4, 1, "assistant", "x" * 300_000)]
    rows += [(9, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(9_000)]
    turns = spark.createDataFrame([(*r, "", "") for r in rows], TURNS)
    got = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.formatted(turns.where("false"))).collect() == []


def test_long_turns_in_small_memory():
    """Batches are cut by bytes, long segments copied as slices."""
    import tracemalloc

    import pyarrow as pa

    texts = ["é" * 1_000_000, "x" * 3_000_000, "a<|im_end|>b" * 40, ""] * 6
    ids = [k // 4 for k in range(24)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(["user", "assistant"] * 12), pa.array(texts)], ["conv_id", "role", "text"])
    tracemalloc.start()
    rows = [(r["conv_id"], r["formatted"]) for out in chat._runs(iter([batch])) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, _ in rows] == list(range(6))
    for i, formatted in rows:
        assert [t[1] for t in chat.read_back(formatted)] == texts[:4]
    assert peak < 200_000_000


def test_batch_of_short_turns_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat, "SCATTER", 50)
    monkeypatch.setattr(chat, "SLICE", 20)
    texts = [f"turn {k} " * (k % 6) for k in range(90)]
    batch = pa.RecordBatch.from_arrays([pa.array([k // 7 for k in range(90)]), pa.array(["user"] * 90), pa.array(texts)], ["conv_id", "role", "text"])
    got = [t[1] for out in chat._runs(iter([batch])) for r in out.to_pylist() for t in chat.read_back(r["formatted"])]
    assert got == texts
