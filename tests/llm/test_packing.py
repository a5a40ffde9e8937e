import random
import zlib

import numpy as np
import public_tokenizers
from conftest import make_docs, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's THE end!! don't 123 4,5", "a b c　d", "é ́x Ω ΟΔΟΣ ΣΑΣ", "<|endoftext|> x<|startoftext|>y", "  \t tab\r\nline ",
       "\x1c\x1d\x85weird\x00", "naïve ﬁ ǅ İstanbul", "漢字かな😀👍🏽", "'s 'S can'T", "x" * 5_000, "...!!!???", "a_b-c@d.e"]


def test_words_like_whole_texts():
    whole, own = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    draw = random.Random(3)
    latin = [chr(c) for c in range(1, 256)]
    wide = [*latin, *"ΣςΩ漢字ｱﬁ̈́ İıǅ½Ⅷ٣😀\u200d\u2028\ufeff", "'s", "'LL", "<|", "|>", " ", " "]
    noise = ["".join(draw.choice(pool) for _ in range(draw.randrange(1, 30))) for pool in (latin, wide) for _ in range(3_000)]
    for text in [*ODD, " ".join(ODD), prose(1, 500), "", *noise]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check(docs, rows):
    whole = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH).withColumn("crc", F.crc32("ids")).collect()
    want = []
    for i, text, _ in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        while at < len(ids):
            n = 1 << min(12, (len(ids) - at).bit_length() - 1)
            want.append((i or -1, at, n, len(ids), zlib.crc32(ids[at:at + n].tobytes())))
            at += n
    assert sorted((r.doc_id or -1, r.start, r.length, r.doc_tokens, r.crc) for r in got) == sorted(want)
    assert all(len(r.ids) == 4 * r.length and r.offset == 0 for r in got)
    by_id = sorted(got, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_id] == list(range(len(got)))
    assert [r.length for r in by_id] == sorted((r.length for r in got), reverse=True)


def test_edges(edge_docs, edge_rows, no_docs):
    check(edge_docs, edge_rows)
    assert packing.pack(no_docs, PATH).collect() == []


def test_many_tasks(spark):
    rows = [(k, prose(k, 10 + 37 * (k % 90)) + " " + ODD[k % len(ODD)], "s") for k in range(150)]
    check(make_docs(spark, rows).repartition(9), rows)


def test_memory_is_bounded():
    own = packing.Remembering(lambda k: k.encode(), 10)
    for k in range(1_000):
        assert own[str(k % 7)] == str(k % 7).encode() and own[f"x{k}"] == f"x{k}".encode()
        assert len(own) <= 10 and len(own.old) <= 10
