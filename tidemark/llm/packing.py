"""Packing by power-of-two decomposition.

The tokens of a document (its ids, then one end id) are cut into pieces whose lengths are powers of two: whole
pieces of the longest length first, then the binary digits of the rest, longest first. Each piece is one sequence; sequences of equal length
form a bucket. So no sequence crosses documents and none needs padding.

Sequence ids count through the buckets, longest first, without gaps: the tokenising task numbers its own pieces, the
totals of the tasks are added up, and no token is shuffled. They follow the layout of the input, and are fixed once written.

Defined results: a null or empty text is one piece that holds the end id only; repeated rows are packed once each; no row has no
pieces.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.session import stored

LONGEST_BITS = 12
END_ID = 2
#: Entries of a worker's memories of parts, and of runs of the few texts that need them, in the young and in the old half.
PARTS, RUNS = 200_000, 20_000
_TOKENIZERS: dict[str, "WordTokenizer"] = {}
#: The vocabulary's own rule for lower-case text below U+0100: contractions, letters, single numerals, runs of the rest.
_LETTERS, _NUMERALS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMERALS}]|[^\s{_LETTERS}{_NUMERALS}]+")
#: What the rule cannot take: characters from U+0100 on, controls and spaces that libraries disagree on, and special tokens.
_ODD = re.compile(r"[^\t\n\x0b\x0c\r -~\u00a1-\u00ff]|<\|")


class Remembering(dict):
    """A mapping that computes missing values and forgets those not asked for of late."""

    def __init__(self, compute, half: int):
        super().__init__()
        self.compute, self.half, self.old = compute, half, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Ids of texts by a tokenizer whose tokens cross neither white space nor the parts of a word, remembering parts.

    Texts with characters outside of the plain rule are cut at spaces and line feeds only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.runs = Remembering(self._part, PARTS), Remembering(self._run, RUNS)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            (part, _), = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
        return np.array([t.id for t in self.tokenizer.model.tokenize(part)], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def _run(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _ODD.search(text):
            return self._plain(text)
        runs = text.replace("\n", " ").split(" ")
        return b"".join([self._plain(r) if not _ODD.search(r) else self.runs[r] for r in runs])


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenised(docs: DataFrame, tokenizer: str, longest_bits: int = LONGEST_BITS, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit), ``task`` and ``before``: the pieces of each length (power) that this task
    has made before."""
    powers = np.arange(longest_bits + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, done = _tokenizer(tokenizer), TaskContext.get().partitionId(), np.zeros(longest_bits + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            step = 500
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [encode.ids(t) + end for t in part.column(1).to_pylist()]
                lengths = np.array([len(r) for r in rows], np.int64) // 4
                made = (lengths[:, None] >> powers) & 1
                made[:, longest_bits] = lengths >> longest_bits
                before = np.cumsum(made, axis=0) - made + done
                done = done + made.sum(axis=0)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(rows, pa.binary()), pa.array(np.full(len(rows), task), pa.int32()), pa.array(list(before), pa.list_(pa.int64())),
                ], ["doc_id", "ids", "task", "before"])

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids binary, task int, before array<bigint>")


def _made(length: Column, power: int, longest_bits: int) -> Column:
    count = F.shiftright(length, power)
    return count if power == longest_bits else count.bitwiseAND(F.lit(1))


def pack(docs: DataFrame, tokenizer: str, longest_bits: int = LONGEST_BITS, end_id: int = END_ID) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ids are little-endian unsigned 32-bit numbers."""
    powers = range(longest_bits, -1, -1)
    rows = stored(tokenised(docs, tokenizer, longest_bits, end_id), "tokenised")
    length = F.shiftright(F.octet_length("ids"), 2)
    # One row a task: what it has made of each length, then what all tasks before it and all longer buckets have made.
    totals = rows.groupBy("task").agg(*[F.sum(_made(length, p, longest_bits)).alias(f"n{p}") for p in powers])
    ordered = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base, bases = F.lit(0).cast("long"), []
    for p in powers:
        bases.append((F.coalesce(F.sum(f"n{p}").over(ordered), F.lit(0)) + base).alias(f"b{p}"))
        base = base + F.sum(f"n{p}").over(every)
    # Written, so that the join knows its size: one row a task is sent around only while it is small.
    totals = stored(totals.select("task", F.array(*reversed(bases)).alias("bases")), "totals")
    joined = rows.join(totals, "task").select(
        "doc_id", "ids", length.alias("n"), F.zip_with("before", "bases", lambda a, b: a + b).alias("first"))
    top = 1 << longest_bits
    wholes = F.shiftright("n", longest_bits)
    rest = F.col("n") - F.shiftleft(wholes, longest_bits)
    long_pieces = F.when(wholes > 0, F.transform(F.sequence(F.lit(0), wholes - 1), lambda i: F.struct(
        (i * top).alias("start"), F.lit(top).alias("length"), (F.element_at("first", longest_bits + 1) + i).alias("seq"))))
    short_pieces = F.filter(F.array(*[F.struct(
        (F.col("n") - rest.bitwiseAND(F.lit((2 << p) - 1))).alias("start"),
        rest.bitwiseAND(F.lit(1 << p)).alias("length"),
        F.element_at("first", p + 1).alias("seq")) for p in powers if p < longest_bits]), lambda x: x["length"] > 0)
    empty = F.lit([]).cast("array<struct<start:int,length:int,seq:bigint>>")
    pieces = joined.select("doc_id", "ids", "n", F.explode(F.concat(F.coalesce(long_pieces, empty), short_pieces)).alias("piece"))
    return pieces.select(
        "doc_id", F.col("piece.start").cast("long").alias("start"), F.col("piece.length").cast("long").alias("length"),
        F.substring("ids", F.col("piece.start") * 4 + 1, F.col("piece.length") * 4).alias("ids"), F.col("n").cast("long").alias("doc_tokens"),
        F.col("piece.seq").alias("sequence_id"), F.lit(0).cast(T.LongType()).alias("offset"))

