"""Alignment of two tokenizers over the same bytes, as a monoid of fragments.

A text with a space before it is read by tokenizer A (byte-level BPE) and by tokenizer B (pieces, which adds that space). Where
tokens of both end at one byte offset the text is cut; the tokens between two cuts are a group, and an A and a B token
whose bytes overlap are linked. Each pair of ids is counted over all links of the corpus.

A fragment is what is known of a byte range: an open prefix (tokens up to its first cut), closed groups, an open suffix
(tokens after its last cut); without a cut all its tokens are open. Composing two neighbours joins the suffix of the left
with the prefix of the right, closes what their new cuts enclose, and keeps only open tokens. This is associative, so
the fragments of one long document are made by many tasks and composed in a tree, ``fanout`` at a time; closed groups leave the tree where
they close. The ranges of A and of B end at the nearest offset that is safe for that tokenizer alone, so groups do cross ranges.

A run (from a space after a non-space to the next) is a fragment without open ends; short documents are the product
of their runs, which a worker remembers in a table of bounded size.

Counts are looked up where the links are: the ``frequent`` most frequent pairs (that bound holds whatever the input) are sent around, the
others are joined by shuffle. Both ways together are exact.

Defined results: a text that is null, empty, or not given back by the joined bytes of either tokenizer has no tokens: zeros and
empty groups. Repeated rows count each. Control strings inside texts are plain text. An empty table gives no rows.
"""
from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

#: Characters of a range, texts longer than which are cut.
CHUNK = 1 << 16
FANOUT = 8
#: Most frequent id pairs that every task holds.
FREQUENT = 1 << 19
#: Documents whose pairs a task counts or looks up together.
DOCS_AT_ONCE = 256
#: Runs remembered in the young and in the old half, and the longest run that is.
RUNS, LONGEST_RUN = 150_000, 80
#: Ids of B fill the low bits of a pair's code.
B_BITS = 15
#: Neither tokenizer has a token across these: a space after a non-space, with more to follow.
_RUN = re.compile(r"(?<=\S)(?= [\s\S])")
#: A's own rule ends a token between a letter and these.
_SAFE_A = re.compile(r"(?<=[A-Za-z])(?=[ \n.,;:!?])")
_READERS: dict[tuple[str, str], "Reader"] = {}
SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that what is made of their rows does not grow with a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            yield batch.slice(at, DOCS_AT_ONCE)


def align(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> tuple[list[str], list[int]]:
    """Groups and linked pairs of tokens that begin at one offset and end at one offset."""
    if not a:
        return [], []
    groups, pairs, i, j = [], [], 0, 0
    left, right = [str(a[0])], [str(b[0])]
    while True:
        pairs.append(a[i] << B_BITS | b[j])
        x, y = a_ends[i], b_ends[j]
        if x == y:
            groups.append(",".join(left) + "|" + ",".join(right))
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, pairs
            left, right = [str(a[i])], [str(b[j])]
        elif x < y:
            i += 1
            left.append(str(a[i]))
        else:
            j += 1
            right.append(str(b[j]))


@dataclass
class Fragment:
    """Open tokens (ids and end offsets) and the first and the last known cut, None without one."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    first: int | None = None
    last: int | None = None

    @staticmethod
    def start() -> "Fragment":
        """What lies before a document: nothing but a cut at offset 0."""
        none = np.empty(0, np.int64)
        return Fragment(none, none, none, none, 0, 0)


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, list[str], list[int], int, int] | None]:
    """The product, and what it closes: start offset, groups, pairs, tokens of A and of B."""
    a, b = np.concatenate([left.a, right.a]), np.concatenate([left.b, right.b])
    a_ends, b_ends = np.concatenate([left.a_ends, right.a_ends]), np.concatenate([left.b_ends, right.b_ends])
    common = np.intersect1d(a_ends, b_ends)
    cuts = [*map(int, common[:1]), *map(int, common[-1:]), *[c for c in (left.first, left.last, right.first, right.last) if c is not None]]
    if not cuts:
        return Fragment(a, a_ends, b, b_ends), None
    first, last = min(cuts), max(cuts)
    lo = first if left.last is None else left.last
    hi = last if right.first is None else right.first
    in_a, in_b = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
    rest = Fragment(a[~in_a], a_ends[~in_a], b[~in_b], b_ends[~in_b], first, last)
    if not in_a.any() or not in_b.any():
        return rest, None
    groups, pairs = align(a[in_a].tolist(), b[in_b].tolist(), a_ends[in_a].tolist(), b_ends[in_b].tolist())
    return rest, (lo, groups, pairs, int(in_a.sum()), int(in_b.sum()))


class Reader:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Byte-level vocabularies write a byte as itself where it is printable Latin-1, else as the next free code point from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        vocab = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << B_BITS:
            raise ValueError("vocabulary of B too large for the code of a pair")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def ids(self, a_text: str, b_text: str) -> tuple[list[int], list[int], bool]:
        """Ids of texts that begin with a space or are empty for B, and whether the tokens give the texts back."""
        a = self.a.encode_batch_fast([a_text], add_special_tokens=False)[0].ids if a_text else []
        b = self.b.encode(b_text[1:]) if b_text else []
        fine = (b"".join([self.a_bytes[i] for i in a]) == a_text.encode() and b"".join([self.b_bytes[i] for i in b]) == b_text.encode())
        return a, b, fine

    def ends(self, ids: list[int], table: list[bytes]) -> list[int]:
        return np.cumsum([len(table[i]) for i in ids]).tolist()

    def _product(self, text: str) -> tuple | None:
        """Groups, pairs and counts of one run, or None where the tokens do not give it back."""
        a, b, fine = self.ids(text, text)
        if not fine:
            return None
        return self._written(*align(a, b, self.ends(a, self.a_bytes), self.ends(b, self.b_bytes)), len(a), len(b))

    @staticmethod
    def _written(groups: list[str], pairs: list[int], n_a: int, n_b: int) -> tuple:
        return ";".join(groups), array("i", pairs).tobytes(), n_a, n_b, len(groups)

    def _learn(self, runs: list[str]) -> None:
        """Remember runs that end in a non-space: they are read as one text, which has a safe cut before each."""
        text = "".join(runs)
        a, b, fine = self.ids(text, text)
        if not fine:
            self.young.update((r, self._product(r)) for r in runs)
            return
        a_ends, b_ends = self.ends(a, self.a_bytes), self.ends(b, self.b_bytes)
        end = i = j = 0
        for run in runs:
            end += len(run) if run.isascii() else len(run.encode())
            i0, j0 = i, j
            while i < len(a) and a_ends[i] <= end:
                i += 1
            while j < len(b) and b_ends[j] <= end:
                j += 1
            self.young[run] = self._written(*align(a[i0:i], b[j0:j], a_ends[i0:i], b_ends[j0:j]), i - i0, j - j0)

    def products(self, texts: list[list[str]]) -> Iterator[list[tuple | None]]:
        """For each text, given as its runs, the products of its runs."""
        asked = set()
        for runs in texts:
            asked.update(runs)
        if len(self.young) > RUNS:
            self.old, self.young = self.young, {}
        unknown, odd = [], {}
        for run in asked:
            if run in self.young:
                continue
            if run in self.old:
                self.young[run] = self.old[run]
            elif len(run) > LONGEST_RUN or run[-1].isspace():
                odd[run] = None
            else:
                unknown.append(run)
        for at in range(0, len(unknown), 2000):
            self._learn(unknown[at:at + 2000])
        young = self.young
        for runs in texts:
            yield [young[r] if r not in odd else self._product(r) for r in runs] if odd else [young[r] for r in runs]


def _reader(a_path: str, b_path: str) -> Reader:
    if (a_path, b_path) not in _READERS:
        _READERS[a_path, b_path] = Reader(a_path, b_path)
    return _READERS[a_path, b_path]


def _forget() -> None:
    """Workers stay for the next stages, which need no tokenizers and no remembered runs."""
    _READERS.clear()


def _distinct(pairs: bytes) -> tuple[bytes, bytes]:
    values, n = np.unique(np.frombuffer(pairs, np.int32), return_counts=True)
    return values.tobytes(), n.astype(np.int32).tobytes()


def _bounds(text: str, safe: re.Pattern, chunk: int) -> list[int]:
    """Offsets (characters) of ranges: the first safe place from each multiple of ``chunk`` on, the end where there is none."""
    out = [0]
    for at in range(chunk, len(text), chunk):
        if out[-1] >= at:
            out.append(out[-1])
        else:
            found = safe.search(text, at)
            out.append(found.start() if found else len(text))
    return [*out, len(text)]


def _read(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """Short documents with groups and pairs; long ones as ranges (``part`` of ``parts``) with the texts of A and B."""
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = (f"key bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, ns binary, "
              "part int, parts int, a_text string, a_from bigint, b_text string, b_from bigint")

    def ranges(text: str) -> Iterator[dict]:
        a_at, b_at = _bounds(text, _SAFE_A, chunk), _bounds(text, _RUN, chunk)
        a_from = b_from = 0
        for p in range(len(a_at) - 1):
            a_text, b_text = text[a_at[p]:a_at[p + 1]], text[b_at[p]:b_at[p + 1]]
            yield {"part": p, "parts": len(a_at) - 1, "a_text": a_text, "a_from": a_from, "b_text": b_text, "b_from": b_from}
            a_from, b_from = a_from + len(a_text.encode()), b_from + len(b_text.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key = _reader(a_path, b_path), TaskContext.get().partitionId() << 36
        out_schema = None
        for batch in batches:
            if out_schema is None:
                out_schema = pa.schema([("key", pa.int64()), ("doc_id", batch.schema.field(0).type)] + [(c, pa.int64()) for c in SUMS] + [
                    ("groups", pa.string()), ("pairs", pa.binary()), ("ns", pa.binary()), ("part", pa.int32()), ("parts", pa.int32()),
                    ("a_text", pa.string()), ("a_from", pa.int64()), ("b_text", pa.string()), ("b_from", pa.int64())])
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                ids, texts, rows = piece.column(0).to_pylist(), piece.column(1).to_pylist(), []
                short = [_RUN.split(" " + t) if t and len(t) <= chunk else [] for t in texts]
                for doc_id, text, made in zip(ids, texts, reader.products(short)):
                    key += 1
                    row = {"key": key, "doc_id": doc_id}
                    if text and len(text) > chunk:
                        for part in ranges(" " + text):
                            yield pa.RecordBatch.from_pylist([row | part], schema=out_schema)
                        continue
                    fine = bool(made) and None not in made
                    used = made if fine else []
                    pairs = b"".join([m[1] for m in used])
                    values, ns = _distinct(pairs)
                    rows.append(row | {
                        "n_a": sum([m[2] for m in used]), "n_b": sum([m[3] for m in used]), "n_groups": sum([m[4] for m in used]),
                        "n_links": len(pairs) // 4, "groups": ";".join([m[0] for m in used]), "pairs": values, "ns": ns})
                yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    return narrow.mapInArrow(run, schema)


#: Rows of the tree: open tokens of a range (``part`` not null), or groups that have been closed (``at`` not null).
_TREE = ("key bigint, doc_id {kind}, bad boolean, part int, first bigint, last bigint, a binary, a_ends binary, b binary, b_ends binary, "
         "at bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, ns binary")


def _open(fragment: Fragment, part: int) -> dict:
    return {"part": part, "first": fragment.first, "last": fragment.last,
            **{c: getattr(fragment, c).astype(np.int64).tobytes() for c in ("a", "a_ends", "b", "b_ends")}}


def _closed(closing: tuple) -> dict:
    at, groups, pairs, n_a, n_b = closing
    values, ns = _distinct(np.array(pairs, np.int32).tobytes())
    return {"at": at, "n_a": n_a, "n_b": n_b, "n_groups": len(groups), "n_links": len(pairs), "groups": ";".join(groups), "pairs": values, "ns": ns}


def _tree_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("key", pa.int64()), ("doc_id", key), ("bad", pa.bool_()), ("part", pa.int32())]
                     + [(c, pa.int64()) for c in ("first", "last")] + [(c, pa.binary()) for c in ("a", "a_ends", "b", "b_ends")]
                     + [(c, pa.int64()) for c in ("at", *SUMS)] + [("groups", pa.string()), ("pairs", pa.binary()), ("ns", pa.binary())])


def _leaves(ranges: DataFrame, a_path: str, b_path: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(a_path, b_path)
        for batch in batches:
            out = _tree_schema(batch.schema.field("doc_id").type)
            for row in batch.to_pylist():
                a, b, fine = reader.ids(row["a_text"], row["b_text"])
                own = {"key": row["key"], "doc_id": row["doc_id"], "bad": not fine}
                if not fine:
                    a = b = []
                ends = [np.array(reader.ends(ids, table), np.int64) + at for ids, table, at in
                        ((a, reader.a_bytes, row["a_from"]), (b, reader.b_bytes, row["b_from"]))]
                none = np.empty(0, np.int64)
                whole = Fragment(np.array(a, np.int64), ends[0], np.array(b, np.int64), ends[1])
                left = Fragment.start() if row["part"] == 0 else Fragment(none, none, none, none)
                fragment, closing = compose(left, whole)
                rows = [own | _open(fragment, row["part"])] + ([own | _closed(closing)] if closing else [])
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return ranges.select("key", "doc_id", "part", "a_text", "a_from", "b_text", "b_from").mapInArrow(run, schema)


def _composed(fragments: DataFrame, fanout: int, schema: str) -> DataFrame:
    """One level of the tree."""
    def run(table: pa.Table) -> pa.Table:
        out = _tree_schema(table.schema.field("doc_id").type)
        rows, product, made = sorted(table.to_pylist(), key=lambda r: r["part"]), None, []
        own = {"key": rows[0]["key"], "doc_id": rows[0]["doc_id"], "bad": any(r["bad"] for r in rows)}
        for r in rows:
            fragment = Fragment(*[np.frombuffer(r[c], np.int64) for c in ("a", "a_ends", "b", "b_ends")], r["first"], r["last"])
            if product is None:
                product = fragment
                continue
            product, closing = compose(product, fragment)
            if closing:
                made.append(own | _closed(closing))
        return pa.Table.from_pylist([own | _open(product, rows[0]["part"] // fanout), *made], schema=out)

    return fragments.withColumn("node", F.floor(F.col("part") / fanout)).groupBy("key", "node").applyInArrow(run, schema)


def _long(ranges: DataFrame, parts: int, a_path: str, b_path: str, fanout: int) -> DataFrame:
    """Closed groups of long documents whose tokens give the text back; one row without groups for each other one."""
    schema = _TREE.format(kind=ranges.schema["doc_id"].dataType.simpleString())
    level = stored(_leaves(ranges.repartition("key", "part"), a_path, b_path, schema), "ranges")
    closed = level.where("part is null")
    while parts > 1:
        level = stored(_composed(level.where("part is not null"), fanout, schema), "fragments")
        closed, parts = closed.unionByName(level.where("part is null")), -(-parts // fanout)
    roots = level.where("part is not null").select("key", F.col("bad").alias("lost"))
    zero = level.where("part is not null and bad").select(
        "key", "doc_id", F.lit(0).cast("bigint").alias("at"), *[F.lit(0).cast("bigint").alias(c) for c in SUMS], F.lit("").alias("groups"),
        F.lit(b"").alias("pairs"), F.lit(b"").alias("ns"))
    return closed.join(roots, "key").where("not lost").select(*zero.columns).unionByName(zero)


def _counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each pair of ids; each task adds up blocks before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        held, size = [], 0

        def summed():
            values, at = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            return values, n

        for batch in _few(batches):
            pairs, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held.append((np.frombuffer(b"".join(pairs), np.int32), np.frombuffer(b"".join(ns), np.int32)))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "n"])
                    held, size = [], 0
        if held:
            values, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(n)], ["pair", "n"])

    return links.select("pairs", "ns").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _looked_up(links: DataFrame, held) -> DataFrame:
    """``links`` with the sums over the pairs held by every task, and the other pairs as ``rest``."""
    keep = [c for c in links.columns if c not in ("pairs", "ns")]
    schema = ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        known, counts, best = held.value
        for batch in _few(batches):
            passed = [batch.column(i) for i in range(len(keep))]
            pairs, ns = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            of = np.repeat(np.arange(len(pairs)), [len(p) // 4 for p in pairs])
            pair, n = np.frombuffer(b"".join(pairs), np.int32), np.frombuffer(b"".join(ns), np.int32).astype(np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            count_sum, n_best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if found.any():
                np.add.at(count_sum, of[found], counts[at[found]] * n[found])
                np.add.at(n_best, of[found], best[at[found]] * n[found])
            # Rows are in order, so the pairs that are left form one run a row.
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of[~found], minlength=len(pairs)))])
            entries = pa.StructArray.from_arrays([pa.array(pair[~found]), pa.array(n[~found])], ["pair", "times"])
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*passed, pa.array(count_sum), pa.array(n_best), rest],
                                             [*keep, "count_sum", "n_best", "rest"])

    return links.select(*keep, "pairs", "ns").mapInArrow(
        run, schema + ", count_sum bigint, n_best bigint, rest array<struct<pair:int,times:bigint>>")


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, fanout: int = FANOUT, frequent: int = FREQUENT) -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``."""
    spark = docs.sparkSession
    read = stored(_read(docs, a_path, b_path, chunk), "tokens")
    links = read.where("part is null").select("key", "doc_id", F.lit(0).cast("bigint").alias("at"), *SUMS, "groups", "pairs", "ns")
    parts = read.agg(F.max("parts")).first()[0]
    closed = None
    if parts:
        closed = stored(_long(read.where("part is not null"), parts, a_path, b_path, fanout), "closed")
    every = links if closed is None else links.unionByName(closed)

    counts = stored(_counts(every), "counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    # One row for each id of B, a vocabulary of fixed size.
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    counts = stored(counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counted")
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    held = spark.sparkContext.broadcast(
        (top["pair"].to_numpy(np.int32), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))

    sums = [*SUMS, "count_sum", "n_best"]
    found = _looked_up(links, held)
    whole = None if closed is None else _looked_up(closed, held)
    more = None
    if counts.count() > frequent:
        found = stored(found, "found")
        whole = None if whole is None else stored(whole, "found")
        left = found.select("key", F.explode("rest").alias("r"))
        if whole is not None:
            left = left.unionByName(whole.select("key", F.explode("rest").alias("r")))
        more = left.select("key", "r.pair", "r.times").join(counts, "pair").groupBy("key").agg(
            F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.col("best").cast("bigint") * F.col("times")).alias("more_best"))
    out = found.select("key", "doc_id", *sums, "groups")
    if whole is not None:
        in_order = F.array_sort(F.collect_list(F.struct("at", "groups")))
        out = out.unionByName(whole.groupBy("key").agg(
            F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums],
            F.array_join(F.transform(in_order, lambda x: x["groups"]), ";").alias("groups")))
    if more is not None:
        out = out.join(more, "key", "left").withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).withColumn(
            "n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
    return out.select("doc_id", *SUMS, "n_best", "count_sum", "groups")
