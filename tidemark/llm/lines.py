"""Line deduplication: windows of three consecutive lines that occur again are removed after their first occurrence.

A window is named by a 128-bit hash of its lines, found again globally by one aggregation, and every occurrence after the first
one, in the order of document id (null last) and line, covers its lines. Covered positions of a document are merged and removed.

Defined results: a null text stays null; a text of fewer than three lines has no window and stays as it is; windows of blank
lines only do not count; rows with the same id and text are one document and keep the same lines; a document that is covered
whole becomes the empty text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, whole
from tidemark.session import stored

WIDTH = 3
_FILLED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows_of(text: Column, width: int = WIDTH) -> Column:
    """``at, a, b`` of every window of a text: first line and two independent hashes."""
    def hashed(line: Column) -> Column:
        return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), line.rlike(_FILLED).alias("filled"))

    def window(marks: Column, i: Column) -> Column:
        part = [F.get(marks, i + k) for k in range(width)]
        filled = part[0]["filled"]
        for p in part[1:]:
            filled = filled | p["filled"]
        return F.struct(i.alias("at"), F.xxhash64(*[p["a"] for p in part]).alias("a"),
                        F.xxhash64(F.lit(1), *[p["b"] for p in part]).alias("b"), filled.alias("filled"))

    def windows(marks: Column) -> Column:
        starts = F.when(F.size(marks) >= width, F.sequence(F.lit(0), F.size(marks) - width))
        return F.filter(F.transform(starts, lambda i: window(marks, i)), lambda w: w["filled"])

    return let(F.transform(_lines(text), hashed), windows)


def covered_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id, body`` (hash of the text) and ``starts`` of the windows to remove, for the documents that have any."""
    found = docs.select(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("body"), F.explode(windows_of(docs["text"], width)).alias("w"))
    found = stored(found.select("id", "body", "w.at", "w.a", "w.b"), "windows")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("at").alias("at"))
    firsts = (found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("a", "b", "first"))
    later = found.join(firsts, ["a", "b"]).where(place > F.col("first"))
    return later.groupBy("id", "body").agg(F.collect_set("at").alias("starts"))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each document as ``row`` with its remaining ``text`` and the numbers of ``lines`` and of ``removed`` lines."""
    covered = covered_lines(docs, width)
    rows = docs.select(whole(docs), docs["doc_id"].alias("doc"), F.xxhash64(docs["text"]).alias("hash"))
    joined = rows.join(covered, rows["doc"].eqNullSafe(covered["id"]) & (rows["hash"] == covered["body"]), "left")
    text, starts = F.col("row")["text"], F.col("starts")

    def kept(lines: Column) -> Column:
        gone = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + width - 1)))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"),
                        F.size(lines).cast("long").alias("lines"), (F.size(lines) - F.size(left)).cast("long").alias("removed"))

    untouched = F.struct(text.alias("text"), F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long").alias("lines"),
                         F.lit(0).cast("long").alias("removed"))
    return joined.select("row", F.when(starts.isNull() | text.isNull(), untouched).otherwise(let(_lines(text), kept)).alias("out")) \
        .select("row", "out.*")


def replaced(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with their remaining text; ``n_chars``, where there is one, follows."""
    rows = deduplicated(docs, width)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.col("row")["n_chars"]).cast("long")
           if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, text, p, lines[p + 1] AS a, lines[p + 2] AS b, lines[p + 3] AS c
      FROM (SELECT DISTINCT doc_id, text, lines, unnest(range(0, len(lines) - 2)) AS p FROM d)),
r AS (SELECT doc_id, text, p, rank() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, p) AS nth
      FROM w WHERE regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, text, p + o AS p FROM r, (VALUES (0), (1), (2)) AS v(o) WHERE nth > 1),
every AS (SELECT doc_id, text, lines, unnest(range(0, len(lines))) AS p FROM (SELECT DISTINCT * FROM d)),
left_over AS (SELECT e.doc_id, e.text, string_agg(e.lines[e.p + 1], chr(10) ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS rest,
              count(*) AS lines, count(g.p) AS lines_removed
              FROM every e LEFT JOIN gone g ON e.doc_id IS NOT DISTINCT FROM g.doc_id AND e.text = g.text AND e.p = g.p
              GROUP BY e.doc_id, e.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.rest, '') END AS text,
       coalesce(l.lines, 0) AS lines, coalesce(l.lines_removed, 0) AS lines_removed
FROM d LEFT JOIN left_over l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.text = l.text
"""
