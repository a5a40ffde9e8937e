"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (always reported once they pass their check): ``email``, ``ip`` (parts at most 255), ``card`` (12 to 19
digits that pass Luhn) and ``phone`` (international, 9 to 15 digits). Further kinds, reported from a score of
``threshold`` on: ``iban`` (mod-97 over the length that its country code sets) and ``secret`` (keys by the form of their issuer, and
values assigned to a name such as ``token`` or ``api_key`` that mix letters with digits and have an entropy of ``ENTROPY`` bits a character;
the span is the value), also beside base spans that they touch; ``local_phone`` and ``ssn``, which need a context word, only where they
touch no base span.

Defined results: a null or empty text has no spans; repeated rows each get theirs; matches of one kind never overlap;
a failed match of a base kind is dropped and not tried again; after a failed IBAN the next word is tried. Every pattern takes time in proportion to the text; spans are sorted once.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone", "ssn", "secret")
BESIDE_BASE = ("iban", "secret")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match cannot start inside a run of digits: what fails or ends at the head of the run fails for its tail too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: Characters of an IBAN by country; of a country that is not listed, as far as upper-case letters and digits go.
IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in range(15, 35)}
_IBAN_OPEN = re.compile(r"(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
#: Forms of keys by which their issuers are known.
_ISSUED = re.compile(r"(?<![A-Za-z0-9_])(?:A(?:KI|SI)A[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+"
                     r"|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])|[rs]k_live_[A-Za-z0-9]{16,}+"
                     r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----)")
_ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\"']?[ \t]{0,4}[:=][:=]?[ \t]{0,4}[\"']?"
                       r"([A-Za-z0-9+/_.~-]{16,}+)", re.I)
LONGEST_SECRET, ENTROPY = 512, 3.0
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score before context, after the validator has passed.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3, "ssn": 0.3, "secret": 0.6}
CONTEXT = {
    "email": "email e-mail mail contact write",
    "ip": "ip address host server login",
    "card": "card credit visa mastercard payment debit",
    "phone": "phone call tel telephone mobile cell fax contact",
    "iban": "iban account bank transfer",
    "local_phone": "phone call tel telephone mobile cell fax contact",
    "ssn": "ssn social security",
    "secret": "token secret password passwd pwd key apikey api_key access_key secret_key auth bearer credential credentials",
}
#: Words after which a number is more likely something else.
AGAINST = {"ip": "version release build", "card": "isbn order invoice serial", "phone": "isbn serial",
           "local_phone": "isbn order invoice serial", "ssn": "isbn order part serial", "secret": "checksum commit digest sha1 sha256 md5 uuid"}
_FOR = {k: re.compile(rf"\b(?:{'|'.join(v.split())})\b", re.I) for k, v in CONTEXT.items()}
_NOT = {k: re.compile(rf"\b(?:{'|'.join(v.split())})\b", re.I) for k, v in AGAINST.items()}
BEFORE, AFTER = 48, 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mixed(value: str) -> bool:
    """Letters and digits in no plain order, as drawn keys have them."""
    n = len(value)
    if n > LONGEST_SECRET or not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    return -sum(k / n * log2(k / n) for k in Counter(value).values()) >= ENTROPY


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _found(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN_HEAD.finditer(text):
        length = IBAN_LENGTH.get(m[0][:2])
        rest = (_IBAN_REST[length] if length else _IBAN_OPEN).match(text, m.end())
        if m.start() >= done and rest and mod97(text[m.start():rest.end()]):
            done = rest.end()
            yield m.start(), done


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Issued keys, and assigned values that overlap none of them."""
    issued = [m.span() for m in _ISSUED.finditer(text)]
    touches = _touching(issued)
    yield from issued
    for m in _ASSIGNED.finditer(text):
        if mixed(m[1]) and not touches(*m.span(1)):
            yield m.span(1)


def _touching(spans: list[tuple[int, int]]):
    """Test of whether a span overlaps any of these."""
    spans = sorted(spans)
    starts = [s for s, _ in spans]
    reach = list(accumulate((e for _, e in spans), max))

    def touches(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    return touches


def _further(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _ibans(text):
        yield "iban", start, end
    for kind, pattern in (("local_phone", _LOCAL_PHONE), ("ssn", _SSN)):
        for m in pattern.finditer(text):
            yield kind, *m.span()
    for start, end in _secrets(text):
        yield "secret", start, end


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - BEFORE):start]} \n {text[end:end + AFTER]}"
    score = PRIOR[kind] + 0.3 * bool(_FOR[kind].search(near))
    return round(min(1.0, max(0.0, score - 0.3 * bool(kind in _NOT and _NOT[kind].search(near)))), 3)


def spans_of(text: str | None, threshold: float = 0.5) -> list[dict]:
    """Spans of one text by start, then kind; positions are code points, the end is exclusive."""
    if not text:
        return []
    base = list(_found(text))
    touches = _touching([(start, end) for _, start, end in base])
    scored = [(*x, _score(text, *x)) for x in base]
    for x in _further(text):
        if x[0] in BESIDE_BASE or not touches(*x[1:]):
            score = _score(text, *x)
            if score >= threshold:
                scored.append((*x, score))
    scored.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [{"kind": k, "start": s, "end": e, "score": score} for k, s, e, score in scored]


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id`` and ``spans`` of every whole text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [spans_of(t.as_py(), threshold) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
