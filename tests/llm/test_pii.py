import random
import re
import time

import regex
from conftest import make_docs

from tidemark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[-1::-2]]
        even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
        return 12 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(BASE.values()) for m in regex.finditer(p, text) if valid(list(BASE)[k], m[0])]
    return [(list(BASE)[k], s, e) for s, k, e in sorted(found)]


def test_base_kinds_like_plain_patterns():
    draw = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "25", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+", "(", ")", "é", "😀", "10.0.0.1",
             "x@y.zz", "+1 (743) 555-3824", "%", "_", "007"]
    for _ in range(4_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(14)))
        own = [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["kind"] in BASE]
        assert own == brute(text), text


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 130_000, "a@b." * 100_000, "A1" * 200_000, "1-" * 200_000):
        pii.spans_of(text)
    assert time.time() - start < 40


def test_context_and_checksums():
    kinds = lambda t: [s["kind"] for s in pii.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 today") == ["iban"]
    assert kinds("IBAN DE88370400440532013000") == []
    assert kinds("please call 743-555-3824") == ["local_phone"] and kinds("lot 743-555-3824") == []
    assert kinds("social security 219-09-9999") == ["ssn"]
    assert pii.spans_of("host 10.1.2.3")[0]["score"] > pii.spans_of("version 10.1.2.3")[0]["score"]


def test_edges(edge_docs, edge_rows, no_docs, spark):
    assert pii.detect(edge_docs).count() == len(edge_rows)
    assert pii.detect(no_docs).collect() == []
    docs = make_docs(spark, [(1, "mail x@y.zz or 10.0.0.1", "s")] * 2 + [(2, None, "s")])
    got = pii.detect(docs).select("doc_id", pii.count_of("spans", "email").alias("n"), pii.listing("spans").alias("l")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, "email:5:11,ip:15:23")] * 2 + [(2, 0, "")]


def with_check(country, body):
    rest = int("".join(str(int(c, 36)) for c in body + country)) * 100
    return f"{country}{98 - rest % 97:02d}{body}"


def test_ibans_end_where_their_country_says():
    found = lambda t: [t[s["start"]:s["end"]] for s in pii.spans_of(t) if s["kind"] == "iban"]
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for after in (" BIC COBADEFFXXX", " Berlin", " 2024", " A", "", ".", " BIC"):
        assert found(f"IBAN {de}{after}") == [de] and found(f"IBAN {gb}{after}") == [gb]
    assert found(f"AB12 {gb} {de} NO DE") == [gb, de]
    assert found(de + "X") == [] and found(de[:-1] + " BIC") == []
    assert found("ZZ" + with_check("ZZ", "1" * 14)[2:]) == [with_check("ZZ", "1" * 14)]


def test_iban_stays_beside_a_card_that_it_touches():
    """The digits of the account pass Luhn."""
    body = next(b for k in range(100) if pii.luhn((b := with_check("NL", f"ABNA{417164300 + k:010d}"))[8:]))
    iban = next(i for k in range(10_000) if pii.luhn((i := with_check("BE", f"{539007547000 + k:012d}"))[2:]))
    kinds = [s["kind"] for s in pii.spans_of(f"account {iban} due")]
    assert kinds == ["iban", "card"] and [s["kind"] for s in pii.spans_of(f"account {body} due")][0] == "iban"


def test_secrets():
    found = lambda t: [t[s["start"]:s["end"]] for s in pii.spans_of(t) if s["kind"] == "secret"]
    drawn = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    for text in (f'token = "{drawn}" next', f"API_KEY:{drawn}", f"password={drawn}.", f"my_secret => {drawn} Secret := '{drawn}'"):
        assert found(text) in ([drawn], [drawn + "."]), text
    issued = ["AKIA" + "ABCDEFGH23456789", "ghp_" + "a1B2" * 9, "AIza" + "x" * 35, "sk_live_" + "9a" * 8, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"]
    for key in issued:
        assert found(f"the key {key} is") == [key] and found(f"token = {key}") == [key]
    for text in ("token = short1", "token = " + "a" * 40, "token = " + "1" * 40, f"sha {drawn}", "the token of appreciation", f"token = {'a1' * 300}"):
        assert found(text) == [], text
    assert found(f"commit checksum {issued[1]}") == []
    # A card number inside a key stays beside it.
    assert [s["kind"] for s in pii.spans_of("token = abcdef4539578763621486abcdef0987")] == ["secret", "card"]


def test_touching_spans():
    draw = random.Random(5)
    for _ in range(500):
        spans = [(s, s + draw.randrange(1, 9)) for s in (draw.randrange(60) for _ in range(draw.randrange(8)))]
        touches = pii._touching(spans)
        for _ in range(10):
            a = draw.randrange(60)
            b = a + draw.randrange(1, 6)
            assert touches(a, b) == any(a < e and s < b for s, e in spans)


def test_many_spans_take_linear_time():
    start = time.time()
    for part in ("x@y.zz 743-555-3824 ", "call 743-555-3824 or 10.0.0.1 ", "token=token=", "token = a1b2c3d4e5f6g7h8 ", "eyJ.", "xox"):
        pii.spans_of(part * 20_000)
    assert time.time() - start < 60
