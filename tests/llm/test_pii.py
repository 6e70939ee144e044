"""Personal data: plain spans against the patterns, disguised ones, offsets, edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pii
from ledgerline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
# The plain kinds as their contract states them, for brute force.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            total += int(c) if i % 2 == 0 else (2 * int(c)) % 9 or (9 if c == "9" else 0)
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def got(text, added=True):
    return [(pii.KINDS[k], text[a:b]) for k, a, b, more in pii.spans(text) if more or added]


@pytest.mark.parametrize("seed", range(8))
def test_plain_spans_equal_the_patterns(seed):
    rnd = random.Random(seed)
    pieces = ["a", "B.", "@", "x@y.z", ".", "-", " ", "1", "25", "256", "1.2.3.4", "+1", "(", "4111 1111 1111 1111",
              "4111-1111-1111-1111", "+49 170 1234567", "é", "\n", "a@b.c@d.e", "0001.002.3.4", "55555"]
    for _ in range(1500):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.plain_spans(text)] == brute(text), text


@pytest.mark.parametrize("text, kind, part", [
    ("mail john [at] mail [dot] com now", "email", "john [at] mail [dot] com"),
    ("mail john(at)mail(dot)co(dot)uk now", "email", "john(at)mail(dot)co(dot)uk"),
    ("so john dot smith at mail dot com.", "email", "dot smith at mail dot com"),
    ("so user.55 at mail4.example.com.", "email", "user.55 at mail4.example.com"),
    ("jоhn@mail.com", "email", "jоhn@mail.com"),  # a Cyrillic letter
    ("ｊｏｅ＠ｍａｉｌ．ｄｅ", "email",
     "ｊｏｅ＠ｍａｉｌ．ｄｅ"),  # full width
    ("jo​e@mail.com", "email", "jo​e@mail.com"),  # an invisible character
    ("\U0001d4a5oe@mail.com", "email", "\U0001d4a5oe@mail.com"),  # mathematical letter
    ("call +1 five five five one two three four five!", "phone", "+1 five five five one two three four five"),
    ("plus vier neun eins sieben zwei drei vier fünf sechs", "phone",
     "plus vier neun eins sieben zwei drei vier fünf sechs"),
    ("card 4111 one one one one 1111 1111", "card", "4111 one one one one 1111 1111"),
    ("card 4l11 1111 1111 11l1", "card", "4l11 1111 1111 11l1"),
    ("card ٤١١١ 1111 1111 1111", "card", "٤١١١ 1111 1111 1111"),
    ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
    ("ip 192[.]168[.]1[.]1 end", "ip", "192[.]168[.]1[.]1"),
])
def test_disguised_identifiers(text, kind, part):
    assert any(k == kind and part in s for k, s in got(text)), got(text)
    assert part not in pii.redacted(text)


@pytest.mark.parametrize("text", [
    "look at example.com", "we met at noon dot dot dot", "почта@mail.ru", "one two three",
    "un deux trois quatre", "a at b dot", "he is at the point of no return", "@", "1 at 2", "5 plus five",
    "un, deux at x.y"])
def test_ordinary_text_has_no_span(text):
    assert pii.spans(text) == []


def test_a_number_word_beside_a_phone_stays_out_of_it():
    assert got("+1 (017) 555-7713 one") == [("phone", "+1 (017) 555-7713")]


@pytest.mark.parametrize("seed", range(6))
def test_disguises_map_back_to_the_same_span(seed):
    """Any mix of disguises of a planted identifier is found at exactly its source offsets."""
    rnd = random.Random(seed)
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and rnd.random() < .5 else c for c in s)
    hidden = lambda s: "".join(c + ("​" if rnd.random() < .3 else "") for c in s[:-1]) + s[-1]
    for _ in range(300):
        plain = rnd.choice(["jane.roe7@mail3.example.com", "10.20.30.40", "4111111111111111", "+14155550123"])
        disguised = rnd.choice([wide, hidden, lambda s: wide(hidden(s))])(plain)
        before = rnd.choice(["", "né à ", "世界 ", "x ", "\U0001f600 "])
        text = before + disguised + rnd.choice(["", " fin", "　ok", " é"])
        if disguised != plain:
            spans = [(a, b) for _, a, b, _ in pii.spans(text)]
            assert (len(before), len(before) + len(disguised)) in spans, (text, pii.spans(text))


def test_base_spans_always_stay():
    rnd = random.Random(5)
    pieces = ["a@b.cc", "1.2.3.4", " at ", " dot ", "one ", "[at]", "[dot]", "4111111111111111", " ", "​", "о",
              "+49 170 1234567", "x", "O1l", " ", "two ", "com"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9)))
        assert [s[:3] for s in pii.spans(text) if not s[3]] == pii.plain_spans(text)


def test_scans_are_linear_on_hostile_texts():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000, "a_at_" * 20_000,
                 "one " * 50_000, "1 " * 100_000, "o0" * 100_000, "dot " * 50_000 + "at x.y", " " * 300_000,
                 "a at b.c " * 20_000, "о" * 200_000):
        pii.spans(text)


def test_table(spark):
    rows = [(1, "x a@b.cc", "s", 1), (1, "x a@b.cc", "s", 1), (2, None, None, 2), (None, "", None, None),
            (3, "é" * 200_000 + " joe [at] b [dot] com", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, spans int")
    found = {(r["doc_id"], len(r["spans"])) for r in pii.find(docs).collect()}
    assert found == {(1, 1), (2, 0), (None, 0), (3, 1)} and pii.find(docs).count() == 5
    assert pii.find(docs.limit(0)).count() == 0
    long = pii.find(docs.where("doc_id = 3")).first()["spans"][0]
    assert (long["kind"], long["start"], long["end"], long["added"]) == ("email", 200_001, 200_021, True)


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_pii"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_email"] for r in rows) > 0
