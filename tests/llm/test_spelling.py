"""Spelling variants: index, searches and the whole operator against brute force."""

import random
import zlib
from collections import Counter

import pytest

from ledgerline.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(25))
def test_both_searches_give_each_pair_once(seed):
    rnd = random.Random(seed)
    letters = "abé"[:rnd.randint(1, 3)]
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    queries = [w for w in words if len(w) > 1]
    found = [(queries[a], words[b]) for turn in (False, True) for a, b in zip(*spelling.near_words(words, queries, turn))]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in queries for b in words if one_edit(a, b)}


def test_queries_with_letters_that_the_index_lacks():
    words, queries = ["house", "mouse"], ["hxuse", "hous", "houses", "ÿouse", "zzzzz"]
    pairs = {(queries[a], words[b]) for t in (False, True) for a, b in zip(*spelling.near_words(words, queries, t))}
    assert pairs == {(a, b) for a in queries for b in words if one_edit(a, b)}


def test_intervals_are_those_of_the_sorted_words():
    words = ["abc", "abd", "b", "cab"]
    index = spelling.Index(words)
    low, high = 0, index.n
    for letter in "ab":
        low, high = index.extend(int(index.encode([letter])[0]), low, high)
    assert high - low == 2  # abc and abd begin with ab


def brute(rows, min_length=5, min_count=3):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                counts[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def variants(spark, rows, **sizes):
    docs = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows],
                                 "doc_id long, text string, n int, word string, form int")
    return {tuple(r) for r in spelling.variants(docs.repartition(5), **sizes).collect()}


def corpus(seed):
    """Texts of a few base words with frequent misspellings, in chains."""
    rnd = random.Random(seed)
    base = ["house", "Water", "straße", "mañana", "internationalization", "aaaaaa", "aaaaaaa"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rnd.randint(0, 80)):
            w = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice("aeß") + w[at:], w[:at] + "e" + w[at + 1:]])
            words.append(w)
        rows.append((rnd.choice([i, i, None, 7]), rnd.choice([" ", "-", "×", "1", "Ā "]).join(words)))
    return rows + [(None, None), (5, ""), (6, "1 2 3 !")]


@pytest.mark.parametrize("sizes", [{}, {"shard": 20, "hot": 3}, {"shard": 7, "hot": 1000}])
def test_variants_against_brute_force(spark, sizes):
    rows = corpus(1)
    want = brute(rows)
    assert variants(spark, rows, **sizes) == want
    assert any(w[1] and w[1] != w[2] for w in want)  # a chain of two steps or more


def test_a_long_chain_of_forms(spark):
    """Each word is twice as frequent as the one before it."""
    words = ["zzzzzzz"[:7 - i] + "yyyyyyy"[:i] for i in range(7)]
    rows = [(1, " ".join(w for i, w in enumerate(words) for _ in range(3 << i)))]
    want = brute(rows)
    assert variants(spark, rows) == want and max(len({w[2]}) for w in want) == 1


def test_empty_and_very_long(spark):
    assert variants(spark, [(1, None)]) == set()
    long = "ab" * 1500
    rows = [(None, f"{long} {long}x {long} {long}x {long} {long}x " * 2)]
    assert variants(spark, rows) == brute(rows)


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 5)
    rows = corpus(2)
    total = Counter()
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([None if i is None else str(i) for i, _ in rows]),
                                        pa.array([t for _, t in rows])], names=["doc_id", "text"])
    parts = list(spelling._counts([batch]))
    for p in parts:
        total.update(dict(zip(p["word"].to_pylist(), p["n"].to_pylist())))
    assert len(parts) > 3
    whole = Counter()
    for i, t in rows:
        if t is not None:
            whole.update(spelling.words_of(None if i is None else str(i), t))
    assert total == whole
