"""Both substring operators against brute force, hot anchors and the index family included."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import repeats as R
from ledgerline.llm import suffix_automaton, suffix_index

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans int, _d int, kept string"


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    base = text(400)
    texts = [text(300), base, base, base[:900] + "X" + base[900:], shared, None, "", "short", None]
    texts += [f"{text(rnd.randint(5, 40))} {shared}\n{text(rnd.randint(5, 40))}" for _ in range(25)]
    texts += ["ab " * 300, "z" * 700, text(50) + "\t" + " ".join([text(30)] * 4), base.upper(), "é" * 130]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other " + shared)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, "x") for i, t in rows], SCHEMA).repartition(5)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def brute(rows, length, split, join):
    seen, out = set(), []
    for i, t in ordered(rows):
        tokens = split((t or "").encode())
        gone = [False] * len(tokens)
        for k in range(len(tokens) - length + 1):
            w = tuple(tokens[k:k + length])
            if w in seen:
                gone[k:k + length] = [True] * length
            seen.add(w)
        out.append((i, len(tokens), sum(gone), join([x for x, g in zip(tokens, gone) if not g])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_runs, anchor_runs", [(None, R.ANCHOR_RUNS), (256, 256), (256, 3), (2, 256), (1, 1)])
@pytest.mark.parametrize("op", [suffix_index, suffix_automaton])
def test_removal_matches_brute_force(spark, op, hot_runs, anchor_runs):
    rows = corpus()
    if op is suffix_index:
        want = brute(rows, 100, list, bytes)
    else:
        want = brute(rows, 20, bytes.split, b" ".join)
    out = op.remove(frame(spark, rows), hot_runs=hot_runs, anchor_runs=anchor_runs)
    got = sorted(((r[0], r[1], r[2], bytes(r["kept"])) for r in out.collect()), key=repr)
    assert got == want
    assert sum(w[2] for w in want) > 500


@pytest.mark.parametrize("op", [suffix_index, suffix_automaton])
def test_empty_table_and_null_ids(spark, op):
    assert op.remove(frame(spark, []).limit(0)).count() == 0
    rows = [(None, "w " * 200), (None, None), (5, "w " * 200)]
    got = {(r["doc_id"], r["n_removed"]) for r in op.remove(frame(spark, rows)).collect()}
    n = {suffix_index: (298 + 2, 400), suffix_automaton: (200 - 1, 200)}[op]
    assert (None, 0) in got and (5, n[1]) in got


def blobs(texts, tag, bits=2):
    bodies = pa.array([t.encode() for t in texts], pa.binary())
    doc = np.arange(len(texts)) + tag * 1000
    parts = [R.entries(b, suffix_index.SHAPE, doc, np.zeros(len(texts), np.int32))
             for b in R.blocks(bodies, suffix_index.SHAPE)]
    return R.batch_rows(parts, bits)


def test_index_levels_can_be_extended():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcd ") for _ in range(3000)) for _ in range(24)]
    batches = [blobs(texts[k:k + 2] + [texts[0]], k) for k in range(0, 24, 2)]
    whole = pa.Table.from_batches(batches)
    for bucket in range(4):
        rows = [r for r in whole.to_pylist() if r["bucket"] == bucket]
        found, family = suffix_index.scan_bucket(pa.Table.from_pylist(rows, schema=R._OUT))
        sizes = [len(x["rank"]) for x in family.levels]
        assert all(a.bit_length() > b.bit_length() for a, b in zip(sizes, sizes[1:]))
        # half first, its levels stored, then the rest: the same repeats in all
        half = sorted((r for r in rows if r["kind"] == "R"), key=lambda r: r["batch"])
        early, late = half[:len(half) // 2], half[len(half) // 2:]
        _, first = suffix_index.scan_bucket(pa.Table.from_pylist(early, schema=R._OUT), False)
        stored = [{"bucket": bucket, "batch": 0, "kind": "L", "blob": R.pack(x)} for x in first.levels]
        _, both = suffix_index.scan_bucket(pa.Table.from_pylist(stored + late, schema=R._OUT), False)
        assert sorted(both.all()["run"].tolist()) == sorted(family.all()["run"].tolist())


def test_pieces_of_a_long_text_cover_all_windows(monkeypatch):
    rnd = random.Random(5)
    body = bytes(rnd.randrange(256) for _ in range(20_000))
    monkeypatch.setattr(R, "BLOCK_TOKENS", 3000)
    seen = np.zeros(len(body), int)
    for block in R.blocks(pa.array([b"abc", body, b""], pa.binary()), suffix_index.SHAPE):
        c = R.entries(block, suffix_index.SHAPE, np.array([1, 2, 3]), np.zeros(3, np.int32))
        own = c["doc"] == 2
        np.add.at(seen, R.ranges(c["start"][own], c["n"][own].astype(np.int64)), 1)
    assert (seen[:len(body) - 99] == 1).all() and not seen[len(body) - 99:].any()


def test_anchors_do_not_depend_on_the_block():
    rnd = random.Random(6)
    body = bytes(rnd.randrange(97, 100) for _ in range(5000))
    alone = R.blocks(pa.array([body], pa.binary()), suffix_index.SHAPE)
    beside = R.blocks(pa.array([b"x" * 300_000, body], pa.binary()), suffix_index.SHAPE)
    one, two = (R.entries(next(b), suffix_index.SHAPE, np.arange(2), np.zeros(2, np.int32)) for b in (alone, beside))
    two = R.pick(two, two["doc"] == 1)
    assert all((one[k] == two[k]).all() for k in ("kgram", "run", "start", "n"))


def test_suffix_automaton_statistics():
    rnd = random.Random(2)
    for _ in range(200):
        automaton, held = suffix_automaton.SuffixAutomaton(), []
        for _ in range(4):
            tokens = [rnd.randrange(3) for _ in range(rnd.randint(1, 14))]
            want = []
            for j in range(len(tokens)):
                want.append(next(n for n in range(j + 1, -1, -1) if n == 0 or any(
                    h[a:a + n] == tokens[j + 1 - n:j + 1] for h in held for a in range(len(h)))))
            assert automaton.statistics(tokens) == want
            automaton.add(tokens)
            held.append(tokens)


def test_buckets_follow_the_input(spark, tmp_path, monkeypatch):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    least = R.bucket_bits(docs)
    want = sorted(map(str, suffix_automaton.remove(docs).collect()))
    monkeypatch.setattr(R, "BUCKET_BYTES", 4)
    assert R.bucket_bits(docs) > least == R.BUCKET_BITS
    assert sorted(map(str, suffix_automaton.remove(docs).collect())) == want


@pytest.mark.parametrize("size", [1 << 20, 200, 7, 1])
@pytest.mark.parametrize("op, length, split, join", [(suffix_automaton, 20, bytes.split, b" ".join),
                                                     (suffix_index, 100, list, bytes)])
def test_texts_in_pieces_of_any_size(monkeypatch, size, op, length, split, join):
    """Blocks of a long text hold the same windows, and the cut gives the same bytes."""
    monkeypatch.setattr(R, "BLOCK_TOKENS", size)
    rnd = random.Random(size)
    texts = [" ".join("abcé"[rnd.randrange(4)] * rnd.randint(1, 9) for _ in range(300)), "x" * 500, " \t ", "",
             "  a  bb \n ccc  " * 60, "word " * 19, "word " * 20]
    for text in texts:
        body = text.encode()
        whole = [w.tolist() for w in R.document_tokens(body, op.SHAPE)]
        windows = {}
        for block in R.blocks(pa.array([body], pa.binary()), op.SHAPE):
            for i in range(len(block.values[0]) - length + 1):
                assert block.offset + i not in windows  # each window is in one piece
                windows[block.offset + i] = block.values[0][i:i + length].tolist()
        n = len(split(body))
        assert len(whole[0]) == n and windows == {i: whole[0][i:i + length] for i in range(n - length + 1)}
        gone = np.array([rnd.random() < 0.3 for _ in range(n)], bool)
        if op is suffix_automaton:
            assert R.kept_words(body, lambda k: gone) [0::2] == (
                n, b" ".join(w for w, g in zip(body.split(), gone) if not g))


def test_equal_ranks_of_different_runs_are_told_apart():
    """Entries whose 64-bit ranks collide inside a level are all found."""
    def entry(kgram, run, doc):
        return {"kgram": np.array(kgram, np.uint64), "run": np.array(run, np.uint64), "doc": np.array(doc, np.int64),
                "tag": np.zeros(len(doc), np.int32), "start": np.zeros(len(doc), np.int64),
                "n": np.ones(len(doc), np.uint8)}
    grams = np.array([5, 9, 70, 1 << 40], np.uint64)
    runs = R.mix(grams) ^ np.uint64(12345)  # one rank for all
    family = suffix_index.Family()
    assert family.scan(entry(grams, runs, [1, 2, 3, 4])) == []
    later = R.joined([R.pick(x, np.argsort(x["doc"])) for x in family.scan(entry(grams[::-1], runs[::-1], [8, 7, 6, 5]))])
    assert sorted(later["doc"].tolist()) == [5, 6, 7, 8]
