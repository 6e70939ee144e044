"""The other corpus operators on small fixtures: edge cases, properties, brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import decontamination, exact_dedup, langid, mixing, quality, sharding, simhash, warc
from ledgerline.llm.common import keyed
from ledgerline.llm.queries import QUERIES, fold

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, score int, fp int"


def documents(spark, rows):
    full = [(i, t, lang, source, 0, 7, 7, 7, 7) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def test_language_spans_and_edge_cases(spark):
    rnd = random.Random(0)
    vocabulary = {"aa": "the of and house water".split(), "bb": "der die und haus wasser".split(),
                  "cc": "и в не дом вода".split()}
    say = lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, say(lang, 40), lang, None) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    model = langid.train(documents(spark, rows))
    probe = [(900, say("aa", 30) + ". " + say("bb", 60), None, None), (901, None, None, None),
             (902, "123 ... !!", None, None), (903, say("cc", 3), None, None), (904, "", None, None),
             (None, say("bb", 5000), None, None), (903, say("cc", 3), None, None)]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, probe), model).collect()}
    assert got[900]["lang_pred"] == "bb" and [s["lang"] for s in got[900]["spans"]] == ["aa", "bb"]
    assert abs(got[900]["spans"][1]["first_word"] - 30) <= 2
    assert [got[i]["lang_pred"] for i in (901, 902, 904)] == ["und"] * 3 and got[901]["score"] == 0
    assert got[903]["lang_pred"] == "cc" and got[None]["lang_pred"] == "bb"
    nothing = langid.train(documents(spark, rows).limit(0))
    assert langid.identify(documents(spark, probe), nothing).where("lang_pred != 'und'").count() == 0


def test_viterbi_shortcut_is_exact():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        s, penalty = rnd.normal(0, 2, (rnd.integers(1, 9), 3)), 3.0
        paths = np.array(np.meshgrid(*[range(3)] * len(s))).reshape(len(s), -1).T
        value = lambda p: s[np.arange(len(s)), p].sum() - penalty * (np.diff(p) != 0).sum()
        assert value(langid.viterbi(s, penalty)) == pytest.approx(max(value(p) for p in paths))


def test_viterbi_switches_between_languages_that_are_not_best_overall():
    """Two stretches pay for one switch, so each needs only half a penalty of gain."""
    s = np.array([[0.0, -20.0, -8.0], [-20.0, 0.0, -8.0]])
    assert langid.viterbi(s, 12.0).tolist() == [0, 1]


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_reaches_the_best_value(seed):
    rnd = np.random.default_rng(seed)
    for n, m, spread in [(n, m, spread) for n in (2, 3, 5, 9, 20) for m in (2, 3, 6) for spread in (1, 2, 5)]:
        penalty, s = rnd.uniform(1, 12), -np.abs(rnd.normal(0, spread, (250, n, m)))
        best = s[:, 0]  # of all paths, for all cases at once
        for i in range(1, n):
            best = np.maximum(best, best.max(axis=1, keepdims=True) - penalty) + s[:, i]
        got = []
        for case in s:
            p = langid.viterbi(case, penalty)
            got.append(case[np.arange(n), p].sum() - penalty * (np.diff(p) != 0).sum())
        assert got == pytest.approx(best.max(axis=1).tolist())


def test_scripts():
    w = langid.words_of(["abc дом 漢字 é"])
    assert [langid.SCRIPTS[i] for i in w.script] == ["latin", "cyrillic", "han", "latin"]


def test_held_out_accuracy(spark):
    path = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op1_language_id"](spark, path).join(docs, "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    labels = spark.read.parquet(f"{path}/labels.parquet")
    out = QUERIES["op4_quality"](spark, path).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score.values, out[out.quality == 0].score.values
    assert (good[:, None] > bad).mean() > 0.85 and (good >= 0.3).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_quality_edge_cases(spark):
    rows = [(i, ("good text about houses and water " if i % 2 else "%%% ### !!! $$$ ") * 20, None, None)
            for i in range(60)] + [(90, None, None, None), (91, "", None, None), (92, "x" * 300_000, None, None)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(90, 1, 0), (95, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["p"] for r in quality.score(docs, model, "p").collect()}
    assert min(got[i] for i in range(1, 60, 2)) > 0.8 > 0.2 > max(got[i] for i in range(0, 60, 2))
    assert got[90] == got[91] == model.base
    one = quality.train(docs, labels.where("quality = 1"))
    assert {r["p"] for r in quality.score(docs, one, "p").collect()} == {1.0}
    assert quality.train(docs, labels.limit(0)).base == 0.5
    assert quality.score(docs.limit(0), model).count() == 0


def test_warc_round_trip(spark):
    big, small = "<p>é" * 400, "tiny"
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", small), (5, "u", small),
            (6, "u", None), (7, "u", ""), (2, "http://b/", big), (None, "n", big), (8, "z", "q" * 1_000_00)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "page_id long, url string, html string, digest string, payload int")
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == 4
    records = warc.read_archive(archive).collect()
    want = {i: (h or "").encode() for i, _, h in rows}
    for r in records:
        body = want[r["page_id"]]
        assert bytes(r["payload"]) == body and r["payload_bytes"] == len(body)
        assert r["payload_digest"] == hashlib.sha1(body).hexdigest()
        revisit = body == big.encode() and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
    for r in warc.record_bytes(warc.read_archive(archive)).collect():
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) - 4
        payload = block[:-4].split(b"\r\n\r\n", 1)[1]
        assert payload == (b"" if fields["WARC-Type"] == "revisit" else want[r["page_id"]])
    swapped = archive._replace(payloads=archive.payloads.withColumn("packed", F.lit(None).cast("binary")))
    with pytest.raises(Exception, match="doesn't match"):
        warc.read_archive(swapped).collect()
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def test_sharding(spark):
    rnd = random.Random(0)
    rows = [(i, "x" * rnd.randint(0, 400), None, None) for i in range(1500)]
    rows += [(5000 + i, "same text", None, None) for i in range(300)] + [(5, None, None, None), (5, None, None, None)]
    rows += [(9000 + i, "hot" * 400, None, None) for i in range(600)]
    out, maps = sharding.shard_documents(documents(spark, rows))
    got = out.toPandas()
    assert len(got) == len(rows)
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() < 1.02 * load.min()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc_id.between(5000, 5299)].shard.nunique() == 1  # equal texts stay together
    assert got[got.doc_id >= 9000].shard.nunique() > 1  # unless they are too much for one slot
    assert set(got[got.doc_id == 5]["size"]) >= {1} and set(got.law) == {"bytes"}
    assert {r["version"] for r in maps.select("version").distinct().collect()} == {1, 2}
    assert sharding.shard_documents(documents(spark, rows).limit(0))[0].count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sharding_spreads_copies_that_share_a_doc_id(spark, doc_id):
    rnd = random.Random(1)
    rows = [(100 + i, f"{i} " + "x" * rnd.randint(0, 400), None, None) for i in range(1200)]
    rows += [(doc_id, "hot" * 70, None, None)] * 1000
    got = sharding.shard_documents(documents(spark, rows))[0].toPandas()
    assert len(got) == len(rows)
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() < 1.05 * load.min()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc_id >= 100].doc_id.nunique() == 1200
    assert got[got["size"] == 211].virtual_slot.nunique() > 100


def test_growing_moves_slots_into_the_new_shard_only():
    sizes = {s: 100 + s % 37 for s in range(4096)}
    before = sharding.rebalance({}, sizes, 8)
    after = sharding.rebalance(before, sizes, 9)
    assert {after[s] for s in sizes if after[s] != before[s]} == {8}


def brute_mix(rows):
    sizes, sources = {}, {}
    for i, t, _, s in rows:
        sizes[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sources[s] = sources.get(s, 0) + sizes[i]
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(sources.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * sources[s]}
        for s in over or free:
            target[s] = 3 * sources[s] if over else level * weight[s]
        free -= over or free
    return sizes, sources, target


@pytest.mark.parametrize("seed", [0, 1])
def test_mixing(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.randint(0, 60) if rnd.random() < 0.95 else None, None,
             rnd.choice(["a", "a", "a", "a", "b", "c", None, "é", "Z"])) for i in range(400)]
    sizes, sources, target = brute_mix(rows)
    got = mixing.mix(documents(spark, rows)).toPandas().set_index("doc_id")
    by_source = {s: 0 for s in sources}
    for i, _, _, s in rows:
        r = got.loc[i]
        assert (r["size"], r.source_size) == (sizes[i], sources[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * sizes[i]
        by_source[s] += r.taken
    assert all(abs(by_source[s] - target[s]) <= 1 for s in sources)
    again = mixing.mix(documents(spark, rows)).toPandas().set_index("doc_id")
    assert (got.taken.sort_index() == again.taken.sort_index()).all()
    positions = mixing.mix(documents(spark, rows)).select("position").toPandas().position
    assert positions.is_monotonic_increasing
    copies = mixing.mixed_texts(documents(spark, rows)).select("doc_id", "text").toPandas()
    words = copies.text.fillna("").str.count(r"[^\x20\x09-\x0D]+").groupby(copies.doc_id).sum()
    assert all(words.get(i, 0) == got.loc[i].taken for i in sizes)
    assert mixing.mix(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("words", [True, False])
def test_mixing_keeps_sources_without_words(spark, words):
    """Without words a source's target is 0; its documents take part once, unchanged."""
    rows = [(1, None, None, "blank"), (2, "", None, "blank"), (3, " \t\n", None, "blank"), (None, None, None, None)]
    rows += [(10 + i, "one two three" if words else " ", None, "full") for i in range(20)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and set(got[got.doc_id.isin([1, 2, 3])].target) == {0.0}
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()]
    blank = sorted(((i, t) for i, t, *_ in rows if not (t or "").strip()), key=repr)
    assert sorted((r for r in out if not (r[1] or "").strip()), key=repr) == blank
    assert sum(len((t or "").split()) for _, t in out) == (60 if words else 0)


def test_demand_inverse(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for slope in (-0.9, -0.5, 0.0, 0.5):
        t = mixing.demand_inverse(F.col("u"), F.lit(slope))
        worst = df.select(F.max(F.abs((1 - slope) * t + slope * t * t - F.col("u")))).first()[0]
        assert worst < 1e-12


def brute_contamination(rows, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(
        {c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - n + 1) if ws else 0):
            windows.setdefault(tuple(ws[k:k + n]), set()).add(str(item) if item is not None else "null")
    out = []
    for i, t, *_ in rows:
        ws, hit, found = words(t), set(), set()
        for w, own in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k:k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= own
        out.append((i, len(ws), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("the of a at in x1 élan Ünit zeta 中文 rho".split())
    items = [(1, " ".join(word() for _ in range(14))), (2, "the Of"), (3, None), (4, ""), (5, "zeta " * 12),
             (6, " ".join(word() for _ in range(10))), (6, "solo"), (None, "rho rho rho")]
    items.append((7, items[0][1]))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 60))), None, None) for i in range(60)]
    rows += [(100, f"x {items[0][1].upper()}. tail", None, None), (101, None, None, None), (102, "zeta-" * 30, None, None),
             (103, items[5][1].replace(" ", ", "), None, None), (104, "SOLO", None, None), (104, "other", None, None)]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, pos int")
    docs = documents(spark, rows)
    got = sorted((tuple(r) for r in decontamination.contamination(docs, bench).collect()), key=repr)
    assert got == brute_contamination(rows, items)
    rows += [(None, f"y {items[0][1]}", None, None), (None, "quite clean", None, None), (None, None, None, None)]
    clean = decontamination.clean_documents(documents(spark, rows), bench)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted(
        ((i, t) for i, t, *_ in rows if not brute_contamination([(i, t)], items)[0][-1]), key=repr)
    assert clean.columns == docs.columns
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    near = decontamination.build_index(documents(spark, [(1, "alpha x x beta gamma", None, None)]),
                                       spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    assert decontamination.phrase_matches(near).count() == 0
    assert [r["gap"] for r in decontamination.proximity_matches(near, 3).collect()] == [2]


def test_exact_dedup(spark):
    rows = [(1, "Same É", None, None), (9, "sAME É", None, None), (4, "same é", None, None), (2, None, None, None),
            (3, "", None, None), (9, "unique", None, None), (None, "unique", None, None), (7, "x" * 200_000, None, None)]
    rows += [(100 + i, "Copy", None, None) for i in range(500)]
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"])
           for r in exact_dedup.dedup(documents(spark, rows)).collect()}
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, key("same É")] == (9, 2, False) and got[9, key("same É")] == (9, 2, True)
    assert got[4, key("same é")] == (4, 1, True) and got[2, key("")] == (3, 2, False)
    assert got[None, key("unique")] == (9, 2, False) and got[599, key("copy")] == (599, 500, True)
    assert exact_dedup.dedup(documents(spark, rows).limit(0)).count() == 0


def test_counting_quotient_filter_merges_losslessly():
    rnd = np.random.default_rng(0)
    values = rnd.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2)
    parts = [np.sort(rnd.choice(values, 2000)) for _ in range(4)]
    decoded = []
    for p in parts:
        fps, counts = np.unique(p, return_counts=True)
        decoded += [exact_dedup.decode(**b) for b in exact_dedup.encode(fps, counts)]
    fps, counts = exact_dedup.merge_sorted(np.concatenate([d[0] for d in decoded]),
                                           np.concatenate([d[1] for d in decoded]))
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert (fps == want[0]).all() and (counts == want[1]).all()


def test_byte_verification_separates_equal_fingerprints(spark):
    """The group key is the text: rows of one fingerprint with different bytes stay apart."""
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "fp long, norm string")
    assert sorted(r["count"] for r in df.groupBy("fp", "norm").count().collect()) == [1, 2]


def brute_simhash(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    sh = [" ".join(ws[k:k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_fingerprints(spark):
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO\tthree É four"), (4, "a " * 70_000), (5, " \n")]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    assert {i: v & ((1 << 64) - 1) for i, v in got.items()} == {i: brute_simhash(t) for i, t in rows}


@pytest.mark.parametrize("block_rows", [simhash.BLOCK_ROWS, 1])
def test_simhash_links(spark, block_rows):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:8]:  # clusters and chains of close values
        for _ in range(30):
            b ^= 1 << rnd.randrange(64) if rnd.random() < 0.5 else (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            fps.add(b)
    fps = sorted(fps)
    parent = list(range(len(fps)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    roots = {r["id"]: r["root"] for r in simhash.components(simhash.links(nodes, block_rows=block_rows)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_simhash_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (3, text), (8, None), (9, ""), (None, ""), (10, "else where now then")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == len(rows) and set(got[got.doc_id.isin([3, 5])].component_id) == {3}
    assert set(got[got.fingerprint == "0" * 16].component_id) == {8}
    loose = documents(spark, [(None, text, "en", "s"), (None, "else where now then", "en", "s"),
                              (None, "else where now then", "en", "s"), (4, text.upper(), "en", "s"),
                              (7, "one more thing here", "en", "s"), (7, "far from any other text", "en", "s")])
    assert simhash.near_duplicates(loose).where("component_id is null").count() == 2
    first = [(r["doc_id"], r["text"]) for r in simhash.keep_first(loose).collect()]
    assert len(first) == 4 and (None, "else where now then") in first and {i for i, _ in first} == {None, 4, 7}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 8, 10]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.stored(docs, "test")
        assert docs.columns == columns and 0 < docs.count() <= 3 * rows, name
        if name == "quality":  # the stage decides as the query does
            scores = QUERIES["op4_quality"](spark, SF).where("predicted = 1")
            assert docs.select("doc_id").exceptAll(scores.select("doc_id")).count() == 0 \
                and docs.count() == scores.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and corpus_pipeline.run(spark, SF).count() == last.count()


def test_stages_keep_columns_with_clashing_names(spark):
    """Columns named like the operators' own, or with a dot, come out as they went in."""
    extra = ["_row", "_h1", "_h2", "_n", "_d", "_t", "_a", "_copy", "_quality", "score", "size", "fp", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).select(
        "*", *[F.col("doc_id").cast("string").alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        same = [F.col(f"`{c}`").eqNullSafe(F.col("doc_id").cast("string")) for c in extra]
        rows = out.select("doc_id", *[s.alias(f"c{i}") for i, s in enumerate(same)]).collect()
        assert rows and all(all(r[1:]) for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 80


def test_rows_of_one_id_are_numbered_by_text(spark):
    rows = [(None, f"t{i % 40}") for i in range(300)] + [(1, "b"), (1, None), (1, "a"), (2, "z")]
    got = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len({(r["_d"], r["_t"]) for r in got}) == len(rows)
    for i in (None, 1, 2):
        own = sorted((r["_t"], r["text"] is not None, r["text"] or "") for r in got if r["doc_id"] == i)
        assert [o[0] for o in own] == list(range(len(own))) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_folds(spark):
    df = spark.createDataFrame([(0,), (7,), (None,)], "doc_id long").select(fold("doc_id", 4).alias("k"))
    import zlib
    assert [r["k"] for r in df.collect()] == [zlib.crc32(b"0") % 4, zlib.crc32(b"7") % 4, 0]


def test_texts_with_equal_fingerprints_stay_apart(spark):
    """With a fingerprint that collides for all texts, only equal texts form groups."""
    rows = [(1, "A b", None, None), (2, "a B", None, None), (3, "c", None, None), (4, None, None, None),
            (5, "", None, None), (6, "d" * 300_000, None, None), (7, "D" * 300_000, None, None)]
    for fingerprint in (lambda c: F.length(F.lit("x")).cast("long"), lambda c: F.length(c).cast("long") % 2):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(
            documents(spark, rows), fingerprint).collect()}
        assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True),
                       6: (7, 2, False), 7: (7, 2, True)}


def test_filter_blocks_follow_the_rows(spark, monkeypatch):
    docs = documents(spark, [(i, f"text {i // 2}", None, None) for i in range(3000)])
    want = sorted(map(tuple, exact_dedup.dedup(docs).collect()))
    assert exact_dedup.block_bits(3000) == 10 and exact_dedup.block_bits(10 ** 11) == 17
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 1)
    assert exact_dedup.block_bits(3000) == 12
    assert sorted(map(tuple, exact_dedup.dedup(docs).collect())) == want


def test_partition_filters_merge_by_doubling():
    import pyarrow as pa
    rnd = np.random.default_rng(1)
    fps = rnd.integers(0, 5000, 40_000, np.int64) << 40
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], names=["fp"]) for x in np.array_split(fps, 37)]
    rows = [r for b in exact_dedup.partition_filters(10)(batches) for r in b.to_pylist()]
    parts = [exact_dedup.decode(**r) for r in rows]
    got = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    want = np.unique(fps.view(np.uint64), return_counts=True)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_mixing_buckets_follow_the_rows(spark, monkeypatch):
    rows = [(i % 40 if i < 200 else None if i < 320 else i, f"w{i} " * (i % 7), "ab"[i % 2], None) for i in range(500)]
    docs = documents(spark, [(i, t, None, s) for i, t, s, _ in rows])
    want = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert mixing.bucket_digits(500) == 3 and mixing.bucket_digits(10 ** 11) == 6
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 0.001)
    assert mixing.bucket_digits(500) == 5
    again = mixing.mix(docs)
    assert {r["source"]: r["n"] for r in again.groupBy("source").agg(F.sum("taken").alias("n")).collect()} == want
    goals = {r["source"]: round(r["target"]) for r in again.collect()}
    assert want == goals  # every word of the target is taken, none twice
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(11)))
    assert a == b  # rows that share an id, or have none, are cut alike


def test_repeated_ids_have_many_buckets(spark):
    docs = documents(spark, [(None if i % 2 else 7, f"text {i}", None, "s") for i in range(400)])
    sized = mixing.sized_documents(docs)
    many = sized.groupBy("_hash").count().where("count > 1").select("_hash", F.lit(True).alias("_many"))
    counts = mixing.bucketed(sized, 3, many).groupBy("_bucket").count()
    assert counts.agg(F.max("count")).first()[0] < 10


def test_long_texts_are_labelled_in_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = {"aa": "the of and house water".split(), "bb": "der die und haus wasser".split()}
    say = lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    model = langid.train(documents(spark, [(i, say(lang, 40), lang, None) for i, lang in enumerate(["aa", "bb"] * 20)]))
    texts = [say("aa", 300) + "! " + say("bb", 500), "x" * 5000, "", None, say("bb", 3), " ".join(["é1"] * 900)]
    want = langid.label(texts, model)
    monkeypatch.setattr(langid, "BLOCK", 64)
    monkeypatch.setattr(langid, "pieces", lambda t, size=64: list(_pieces(t, 64)))
    got = [langid.label([t], model)[0] for t in texts]
    for a, b in zip(got, want):
        assert a["lang_pred"] == b["lang_pred"] and a["spans"] == b["spans"] and a["score"] == pytest.approx(b["score"])


_pieces = langid.pieces


def test_pieces_cut_no_word():
    text = "abc def, ghi " * 50 + "z" * 200 + " é"
    parts = list(langid.pieces(text, 20))
    assert "".join(parts) == text and len(parts) > 10
    assert [w for p in parts for w in re.findall(r"\w+", p)] == re.findall(r"\w+", text)


@pytest.mark.parametrize("seed", [0, 1])
def test_proximity_matches_brute_force(spark, seed):
    """All terms in order with up to slack words between, from every place of the first term."""
    rnd = random.Random(seed)
    words = "abcdefgh"
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [say(n) for n in (1, 2, 3, 3, 4, 12)] + [["z", "a"]]
    texts = [say(n) for n in (0, 3, 40, 200, 7)] + [[*items[5][:4], "x", *items[5][4:9], "y", "y", items[5][9]], items[5]]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id int, text string")
    docs = documents(spark, [(i, " ".join(t), None, None) for i, t in enumerate(texts)])
    index = decontamination.build_index(docs, bench)
    keys = {}
    for r in index.phrases.orderBy("phrase", "off").collect():
        keys.setdefault(r["phrase"], []).append(r["term"])
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words + "xyz"], "w string")
              .withColumn("h", F.xxhash64("w")).collect()}
    want = set()
    for phrase, terms in keys.items():
        for d, text in enumerate(texts):
            at = [hashes[w] for w in text]
            for first in (i for i, t in enumerate(at) if t == terms[0]):
                end = first
                for t in terms[1:]:
                    end = next((j for j in range(end + 1, len(at)) if at[j] == t), None)
                    if end is None:
                        break
                if end is not None and end - first - len(terms) + 1 <= 3:
                    want.add((phrase, d, first, end - first - len(terms) + 1))
    got = [(r["phrase"], r["_d"], r["start"], r["gap"]) for r in decontamination.proximity_matches(index, 3).collect()]
    assert set(got) == want and len(got) == len(want) and any(g[3] for g in want)
