"""Benchmark decontamination through a distributed positional inverted index (DataFrame only).

Windows of ``WINDOW`` consecutive words of benchmark items are the phrases
looked for. ``build_index`` stores the postings (term, document, position) of
training words that occur in the benchmark, written where the documents are
read, without a shuffle. Term counts come from these postings. For every phrase
the offset-adjusted posting lists of its two rarest terms are intersected; the
few starts that survive are then checked against the postings of all other
terms of the phrase, so a match is exact, word by word. ``proximity_matches``
returns the places where all terms of a phrase stand in order with up to
``slack`` other words between them.

Hot terms: a posting list is never gathered; lists are joined and counted by
(document, start) or (document, position). The benchmark side (terms and
phrases) is broadcast up to ``BROADCAST_ROWS`` rows, counted first; beyond that
Spark joins by shuffle. So are the documents with surviving starts.

Defined results: null has no words; an item without words matches nothing;
items with equal phrases all count; a null item_id is the item ``null``; rows
that repeat a doc_id are told apart by their text; empty tables give no
matches; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import NULL_ID, ascii_lower, keyed, stored, text_or_empty, whole_row

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A posting of its own after the last word of every document; its position is the number of words.
END = " "
WINDOW = 10
BROADCAST_ROWS = 200_000


class Index(NamedTuple):
    postings: DataFrame  # term, _d, _t, pos; one END posting per document
    phrases: DataFrame  # phrase, n, off, term: a row per term of each phrase
    items: DataFrame  # phrase, item_id


def words(text: str = "text"):
    return F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(WORD), F.lit(0))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint up to a checked number of rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def build_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> Index:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
                             words().alias("ws")).where(F.size("ws") > 0)
    first = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - window))
    windows = items.select("item_id", "ws", F.explode(first).alias("at")).select(
        "item_id", F.slice("ws", F.col("at") + 1, window).alias("ws"))
    # a phrase is named by two hashes of its words (128 bits)
    key = F.concat_ws(":", F.xxhash64("ws").cast("string"), F.xxhash64(F.lit(7), "ws").cast("string"))
    windows = stored(windows.select(key.alias("phrase"), "item_id", "ws"), "windows")
    distinct = windows.dropDuplicates(["phrase"]).select(
        "phrase", F.size("ws").alias("n"), F.posexplode("ws").alias("off", "word"))
    phrase_terms = stored(distinct.select("phrase", "n", "off", "word",
                                          F.xxhash64("word").alias("term")), "phrases")
    end = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.xxhash64(F.lit(END)).alias("term"))
    terms = phrase_terms.select("word", "term").distinct().union(end)
    found = F.regexp_extract_all(text_or_empty(), F.lit(ANY_CASE), F.lit(0))
    tokens = keyed(docs).select("_d", "_t", F.posexplode(F.concat(found, F.array(F.lit(END)))).alias("pos", "word"))
    # the same as ascii_lower, which is slow, where a word has no other characters
    lower = F.when(F.octet_length("word") == F.char_length("word"), F.lower("word")).otherwise(
        ascii_lower(F.col("word")))
    postings = tokens.withColumn("word", lower).join(small(terms, terms.count()), "word").select("term", "_d", "_t", "pos")
    return Index(stored(postings, "postings"), phrase_terms.drop("word"),
                 windows.select("phrase", "item_id").distinct())


def rarest_terms(index: Index, keep: int = 2) -> DataFrame:
    """The ``keep`` rarest places of each phrase: phrase, n, off, term, rank (1: rarest).

    A phrase with a term that no document has can't occur and is left out.
    """
    counts = stored(index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "counts")
    found = index.phrases.join(small(counts, counts.count()), "term", "left")
    inside = Window.partitionBy("phrase")
    return (found.withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(inside))
            .where("least > 0")
            .withColumn("rank", F.row_number().over(inside.orderBy("df", "off")))
            .where(F.col("rank") <= keep).select("phrase", "n", "off", "term", "rank"))


def candidate_starts(index: Index, rare: DataFrame) -> DataFrame:
    """(phrase, n, _d, _t, start) where the rarest lists of a phrase meet."""
    need = rare.groupBy("phrase").agg(F.count(F.lit(1)).alias("need"))
    rare = rare.join(need, "phrase")
    lists = index.postings.join(small(rare, rare.count()), "term").select(
        "phrase", "n", "need", "_d", "_t", (F.col("pos") - F.col("off")).alias("start"))
    return (lists.groupBy("phrase", "n", "need", "_d", "_t", "start").agg(F.count(F.lit(1)).alias("found"))
            .where("found = need").drop("need", "found"))


def phrase_matches(index: Index) -> DataFrame:
    """(phrase, n, _d, _t, start) of every exact occurrence of a phrase."""
    rare = stored(rarest_terms(index), "rarest")
    starts = stored(candidate_starts(index, rare), "starts")
    others = index.phrases.join(rare.select("phrase", "off"), ["phrase", "off"], "left_anti") \
        .select("phrase", "off", "term")
    counts = index.phrases.select("phrase").distinct()
    wanted = starts.join(small(others, others.count()), "phrase").select(
        "phrase", "n", "_d", "_t", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    holders = starts.select("_d", "_t").distinct()
    near = index.postings.join(small(holders, holders.count()), ["_d", "_t"], "left_semi")
    checked = wanted.join(near, ["_d", "_t", "pos", "term"]).groupBy(
        "phrase", "n", "_d", "_t", "start").agg(F.count(F.lit(1)).alias("found"))
    sizes = rare.groupBy("phrase").agg(F.count(F.lit(1)).alias("known"))
    starts = starts.join(small(sizes, counts.count()), "phrase")
    return (starts.join(checked, ["phrase", "n", "_d", "_t", "start"], "left")
            .where(F.coalesce("found", F.lit(0)) + F.col("known") == F.col("n"))
            .select("phrase", "n", "_d", "_t", "start"))


def proximity_matches(index: Index, slack: int) -> DataFrame:
    """(phrase, _d, _t, start, gap): all terms of a phrase in order, with ``gap`` (0..slack) other words between.

    Every place of a phrase's rarest term opens a window that any such match through it fits in. The
    phrase's postings in that window are brought together by (document, term, block of positions), so
    at most a window's length of them meets, however long the document or frequent the term. From each
    place of the first term in the window, the others are taken at their next place in turn.
    """
    rare = stored(rarest_terms(index, 1), "rarest")
    anchors = index.postings.join(small(rare, rare.count()), "term").select(
        "phrase", "n", "_d", "_t", F.col("pos").alias("at"), (F.col("pos") - F.col("off") - slack).alias("lo"),
        (F.col("pos") - F.col("off") + F.col("n") - 1 + slack).alias("hi"))
    longest = WINDOW + 2 * slack
    block = lambda c: F.floor(c / longest).cast("int")
    terms = index.phrases.groupBy("phrase").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("off", "term"))), lambda x: x["term"]).alias("terms"))
    phrase_terms = index.phrases.select("phrase", "term").distinct()
    wanted = anchors.withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))))
    wanted = wanted.join(small(phrase_terms, phrase_terms.count()), "phrase")
    places = index.postings.withColumn("block", block(F.col("pos")))
    window = (wanted.join(places, ["_d", "_t", "term", "block"]).where("pos between lo and hi")
              .groupBy("phrase", "n", "_d", "_t", "at")
              .agg(F.collect_set(F.struct("term", "pos")).alias("near")))
    window = window.join(small(terms, rare.count()), "phrase")

    def places_of(term, after):
        return F.transform(F.filter("near", lambda x: (x["term"] == term) & (x["pos"] > after)), lambda x: x["pos"])

    def end(first):
        return F.aggregate(F.slice("terms", F.lit(2), F.size("terms")), first,
                           lambda at, term: F.array_min(places_of(term, at)))

    starts = places_of(F.element_at("terms", 1), F.lit(-1))
    matches = F.transform(starts, lambda first: F.struct(
        first.alias("start"), (end(first) - first - F.col("n") + 1).alias("gap")))
    return (window.select("phrase", "_d", "_t", F.explode(matches).alias("m")).select("phrase", "_d", "_t", "m.*")
            .where(F.col("gap").between(0, slack)).distinct())


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _d, _t, n_words, n_hit, n_items, items, contaminated), a row per document."""
    index = build_index(docs, benchmark, window)
    matches = stored(phrase_matches(index), "matches")
    places = F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)
    hits = matches.select("_d", "_t", F.explode(places).alias("pos")).distinct() \
        .groupBy("_d", "_t").agg(F.count(F.lit(1)).alias("n_hit"))
    items = matches.select("_d", "_t", "phrase").distinct().join(index.items, "phrase") \
        .groupBy("_d", "_t").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    counted = index.postings.where(F.col("term") == F.xxhash64(F.lit(END))).select(
        F.when(F.col("_d") != NULL_ID, F.col("_d")).alias("doc_id"), "_d", "_t",
        F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return (counted.join(hits.join(items, ["_d", "_t"]), ["_d", "_t"], "left")
            .select("doc_id", "_d", "_t", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), a row per document."""
    return marked(docs, benchmark, window).drop("_d", "_t")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark phrase.

    Rows are found again by doc_id and two hashes of the text, so a clean row
    stays beside a contaminated one with the same doc_id, or none.
    """
    text = text_or_empty()
    names = {"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(7), text)}
    found = marked(docs, benchmark, window).where("contaminated").select("_d", "_t")
    bad = keyed(docs).withColumns(names).join(found, ["_d", "_t"], "left_semi").select(
        F.col("_d").alias("_bad"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b")).distinct()
    same = ((F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("_bad"))
            & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")))
    rows = docs.select(whole_row(docs), "doc_id", *[h.alias(c) for c, h in names.items()])
    return rows.join(bad, same, "left_anti").select("_row.*")
