"""Spelling variants of a vocabulary, found with FM-index searches that allow one error.

A word one edit away from another keeps one of the other's halves whole. Each
search matches that half exactly, from its delimiter, and extends across the
other half with one inserted, deleted or replaced code point up to the closing
delimiter. The index of a shard of the delimited vocabulary is bidirectional: a
search for a left half extends to the right, on the sorted rotations of the
reversed words, a search for a right half extends to the left, on those of the
words; each direction has shards of its own, so a shard builds the one it needs.
A state of a search is an interval of suffix ranks; a step narrows it by one
character (backward search), all searches of a shard at once.

Shards hold words by a hash of the half they share with a searcher, so only
words that have this half meet. A half with more than ``HOT`` words is dealt
over pieces by word, and its searches run on every piece. The number of shards
follows the size of the vocabulary. A pair that shares both halves' searches is
counted by the left one only, and a shard returns a count and the best partner
for each word, never pairs.

A word's form is its most frequent near word if that is at least twice as
frequent; the root is the end of the chain of forms. Counts at least double on
every step, so the chain is short; roots come from pointer jumping.

Defined results: null texts have no words; a null doc_id hashes like an empty
one; rows with equal ids each count; an empty table gives no rows; a word may be
as long as its text; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import group_arrow, map_arrow, stored
from ledgerline.operators.joins import dim

#: Letters of a word, after lower-casing A-Z (fixed by the contract).
RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many (document, run) pairs loses a code point (fixed by the contract).
DROP = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Index words of a shard, on average, and words of one half beyond which it is dealt over pieces.
SHARD, HOT = 50_000, 200_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 500_000
#: Code points of the searches that run together.
TOGETHER = 1 << 18


# --- the vocabulary ---

def words_of(doc_id, text: str) -> Counter:
    """The words of a text with their counts, after the deletions that the document's id decides."""
    lower = text.encode("utf-8", "replace").lower().decode("utf-8")  # bytes: A-Z only
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    out = Counter()
    for run, n in Counter(RUN.findall(lower)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def _counts(batches):
    total = Counter()

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            if text.is_valid:
                total.update(words_of(doc_id.as_py(), text.as_py()))
                if len(total) >= COUNTED:
                    yield rows()
                    total.clear()
    if total:
        yield rows()


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``docs`` that are long and frequent enough."""
    parts = map_arrow(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")), _counts,
                      "word string, n long").where(F.length("word") >= min_length)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- the index of a shard ---

def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Index:
    """Sorted rotations of the delimited words, read backwards: a step appends a character to a match.

    Rows 0 to ``len(words)`` are the rotations that start with a delimiter.
    ``last`` holds the last column; ``keys`` its (character, row) pairs in order,
    so the place of such a pair is the row that the step leads to.
    """

    def __init__(self, words: list[str]):
        points = code_points(words)
        self.letters = np.unique(points)
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths + 1) - 1  # the delimiter of each word
        text = np.zeros(int(lengths.sum()) + len(words), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.searchsorted(self.letters, points) + 1
        # a step of a rotation goes one to the left, from the first letter to the word's delimiter
        step = np.arange(len(text)) - 1
        step[ends - lengths] = ends
        before = np.empty_like(step)
        before[step] = np.arange(len(text))
        order = self._sorted(text, step)
        self.n, self.rows = len(words), len(text)
        self.word_at = np.searchsorted(ends, order[:self.n])
        self.last = text[before[order]]
        by_letter = np.argsort(self.last, kind="stable")
        self.keys = self.last[by_letter] * (self.rows + 1) + by_letter

    @staticmethod
    def _sorted(text: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Positions in the order of their rotations; all differ, since the words do."""
        base = int(text.max(initial=0)) + 1
        key, at, room = text, step, base
        while room < (1 << 62) // base:  # as many characters as fit in a number
            key, at, room = key * base + text[at], step[at], room * base
        while True:
            order = np.argsort(key, kind="stable")
            fresh = np.append(False, key[order][1:] != key[order][:-1]) if len(order) else np.empty(0, bool)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(fresh)
            if not len(order) or rank[order[-1]] == len(order) - 1:
                return order
            key, at = rank * len(order) + rank[at], at[at]  # twice as many characters

    def encode(self, words: list[str]) -> np.ndarray:
        """Numbers of the letters; a letter that the index lacks gets one beyond all."""
        points = code_points(words)
        found = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(found, len(self.letters) - 1)] == points
        return np.where(known, found + 1, len(self.letters) + 1)

    def extend(self, letter, low, high):
        base = letter * (self.rows + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def children(self, low: np.ndarray, high: np.ndarray):
        """(state, letter, low, high) of every letter that can follow each interval."""
        sigma, size = len(self.letters), high - low
        small, big = np.flatnonzero(size <= sigma), np.flatnonzero(size > sigma)
        ends = np.cumsum(size[small])
        state = np.repeat(small, size[small])
        row = np.arange(len(state)) - np.repeat(ends - size[small], size[small]) + low[state]
        seen = np.unique(state * (sigma + 1) + self.last[row])
        state = np.append(seen // (sigma + 1), np.repeat(big, sigma))
        letter = np.append(seen % (sigma + 1), np.tile(np.arange(1, sigma + 1), len(big)))
        state, letter = state[letter > 0], letter[letter > 0]
        lo, hi = self.extend(letter, low[state], high[state])
        live = hi > lo
        return state[live], letter[live], lo[live], hi[live]


def search(index: Index, queries: list[str], halves: np.ndarray):
    """(query, word of the index) one edit apart, the first ``halves`` letters of the query being whole."""
    lengths = np.array([len(q) for q in queries], np.int64)
    letters = np.zeros((len(queries), int(lengths.max(initial=0)) + 2), np.int64)
    letters[np.arange(letters.shape[1]) < lengths[:, None]] = index.encode(queries)
    # exact: intervals of the queries' beginnings; near: intervals after an error
    q = np.arange(len(queries))
    low, high = np.zeros(len(q), np.int64), np.full(len(q), index.n, np.int64)
    near = [np.empty(0, np.int64)] * 3
    found = []
    for i in range(letters.shape[1] - 1):
        own = letters[q, i]
        # an error at i: a letter replaced (goes on at i + 1), put in before (goes on at i) or left out
        open_ = halves[q] <= i
        state, letter, lo, hi = index.children(low[open_], high[open_])
        by = q[open_][state]
        other = letter != letters[by, i]
        by, lo, hi = by[other], lo[other], hi[other]
        inside = lengths[by] > i
        out = open_ & (lengths[q] > i) & ((halves[q] == i) | (own != letters[q, i - 1]))
        now = [np.append(near[0], by), np.append(near[1], lo), np.append(near[2], hi)]
        later = [np.append(by[inside], q[out]), np.append(lo[inside], low[out]), np.append(hi[inside], high[out])]
        letter = letters[now[0], i]
        lo, hi = index.extend(letter, now[1], now[2])
        live = hi > lo
        done = live & (lengths[now[0]] == i)
        found.append((now[0][done], index.word_at[lo[done]]))
        live &= ~done
        near = [np.append(now[0][live], later[0]), np.append(lo[live], later[1]), np.append(hi[live], later[2])]
        low, high = index.extend(own, low, high)
        live = (high > low) & (lengths[q] > i)
        q, low, high = q[live], low[live], high[live]
    # words that end where the query's last letter was left out or replaced
    lo, hi = index.extend(letters[near[0], letters.shape[1] - 1], near[1], near[2])
    live = hi > lo
    found.append((near[0][live], index.word_at[lo[live]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def near_words(words: list[str], queries: list[str], reverse: bool):
    """(query, word) pairs one edit apart that share the half whose shard this is; each pair once.

    ``reverse``: the right half is shared; pairs that share the left one too are left out.
    """
    none = np.empty(0, np.int64)
    if not words or not queries:  # a piece of a hot half may have searches only
        return none, none
    turned = [w[::-1] for w in words] if reverse else words
    index = Index(turned)
    order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    pairs, at = [], 0
    while at < len(order):
        end = at + 1  # as many as fit, the longest sets the width
        while end < len(order) and (end - at + 1) * (len(queries[order[end]]) + 2) <= TOGETHER:
            end += 1
        some = [queries[i][::-1] if reverse else queries[i] for i in order[at:end]]
        halves = np.array([len(s) - len(s) // 2 if reverse else len(s) // 2 for s in some], np.int64)
        q, w = search(index, some, halves)
        pairs.append((np.array(order[at:end])[q], w))
        at = end
    q, w = (np.concatenate(c) for c in zip(*pairs))
    if reverse:
        left = [s[:len(s) // 2] for s in queries]
        keep = np.fromiter((not words[b].startswith(left[a]) for a, b in zip(q.tolist(), w.tolist())), bool, len(q))
        q, w = q[keep], w[keep]
    return q, w


_FOUND = "word string, n_near long, best struct<back:long,form:string>"


def _searched(table: pa.Table) -> pa.Table:
    """A count and the best partner for each searcher of a shard (role 1) among its words (role 0)."""
    role = np.asarray(table["role"])
    word, n = table["word"].to_pylist(), np.asarray(table["n"])
    counts = {word[i]: int(n[i]) for i in np.flatnonzero(role == 0)}
    words = sorted(counts)
    queries = sorted({word[i] for i in np.flatnonzero(role == 1)})
    q, w = near_words(words, queries, bool(table["reverse"][0].as_py()))
    times = np.array([counts[x] for x in words], np.int64)
    order = np.lexsort((w, -times[w], q))  # the words are sorted, so ties fall to the smallest
    q, w = q[order], w[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    best = pa.StructArray.from_arrays(
        [pa.array(-times[w[first]], pa.int64()), pa.array([words[i] for i in w[first]], pa.string())],
        names=["back", "form"])
    return pa.table({"word": pa.array([queries[i] for i in q[first]], pa.string()),
                     "n_near": pa.array(np.diff(np.append(first, len(q))), pa.int64()), "best": best})


# --- over the whole vocabulary ---

def _entries(words: DataFrame) -> DataFrame:
    """(word, n, role, reverse, half): under which halves a word is indexed (0) and searched for (1)."""
    own = F.floor(F.col("size") / 2)
    lengths = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def half(reverse: int, role: int, length):
        text = F.reverse("word") if reverse else F.col("word")
        return F.struct(F.lit(role).alias("role"), F.lit(reverse).alias("reverse"),
                        F.substring(text, F.lit(1), length.cast("int")).alias("half"))

    def indexed(reverse: int):
        shifted = F.transform(lengths, lambda d: F.col("size") + d - F.floor((F.col("size") + d) / 2)
                              if reverse else F.floor((F.col("size") + d) / 2))
        return F.transform(F.array_distinct(shifted), lambda h: half(reverse, 0, h))

    searched = F.array(half(0, 1, own), half(1, 1, F.col("size") - own))
    return words.withColumn("size", F.length("word")).select(
        "word", "n", F.explode(F.concat(indexed(0), indexed(1), searched)).alias("e")).select("word", "n", "e.*")


def _sharded(words: DataFrame, shard: int, hot: int) -> DataFrame:
    """The entries with their shard; the words of a hot half are dealt over pieces."""
    entries = _entries(words)
    shards = max(1, -(-4 * words.count() // shard))
    place = F.pmod(F.xxhash64("half", "reverse"), F.lit(shards)) * 2 + F.col("reverse")
    crowded = stored(entries.where("role = 0").groupBy("reverse", "half").count().where(F.col("count") > hot)
                     .withColumn("pieces", F.ceil(F.col("count") / hot).cast("int")), "spelling-hot")
    if crowded.isEmpty():
        return entries.withColumn("shard", place.cast("string"))
    split = entries.join(dim(crowded.select("reverse", "half", "pieces")), ["reverse", "half"], "left")
    # a word of a hot half goes to one piece of the index, and its search to every piece: a grid of
    # (index piece, search piece), where either side keeps to its row or column
    own, every = F.pmod(F.xxhash64("word"), F.col("pieces")), F.sequence(F.lit(0), F.col("pieces") - 1)
    grid = F.transform(every, lambda k: F.concat_ws(
        "/", "reverse", "half", F.when(F.col("role") == 0, own).otherwise(k).cast("string"),
        F.when(F.col("role") == 0, k).otherwise(own).cast("string")))
    return split.withColumn("shard", F.explode(
        F.when(F.col("pieces").isNull(), F.array(place.cast("string"))).otherwise(grid))).drop("pieces")


def partners(words: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, form_n, form) of every word of a table (word, n)."""
    found = group_arrow(_sharded(words, shard, hot).select("shard", "role", "reverse", "word", "n"), "shard",
                        _searched, _FOUND)
    all_words = words.select("word", "n", F.lit(0).cast("long").alias("n_near"),
                             F.lit(None).cast("struct<back:long,form:string>").alias("best"))
    rows = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best").unionByName(all_words)
    best = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"),
                                    F.min("best").alias("best"))
    takes = -F.col("best.back") >= 2 * F.col("n")
    return best.select("word", "n", "n_near", F.when(takes, F.col("best.form")).alias("form"),
                       F.when(takes, -F.col("best.back")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from their (word, form)."""
    now = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # a round doubles the steps taken; a chain has at most 63, since counts double
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(dim(ahead), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word."""
    words = stored(vocabulary(docs, min_length, min_count), "spelling-words")
    forms = stored(partners(words, shard, hot), "spelling-forms")
    ends = roots(forms.where("form is not null"))
    return forms.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
