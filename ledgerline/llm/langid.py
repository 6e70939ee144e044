"""Language identification: scripts narrow, word scores and Viterbi label spans.

Training counts byte 3-grams and 4-grams of words (with their edges) and the
scripts that words are written in, per learned language. A word's score for a
language is the mean of the two n-gram log likelihoods; languages that don't
use the word's script are no candidates for it (a script that no language uses
leaves all of them). A Viterbi pass over the words of a whole text, with a
penalty for each switch, labels spans; the text's language is the one with the
most letters on the best path.

Texts whose best path can't contain a switch are found first, exactly. A path
with m switches has at most m + 1 stretches in other languages than the best
overall one, so if no stretch gains more than half a penalty over that one, the
gains can't exceed (m + 1) / 2 <= m penalties. Only other texts run the full pass.

Training reads a bounded sample of about ``PER_LANGUAGE`` documents a language,
chosen by hash among all training rows. Models hold at most ``MAX_LANGUAGES``.

Defined results: null texts and texts without a letter are ``und`` with score
0, and so is every text if nothing can be learned; equal texts get equal
results; a very long text is scored in pieces of ``BLOCK`` characters and labelled as
a whole; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_arrow

PER_LANGUAGE = 3000
#: Bounds the broadcast model (0.5 MB a language); more languages stop the training.
MAX_LANGUAGES = 2048
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: Least share of a language's words that makes a script one of its own.
SCRIPT_SHARE = 0.005
GRAMS = 1 << 16
BLOCK = 1 << 20
UNDECIDED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")

# First code points of scripts (fixed values of the Unicode block list); 0 is "other".
SCRIPT_STARTS = np.array([
    0x0000, 0x0041, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00,
    0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0,
    0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0,
    0x20000])
SCRIPT_NAMES = [
    "other", "latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other",
    "devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada",
    "malayalam", "sinhala", "thai", "lao", "tibetan", "myanmar", "georgian", "hangul", "ethiopic",
    "latin", "greek", "other", "kana", "kana", "other", "han", "other", "hangul", "other", "han"]
SCRIPTS = sorted(set(SCRIPT_NAMES))
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])


class Words(NamedTuple):
    """Words of a block of texts: grams are (word, table index) pairs, one array an order."""

    text: np.ndarray  # number of the text of each word
    letters: np.ndarray
    script: np.ndarray
    grams: list


class Model(NamedTuple):
    languages: list
    scores: np.ndarray  # (2 * GRAMS, languages), log likelihoods
    uses: np.ndarray  # (scripts, languages), bool


def words_of(texts: list[str]) -> Words:
    """Splits texts into words of letters (any script) with their hashed byte n-grams."""
    plain = [NOT_LETTERS.sub(" ", t.lower()).strip().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" " + b" ".join(plain) + b"   ", np.uint8)
    ends_of_text = np.cumsum([len(p) + 1 for p in plain]) + 1
    space = data == 32
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    word = np.cumsum(np.append(0, space[:-1] & ~space[1:])) - 1
    b = data.astype(np.uint32)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    four = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    mixed = lambda v: (v * np.uint32(2654435761)) >> np.uint32(16)
    in3 = np.flatnonzero(~space[1:-1])  # the middle byte is in a word
    in4 = np.flatnonzero(~space[1:-2] & ~space[2:-1])
    grams = [(word[in3 + 1], mixed(three[in3]).astype(np.int64)),
             (word[in4 + 1], mixed(four[in4]).astype(np.int64) + GRAMS)]
    return Words(np.searchsorted(ends_of_text, first, "right"), last - first,
                 scripts_of(data, first), grams)


def scripts_of(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The script of each word, by the code point of its first letter."""
    b = [data[np.minimum(first + i, len(data) - 1)].astype(np.int64) for i in range(4)]
    tail = [x & 0x3F for x in b]
    point = np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]],
        (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3])
    return SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, point, "right") - 1]


def pieces(text: str, size: int = BLOCK):
    """A long text in pieces of about ``size`` characters that cut no word."""
    at = 0
    while at < len(text):
        end = NOT_LETTERS.search(text, at + size)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def blocks(texts: list[str | None], size: int = BLOCK):
    """Lists of (position, text) of about ``size`` characters; texts without a letter are left out."""
    part, n = [], 0
    for i, t in enumerate(texts):
        if t and re.search(r"[^\W\d_]", t):
            part.append((i, t))
            n += len(t)
            if n >= size:
                yield part
                part, n = [], 0
    if part:
        yield part


def _count(batches):
    """Rows (lang, item, n): item is an n-gram index, or 2 * GRAMS + script."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            total = np.zeros(2 * GRAMS + len(SCRIPTS), np.int64)
            for part in blocks([t if own == lang else None for own, t in zip(langs, texts)]):
                w = words_of([t for _, t in part])
                for _, index in w.grams:
                    total += np.bincount(index, minlength=len(total))
                total[2 * GRAMS:] += np.bincount(w.script, minlength=len(SCRIPTS))
            item = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(item), pa.string()), pa.array(item.astype(np.int32)),
                 pa.array(total[item])], names=["lang", "item", "n"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from (text, lang) of the given rows; rows without either are left out."""
    rows = docs.where("text is not null and lang is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        (F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))).alias("u"))
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, per_language / r["count"])).otherwise(share)
    sample = rows.where(F.col("u") < share).select("lang", "text") if sizes else rows.select("lang", "text")
    found = map_arrow(sample, _count, "lang string, item int, n long").groupBy("lang", "item").agg(
        F.sum("n").alias("n"))
    # at most MAX_LANGUAGES x (2 x 65536 + scripts) counts, as columns
    table = found.orderBy("lang").toArrow()
    names = table["lang"].combine_chunks().dictionary_encode()
    languages = names.dictionary.to_pylist()
    counts = np.zeros((2 * GRAMS + len(SCRIPTS), len(languages)))
    counts[table["item"].to_numpy(), names.indices.to_numpy(zero_copy_only=False)] = table["n"].to_numpy()
    scores = np.empty((2 * GRAMS, len(languages)), np.float32)
    for lo in (0, GRAMS):
        c = counts[lo:lo + GRAMS] + SMOOTHING
        scores[lo:lo + GRAMS] = np.log(c / c.sum(axis=0)) / 2
    used = counts[2 * GRAMS:]
    uses = used / np.maximum(used.sum(axis=0), 1) >= SCRIPT_SHARE
    uses[~uses.any(axis=1)] = True
    return Model(languages, scores, uses)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """(words, languages): log likelihood, relative to the best; no candidate: far below."""
    s = np.zeros((len(w.letters), len(model.languages)))
    for word, index in w.grams:
        if len(word):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            s[word[start]] += np.add.reduceat(model.scores[index], start, axis=0)
    s = np.where(model.uses[w.script], s, s.min(axis=1, keepdims=True) - 50.0)
    return s - s.max(axis=1, keepdims=True)


def viterbi(s: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word when every switch costs ``penalty``."""
    n, m = s.shape
    best = int(s.sum(axis=0).argmax())
    if m == 1 or not switch_can_pay(s, best, penalty):
        return np.full(n, best)
    stay = np.empty((n, m), bool)
    came = np.empty(n, np.int64)
    d = s[0].copy()
    for i in range(1, n):
        came[i] = d.argmax()
        jump = d[came[i]] - penalty
        stay[i] = d >= jump
        d = np.maximum(d, jump) + s[i]
    path = np.empty(n, np.int64)
    at = int(d.argmax())
    for i in range(n - 1, -1, -1):
        path[i] = at
        if i and not stay[i, at]:
            at = int(came[i])
    return path


def switch_can_pay(s: np.ndarray, best: int, penalty: float) -> bool:
    """Whether some stretch of words gains more than half of ``penalty`` by another language than ``best``."""
    for k in range(s.shape[1]):  # a language at a time: a very long text has many words
        run = np.append(0.0, np.cumsum(s[:, k] - s[:, best]))
        if (run - np.minimum.accumulate(run)).max() > penalty / 2:
            return True
    return False


def label(texts: list[str | None], model: Model, penalty: float = SWITCH_PENALTY) -> list[dict]:
    """Per text: lang_pred, score (0 to 1) and spans [(first word, words, lang)]."""
    out = [{"lang_pred": UNDECIDED, "score": 0.0, "spans": []} for _ in texts]
    if not model.languages:
        return out
    for part in blocks(texts):
        if len(part) == 1:  # maybe a very long text: only its scores are held whole
            scores, letters = [], []
            for piece in pieces(part[0][1]):
                w = words_of([piece])
                scores.append(word_scores(w, model))
                letters.append(w.letters)
            s, letters = np.concatenate(scores), np.concatenate(letters)
            w = Words(np.zeros(len(letters), np.int64), letters, None, [])
        else:
            w = words_of([t for _, t in part])
            s = word_scores(w, model)
        edges = np.searchsorted(w.text, np.arange(len(part) + 1))
        for (i, _), lo, hi in zip(part, edges[:-1].tolist(), edges[1:].tolist()):
            if lo == hi:
                continue
            path = viterbi(s[lo:hi], penalty)
            letters = np.bincount(path, weights=w.letters[lo:hi], minlength=len(model.languages))
            k = int(letters.argmax())
            own = s[lo:hi].sum(axis=0)
            sure = 1 / np.exp(np.clip(own - own[k], -50, 50)).sum() if letters[k] == letters.sum() else 1.0
            cuts = np.append(0, np.flatnonzero(np.diff(path)) + 1)
            out[i] = {"lang_pred": model.languages[k],
                      "score": float(min(1.0, letters[k] / letters.sum() * sure)),
                      "spans": [(int(a), int(b - a), model.languages[path[a]])
                                for a, b in zip(cuts, np.append(cuts[1:], hi - lo))]}
    return out


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans), a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most 0.5 MB a language
    schema = "doc_id long, lang_pred string, score double, " \
             "spans array<struct<first_word:int,n_words:int,lang:string>>"

    def values(batches):
        m = Model(*shared.value)
        for batch in batches:
            found = label(batch.column(1).to_pylist(), m, penalty)
            spans = pa.array([[dict(zip(("first_word", "n_words", "lang"), s)) for s in f["spans"]]
                              for f in found], pa.list_(pa.struct([
                                  ("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f["lang_pred"] for f in found], pa.string()),
                 pa.array([f["score"] for f in found], pa.float64()), spans],
                names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, values, schema)
