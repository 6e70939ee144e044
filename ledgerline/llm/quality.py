"""A compression classifier for text quality.

Two zstandard dictionaries are built, from good and from bad labelled text.
A text is cut into chunks of ``CHUNK`` bytes (all of them), each chunk is
compressed with either dictionary, and the difference of the summed sizes,
divided by the larger sum, is the feature: positive when the good dictionary
helps more. Logistic regression on other labelled documents turns it into a
calibrated probability of label 1.

Training reads a bounded sample: of each class, up to ``MAX_DOCUMENTS`` documents
for the dictionaries (and of these up to ``MAX_CHUNKS`` chunks) and as many others
for the calibration, chosen by hash over all labelled training rows. Only
these samples, and the fitted model of a few hundred kB, pass through the
driver. Scoring reads text only.

Defined results: null, empty and undecided texts get the share of label 1 in
training (0.5 when nothing is labelled); if one class has no labelled text every
score is that share; repeated rows get equal scores.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ledgerline.llm.common import map_arrow, stored

CHUNK = 2048
MAX_CHUNKS = 3000
MAX_DOCUMENTS = 2500
FEW = 40
DICT_BYTES = 110 * 1024
THRESHOLD = 0.3
LEVEL = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    base: float  # score of texts that the feature can't tell


def chunks(text: bytes, size: int = CHUNK) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def feature(text: bytes, good, bad) -> float:
    """Normalised difference of the compressed sizes, over all chunks of the text."""
    a = b = 0
    for piece in chunks(text):
        a += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - a) / max(a, b, 1)


def compressors(good: bytes, bad: bytes):
    return [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False,
                                     write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d))
            for d in (good, bad)]


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; plain sample text where there is too little to build one."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(1024, min(size, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, steps: int = 50):
    """Intercept and slope by Newton's method on standardised x."""
    mean, scale = x.mean(), x.std() or 1.0
    z = np.column_stack([np.ones_like(x), (x - mean) / scale])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(x) * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int):
    """(texts of a bounded sample, {(y, half): labelled rows}); half 0 is for the dictionaries.

    The sample is chosen among the labels, by hash, so that only its few
    doc_ids (at most 4 x per_class) are broadcast and no text is shuffled.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"),
        F.xxhash64(F.col("doc_id"), F.lit("quality")).alias("h"))
    known = known.withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    counts = {(r["y"], r["half"]): r["n"]
              for r in known.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where((F.col("y") == y) & (F.col("half") == half)).orderBy("h", "_id")
             .limit(per_class) for y in (0, 1) for half in (0, 1)]
    chosen = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body")).where(
        F.octet_length("body") > 0)
    texts = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "doc_id", "body", "y", "h", "half")
    return stored(texts, "labelled"), counts


def _cut(batches):
    """Chunks with an order of their own: a hash of (document hash, chunk number)."""
    for batch in batches:
        for body, y, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
            pieces = chunks(body)
            mixed = (np.arange(1, len(pieces) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) \
                ^ np.uint64(h & ((1 << 64) - 1))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.binary()), pa.array([y] * len(pieces), pa.int32()),
                 pa.array((mixed ^ (mixed >> np.uint64(32))).view(np.int64))], names=["piece", "y", "h"])


def train(docs: DataFrame, labels: DataFrame, max_chunks: int = MAX_CHUNKS,
          max_documents: int = MAX_DOCUMENTS) -> Model:
    """Fits the model on the given labelled rows (leave held-out rows out of ``labels``)."""
    known, counts = _sample(docs, labels, max_documents)
    total = [sum(n for (y, _), n in counts.items() if y == c) for c in (0, 1)]
    base = total[1] / sum(total) if sum(total) else 0.5
    if not all(total):
        return Model(b"", b"", 0.0, 0.0, base)
    samples = []
    for y in (0, 1):
        rows = known.where(F.col("y") == y)
        # a class with few labels lends all its documents to both steps
        rows = rows if total[y] < FEW else rows.where("half = 0")
        pieces = map_arrow(rows.select("body", "y", "h"), _cut, "piece binary, y int, h long") \
            .orderBy("h").limit(max_chunks).collect()
        samples.append([bytes(r["piece"]) for r in pieces])
    if not all(samples):
        return Model(b"", b"", 0.0, 0.0, base)
    bad, good = (build_dictionary(x) for x in samples)
    few = [y for y in (0, 1) if total[y] < FEW]
    fit = _features(known.where((F.col("half") == 1) | F.col("y").isin(*few) if few
                                else F.col("half") == 1).select("doc_id", "body", "y"), good, bad).collect()
    y = np.array([r["y"] for r in fit], float)
    share = [(y == c).sum() for c in (0, 1)]
    if not all(share):
        return Model(good, bad, float(np.log(base / (1 - base))), 0.0, base)
    intercept, slope = fit_logistic(np.array([r["x"] for r in fit]), y)
    # the sample may hold another share of label 1 than the labels
    intercept += float(np.log(total[1] / share[1] * share[0] / total[0]))
    return Model(good, bad, intercept, slope, base)


def _features(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    def values(batches):
        a, b = compressors(good, bad)
        for batch in batches:
            x = [feature(t or b"", a, b) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(2)], names=["x", "y"])

    return map_arrow(rows, values, "x double, y int")


def probability(text: bytes | None, model: Model, pair) -> float:
    if not text or pair is None:
        return model.base
    z = model.intercept + model.slope * feature(text, *pair)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def filtered(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``."""
    column = "_quality"
    while column in map(str.lower, docs.columns):
        column += "_"
    scored = score(docs, model, column)
    return scored.where(F.col(column) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 appended; other columns pass through."""
    spark_schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a few hundred kB at most
    at, names = docs.columns.index("text"), [*docs.columns, column]

    def values(batches):
        m = Model(*shared.value)
        pair = compressors(m.good, m.bad) if m.good and m.bad else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            p = [probability(t.encode() if isinstance(t, str) else t, m, pair) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=names)

    # columns go in by number, since a name may hold a dot
    return map_arrow(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), values, StructType([*spark_schema.fields]).add(column, DoubleType()))
