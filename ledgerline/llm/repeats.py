"""Content-sampled runs: the machinery shared by both substring operators.

A *window* is ``length`` consecutive tokens (bytes or words) of one document.
Every window has an anchor: of the ``head``-token strings in it, the one with
the smallest fingerprint (leftmost on ties). Equal windows have equal anchors at
equal places, so only windows that share an anchor need to be compared.
Consecutive windows with one anchor form a *run*; the runs of a document cover
all its windows, and there are about ``2 / (length - head)`` of them per token.

Runs travel as sorted, compressed numpy columns, bucketed by the anchor's
fingerprint. Inside a map task copies of a run collapse to the first one, so a
group of copies reaches a bucket once per batch. An anchor with more than
``HOT_RUNS`` different runs in a batch (a passage between ever different
neighbours) is *hot*: its runs bypass the buckets and are compared window by
window, keyed by the window's own hash, which splits at any size; a marker tells
the bucket to do the same with its runs of that anchor. The more batches there
are, the lower that limit, so that all batches together bring a bucket at most
about ``BUCKET_RUNS`` runs of an anchor. An anchor that reaches ``ANCHOR_RUNS`` different runs
only in its bucket is treated as hot from there on. The results don't depend on these limits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import NULL_ID, keyed, map_arrow
from ledgerline.operators.joins import plan_bytes

U = np.uint64
#: Buckets are at least this power of two, about four to a shuffle partition, and of about
#: ``BUCKET_BYTES`` of stored input each: their number follows the input, their size doesn't.
BUCKET_BITS = 9
BUCKET_BYTES = 64 << 20
HOT_RUNS = 256
ANCHOR_RUNS = 1024
BUCKET_RUNS = 1 << 18
#: Later copies and hot runs only pass through the buckets, in pieces of so many.
PIECE_ROWS = 20_000
BLOCK_TOKENS = 1 << 20
FLUSH_ROWS = 600_000
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93))
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

_ENTRY = [("kgram", U), ("run", U), ("doc", np.int64), ("tag", np.int32), ("start", np.int64),
          ("n", np.uint8)]
NAMES = [n for n, _ in _ENTRY]


class Shape(NamedTuple):
    length: int  # tokens of a window
    head: int  # tokens of an anchor
    words: bool  # tokens are words (else bytes)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _powers(n: int, cache={}) -> list:  # noqa: B006 - kept between calls on purpose
    """Powers of each base and of its inverse modulo 2**64, at least n of them."""
    if cache.get("n", -1) < n:
        n = max(n, BLOCK_TOKENS + 4096)
        cache["n"] = n
        cache["p"] = []
        for base in BASES:
            inverse = U(pow(int(base), -1, 1 << 64))
            cache["p"].append(tuple(np.multiply.accumulate(
                np.append(U(1), np.full(n, b, U))) for b in (base, inverse)))
    return cache["p"]


class Rolling:
    """Polynomial fingerprints of any slice of a token array."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = _powers(len(values) + 1)[base]
        self.sums = np.append(U(0), np.cumsum(values * self.up[:len(values)]))

    def of(self, start, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


BYTE_VALUES = [mix(np.arange(1, 257, dtype=U) * b) for b in BASES]


def word_values(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit values of the words in ``data``, number of words before each edge, their first bytes)."""
    gap = SPACE[data]
    inner = edges[1:-1]
    after = np.append(True, gap[:-1])
    after[inner[inner < len(data)]] = True  # a document starts a word of its own
    before = np.append(gap[1:], True)
    ends_at = inner[(inner > 0) & (inner <= len(data))] - 1
    before[ends_at] = True
    first = np.flatnonzero(~gap & after)
    last = np.flatnonzero(~gap & before) + 1
    values = mix(Rolling(BYTE_VALUES[2][data], 2).of(first, last - first) + (last - first).astype(U))
    return values, np.searchsorted(first, edges, "left"), first


def word_pieces(data: np.ndarray, overlap: int = 0):
    """(words before, values, first bytes, piece) of a long text, piece by piece, cut at white space.

    A piece begins with the last ``overlap`` words of the one before it.
    """
    at = words = 0
    while at < len(data):
        end, values = at, ()
        while end < len(data) and len(values) <= overlap:  # a piece has more words than it repeats
            end = next_gap(data, min(len(data), end + BLOCK_TOKENS))
            piece = data[at:end]
            values, _, first = word_values(piece, np.array([0, len(piece)]))
        yield words, values, first, piece
        if end == len(data):
            break
        words += len(values) - overlap
        at += int(first[len(values) - overlap]) if overlap else len(piece)


def next_gap(data: np.ndarray, at: int) -> int:
    """The first white space at or after ``at``, or the end."""
    while at < len(data):
        gaps = np.flatnonzero(SPACE[data[at:at + 4096]])
        if len(gaps):
            return at + int(gaps[0])
        at = min(len(data), at + 4096)
    return at


class Block(NamedTuple):
    """Tokens of some documents, or of a piece of one."""

    values: list  # two value arrays
    edges: np.ndarray  # token edges of the documents
    rows: np.ndarray  # row number of each document in the batch
    offset: int  # tokens of the first document before this piece


def blocks(bodies: pa.Array, shape: Shape):
    """Token blocks of a binary column; a long document comes in overlapping pieces."""
    offsets = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1, bodies.offset * 4).astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8) if bodies.buffers()[2] is not None else np.empty(0, np.uint8)
    row, overlap = 0, shape.length - 1
    while row < len(bodies):
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK_TOKENS, "right")) - 1
        end = max(end, row + 1)
        part = data[offsets[row]:offsets[end]]
        edges = offsets[row:end + 1] - offsets[row]
        if shape.words and end == row + 1 and len(part) > BLOCK_TOKENS:
            for before, values, _, _ in word_pieces(part, overlap):
                yield Block([values, mix(values + BASES[1])], np.array([0, len(values)]), np.array([row]), before)
        elif shape.words:
            values, edges, _ = word_values(part, edges)
            yield Block([values, mix(values + BASES[1])], edges, np.arange(row, end), 0)
        elif end == row + 1 and len(part) > BLOCK_TOKENS:
            for at in range(0, max(1, len(part) - overlap), BLOCK_TOKENS):
                piece = part[at:at + BLOCK_TOKENS + overlap]
                yield Block([BYTE_VALUES[0][piece], BYTE_VALUES[1][piece]],
                            np.array([0, len(piece)]), np.array([row]), at)
        else:
            yield Block([BYTE_VALUES[0][part], BYTE_VALUES[1][part]], edges, np.arange(row, end), 0)
        row = end


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span, cur = 1, v
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    rest = width - span
    return np.minimum(cur[:len(cur) - rest], cur[rest:]) if rest else cur


def runs(block: Block, shape: Shape):
    """(first window, windows, anchor fingerprint, run fingerprint, index of the document)."""
    n, length, head = len(block.values[0]), shape.length, shape.head
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, U, U, np.int64))
    one, two = Rolling(block.values[0], 0), Rolling(block.values[1], 1)
    at = np.arange(n - head + 1)
    anchors = mix(one.of(at, head))
    mask = U(0xFFFFFFFF)  # the same for every block, so that ties fall alike everywhere
    least = sliding_min((anchors & ~mask) | at.astype(U), length - head + 1) & mask
    doc_of = np.repeat(np.arange(len(block.edges) - 1), np.diff(block.edges))
    whole = doc_of[:n - length + 1] == doc_of[length - 1:]
    fresh = np.append(True, (least[1:] != least[:-1]) | ~whole[:-1]) & whole
    first = np.flatnonzero(fresh)
    if not len(first):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, U, U, np.int64))
    stops = np.flatnonzero(np.append(fresh[1:] | ~whole[1:], True) & whole) + 1
    windows = stops - first
    run = mix(two.of(first, windows - 1 + length) + windows.astype(U))
    # the smallest of many fingerprints is small: mixed again, it spreads over the buckets evenly
    kgram = mix(anchors[least[first].astype(np.int64)] + BASES[2])
    return first, windows, kgram, run, doc_of[first]


# --- columns on the wire -----------------------------------------------------------------------

def pack(columns: dict) -> bytes:
    """Compressed columns: a kgram order makes nothing else needed."""
    n = len(columns["kgram"])
    body = b"".join(np.ascontiguousarray(columns[name], t).view(np.uint8).reshape(n, -1).T.tobytes()
                    for name, t in _ENTRY)
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> dict:
    n = int.from_bytes(blob[:8], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[8:]), 0, {}
    for name, t in _ENTRY:
        width = np.dtype(t).itemsize
        raw = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        out[name] = np.ascontiguousarray(raw).view(t).reshape(n)
        at += n * width
    return out


def pick(columns: dict, index) -> dict:
    return {k: v[index] for k, v in columns.items()}


def joined(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k in NAMES}


def earlier(a: dict, b: dict) -> np.ndarray:
    """Where the occurrences of a stand before those of b."""
    return (a["doc"] < b["doc"]) | ((a["doc"] == b["doc"]) & (
        (a["tag"] < b["tag"]) | ((a["tag"] == b["tag"]) & (a["start"] < b["start"]))))


def collapse(c: dict) -> tuple[dict, dict]:
    """(first occurrence of each run, sorted by anchor and run; the other occurrences)."""
    order = np.lexsort((c["start"], c["tag"], c["doc"], c["run"], c["kgram"]))
    c = pick(c, order)
    same = (c["kgram"][1:] == c["kgram"][:-1]) & (c["run"][1:] == c["run"][:-1])
    first = np.append(True, ~same) if len(order) else np.empty(0, bool)
    return pick(c, first), pick(c, ~first)


def group_sizes(kgram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each group of a sorted column, group number of each row)."""
    new = np.append(True, kgram[1:] != kgram[:-1]) if len(kgram) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


_OUT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.string()), ("blob", pa.binary())])
WIRE = "bucket int, batch long, kind string, blob binary"


def bucket_bits(docs: DataFrame) -> int:
    """The power of two of the buckets for these documents, from the size of their files."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(30, max(BUCKET_BITS, (4 * parts - 1).bit_length(), (plan_bytes(docs) // BUCKET_BYTES).bit_length()))


def batch_limit(docs: DataFrame) -> int:
    """Different runs that an anchor may have in a batch: fewer, the more batches there will be."""
    conf = docs.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    split = int(conf.byteStringAsBytes(docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")))
    return max(4, min(HOT_RUNS, BUCKET_RUNS // (plan_bytes(docs) // split + 1)))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + count[i] - 1, one range after another."""
    return np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())


def batch_rows(parts: list[dict], bits: int, hot_runs: int | None = HOT_RUNS):
    """Rows of a map task's batch: runs by bucket (R); later copies (D) and hot runs (H), spread."""
    c, copies = collapse(joined(parts))
    kinds = [("R", c), ("D", copies)]
    if hot_runs is not None and len(c["kgram"]):
        starts, group = group_sizes(c["kgram"])
        hot = np.diff(np.append(starts, len(group)))[group] > hot_runs
        if hot.any():
            markers = pick(c, starts[hot[starts]])
            markers["n"] = np.zeros(len(markers["n"]), np.uint8)
            rest = joined([pick(c, ~hot), markers])
            kinds = [("R", pick(rest, np.argsort(rest["kgram"], kind="stable"))), ("D", copies),
                     ("H", pick(c, hot))]
    out = []
    for kind, columns in kinds:
        n = len(columns["kgram"])
        if kind == "R":
            bucket = (columns["kgram"] >> U(64 - bits)).astype(np.int64)
            cuts = np.append(0, np.flatnonzero(np.diff(bucket)) + 1)
        else:
            cuts = np.arange(0, n, PIECE_ROWS)
            # any bucket will do; with the document in it, pieces of the same copies spread
            bucket = (mix(columns["run"] + columns["doc"].view(U)) >> U(64 - bits)).astype(np.int64)
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], n).tolist()):
            if hi > lo:
                out.append({"bucket": int(bucket[lo]), "batch": int(columns["doc"][lo:hi].min()),
                            "kind": kind, "blob": pack(pick(columns, slice(lo, hi)))})
    return pa.RecordBatch.from_pylist(out, schema=_OUT)


def entries(block: Block, shape: Shape, doc: np.ndarray, tag: np.ndarray) -> dict:
    first, windows, kgram, run, index = runs(block, shape)
    row = block.rows[index]
    start = first - block.edges[index] + block.offset
    return dict(zip(NAMES, (kgram, run, doc[row], tag[row], start, windows.astype(np.uint8))))


def with_bodies(docs: DataFrame) -> DataFrame:
    return keyed(docs).select("_d", "_t", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))


def run_batches(docs: DataFrame, shape: Shape, hot_runs: int | None = None) -> DataFrame:
    """The runs of all documents, batched per map task and bucketed by anchor."""
    bits = bucket_bits(docs)
    hot_runs = hot_runs or batch_limit(docs)

    def values(batches):
        parts, n = [], 0
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for block in blocks(batch.column(2), shape):
                parts.append(entries(block, shape, doc, tag))
                n += len(parts[-1]["kgram"])
                if n >= FLUSH_ROWS:
                    yield batch_rows(parts, bits, hot_runs)
                    parts, n = [], 0
        if n:
            yield batch_rows(parts, bits, hot_runs)

    return map_arrow(with_bodies(docs), values, WIRE)


# --- flagged runs: their text, or their windows one by one -----------------------------------------

def flags_of(column: pa.Array):
    """Per row of a list<struct> column, its fields as arrays."""
    offsets = column.offsets.to_numpy()
    fields = [f.to_numpy(zero_copy_only=False) for f in column.values.flatten()]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for ok, lo, hi in zip(valid, offsets[:-1].tolist(), offsets[1:].tolist()):
        yield [f[lo:hi] for f in fields] if ok and hi > lo else None


def window_batches(flagged: DataFrame, shape: Shape, bits: int = BUCKET_BITS) -> DataFrame:
    """The single windows of the flagged runs of (``_d``, ``_t``, ``packed`` body, ``runs``)."""

    def values(batches):
        parts, n = [], 0
        for batch in batches:
            for d, t, packed, (first, count, _) in zip(*(batch.column(i).to_pylist() for i in range(3)),
                                                       flags_of(batch.column(3))):
                one, two = (Rolling(v, i) for i, v in enumerate(document_tokens(inflate(packed), shape)))
                at = ranges(first, count)
                k = len(at)
                parts.append(dict(zip(NAMES, (
                    mix(one.of(at, shape.length)), mix(two.of(at, shape.length)), np.full(k, d, np.int64),
                    np.full(k, t, np.int32), at, np.ones(k, np.uint8)))))
                n += k
                if n >= FLUSH_ROWS:
                    yield batch_rows(parts, bits, None)
                    parts, n = [], 0
        if n:
            yield batch_rows(parts, bits, None)

    return map_arrow(flagged, values, WIRE)


REFERENCE = "bucket int, kgram binary, doc binary, tag binary, start binary, n binary, tokens binary"
_REFERENCE_TYPES = [("kgram", U), ("doc", np.int64), ("tag", np.int32), ("start", np.int64), ("n", np.int64)]


def reference_rows(flagged: DataFrame, shape: Shape, bits: int = BUCKET_BITS) -> DataFrame:
    """The flagged runs with their tokens, batched by bucket of their anchors."""
    kind = U if shape.words else np.uint8

    def rows(held):
        columns = [np.concatenate([h[i] for h in held]) for i in range(5)]
        tokens = np.concatenate([h[5] for h in held])
        width = columns[4] - 1 + shape.length
        edge = np.append(0, np.cumsum(width))[:-1]
        bucket = (columns[0] >> U(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(0, np.flatnonzero(np.diff(bucket[order])) + 1)
        out = []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            own = order[lo:hi]
            out.append({"bucket": int(bucket[own[0]]), "tokens": tokens[ranges(edge[own], width[own])].tobytes(),
                        **{name: c[own].astype(t).tobytes() for (name, t), c in zip(_REFERENCE_TYPES, columns)}})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("bucket", pa.int32()), *((c, pa.binary()) for c, _ in _REFERENCE_TYPES), ("tokens", pa.binary())]))

    def values(batches):
        held, size = [], 0
        for batch in batches:
            for d, t, packed, (first, count, kgram) in zip(*(batch.column(i).to_pylist() for i in range(3)),
                                                           flags_of(batch.column(3))):
                body = inflate(packed)
                tokens = document_tokens(body, shape)[0] if shape.words else np.frombuffer(body, np.uint8)
                k, count = len(first), count.astype(np.int64)
                own = tokens[ranges(first, count - 1 + shape.length)].astype(kind, copy=False)
                held.append((kgram.view(U), np.full(k, d, np.int64), np.full(k, t, np.int32), first, count, own))
                size += own.nbytes
                if size >= 16 << 20:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return map_arrow(flagged, values, REFERENCE)


def reference_columns(table: pa.Table, shape: Shape) -> dict:
    """The columns of one bucket's reference rows, with the tokens and their edges."""
    got = {name: np.concatenate([np.frombuffer(b, t) for b in table.column(name).to_pylist()])
           for name, t in [*_REFERENCE_TYPES, ("tokens", U if shape.words else np.uint8)]}
    got["edge"] = np.append(0, np.cumsum(got["n"] - 1 + shape.length))
    return got


SPANS = "_d long, _t int, start long, n int"


def spans_table(doc, tag, start, n) -> pa.Table:
    return pa.table({"_d": pa.array(doc, pa.int64()), "_t": pa.array(tag, pa.int32()),
                     "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int32())})


def document_tokens(body: bytes, shape: Shape) -> list:
    """Both value arrays of one document's tokens."""
    data = np.frombuffer(body, np.uint8)
    if not shape.words:
        return [BYTE_VALUES[0][data], BYTE_VALUES[1][data]]
    values = np.concatenate([np.empty(0, U), *(v for _, v, _, _ in word_pieces(data))])
    return [values, mix(values + BASES[1])]


def kept_words(body: bytes, gone) -> tuple[int, np.ndarray, bytes]:
    """(number of words, mask of those that go, the others joined by one space); ``gone`` makes the
    mask from their number. Works on the text piece by piece."""
    if len(body) <= BLOCK_TOKENS:
        words = body.split()
        mask = gone(len(words))
        return len(words), mask, b" ".join(w for w, g in zip(words, mask.tolist()) if not g)
    data = np.frombuffer(body, np.uint8)
    n = sum(len(v) for _, v, _, _ in word_pieces(data))
    mask, out = gone(n), []
    for before, values, first, piece in word_pieces(data):
        keep = ~mask[before:before + len(values)]
        if not keep.any():
            continue
        inside = ~SPACE[piece]
        word = np.cumsum(np.bincount(first, minlength=len(piece)), dtype=np.int32) - 1
        inside &= keep[np.maximum(word, 0)]
        text = np.append(piece, np.uint8(32))  # the byte after a kept word becomes its space
        text[:-1][SPACE[piece]] = 32
        take = np.append(inside, False)
        take[1:] |= inside & ~np.append(inside[1:], False)
        out.append(text[take].tobytes()[:-1])
    return n, mask, b" ".join(out)


# --- documents on the wire ------------------------------------------------------------------------

def deflated(docs: DataFrame) -> DataFrame:
    """(_d, _t, packed): documents as they are shuffled."""
    def values(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([z.compress(b) for b in batch.column(2).to_pylist()], pa.binary())],
                names=["_d", "_t", "packed"])

    return map_arrow(with_bodies(docs), values, "_d long, _t int, packed binary")


def inflate(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def gone_tokens(marks, length: int, n: int) -> np.ndarray:
    """Mask of the n tokens in the windows of marks (first windows, counts); None: no windows."""
    if marks is None:
        return np.zeros(n, bool)
    first, count = marks
    step = np.bincount(first, minlength=n + 1) - np.bincount(first + count - 1 + length, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def gone_spans(gone: np.ndarray) -> list:
    """Maximal ranges [first, last) of a mask."""
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()


def cut_documents(docs: DataFrame, windows: DataFrame, cut, count: str) -> DataFrame:
    """(doc_id, ``count``, n_removed, spans, kept): documents without the windows' tokens.

    ``cut(body, marks)`` gives (tokens, mask of the tokens that go, kept bytes).
    """
    marks = windows.groupBy("_d", "_t").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    rows = deflated(docs).join(marks, ["_d", "_t"], "left").select("_d", "packed", "marks")

    def values(batches):
        for batch in batches:
            out = [cut(inflate(p), m) for p, m in zip(batch.column(1).to_pylist(), flags_of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([int(o[1].sum()) for o in out], pa.int64()),
                 pa.array([gone_spans(o[1]) for o in out], pa.list_(pa.list_(pa.int64()))),
                 pa.array([o[2] for o in out], pa.binary())],
                names=["_d", count, "n_removed", "spans", "kept"])

    return map_arrow(rows, values, f"_d long, {count} long, n_removed long, spans array<array<long>>, kept binary") \
        .select(F.when(F.col("_d") != NULL_ID, F.col("_d")).alias("doc_id"), count, "n_removed", "spans", "kept")
