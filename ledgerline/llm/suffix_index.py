"""Substring deduplication with a logarithmic family of sparse suffix arrays.

Every batch of documents (what a map task read) becomes a sparse suffix array:
its sampled suffixes (see ``repeats``: one per run of byte windows) in the order
of their fingerprints, cut into buckets by anchor. In each bucket the batches
are taken in document order. A new batch is merge-scanned against every level
of the index; a run of windows that a level holds too is a long match, of which
the later occurrence is removed. Then the batch becomes a level, and levels of
equal size class merge, so a bucket never has more than a logarithmic number of
levels and an entry is moved a logarithmic number of times.

Runs that share an anchor but not all windows (where a copied passage begins or
ends) are compared window by window: their bytes are brought together by anchor
and sorted into a dense suffix array. Every byte of a window that occurs earlier is removed.

``index_levels`` gives the index as rows that can be stored; ``scanned`` takes the
union of stored levels and new batches.

Fingerprints have 128 bits (two independent 64-bit polynomials).

Defined results: null is an empty text; texts shorter than the window lose
nothing; rows that repeat a doc_id count as documents in the order of their
text; a null doc_id comes first; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import repeats as R
from ledgerline.llm.common import group_arrow, stored

LENGTH = 100
HEAD = 32
SHAPE = R.Shape(LENGTH, HEAD, False)
FOUND = "kind string, _d long, _t int, start long, n int, kgram long"


class Family:
    """The levels of one bucket; each is sorted by ``rank`` and holds a run once."""

    def __init__(self):
        self.levels: list[dict] = []

    @staticmethod
    def ranked(c: dict) -> dict:
        c = {**c, "rank": R.mix(c["kgram"]) ^ c["run"]}
        return R.pick(c, np.lexsort((c["kgram"], c["rank"])))

    @staticmethod
    def places(level: dict, batch: dict) -> np.ndarray:
        """Where each entry of the batch would stand in the level, by (rank, anchor)."""
        last = len(level["rank"]) - 1
        at = np.minimum(np.searchsorted(level["rank"], batch["rank"]), last)
        while True:  # on to the entry's anchor where several have one rank (64-bit collisions)
            there = R.pick({k: level[k] for k in ("rank", "kgram")}, at)
            on = (there["rank"] == batch["rank"]) & (there["kgram"] < batch["kgram"]) & (at < last)
            if not on.any():
                return at
            at = at + on

    def scan(self, batch: dict) -> list[dict]:
        """Adds a batch (runs once each); returns the later occurrences of all long matches."""
        batch, later = self.ranked(batch), []
        for i, level in enumerate(self.levels):
            at = self.places(level, batch)
            there = R.pick(level, at)
            match = (there["rank"] == batch["rank"]) & (there["kgram"] == batch["kgram"]) \
                & (there["run"] == batch["run"])
            if not match.any():
                continue
            first = match & R.earlier(batch, there)  # the batch may hold the earlier one
            lost = match & ~first
            later += [R.pick(batch, lost), R.pick(level, at[first])]
            if first.any():
                keep = np.ones(len(level["rank"]), bool)
                keep[at[first]] = False
                self.levels[i] = R.pick(level, keep)
            batch = R.pick(batch, ~lost)
        self.levels = [x for x in self.levels if len(x["rank"])]
        if len(batch["rank"]):
            self.levels.append(batch)
        self.merge()
        return later

    def merge(self) -> None:
        """Merges the last two levels while they are of one size class (powers of two)."""
        size = lambda x: len(x["rank"]).bit_length()
        while len(self.levels) > 1 and size(self.levels[-1]) >= size(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            both = {k: np.concatenate([a[k], b[k]]) for k in a}
            self.levels.append(R.pick(both, np.lexsort((both["kgram"], both["rank"]))))

    def all(self) -> dict:
        empty = {k: np.empty(0, t) for k, t in R._ENTRY}
        return R.joined([*self.levels, empty])


def found_rows(kind: str, c: dict) -> pa.Table:
    n = len(c["kgram"])
    return pa.table({"kind": pa.array([kind] * n, pa.string()), "_d": c["doc"], "_t": c["tag"],
                     "start": c["start"], "n": c["n"].astype(np.int32), "kgram": c["kgram"].view(np.int64)})


def scan_bucket(table: pa.Table, partial: bool = True,
                anchor_runs: int = R.ANCHOR_RUNS) -> tuple[list[pa.Table], Family]:
    """(found rows, family) of one bucket.

    Kinds: D, all windows are repeats; F, a first run whose anchor has other
    runs too; H, the same for a hot anchor (of more than ``anchor_runs`` runs, or marked).
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"] != "L", r["batch"]))
    family, later, hot_runs, hot = Family(), [], [], []
    for r in rows:
        c = R.unpack(r["blob"])
        if r["kind"] == "D":
            later.append(c)
        elif r["kind"] == "H":
            hot_runs.append(c)
        else:
            hot.append(c["kgram"][c["n"] == 0])
            later += family.scan(R.pick(c, c["n"] > 0))
    out = [found_rows("D", c) for c in later]
    if partial:
        c = family.all()
        c = R.pick(c, np.argsort(c["kgram"], kind="stable"))
        starts, group = R.group_sizes(c["kgram"])
        size = np.diff(np.append(starts, len(group)))[group]
        in_hot = size > anchor_runs
        if hot:
            in_hot |= np.isin(c["kgram"], np.concatenate(hot))
        out += [found_rows("F", R.pick(c, (size > 1) & ~in_hot)), found_rows("H", R.pick(c, in_hot))]
        out += [found_rows("H", x) for x in hot_runs]
    return out, family


def scanned(batches: DataFrame, partial: bool = True, anchor_runs: int = R.ANCHOR_RUNS) -> DataFrame:
    schema = pa.schema([("kind", pa.string()), ("_d", pa.int64()), ("_t", pa.int32()),
                        ("start", pa.int64()), ("n", pa.int32()), ("kgram", pa.int64())])

    def scan(table):
        parts = scan_bucket(table, partial, anchor_runs)[0]
        return pa.concat_tables([schema.empty_table(), *(p.cast(schema) for p in parts)])

    return group_arrow(batches, "bucket", scan, FOUND)


def index_levels(batches: DataFrame) -> DataFrame:
    """The index after these batches, a row per level: rows of the batches' form, kind L."""
    def levels(table):
        _, family = scan_bucket(table, False)
        bucket = table.column("bucket")[0].as_py()
        # anchors found hot stay marked
        marks = [R.pick(c, c["n"] == 0) for c in (R.unpack(r["blob"]) for r in table.to_pylist()
                                                  if r["kind"] in "RL")]
        kept = [*({k: x[k] for k in R.NAMES} for x in family.levels), *(m for m in marks if len(m["n"]))]
        rows = [{"bucket": bucket, "batch": int(x["doc"].min()), "kind": "L", "blob": R.pack(x)} for x in kept]
        rows += [r for r in table.to_pylist() if r["kind"] == "H"]
        return pa.Table.from_pylist(rows, schema=R._OUT)

    return group_arrow(batches, "bucket", levels, R.WIRE)


def flagged_documents(found: DataFrame, docs: DataFrame, kinds: list[str]) -> DataFrame:
    """(_d, _t, packed, runs): documents with runs of these kinds."""
    flags = found.where(F.col("kind").isin(kinds)).groupBy("_d", "_t").agg(
        F.collect_list(F.struct("start", "n", "kgram")).alias("runs"))
    return R.deflated(docs).join(flags, ["_d", "_t"]).select("_d", "_t", "packed", "runs")


def window_array(table: pa.Table) -> pa.Table:
    """The windows of one bucket's flagged runs that occur earlier, as spans of windows.

    The bucket's windows become one dense suffix array in fingerprint order,
    in which equal windows are neighbours.
    """
    c = R.reference_columns(table, SHAPE)
    own = np.repeat(np.arange(len(c["n"])), c["n"])
    at = R.ranges(c["edge"][:-1], c["n"])
    one, two = (R.Rolling(R.BYTE_VALUES[i][c["tokens"]], i) for i in (0, 1))
    start = c["start"][own] + at - c["edge"][own]
    _, later = R.collapse({"kgram": R.mix(one.of(at, LENGTH)), "run": R.mix(two.of(at, LENGTH)),
                           "doc": c["doc"][own], "tag": c["tag"][own], "start": start, "at": at, "own": own})
    order = np.argsort(later["at"], kind="stable")
    at, own = later["at"][order], later["own"][order]
    first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(own) != 0))) if len(at) else at
    return R.spans_table(c["doc"][own[first]], c["tag"][own[first]], later["start"][order][first],
                         np.diff(np.append(first, len(at))))


def repeated_windows(docs: DataFrame, hot_runs: int | None = None,
                     anchor_runs: int = R.ANCHOR_RUNS) -> DataFrame:
    """(_d, _t, start, n): runs of byte windows that occur earlier."""
    bits = R.bucket_bits(docs)
    found = stored(scanned(R.run_batches(docs, SHAPE, hot_runs), anchor_runs=anchor_runs), "found")
    near = group_arrow(R.reference_rows(flagged_documents(found, docs, ["F"]), SHAPE, bits), "bucket",
                       window_array, R.SPANS)
    hot = scanned(R.window_batches(flagged_documents(found, docs, ["H"]), SHAPE, bits), False)
    return (found.where("kind = 'D'").select("_d", "_t", "start", "n").union(near)
            .union(hot.select("_d", "_t", "start", "n")))


def remove(docs: DataFrame, hot_runs: int | None = None, anchor_runs: int = R.ANCHOR_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), kept being the bytes that stay."""
    def cut(body, marks):
        gone = R.gone_tokens(marks, LENGTH, len(body))
        return len(body), gone, np.frombuffer(body, np.uint8)[~gone].tobytes() if marks else body

    return R.cut_documents(docs, repeated_windows(docs, hot_runs, anchor_runs), cut, "n_bytes")
