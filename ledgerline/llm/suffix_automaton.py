"""Substring deduplication with suffix automata of reference shards.

Documents are word sequences; each word covered by a window of ``LENGTH`` words
that also starts earlier is removed. Runs of windows (see ``repeats``) find
the places worth a look: a run whose windows all occurred before is removed at
once. What is left are first runs that share an anchor with other runs, the
borders of copied passages. These are the reference text: they are cut into
shards by anchor, and each shard gets suffix automata. The documents' runs are
streamed through in document order: an automaton gives the matching statistic
(the longest earlier match that ends here) of each word, windows whose
statistic reaches ``LENGTH`` are removed as maximal spans, and then the run
itself is added.

Automata are not broadcast: the reference text grows with the corpus, and
streaming every document past the automaton of every shard would take (shards x
corpus) work. Instead the shuffle brings the runs to the only shard that can
match them, since equal windows share their anchor. An automaton covers one
anchor's runs and is dropped after it, which bounds memory; an anchor with very
many runs is compared window by window (see ``repeats``).

Defined results: null has no words; texts shorter than the window lose
nothing; rows that repeat a doc_id count as documents in the order of their
text; a null doc_id comes first; an empty table gives no rows; a very long text is
worked on in pieces of ``BLOCK_TOKENS`` bytes that overlap by a window; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import repeats as R
from ledgerline.llm.common import group_arrow, stored
from ledgerline.llm.suffix_index import flagged_documents, scanned

LENGTH = 20
HEAD = 8
SHAPE = R.Shape(LENGTH, HEAD, True)


class SuffixAutomaton:
    """A suffix automaton of several token sequences (generalised, online)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def statistics(self, tokens: list[int]) -> list[int]:
        """For each position, the longest suffix ending there that the automaton holds."""
        state, size, out = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            else:
                size = 0
            out.append(size)
        return out

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of q for the shorter strings that reach it from p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, tokens: list[int]) -> None:
        last = 0
        for token in tokens:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
            last = new


def stream_shard(table: pa.Table) -> pa.Table:
    """The repeated windows of one shard's runs: (_d, _t, start, n)."""
    c = R.reference_columns(table, SHAPE)
    out, automaton, current = [], SuffixAutomaton(), None
    for i in np.lexsort((c["start"], c["tag"], c["doc"], c["kgram"])).tolist():
        if c["kgram"][i] != current:
            automaton, current = SuffixAutomaton(), c["kgram"][i]
        tokens = c["tokens"][c["edge"][i]:c["edge"][i + 1]].tolist()
        long = np.array(automaton.statistics(tokens)[LENGTH - 1:]) >= LENGTH
        out += [(int(c["doc"][i]), int(c["tag"][i]), int(c["start"][i]) + a, b - a)
                for a, b in R.gone_spans(long)]
        automaton.add(tokens)
    return R.spans_table(*(zip(*out) if out else ([], [], [], [])))


def repeated_windows(docs: DataFrame, hot_runs: int | None = None,
                     anchor_runs: int = R.ANCHOR_RUNS) -> DataFrame:
    """(_d, _t, start, n): runs of word windows that occur earlier."""
    bits = R.bucket_bits(docs)
    found = stored(scanned(R.run_batches(docs, SHAPE, hot_runs), anchor_runs=anchor_runs), "found")
    streamed = group_arrow(R.reference_rows(flagged_documents(found, docs, ["F"]), SHAPE, bits), "bucket",
                           stream_shard, R.SPANS)
    hot = scanned(R.window_batches(flagged_documents(found, docs, ["H"]), SHAPE, bits), False)
    return (found.where("kind = 'D'").select("_d", "_t", "start", "n").union(streamed)
            .union(hot.select("_d", "_t", "start", "n")))


def remove(docs: DataFrame, hot_runs: int | None = None, anchor_runs: int = R.ANCHOR_RUNS) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): kept is the words that stay, joined by one space."""
    def cut(body, marks):
        return R.kept_words(body, lambda n: R.gone_tokens(marks, LENGTH, n))  # words split on \x20 and \x09-\x0D

    return R.cut_documents(docs, repeated_windows(docs, hot_runs, anchor_runs), cut, "n_words")
