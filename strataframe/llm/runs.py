"""Periodic runs of words, found by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q and at least four periods
that no neighbour extends. At scale t = 1, 2, 4, ... a position is chosen when
the least hash among the t-word windows that start at it and up to t words
later is that of the first or of the last of them; the choice depends on the
2t words from there on alone, so it repeats with the words. Windows with a
period of a quarter of t or less have no hash: they lie in runs that smaller
scales have found, and without them the chosen positions stay sparse. Outside
such regions every t places have a chosen one, so a run with t <= q < 2t has a
chosen position among its first t, and q words on the next one with the same
2t words. Pairs of that kind propose periods; comparing words to both sides
makes them exact. Names of windows are exact too (pairs of names, numbered);
hashes only choose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataframe.llm.rowwise import append_columns
from strataframe.llm.tokens import SPACE_RULE, Words, chunks, mix, split_words, word_codes

TIMES = 4  # periods that a run has at least
LEAST = 6  # words that it has at least
_NONE = np.uint64(2**64 - 1)
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, for each first one; what lies beyond the end counts as the greatest."""
    n = len(v)
    full = np.full(-(-(n + width) // width) * width, _NONE)
    full[:n] = v
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : n + width - 1])


def shifted(v: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full(len(v), fill, v.dtype)
    if by < len(v):
        out[: len(v) - by] = v[by:]
    return out


def paired(names: np.ndarray, room: np.ndarray, scale: int) -> np.ndarray:
    """Names of the windows of ``2 * scale`` words from those of ``scale``; -1 where a row has no such window."""
    out = np.full(len(names), -1, np.int64)
    ok = np.flatnonzero(room >= 2 * scale)
    if len(ok):
        out[ok] = pd.factorize(names[ok] * np.int64(len(names) + 1) + names[ok + scale])[0]
    return out


def reach(words: np.ndarray, at: int, period: int, end: int, step: int) -> int:
    """The first place from ``at`` on (in the direction of ``step``) that differs from the word a period later, or ``end``."""
    size = 16
    while (end - at) * step > 0:
        n = min(size, (end - at) * step)
        lo, hi = (at, at + n) if step > 0 else (at - n + 1, at + 1)
        differs = np.flatnonzero(words[lo:hi] != words[lo + period : hi + period])
        if len(differs):
            return int(lo + (differs[0] if step > 0 else differs[-1]))
        at, size = at + n * step, size * 4
    return end


class Scales:
    """The scales one after the other, over all words of some rows; rows too short for a scale leave."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        self.words, self.first, self.rows = codes, first, np.arange(len(first) - 1)
        self.room = np.repeat(first[1:], np.diff(first)) - np.arange(len(codes))
        self.names = codes.astype(np.int64)
        self.found: dict[tuple[int, int, int], int] = {}  # (row, start, end) -> period

    def shrink(self, least: int) -> None:
        size = np.diff(self.first)
        stay = size >= least
        if size[stay].sum() < 0.75 * len(self.words):
            mask = np.repeat(stay, size)
            self.words, self.room, self.names = self.words[mask], self.room[mask], self.names[mask]
            self.first, self.rows = np.append(0, np.cumsum(size[stay])), self.rows[stay]

    def periodic(self, scale: int) -> np.ndarray:
        """Which windows of ``scale`` words lie in a run that is known, with a period of a quarter of that or less."""
        step, where = np.zeros(len(self.words) + 1, np.int32), {int(r): int(a) for r, a in zip(self.rows, self.first, strict=False)}
        for (row, start, end), period in self.found.items():
            if TIMES * period <= scale <= end - start and row in where:
                step[where[row] + start] += 1
                step[where[row] + end - scale + 1] -= 1
        return np.cumsum(step[:-1]) > 0

    def run(self) -> dict[tuple[int, int, int], int]:
        scale = 1
        while True:
            self.shrink(TIMES * scale)
            if not len(self.words) or np.diff(self.first).max() < TIMES * scale:
                return self.found
            double = paired(self.names, self.room, scale)
            self.step(scale, double)
            self.names, scale = double, 2 * scale

    def step(self, scale: int, double: np.ndarray) -> None:
        hashed = mix(self.names.astype(np.uint64) + np.uint64(scale)) >> np.uint64(1)
        hashed[(self.room < scale) | self.periodic(scale)] = _NONE
        least = sliding_min(hashed, scale + 1)
        chosen = np.flatnonzero((self.room >= 2 * scale) & (least < _NONE) & ((hashed == least) | (shifted(hashed, scale, _NONE) == least)))
        if len(chosen) < 2:
            return
        order = chosen[np.argsort(double[chosen], kind="stable")]
        same, gap = double[order[1:]] == double[order[:-1]], np.diff(order)
        pair = np.flatnonzero(same & (gap >= scale) & (gap < 2 * scale))
        if not len(pair):
            return
        at, period = order[pair], gap[pair]
        by = np.lexsort((at, period))
        at, period = at[by], period[by]
        # the pairs of one run have the same period and overlap; they are compared once
        new = np.append(True, (np.diff(period) != 0) | (np.diff(at) > 2 * scale))[: len(at)]
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        rows = np.searchsorted(self.first, at[heads], "right") - 1
        for lo, hi, q, r in zip(at[heads].tolist(), (at[tails] + 2 * scale).tolist(), period[heads].tolist(), rows.tolist(), strict=True):
            a, b = int(self.first[r]), int(self.first[r + 1])
            start = reach(self.words, lo - 1, q, a - 1, -1) + 1
            end = reach(self.words, hi, q, b - q, 1) + q
            if end - start >= TIMES * q:  # with a smaller period, it is a run of a smaller scale from end to end
                self.found.setdefault((int(self.rows[r]), start - a, end - a), q)


def find_runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of the rows, in that order, and where each row's begin; row r has ``codes[first[r]:first[r + 1]]``."""
    found = [(r, s, e - s, q) for (r, s, e), q in Scales(codes, np.asarray(first, np.int64)).run().items() if e - s >= LEAST]
    table = np.array(sorted(found, key=lambda x: (x[0], x[1], x[3])), np.int64).reshape(-1, 4)
    return table, np.searchsorted(table[:, 0], np.arange(len(first)))


def _collapsed(w: Words, off: np.ndarray, runs: np.ndarray) -> Iterator[bytes]:
    """The rows' words joined by one space, without those that a run holds after its first period."""
    step = np.zeros(len(w.start) + 1, np.int64)
    base = w.first[runs[:, 0]] + runs[:, 1]
    np.add.at(step, base + runs[:, 3], 1)
    np.subtract.at(step, base + runs[:, 2], 1)
    stay = np.cumsum(step[:-1]) == 0
    edge = np.zeros(len(w.data) + 1, np.int32)  # a kept word, and the byte behind it as its space
    np.add.at(edge, w.start[stay], 1)
    np.subtract.at(edge, np.minimum(w.end[stay] + 1, np.repeat(off[1:], w.counts)[stay]), 1)
    keep = np.cumsum(edge[:-1]) > 0
    flat, cut = np.where(SPACE_RULE[w.data], w.data, 32)[keep].tobytes(), np.append(0, np.cumsum(keep))[off].tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield flat[a:b].removesuffix(b" ")


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period, by start and then period) and ``collapsed`` (text).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``collapsed`` has the
    words that no run holds after its first period, joined by one space. Null
    and empty texts have no words, no runs and an empty ``collapsed``. Repeated
    rows each have their own result, and columns of those three names are
    replaced. No shuffle; a text of any length is handled whole, in memory in
    proportion to it.
    """

    def fn(texts):
        counts, runs, kept = [], [], []
        for _, _, data, off in chunks(texts):
            w = split_words(data, off, SPACE_RULE, lower=False, hashed=False)
            table, cut = find_runs(word_codes(w), w.first)
            counts.append(w.counts)
            flat = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in (1, 2, 3)], fields=list(_ARROW_RUN))
            runs.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat))
            kept += list(_collapsed(w, off, table))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return [pa.array(n, pa.int64()), pa.concat_arrays(runs) if runs else pa.array([], pa.list_(_ARROW_RUN)), pa.array(kept, pa.binary()).cast(pa.string())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return append_columns(docs, [text_col], fields, fn)
