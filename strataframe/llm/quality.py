"""Quality rules: base counts per document and a linear-chain CRF over its lines.

A line with words is a position of the chain, labelled content or boilerplate
by Viterbi decoding; the share of words in content lines decides. Only whole
documents have labels, so the labels of lines are learnt along (``line_labels``):
lines that many sampled documents share are boilerplate anywhere; the other
lines of good documents are content, and those of bad documents start as
boilerplate and become content where the model, fitted again and again, finds
that they look like the lines of good ones. Features describe shape only:
length, symbols, capitals, repetition, punctuation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.rowwise import append_columns
from strataframe.llm.tokens import SPACE_RULE, Words, chunks, mix, ngrams, span_hashes, split_words

MAX_ROWS = 2000
COMMON = 5  # sampled documents with a line that make it boilerplate
ROUNDS = 3
N_FEATURES = 22
CONTENT = 1

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?:;", np.uint8))

BASE = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS = BASE + [T.StructField("content_words", T.LongType()), T.StructField("n_lines", T.LongType())]


def repeated(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes in groups: (occurs twice or more in its group, is not the first to occur)."""
    again, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h):
        key = mix(h + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later[order[1:]] = same
        again[order[1:]] |= same
        again[order[:-1]] |= same
    return again, later


class Lines:
    """Base counts of some rows and the features of their lines with words."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        w: Words = split_words(data, off, SPACE_RULE, lower=False)
        sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        self.n_words = w.counts.astype(np.int64)
        points = sums((data & 0xC0) != 0x80)
        chars = sums(points[w.end] - points[w.start])
        self.word_chars = chars[w.first[1:]] - chars[w.first[:-1]]
        symbols = sums(_SYMBOLS[data])
        self.n_symbols = symbols[off[1:]] - symbols[off[:-1]]
        at, h = ngrams(w, 3)
        twice, _ = repeated(w.rows()[at] if len(at) else at, h)
        inside = np.zeros(len(w.start), bool)
        for j in range(3):
            inside[at[twice] + j] = True
        repeats = sums(inside)
        self.n_repeat_words = repeats[w.first[1:]] - repeats[w.first[:-1]]

        breaks = np.flatnonzero(data == 10)
        per_row = np.diff(np.searchsorted(breaks, off)) + 1
        first = np.concatenate([[0], np.cumsum(per_row)])
        start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
        is_first[first[:-1]] = True
        is_last[first[1:] - 1] = True
        start[is_first], start[~is_first] = off[:-1], breaks + 1
        end[is_last], end[~is_last] = off[1:], breaks
        row = np.repeat(np.arange(n), per_row)
        a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        has = b > a
        start, end, row, a, b = start[has], end[has], row[has], a[has], b[has]
        self.hashes = span_hashes(data, start, end)
        _, dup = repeated(row, self.hashes)
        self.n_dup_lines = np.bincount(row[dup], minlength=n)
        self.row, self.words, self.n = row, b - a, n
        self.first = np.searchsorted(row, np.arange(n + 1))

        size, words = np.maximum(end - start, 1), self.words
        ratio = lambda flags: (c := sums(flags))[end] - c[start]
        symbol = (symbols[end] - symbols[start]) / size
        upper = ratio((data >= 65) & (data <= 90)) / size
        bang = ratio(data == 33) / words
        digit = ratio((data >= 48) & (data <= 57)) / size
        pipe = ratio(data == 124) / words
        mean = (chars[b] - chars[a]) / words
        again = (repeats[b] - repeats[a]) / words
        stop = _STOPS[data[w.end[b - 1] - 1]] if len(b) else np.zeros(0, bool)
        x = [
            words <= 2, (words > 2) & (words <= 5), (words > 5) & (words <= 20), words > 20, symbol == 0, (symbol > 0) & (symbol < 0.05),
            (symbol >= 0.05) & (symbol < 0.15), symbol >= 0.15, upper >= 0.3, (upper >= 0.1) & (upper < 0.3), upper < 0.1, bang >= 0.3, digit >= 0.2,
            pipe >= 0.3, mean >= 12, mean < 3, again >= 0.5, (again > 0) & (again < 0.5), dup, stop, ~stop, np.ones(len(words), bool),
        ]
        self.x = np.stack(x, 1).astype(np.float32)


def by_step(first: np.ndarray) -> list[np.ndarray]:
    """For step t: the chains (in order of falling length) that have one, as positions; so numpy runs over chains."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    sizes, out, t = size[order], [], 0
    live = len(order)
    while live:
        out.append(first[:-1][order[:live]] + t)
        t += 1
        live = int(np.searchsorted(-sizes, -t, "left"))
    return out


def viterbi(unary: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every position of the chains ``first[r]:first[r + 1]``; ties go to content."""
    label, steps = np.zeros(len(unary), np.int8), by_step(first)
    if not steps:
        return label
    best, back = unary[steps[0]].copy(), []
    scores = [best]
    for at in steps[1:]:
        prev = scores[-1][: len(at)]
        via = prev[:, :, None] + trans  # from, to
        pick = (via[:, 1] >= via[:, 0]).astype(np.int8)
        back.append(pick)
        scores.append(np.maximum(via[:, 0], via[:, 1]) + unary[at])
    cur = np.zeros(0, np.int8)
    for t in range(len(steps) - 1, -1, -1):
        s = scores[t]
        own = (s[:, 1] >= s[:, 0]).astype(np.int8)
        if t < len(steps) - 1:
            n = len(steps[t + 1])
            own[:n] = back[t][np.arange(n), cur]
        label[steps[t]] = cur = own
    return label


def _log_add(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 60, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, labels) and transitions (labels, labels) by AdaGrad on the CRF's mean log-likelihood per line."""
    w, tr = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    gw, gt, steps, n = np.full_like(w, 1e-8), np.full_like(tr, 1e-8), by_step(first), max(1, len(x))
    for _ in range(rounds):
        u = x @ w
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        for t, at in enumerate(steps):
            alpha[at] = u[at] if t == 0 else u[at] + _log_add(alpha[at - 1][:, :, None] + tr, 1)
        for at in reversed(steps[1:]):
            beta[at - 1] = _log_add(tr + (u[at] + beta[at])[:, None, :], 2)
        p = np.exp(alpha + beta - _log_add(alpha + beta, 1)[:, None])
        hot = np.eye(2)[y]
        dt = np.zeros((2, 2))
        if len(steps) > 1:
            at = np.concatenate(steps[1:])
            pair = alpha[at - 1][:, :, None] + tr + (u[at] + beta[at])[:, None, :]
            pair = np.exp(pair - _log_add(pair.reshape(-1, 4), 1)[:, None, None])
            dt = (hot[at - 1][:, :, None] * hot[at][:, None, :] - pair).sum(0) / n
        dw = x.T @ (hot - p) / n - l2 * w
        gw += dw * dw
        gt += dt * dt
        w += rate * dw / np.sqrt(gw)
        tr += rate * (dt - l2 * tr) / np.sqrt(gt)
    return w, tr


def common_lines(first: np.ndarray, hashes: np.ndarray, least: int = COMMON) -> np.ndarray:
    """Which lines stand between ``least`` or more different pairs of neighbours: a notice that unlike documents share, not a line of copies."""
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True  # a document starts or ends here
    before, after = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:], after[:-1] = hashes[:-1], hashes[1:]
    before[edge[:-1]], after[edge[1:]] = 0, 0
    context = mix(before + np.uint64(0x9E3779B97F4A7C15) * mix(after))
    own = np.unique(np.stack([hashes, context]), axis=1)[0]
    line, count = np.unique(own, return_counts=True)
    return np.isin(hashes, line[count >= least])


def line_labels(x: np.ndarray, good: np.ndarray, common: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, weights, transitions) from the lines' features, whether their documents are good, and whether they are common.

    Every round fits the CRF and labels the lines of bad documents anew by
    Viterbi decoding; of a bad document at least its least content-like line
    stays boilerplate. The first fit knows no chain, so that a document's
    label is not carried over to its lines by the transitions.
    """
    label = (good & ~common).astype(np.int64)
    fixed = good | common
    w, tr = fit(x, label, np.arange(len(x) + 1))
    for _ in range(rounds):
        u = x @ w
        label = np.where(fixed, label, viterbi(u, tr, first)).astype(np.int64)
        lean = u[:, CONTENT] - u[:, 1 - CONTENT]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a and not good[a] and label[a:b].all():
                label[a + int(np.argmin(lean[a:b]))] = 1 - CONTENT
        w, tr = fit(x, label, first)
    return label, w, tr


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """CRF weights from at most ``max_rows`` labelled documents (those with the smallest id hashes).

    Rows with a null id or label are skipped; of several labels of one id the
    largest counts. Without labels all weights are 0 and every line is content.
    """
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.max("text").alias("text"))

    def run(batches):
        xs, ys, sizes, hashes = [], [], [], []
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), np.int64)
            for a, b, data, off in chunks(batch.column(1)):
                lines = Lines(data, off)
                xs.append(lines.x)
                ys.append((y[a:b] == 1)[lines.row])
                sizes.append(np.diff(lines.first))
                hashes.append(lines.hashes)
        if xs:
            first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            common = common_lines(first, np.concatenate(hashes))
            _, w, tr = line_labels(np.concatenate(xs).astype(np.float64), np.concatenate(ys), common, first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([w.ravel(), tr.ravel()]))], names=["w"])

    one = chosen.repartition(1).sortWithinPartitions(F.xxhash64("id", F.lit(1)), "id")  # bounded by max_rows
    flat = np.array([r.w for r in one.select("y", "text").mapInArrow(run, "w double").collect()])
    if not len(flat):
        return np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    return flat[:-4].reshape(N_FEATURES, 2), flat[-4:].reshape(2, 2)


def label_lines(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with the FIELDS: base counts, words in content lines, lines with words.

    Null and empty texts have zeros. Columns of ``docs`` with these names are replaced.
    """
    w, tr = model

    def fn(texts):
        out = [np.zeros(len(texts), np.int64) for _ in FIELDS]
        for a, b, data, off in chunks(texts):
            s = Lines(data, off)
            label = viterbi(s.x @ w, tr, s.first)
            content = np.bincount(s.row, weights=s.words * (label == CONTENT), minlength=s.n)
            for k, v in enumerate((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, content, np.diff(s.first))):
                out[k][a:b] = v
        return [pa.array(v) for v in out]

    return append_columns(docs, [text_col], FIELDS, fn)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def kept(percent: int = 50) -> Column:
    """No base rule fails and content lines hold at least ``percent`` of the words."""
    return ~base_failed() & (100 * F.col("content_words") >= percent * F.col("n_words"))
