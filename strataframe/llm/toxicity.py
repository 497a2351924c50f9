"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training runs on a sample whose size is bounded by ``max_rows`` (a documented
parameter), so one task and the driver see a bounded number of documents; the
weights are L1-sparse and at most ``2**bits`` numbers, hence safe to broadcast.
Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.rowwise import append_columns
from strataframe.llm.tokens import ALNUM_RULE, chunks, distinct, mix, split_words

MAX_ROWS = 12_000
BITS = 20
_SALT = [np.uint64(s) for s in (0x51ED270B9F0A1C35, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
_BIAS = -1


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, adjacent pair and one-word-skipping pair of the rows; not deduplicated."""
    w = split_words(data, off, ALNUM_RULE, lower=True)
    row, h, shift = w.rows(), w.hashes, np.uint64(64 - bits)
    rows, feats = [row], [mix(h + _SALT[0]) >> shift]
    for gap in (1, 2):
        ok = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        a, b = h[:-gap][ok] if len(row) > gap else h[:0], h[gap:][ok] if len(row) > gap else h[:0]
        rows.append(row[gap:][ok] if len(row) > gap else row[:0])
        feats.append(mix(a * _SALT[gap] + b) >> shift)
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def ftrl(examples, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of FTRL-proximal (McMahan et al. 2013) over (label, features) pairs."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = 0.0
    for _ in range(epochs):
        for y, idx in examples:
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2), 0.0)
            b = -bz / ((beta + bn**0.5) / alpha)
            g = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, w.sum() + b)))) - y
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[idx] = ni + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * b
            bn += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w, -bz / ((beta + bn**0.5) / alpha)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, epochs: int = 10,
) -> DataFrame:
    """Weights as rows (feature, weight), feature -1 being the bias; at most ``2**bits + 1`` rows.

    ``labels`` are the rows to learn from. Rows with a null id or label are
    skipped; of several labels of one id the largest counts, of several texts
    of one id the last in string order. Of more than ``max_rows`` labelled ids
    those with the smallest id hashes are taken. What is rare falls to L1 alone.
    Without labels: no rows.
    """
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.max("text").alias("text"))

    def encode(batches):
        for batch in batches:
            ys, out, keys = batch.column(1).to_pylist(), [], batch.column(0)
            for a, b, data, off in chunks(batch.column(2)):
                row, feat = features(data, off, bits)
                both = distinct(row << bits | feat)
                cut = np.searchsorted(both >> bits, np.arange(b - a + 1))
                both = (both & ((1 << bits) - 1)).astype(np.int32)
                out += [both[cut[i] : cut[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ys, pa.float64()), pa.array(out, pa.binary())], names=["id", "y", "f"])

    encoded = chosen.select("id", "y", "text").mapInArrow(
        encode, T.StructType([chosen.schema["id"], T.StructField("y", T.DoubleType()), T.StructField("f", T.BinaryType())])
    )

    def fit(batches):
        examples = []
        for batch in batches:
            examples += [(y, np.frombuffer(f, np.int32)) for y, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if not examples:
            return
        w, bias = ftrl(examples, bits, alpha, beta, l1, l2, epochs)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, _BIAS)), pa.array(np.append(w[at], bias))], names=["feature", "weight"])

    # bounded by max_rows, so one task is enough; sorted, so that reruns agree
    one = encoded.repartition(1).sortWithinPartitions(F.xxhash64("id", F.lit(1)), "id")
    return one.select("y", "f").mapInArrow(fit, "feature long, weight double")


def score(docs: DataFrame, weights: DataFrame, text_col: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with the probability of the label in ``out`` (0 to 1).

    A feature counts once per document. Null and empty texts have no feature
    and get the bias alone; without weights every score is 0.5.
    """
    rows = weights.collect()  # at most 2**bits + 1 small rows
    dense, bias = np.zeros(1 << bits, np.float32), 0.0
    for r in rows:
        if r.feature == _BIAS:
            bias = r.weight
        else:
            dense[r.feature] = r.weight
    at = np.flatnonzero(dense)
    model = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), dense[at], bias))
    state: dict = {}

    def fn(texts):
        if "w" not in state:
            at, w, state["b"] = model.value
            state["w"] = np.zeros(1 << bits, np.float32)
            state["w"][at] = w
        w, scores = state["w"], np.full(len(texts), float(state["b"]))
        for a, _, data, off in chunks(texts):
            row, feat = features(data, off, bits)
            known = w[feat] != 0
            both = distinct(row[known] << bits | feat[known])
            np.add.at(scores, a + (both >> bits), w[both & ((1 << bits) - 1)].astype(float))
        return [pa.array(1.0 / (1.0 + np.exp(-np.clip(scores, -500, 500))))]

    return append_columns(docs, [text_col], [T.StructField(out, T.DoubleType())], fn)
