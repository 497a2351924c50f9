"""Hard negatives of anchors among all rows, by exact integer products in residue number systems.

Scores are inner products of integer vectors. A task holds one group of rows
and one group of anchors; it multiplies their matrices modulo several primes
below 1,024 in float32, where sums of 64 products of residues are exact, and
puts the scores together by the Chinese remainder theorem. As many primes are
used as the largest possible score asks for. Each task keeps the few rows an
anchor may need; windows over the tasks' results select what is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.cluster import Scratch

POSITIVES = 5
NEGATIVES = 10
BAND = (30, 90)  # percent of a positive's score that a negative's lies between
GROUP_BYTES = 2 << 20  # of rows in a task's group
GROUP_ANCHORS = 2048
LEAST_GROUPS = 32
DEPTH = 64  # products in one float32 sum
_BLOCK = 1 << 22  # scores at once
#: The largest first; DEPTH products of residues stay below 2**24.
PRIMES = [p for p in range(1021, 500, -2) if all(p % k for k in range(3, 32, 2)) and DEPTH * (p // 2) ** 2 < 1 << 24]
_LIMIT = 1 << 54  # scores and a hundred times them fit into 64 bits


def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds all differences of scores from -bound to bound."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound + 1:
            break
        out, product = [*out, p], product * p
    return out


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """The integers modulo p as float32 from -(p - 1) / 2 to (p - 1) / 2."""
    r = np.mod(v, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """The exact inner products of the rows of two integer matrices, if they lie within half of the primes' product."""
    total, base, shape = np.zeros((len(a), len(b)), np.int64), 1, a.shape[1]
    for p in primes:
        ra, rb = residues(a, p), residues(b, p)
        r = np.zeros(total.shape, np.int64)
        for k in range(0, shape, DEPTH):
            r += (ra[:, k : k + DEPTH] @ rb[:, k : k + DEPTH].T).astype(np.int64)
        # mixed radix: the digit that makes the number so far agree modulo p too
        total += base * np.mod((r - total) % p * pow(base % p, -1, p), p)
        base *= p
    return np.where(total > base // 2, total - base, total)


def first_few(scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the n greatest values, the first ones on ties, from the greatest on."""
    if len(scores) > n:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:n]


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, v) of the rows that take part, one for an id; ``v`` has floor(scale * x) of the components as doubles."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(finite)
    # floor() gives a long, which the bound below must hold first; the difference of the remainder stays a double
    own = own.select("id", "label", F.transform("x", lambda x: x * scale - F.pmod(x * scale, F.lit(1.0))).alias("v"))
    return own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def bound_of(rows: DataFrame) -> tuple[int, int, int]:
    """(rows, longest vector, largest possible absolute score); too large a score is an error."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(largest)).first()
    bound = (dim or 0) * int(top or 0) ** 2
    if bound >= _LIMIT:
        raise OverflowError(f"scores up to {bound} do not fit into 64 bits")
    return n, dim or 0, bound


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, dim: int, fn, schema: str) -> DataFrame:
    """``fn(row table, anchor table)`` for every group of rows, in order of id, and every group of anchors."""
    tall = max(LEAST_GROUPS, -(-n_rows * max(1, dim) * 8 // GROUP_BYTES))
    wide = max(1, -(-n_anchors // GROUP_ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(tall)).cast("int").alias("_g"), every(wide).alias("_h"))
    right = anchors.select("*", every(tall).alias("_g"), F.pmod(F.xxhash64("id"), F.lit(wide)).cast("int").alias("_h"))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # they come from one table
    run = lambda a, b: fn(a.sort_by("id"), b)
    return left.groupBy("_g", "_h").cogroup(right.groupBy("_g", "_h")).applyInArrow(run, schema)


def _scored(rows: pa.Table, anchors: pa.Table, dim: int, primes: list[int], same: bool):
    """(anchor number, places of rows, scores), for rows of the anchor's label or of all others; never more than ``_BLOCK`` scores at once."""
    ids, labels, v = rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"], dim)
    own_ids, own, w = anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["v"], dim)
    for label in np.unique(own):
        mine, use = np.flatnonzero(own == label), np.flatnonzero((labels == label) == same)
        for k in range(0, len(mine) if len(use) else 0, max(1, _BLOCK // max(1, len(use)))):
            some = mine[k : k + max(1, _BLOCK // len(use))]
            for a, scores in zip(some.tolist(), products(w[some], v[use], primes), strict=True):
                ok = ids[use] != own_ids[a]
                yield a, use[ok], scores[ok]


def mine(
    rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scratch: Scratch | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of every anchor and positive.

    Scores are inner products of floor(scale * x); ``is_anchor`` is a condition
    on ``id``. Positives are the first rows of the anchor's label, negatives the
    first of other labels with a score between the ``band`` percents of the
    positive's; greater scores come first, then smaller ids. Rows without an id
    or a label, without a vector or with a null or non-finite component take no
    part; of rows that share an id the least (label, vector) counts. Shorter
    vectors are filled up with zeros. Scores beyond 64 bits are an error. Empty
    tables and labels of one row give no rows. The result reads tables of
    ``scratch``; whoever passes one closes it afterwards.
    """
    (low, high), scratch = band, scratch or Scratch(rows.sparkSession, "negatives")
    own = prepared(rows, id_col, vector_col, label, scale)
    n, dim, bound = bound_of(own)
    own = scratch.cut(own.withColumn("v", F.col("v").cast("array<long>")))
    anchors = own.where(is_anchor)
    n_anchors, primes = anchors.count(), primes_for(bound)

    def positives(left, right):
        out, ids, names = [], left["id"].to_numpy(), right["id"].to_numpy()
        for a, at, scores in _scored(left, right, dim, primes, same=True):
            best = first_few(scores, n_positives)
            out.append((np.full(len(best), names[a]), ids[at[best]], scores[best]))
        return _columns(out, ["anchor_id", "positive_id", "positive_score"])

    found = meet(own, anchors, n, n_anchors, dim, positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    lists = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p")).withColumnRenamed("anchor_id", "id")
    asked = anchors.join(lists, "id").select("id", "label", "v", "p.positive_id", "p.positive_score")

    def negatives(left, right):
        out, ids, names = [], left["id"].to_numpy(), right["id"].to_numpy()
        asked_ids, asked_scores = right["positive_id"].to_pylist(), right["positive_score"].to_pylist()
        for a, at, scores in _scored(left, right, dim, primes, same=False):
            for p, s in zip(asked_ids[a], asked_scores[a], strict=True):
                ok = np.flatnonzero((low * s <= 100 * scores) & (100 * scores <= high * s))
                k = ok[first_few(scores[ok], n_negatives)]
                out.append((np.full(len(k), names[a]), np.full(len(k), p), ids[at[k]], np.full(len(k), s), scores[k]))
        return _columns(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = meet(own, asked, n, n_anchors, dim, negatives, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _columns(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, cols, strict=True)})
