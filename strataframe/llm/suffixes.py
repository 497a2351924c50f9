"""Suffix-array dedup of bytes: distributed prefix doubling over suffixes that start at content-chosen anchors.

Ranks of all byte positions would be many times the text. The suffixes that
are ranked start at minimiser anchors instead: of every ``reach`` consecutive
8-grams the one with the least hash. Anchors depend on nearby bytes only, so
equal 400-byte strings have the same anchors inside, and every string belongs
to exactly one: the first anchor ``reach`` or more bytes after its start.

Doubling runs over anchors instead of bytes. ``reach + 8`` bytes from an anchor
fix where the next anchor is, so the rank of h anchors names the bytes from the
first of them to ``reach + 8`` after the last. The first exchange names pairs of
two anchors each, drops the suffixes that are alone and ranks the others in the
order of their names. From then on every round is Spark's: the pair (rank of h
anchors, rank of the h anchors after those) of each suffix is looked up, equal
pairs are counted, those that repeat are sorted, and their place in the order
is the rank of 2h anchors. Each anchor has a number m of anchors that all its
strings have in common; once h passes half of m, two overlapping ranks name all
m of them and the suffix is past the threshold.

What is left has neighbours with the same core. 128-bit fingerprints of the
bytes decide: anchors whose whole surroundings repeat are settled at once, and
of the others every 400-byte string is compared by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.cluster import Scratch
from strataframe.llm.spread import BLOBS, Packer, blob_table, exchange, items, keyed, map_texts, refine, unpacked, with_texts
from strataframe.llm.tokens import FAMILIES, chunks, covered, mix, prefix_sums, span_hashes, text_buffers

LENGTH = 400
GRAM = 8
FIRST = 4  # anchors that the first exchange ranks; every string has at least as many
_MIXER = np.uint64(0x9E3779B97F4A7C15)

RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
CERTAIN, SHIP = 1, 2


def reach(length: int) -> int:
    """Anchors are at most so far apart, and every string has at least ``FIRST`` of them in its core."""
    if length < 64:
        raise ValueError("length must be at least 64 bytes")
    return min(64, max(8, (length - 2 * GRAM) // 6))


def anchors(data: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost least 8-gram of any ``width`` consecutive ones inside a row, ascending."""
    n = len(data) - GRAM + 1
    if n < width:
        return np.zeros(0, np.int64)
    grams = np.empty(n, np.uint64)
    for r in range(GRAM):
        k = (len(data) - r) // 8
        part = np.frombuffer(data[r : r + 8 * k].tobytes(), np.uint64)
        grams[r::8] = part[: len(grams[r::8])]
    key = ((grams * _MIXER) >> np.uint64(32)) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    size = 1
    while size < width:  # sliding minimum over powers of two, then the rest
        step = min(size, width - size)
        key = np.minimum(key[:-step], key[step:])
        size += step
    first = np.arange(len(key))
    row_end = off[np.searchsorted(off, first, "right")] if len(off) > 1 else off
    inside = first + width + GRAM - 1 <= row_end
    at = (key[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def bucket_of(fp: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of fingerprints, so ranks within buckets are ranks overall."""
    return ((fp >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Suffixes:
    """The anchors of some rows: ``row``, ``at``, ``place`` (number within the row), ``m`` and the strings ``x - t`` for low <= t <= high."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        width = reach(length)
        self.at = a = anchors(data, off, width)
        self.row = row = np.searchsorted(off, a, "right") - 1
        self.first = np.searchsorted(row, np.arange(len(off)))
        self.place = np.arange(len(a)) - self.first[row]
        begin, end = off[row], off[row + 1]
        gap = np.full(len(a), width, np.int64)
        if len(a):
            same = row[1:] == row[:-1]
            gap[1:][same] = np.minimum(width, (a[1:] - a[:-1])[same])
        self.x = a - width
        self.low, self.high = np.maximum(0, self.x + length - end), np.minimum(gap - 1, self.x - begin)
        self.has = (self.x >= begin) & (self.low <= self.high)
        # bytes after the anchor that all its strings hold, less those the last anchor's own bytes need
        core = length - 2 * width + 1 - (width + GRAM)
        self.m = np.minimum(np.searchsorted(a, a + core, "right"), self.first[row + 1]) - np.arange(len(a))

    def pairs(self, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, name of the pair of ranks of two anchors each) wherever FIRST anchors follow in the row."""
        n = len(self.at) - FIRST + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = prefix_sums(data)
        two = span_hashes(data, self.at[:-1], np.minimum(self.at[1:] + reach(length) + GRAM, len(data)), sums)
        ok = np.flatnonzero(self.row[:n] == self.row[FIRST - 1 :])
        return ok, mix(two[ok] + two[ok + 2] * _MIXER)


LOOKED = "rk long, i long, m long, rank long, last long, next long"


def look(rk: np.ndarray, i: np.ndarray, m: np.ndarray, rank: np.ndarray, h: int) -> pa.Table:
    """The suffixes of some documents that still matter, with the ranks of h anchors that complete theirs (-1 for none).

    ``last`` completes the m anchors of a suffix with h <= m < 2h, by overlap;
    ``next`` is the rank h anchors on, for suffixes inside the m anchors of one with m >= 2h.
    """
    order = np.lexsort((i, rk))
    rk, i, m, rank = (v[order] for v in (rk, i, m, rank))
    doc = np.cumsum(np.append(0, rk[1:] != rk[:-1])) << 32 if len(rk) else rk
    key = doc + i

    def rank_at(off):
        at = np.minimum(np.searchsorted(key, key + off), len(key) - 1)
        return np.where(key[at] == key + off, rank[at], -1)

    ends = (m > 0) & (m < 2 * h)
    wanted = np.maximum.accumulate(doc + np.where(m >= 2 * h, i + m, 0)) > key
    last, nxt = np.where(ends, rank_at(m - h), -1), np.where(wanted, rank_at(h), -1)
    use = (last >= 0) | (nxt >= 0)
    cols = (rk, i, np.where(ends | (m >= 2 * h), m, 0), rank, last, nxt)
    return pa.table([pa.array(c[use]) for c in cols], names=["rk", "i", "m", "rank", "last", "next"])


def _looker(h: int):
    def rows(table):
        return look(*(table.column(c).to_numpy() for c in ("rk", "i", "m", "rank")), h)

    return rows


def double(met: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(rk, i, class, members): suffixes whose m anchors repeat, from packed (rk, i, m, rank), rank being that of FIRST anchors; m is 0 where a suffix only continues others.

    ``class`` is the place of the m anchors in the sorted order of those that repeat.
    """
    h, finals = FIRST, None

    def packed(table):
        own = items(table.column("payload"))
        return look(own["rk"], own["i"].astype(np.int64), own["m"].astype(np.int64), own["rank"], FIRST)

    looked = scratch.cut(refine(met, n).groupBy("bucket").applyInArrow(packed, LOOKED))
    while True:
        past = looked.where("last >= 0").select("rk", "i", "m", "rank", F.col("last").alias("other"))
        finals = past if finals is None else finals.unionByName(past)
        pairs = looked.where("next >= 0").select("rk", "i", F.when(F.col("m") >= 2 * h, F.col("m")).otherwise(0).alias("m"), "rank", F.col("next").alias("other"))
        if pairs.where("m > 0").isEmpty():
            return ranked(finals, scratch, ["m", "rank", "other"]).select("rk", "i", F.col("place").alias("class"), "members")
        alive = ranked(pairs, scratch, ["rank", "other"]).select(F.pmod("rk", F.lit(n)).alias("bucket"), "rk", "i", "m", F.col("place").alias("rank"))
        h *= 2
        looked = scratch.cut(alive.groupBy("bucket").applyInArrow(_looker(h), LOOKED))


def ranked(pairs: DataFrame, scratch: Scratch, key: list[str]) -> DataFrame:
    """The rows whose key repeats, with the number of its ``members`` and ``place``, its place in the sorted order: keys are counted before they are
    shuffled, sorted by ranges, and numbered, so a key of any number of rows is one row in the sort."""
    often = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    places = scratch.cut(often.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id()))
    return pairs.join(places, key)


def repeats(rows: DataFrame, n: int, scratch: Scratch, length: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of (rk, bucket, pos, count) of repeated strings: ``count`` of them from ``pos`` on."""

    def first_pairs(p: Packer, ids, rk, texts):
        for a, _, data, off in chunks(texts):
            s = Suffixes(data, off, length)
            at, fp = s.pairs(data, length)
            row = s.row[at]
            p.add(bucket_of(fp, n), fp=fp, rk=rk[a + row], i=s.place[at].astype(np.uint32), m=np.where(s.has[at], np.minimum(s.m[at], 65535), 0).astype(np.uint16))
            yield

    met = exchange(map_texts(rows, first_pairs, n), n, lambda own, lo, hi, count: count > 1, ("i", "m"), scratch, ranked=True)
    classes = double(met, n, scratch)

    def surroundings(ids, rk, texts, found):
        out = []
        rk, texts = found.only(rk, texts)
        for a, b, data, off in chunks(texts):
            own = [(r, found.get(rk[a + r])) for r in range(b - a)]
            s = Suffixes(data, off, length)
            at = np.concatenate([s.first[r] + v["i"] for r, v in own])
            names = [span_hashes(data, s.x[at] - s.high[at], s.x[at] - s.low[at] + length, family=f) for f in FAMILIES]
            out.append(
                [*(np.concatenate([v[c] for _, v in own]) for c in ("class", "members")), *(h.view(np.int64) for h in names), rk[a + s.row[at]], s.x[at] - s.high[at] - off[s.row[at]], s.high[at] - s.low[at] + 1]
            )
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(7)]
        return pa.table([pa.array(c) for c in cols], names=["class", "members", "full", "full2", "rk", "pos", "count"])

    by_doc = classes.withColumn("bucket", F.pmod("rk", F.lit(n)))
    old = scratch.so_far()
    around = scratch.cut(with_texts(rows, by_doc, surroundings, "class long, members long, full long, full2 long, rk long, pos long, count long", n, packed=False))
    scratch.release(old)
    key = ["class", "full", "full2"]
    kinds = scratch.cut(around.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.first("members").alias("members"), F.min(F.struct("rk", "pos")).alias("leader")))
    judged = around.join(kinds.where("copies > 1").select(*key, F.lit(CERTAIN).alias("sure")), key, "left")
    certain = judged.where("sure IS NOT NULL").select("rk", "pos", "count", F.lit(CERTAIN).alias("status"))
    # one of each kind of surroundings meets the other kinds of its class, string by string
    ship = kinds.where("copies < members").select("leader.*").join(around.select("rk", "pos", "count"), ["rk", "pos"]).select("rk", "pos", "count", F.lit(SHIP).alias("status"))
    old = scratch.so_far()
    settled = scratch.cut(certain.unionByName(ship).withColumn("bucket", F.pmod("rk", F.lit(n))))
    scratch.release(old)

    def single(ids, rk, texts, found):
        p = Packer(n, split=True)
        rk, texts = found.only(rk, texts)
        for a, b, data, off in chunks(texts):
            row, pos = [], []
            for r in range(b - a):
                v = found.get(rk[a + r])
                count = v["count"]
                own = np.repeat(v["pos"] - np.cumsum(count) + count, count) + np.arange(count.sum())
                row.append(np.full(len(own), r))
                pos.append(own)
            row, pos = np.concatenate(row), np.concatenate(pos)
            fp, fp2 = (span_hashes(data, off[row] + pos, off[row] + pos + length, family=f) for f in FAMILIES)
            p.add(bucket_of(fp, n), fp=fp, fp2=fp2, rk=rk[a + row], pos=pos.astype(np.uint32))
        return blob_table(p)

    strings = with_texts(rows, settled.where(F.col("status") == SHIP), single, BLOBS, n, packed=False)
    twice = exchange(strings, n, lambda own, lo, hi, count: count > 1, ("pos",), scratch)
    alone = unpacked(twice, "rk long, pos long", ["pos"]).select("rk", "pos", F.lit(1).cast("long").alias("count"))
    return settled.where(F.col("status") == CERTAIN).select("rk", "bucket", "pos", "count"), alone.select("rk", F.pmod("rk", F.lit(n)).alias("bucket"), "pos", "count")


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): every byte of a repeated ``length``-byte string removed.

    A string is repeated if it starts at another position anywhere, same
    document included; all are judged on the input, overlaps count, and none
    crosses documents. ``n_spans`` counts maximal removed runs; ``kept`` has the
    remaining bytes (null if not ``keep_bytes``). Null texts are empty; rows
    with equal id and text are documents of their own. The result reads tables of
    ``scratch``; whoever passes one closes it afterwards.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    rows, n = keyed(docs, id_col, text_col, scratch)
    certain, singles = repeats(rows, n, scratch, length)

    def finish(ids, rk, texts, found):
        data, off = text_buffers(texts)
        out = ([], [], [], [], [])
        for r in range(len(texts)):
            own, hit, removed, spans = data[off[r] : off[r + 1]], found.get(rk[r]), 0, 0
            if hit is not None:
                gone = covered(len(own), hit["pos"], hit["pos"] + hit["count"] - 1 + length)
                removed = int(gone.sum())
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                own = own[~gone]
            kept = own.tobytes()
            for o, v in zip(out, (len(kept) + removed, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None), strict=True):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        return pa.table([pa.array(ids), *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], names=names)

    return with_texts(rows, certain.unionByName(singles), finish, RESULT, n, packed=False)
