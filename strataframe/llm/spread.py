"""Exchange of fingerprints between documents and hash buckets, as packed arrays.

Many operators here ask of every position of every text whether a fingerprint
occurs elsewhere. One row per position would be many small rows; instead a
task packs what it has for a bucket into one binary value. Buckets of
fingerprints find the repeated ones and answer to buckets of documents.

* The number of buckets follows the bytes of text without a limit. Tasks pack
  for at most ``COARSE`` buckets; beyond that a second exchange splits each
  coarse bucket into its fine ones (``refine``).
* A fingerprint that is frequent within one task's flush is not sent item by
  item: its items stay together in one held row, and only a summary (least and
  greatest id, count) meets the others of that fingerprint. The verdict goes
  back to the held row. So no task gets a group that grows with the documents.
* Texts are shuffled once: they are written by bucket, and answers join the
  written table bucket by bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.cluster import Scratch
from strataframe.llm.tokens import mix

BUCKET_BYTES = 8 << 20  # text bytes for one bucket
FILES = 1 << 11  # of a written table, while none has more than 64 buckets
COARSE = 1 << 12  # buckets that one task packs for
FLUSH_ITEMS = 1 << 20
HOT = 128  # items of one fingerprint in one flush that stay together
_SLOTS = 1 << 20

BLOBS = "bucket long, kind int, payload binary"
ITEMS, SUMMARIES, HELD, VERDICTS = range(4)
_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than all others


def text_buckets(docs: DataFrame, text_col: str) -> int:
    """One bucket for every ``BUCKET_BYTES`` of text, however many that are."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id`` or NO_ID, ``rk``, ``text``) of every row; ``rk`` is a hash of id and text, which equal rows share."""
    ident, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("rk"), text.alias("text"))


def keyed(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(``id`` or NO_ID, ``rk``, ``bucket``, ``text``) of every row, written by bucket, and the number of buckets.

    ``rk`` numbers the rows, so no two share one. A bucket holds about
    ``BUCKET_BYTES``, and a file some buckets.
    """
    n = text_buckets(docs, text_col)
    rows = named(docs, id_col, text_col).select("id", F.monotonically_increasing_id().alias("rk"), "text")
    rows = rows.select("id", "rk", F.pmod("rk", F.lit(n)).alias("bucket"), "text")
    return scratch.bucketed(rows, "bucket", max(1, min(-(-n // 2), max(FILES, n // 64)))), n


def pack(cols: dict[str, np.ndarray], width: dict[str, int] | None = None) -> bytes:
    """Arrays of one length as compressed byte planes; ``width`` keeps only the low bytes of a column."""
    c, out = zstandard.ZstdCompressor(level=1), {}
    for name, v in cols.items():
        v = np.ascontiguousarray(v)
        planes = v.view(np.uint8).reshape(len(v), v.itemsize).T[: (width or {}).get(name, v.itemsize)]
        out[name] = (v.dtype.str, len(v), c.compress(np.ascontiguousarray(planes).tobytes()))
    return pickle.dumps(out, protocol=5)


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    d, out = zstandard.ZstdDecompressor(), {}
    for name, (kind, n, raw) in pickle.loads(payload).items():
        kind = np.dtype(kind)
        planes = np.frombuffer(d.decompress(raw, max_output_size=max(1, n * kind.itemsize)), np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
        full = np.zeros((n, kind.itemsize), np.uint8)
        full[:, : len(planes)] = planes.T
        out[name] = full.view(kind).reshape(n)
    return out


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each run of equals starts in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def sizes(order: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.diff(np.append(start, len(order)))


def _prints(cols: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [cols[k] for k in ("fp", "fp2") if k in cols]


def _ids(cols: dict[str, np.ndarray]) -> np.ndarray:
    return cols["id"] if "id" in cols else cols["rk"]


class Packer:
    """Collects items and gives packed rows by bucket; runs of equal row keys are stored once.

    ``split`` holds back frequent fingerprints; ``fine`` packs by fine bucket at any number of buckets.
    """

    def __init__(self, n_buckets: int, width: dict[str, int] | None = None, split: bool = False, fine: bool = False, kind: int = ITEMS):
        self.n, self.width, self.split, self.kind = n_buckets, width, split, kind
        self.per = 1 if fine else -(-n_buckets // COARSE)
        self.parts, self.items = [], 0

    def add(self, bucket: np.ndarray, **cols: np.ndarray) -> None:
        if len(bucket):
            self.parts.append({"_b": bucket, **cols})
            self.items += len(bucket)

    def flush(self, force: bool = True) -> Iterator[pa.RecordBatch]:
        if not self.parts or not force and self.items < FLUSH_ITEMS:
            return
        cols = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        self.parts, self.items = [], 0
        bucket = cols.pop("_b").astype(np.int64)
        if self.split:
            hot, first, count = _frequent(cols)
            if len(hot):
                held = {k: v[hot] for k, v in cols.items()}
                back = self.n + int(mix(np.array([mix(held["fp"] ^ held["rk"].view(np.uint64)).sum(dtype=np.uint64)]))[0] % np.uint64(4 * self.n))
                ids = _ids(held)
                told = {k: held[k][first] for k in ("fp", "fp2") if k in held} | {
                    "lo": np.minimum.reduceat(ids, first), "hi": np.maximum.reduceat(ids, first), "count": count.astype(np.int64), "rk": np.full(len(first), back, np.int64),
                }
                yield _batch([back], HELD, [self._rows(held)])
                yield from self._packed(bucket[hot][first], told, SUMMARIES, None)
                cold = np.ones(len(bucket), bool)
                cold[hot] = False
                bucket, cols = bucket[cold], {k: v[cold] for k, v in cols.items()}
        yield from self._packed(bucket, cols, self.kind, self.width)

    def _packed(self, bucket: np.ndarray, cols: dict[str, np.ndarray], kind: int, width: dict[str, int] | None) -> Iterator[pa.RecordBatch]:
        if not len(bucket):  # all of them are held
            return
        key = bucket // self.per
        if self.per > 1:
            cols = cols | {"_f": bucket}
        order, start = groups(key)
        end, keys, blobs = np.append(start[1:], len(order)), [], []
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            keys.append(int(key[order[a]]))
            blobs.append(self._rows({k: v[order[a:b]] for k, v in cols.items()}, width))
        for k in range(0, len(keys), 64):
            yield _batch(keys[k : k + 64], kind, blobs[k : k + 64])

    def _rows(self, own: dict[str, np.ndarray], width: dict[str, int] | None = None) -> bytes:
        own = dict(own)
        rk = own.pop("rk")
        new = np.append(True, rk[1:] != rk[:-1])
        if "id" in own:  # one row key may have several ids
            new[1:] |= own["id"][1:] != own["id"][:-1]
        starts = np.flatnonzero(new)
        row = {"rk": rk[starts], "n": np.diff(np.append(starts, len(rk))).astype(np.uint32)}
        if "id" in own:
            row["id"] = own.pop("id")[starts]
        return pickle.dumps((pack(row), pack(own, width)), protocol=5)


def _batch(keys: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([kind] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], schema=_ARROW)


def _frequent(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items of frequent fingerprints, grouped; where each group starts; its size)."""
    slot = (cols["fp"] & np.uint64(_SLOTS - 1)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot, minlength=_SLOTS)[slot] >= HOT)
    order, start = groups(*[k[maybe] for k in _prints(cols)])
    size = sizes(order, start)
    often = size >= HOT
    count = size[often]
    return maybe[order[np.repeat(often, size)]], np.cumsum(count) - count, count


def items(payloads: pa.ChunkedArray | pa.Array) -> dict[str, np.ndarray]:
    """All items of packed rows, as arrays of one length; empty without rows."""
    parts = []
    for payload in payloads:
        rows, own = pickle.loads(payload.as_py())
        rows, own = unpack(rows), unpack(own)
        n = rows.pop("n")
        parts.append(own | {k: np.repeat(v, n) for k, v in rows.items()})
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def blob_table(p: Packer) -> pa.Table:
    return pa.Table.from_batches(list(p.flush()), _ARROW)


def refine(blobs: DataFrame, n_buckets: int) -> DataFrame:
    """Packed rows by fine bucket; without effect while there are no more buckets than tasks pack for."""
    if n_buckets <= COARSE:
        return blobs

    def run(batches):
        packers = {k: Packer(n_buckets, fine=True, kind=k) for k in (ITEMS, SUMMARIES)}
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for kind, p in packers.items():
                for k in np.flatnonzero(kinds == kind).tolist():
                    own = items(batch.column(2).slice(k, 1))
                    p.add(own.pop("_f"), **own)
                    yield from p.flush(force=False)
            if (rest := pa.array(kinds > SUMMARIES)).true_count:
                yield batch.filter(rest)
        for p in packers.values():
            yield from p.flush()

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, BLOBS)


def answer(rk: np.ndarray, n_buckets: int, **cols: np.ndarray) -> pa.Table:
    """Items packed by the bucket of their document."""
    if not len(rk):
        return _ARROW.empty_table()
    order = np.lexsort((cols["pos"], rk)) if "pos" in cols else np.argsort(rk, kind="stable")
    rk, cols = rk[order], {k: v[order] for k, v in cols.items()}
    p = Packer(n_buckets)
    p.add(np.mod(rk, n_buckets), rk=rk, **cols)
    return blob_table(p)


def _told(own: dict[str, np.ndarray], told: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(class, least id, greatest id, count) by element of ``own`` and then of ``told``; classes stand in order of fingerprint."""
    both = [d for d in (own, told) if d]
    prints = [np.concatenate([_prints(d)[k] for d in both]) for k in range(len(_prints(both[0])))]
    lo = np.concatenate(([_ids(own)] if own else []) + ([told["lo"]] if told else []))
    hi = np.concatenate(([_ids(own)] if own else []) + ([told["hi"]] if told else []))
    count = np.concatenate(([np.ones(len(_ids(own)), np.int64)] if own else []) + ([told["count"]] if told else []))
    order, start = groups(*prints)
    cls = np.empty(len(order), np.int64)
    cls[order] = np.repeat(np.arange(len(start)), sizes(order, start))
    return cls, np.minimum.reduceat(lo[order], start)[cls], np.maximum.reduceat(hi[order], start)[cls], np.add.reduceat(count[order], start)[cls]


def exchange(blobs: DataFrame, n: int, keep: Callable, columns: tuple[str, ...], scratch: Scratch, ranked: bool = False) -> DataFrame:
    """Packed answers, by document, with the ``columns`` of the items that ``keep(id, least, greatest, count)`` lets pass.

    ``least``, ``greatest`` and ``count`` are those of all items with the same
    fingerprint (the id is the row key where items have no id). With ``ranked``
    answers carry ``rank``, which numbers the fingerprints in their order if
    buckets are ranges of them.
    """

    def passed(own, lo, hi, count, rank):
        use = np.flatnonzero(keep(_ids(own), lo, hi, count))
        return answer(own["rk"][use], n, **{c: own[c][use] for c in columns}, **({"rank": rank[use]} if ranked else {}))

    def meet(key, table):
        kind = table.column("kind").to_numpy()
        if (kind == HELD).all():
            return table.select(["bucket", "kind", "payload"])
        own, told = (items(table.column("payload").filter(pa.array(kind == k))) for k in (ITEMS, SUMMARIES))
        cls, lo, hi, count = _told(own, told)
        m, rank = len(_ids(own)) if own else 0, (key[0].as_py() << 32) + cls
        out = passed(own, lo[:m], hi[:m], count[:m], rank[:m]) if m else _ARROW.empty_table()
        if told:
            p = Packer(1 << 62, fine=True, kind=VERDICTS)
            p.add(told["rk"], **{k: told[k] for k in ("fp", "fp2") if k in told}, rk=told["rk"], lo=lo[m:], hi=hi[m:], count=count[m:], rank=rank[m:])
            out = pa.concat_tables([out, blob_table(p)])
        return out

    def resolve(table):
        kind = table.column("kind").to_numpy()
        held, told = (items(table.column("payload").filter(pa.array(kind == k))) for k in (HELD, VERDICTS))
        if not held:
            return _ARROW.empty_table()
        order, start = groups(*[np.concatenate([a, b]) for a, b in zip(_prints(held), _prints(told), strict=True)])
        m, size = len(held["rk"]), sizes(order, start)
        facts = []
        for name, none, combine in (("lo", NO_ID, np.minimum), ("hi", -NO_ID - 1, np.maximum), ("count", 0, np.maximum), ("rank", -1, np.maximum)):
            v = np.concatenate([np.full(m, none, np.int64), told[name]])[order]
            back = np.empty(len(order), np.int64)
            back[order] = np.repeat(combine.reduceat(v, start), size)
            facts.append(back[:m])
        return passed(held, *facts)

    met = scratch.cut(refine(blobs, n).groupBy("bucket").applyInArrow(meet, BLOBS))
    hot = met.where(F.col("kind") >= HELD).groupBy("bucket").applyInArrow(resolve, BLOBS)
    return met.where(F.col("kind") == ITEMS).unionByName(scratch.cut(hot))


class ByRow:
    """Items looked up by row key."""

    def __init__(self, own: dict[str, np.ndarray]):
        own = dict(own)
        self.rk = own.pop("rk") if own else np.zeros(0, np.int64)
        order = np.argsort(self.rk, kind="stable")
        self.rk, self.cols = self.rk[order], {k: v[order] for k, v in own.items()}

    def only(self, rk: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The row keys and texts that have items."""
        have = np.isin(rk, self.rk)
        return rk[have], texts.filter(pa.array(have))

    def get(self, rk: int) -> dict[str, np.ndarray] | None:
        a, b = np.searchsorted(self.rk, rk, "left"), np.searchsorted(self.rk, rk, "right")
        return {k: v[a:b] for k, v in self.cols.items()} if b > a else None


def map_texts(rows: DataFrame, fn, n_buckets: int, width: dict[str, int] | None = None, split: bool = True) -> DataFrame:
    """Packed items of every row; ``fn(packer, id, rk, texts)`` adds those of one batch."""

    def run(batches):
        p = Packer(n_buckets, width, split)
        for batch in batches:
            for _ in fn(p, batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                yield from p.flush(force=False)
        yield from p.flush()

    return rows.select("id", "rk", "text").mapInArrow(run, BLOBS)


def unpacked(answers: DataFrame, schema: str, names: list[str]) -> DataFrame:
    """Answers as rows with the columns ``rk`` and ``names``."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = items(batch.column(2).slice(k, 1))
                yield pa.RecordBatch.from_arrays([pa.array(own[c].astype(np.int64)) for c in ["rk", *names]], names=["rk", *names])

    return answers.mapInArrow(run, schema)


def with_texts(rows: DataFrame, answers: DataFrame, fn, schema: str, n_buckets: int, packed: bool = True) -> DataFrame:
    """``fn(id, rk, texts, answers by row) -> table`` for the rows of every document bucket, in order of row key.

    ``answers`` are packed, or rows with ``rk`` and ``bucket`` of numbers.
    """

    def run(left, right):
        left = left.sort_by("rk").combine_chunks()
        texts = left.column("text")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        own = items(right.column("payload")) if packed else {c: right.column(c).to_numpy() for c in right.column_names if c != "bucket"}
        return fn(left.column("id").to_numpy(), left.column("rk").to_numpy(), texts, ByRow(own))

    answers = refine(answers, n_buckets) if packed else answers
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)
