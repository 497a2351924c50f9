"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all document windows.

The benchmark's distinct pairs of a window and an item are cut into blocks of
about ``MAX_WINDOWS``; each block is broadcast by itself, so what is broadcast
has a fixed bound however large the benchmark is and however many items share a
window. One block, the usual case, is one pass over the documents without any
shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.cluster import Scratch
from strataframe.llm.rowwise import append_columns, fresh
from strataframe.llm.tokens import ALNUM_RULE, chunks, ngrams, split_words

WINDOW = 13
MAX_WINDOWS = 200_000
_TABLE_BITS = 22

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first_word", "end_word", "first_byte", "end_byte")])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct (size, words, item) of the benchmark: n consecutive normalised words; a shorter item is one window."""

    def cut(batches):
        for batch in batches:
            items, out = batch.column(0).to_pylist(), []
            for a, b, data, off in chunks(batch.column(1)):
                w = split_words(data, off, ALNUM_RULE, lower=True, hashed=False)
                for r in range(b - a):
                    words = [w.text(k) for k in range(w.first[r], w.first[r + 1])]
                    size = min(n, len(words))
                    out += [(items[a + r], size, b" ".join(words[k : k + size])) for k in range(len(words) - size + 1 if words else 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                names=["item", "size", "words"],
            )

    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, "item string, size int, words binary")
    return rows.distinct()


def _matcher(block):
    """A function of an Arrow text array giving the three FIELDS for one broadcast block."""
    state: dict = {}

    def load():
        exact = {}
        for size, words, item in block.value:
            own = exact.setdefault(words, (size, []))[1]
            if item is not None:
                own.append(item)
        texts = pa.array([w.decode("utf-8", "surrogateescape").encode("utf-8", "surrogateescape") for w in exact], pa.binary()).cast(pa.large_binary())
        data = b"".join(t.as_py() for t in texts)
        off = np.concatenate([[0], np.cumsum([len(w) for w in exact])]).astype(np.int64)
        w = split_words(np.frombuffer(data, np.uint8), off, ALNUM_RULE, lower=False)
        for size in {s for s, _ in exact.values()}:
            _, h = ngrams(w, size)  # of longer windows some sub-windows too: the exact test drops them
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[h >> np.uint64(64 - _TABLE_BITS)] = True
            state[size] = (table, np.sort(h))
        state["exact"] = exact

    def fn(texts):
        if not state:
            load()
        exact, sizes = state["exact"], sorted(k for k in state if k != "exact")
        n_words, spans, items = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        for a, b, data, off in chunks(texts):
            w = split_words(data, off, ALNUM_RULE, lower=True)
            n_words[a:b] = w.counts
            found: list[tuple[int, int]] = []
            for size in sizes:
                at, h = ngrams(w, size)
                table, keys = state[size]
                maybe = np.flatnonzero(table[h >> np.uint64(64 - _TABLE_BITS)])
                if len(maybe):
                    near = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                    found += [(int(k), size) for k in at[maybe[keys[near] == h[maybe]]]]
            if not found:
                continue
            found.sort()
            rows = np.searchsorted(w.first, [k for k, _ in found], "right") - 1
            for (k, size), r in zip(found, rows.tolist(), strict=True):
                hit = exact.get(b" ".join(w.text(x) for x in range(k, k + size)))
                if hit is None or hit[0] != size:
                    continue
                items[a + r] += hit[1]
                own, first = spans[a + r], k - int(w.first[r])
                begin = int(w.start[k] - off[r])
                last = int(w.end[k + size - 1] - off[r])
                if own and first <= own[-1]["end_word"]:
                    own[-1]["end_word"] = max(own[-1]["end_word"], first + size)
                    own[-1]["end_byte"] = max(own[-1]["end_byte"], last)
                else:
                    own.append({"first_word": first, "end_word": first + size, "first_byte": begin, "end_byte": last})
        return [
            pa.array(n_words),
            pa.array(spans, pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN.fields]))),
            pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
        ]

    return fn


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined."""
    empty = F.array().cast(T.ArrayType(SPAN))

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["first_word"].alias("first_word"), F.greatest(last["end_word"], x["end_word"]).alias("end_word"),
            last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], x["end_byte"]).alias("end_byte"),
        )
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end_word"] >= x["first_word"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def find(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text",
    n: int = WINDOW, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (words and bytes, half-open, sorted) and ``hit_items`` (sorted strings).

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.
    Null and empty texts have no words; null item ids are not reported but
    their windows hit. Repeated rows are treated row by row; columns of
    ``docs`` named as one of the three are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bench")
    table = scratch.cut(windows(bench, item_col, bench_text_col, n))
    blocks = max(1, -(-table.count() // max_windows))
    out, more = docs, fresh(docs, *(f.name for f in FIELDS))
    for k in range(blocks):
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k)
        rows = [(r["size"], bytes(r["words"]), r["item"]) for r in part.collect()]  # bounded by max_windows
        found = append_columns(out, [text_col], FIELDS if k == 0 else [T.StructField(m, f.dataType) for m, f in zip(more, FIELDS, strict=True)], _matcher(spark.sparkContext.broadcast(rows)))
        if k:
            found = found.withColumns({
                "hit_spans": _merged(F.concat("hit_spans", more[1])), "hit_items": F.array_sort(F.array_union("hit_items", more[2])),
            }).drop(*more)
        out = found if blocks == 1 else scratch.cut(found)
    return out


def n_hit() -> Column:
    """Words of ``hit_spans``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end_word"] - x["first_word"]))


def contaminated(percent: int = 5) -> Column:
    """At least ``percent`` of the words are hit."""
    return (n_hit() > 0) & (100 * n_hit() >= percent * F.col("n_words"))


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_col`` without the bytes of ``hit_spans`` (the words hit and what stands between them); null stays null."""
    first, rest = F.slice("hit_spans", 1, 1), F.col("hit_spans")
    data = F.col(text_col).cast("binary")
    edges = F.concat(
        F.array(F.struct(F.lit(0).alias("a"), F.coalesce(F.element_at(F.transform(first, lambda x: x["first_byte"]), 1), F.octet_length(text_col)).alias("b"))),
        F.transform(
            F.sequence(F.lit(1), F.size(rest)),
            lambda i: F.struct(
                F.element_at(rest, i)["end_byte"].alias("a"),
                F.coalesce(F.try_element_at(rest, i + 1)["first_byte"], F.octet_length(text_col)).alias("b"),
            ),
        ),
    )
    kept = F.transform(edges, lambda e: F.decode(F.substring(data, e["a"] + 1, e["b"] - e["a"]), "UTF-8"))
    return found.withColumn(text_col, F.when(F.size("hit_spans") > 0, F.concat_ws("", kept)).otherwise(F.col(text_col)))


def drop_documents(docs: DataFrame, bench: DataFrame, percent: int = 5, **kw) -> DataFrame:
    """``docs`` without contaminated rows, columns unchanged whatever their names."""
    inner = dict(zip([f.name for f in FIELDS], fresh(docs, *(f.name for f in FIELDS)), strict=True))
    out = find(docs.withColumnsRenamed(inner), bench, **kw).where(~contaminated(percent))
    return out.drop(*inner).withColumnsRenamed({v: k for k, v in inner.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
