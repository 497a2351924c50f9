"""Substring dedup over words with difference-cover anchors.

Of the window starts of a text only those at cover positions modulo a period
are hashed, as anchors of ``window - period + 1`` words. Any two equal windows,
wherever they start, have anchors at one common offset (the defining property
of a difference cover), so every repeated window shares an aligned anchor. The
windows around shared anchors are then extended to full length and compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataframe.llm.cluster import Scratch
from strataframe.llm.spread import BLOBS, Packer, blob_table, exchange, keyed, map_texts, with_texts
from strataframe.llm.tokens import SPACE_RULE, chunks, covered, ngrams, run_hashes, span_hashes, split_words

WINDOW = 13
#: Difference covers (period: offsets); every residue is a difference of two offsets.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

RESULT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def period_for(window: int) -> int:
    """The largest cover period that leaves anchors of at least half a window; 1 (all positions) for short windows."""
    return max([p for p in COVERS if window - p + 1 >= (window + 1) // 2], default=1)


def shared_windows(rows: DataFrame, n: int, scratch: Scratch, window: int) -> DataFrame:
    """Packed (rk, pos) of the windows that also start in a document with a smaller id."""
    period = period_for(window)
    cover = np.isin(np.arange(period), COVERS.get(period, (0,)))
    length = window - period + 1

    def anchors(p: Packer, ids, rk, texts):
        for a, _, data, off in chunks(texts):
            w = split_words(data, off, SPACE_RULE, lower=False)
            at, h = ngrams(w, length)
            row = np.searchsorted(w.first, at, "right") - 1
            pos = at - w.first[row]
            # anchors of texts too short for a window are of no use
            use = cover[pos % period] & (w.counts[row] >= window)
            row, h = row[use], h[use]
            p.add((h % np.uint64(n)).astype(np.int64), fp=h >> np.uint64(16), id=ids[a + row], rk=rk[a + row], pos=pos[use].astype(np.uint32))
            yield

    alive = exchange(map_texts(rows, anchors, n, {"fp": 6}), n, lambda own, lo, hi, count: lo != hi, ("pos",), scratch)

    def extend(ids, rk, texts, found):
        p, ident = Packer(n, split=True), dict(zip(rk.tolist(), ids.tolist(), strict=True))
        rk, texts = found.only(rk, texts)
        ids = np.array([ident[k] for k in rk.tolist()], np.int64)
        for a, b, data, off in chunks(texts):
            own = {r: found.get(rk[a + r]) for r in range(b - a)}
            w = split_words(data, off, SPACE_RULE, lower=False)
            at, h = ngrams(w, window)
            near = np.zeros(len(w.start) + 1, bool)
            for r, v in own.items():
                k = w.counts[r]
                first = np.maximum(v["pos"].astype(np.int64) - period + 1, 0)
                near[w.first[r] : w.first[r + 1]] = covered(k, first, np.minimum(v["pos"].astype(np.int64) + 1, k))
            use = near[at]
            at, h = at[use], h[use]
            row = np.searchsorted(w.first, at, "right") - 1
            # what is removed is decided here: by 125 bits
            second = run_hashes(span_hashes(data, w.start, w.end, family=1), at, window, family=1)
            p.add((h % np.uint64(n)).astype(np.int64), fp=h, fp2=second, id=ids[a + row], rk=rk[a + row], pos=(at - w.first[row]).astype(np.uint32))
        return blob_table(p)

    old = scratch.so_far()
    hits = exchange(with_texts(rows, alive, extend, BLOBS, n), n, lambda own, lo, hi, count: own > lo, ("pos",), scratch)
    scratch.release(old)
    return hits


def remove(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text): every word covered by a repeated window removed.

    A window is repeated if its word sequence also starts in a document with a
    smaller id; all windows are judged on the input. Null and empty texts have
    no words; a null id counts as larger than all others; rows with one id do
    not repeat each other. ``kept_text`` joins the kept words by one space (null
    if not ``keep_text``). The result reads tables of ``scratch``; whoever passes
    one closes it afterwards.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    rows, n = keyed(docs, id_col, text_col, scratch)
    hits = shared_windows(rows, n, scratch, window)

    def finish(ids, rk, texts, found):
        out = ([], [], [], [])
        for r, text in enumerate(texts):
            words = text.as_py().encode().split()
            hit, removed = found.get(rk[r]), 0
            if hit is not None:
                pos = hit["pos"].astype(np.int64)
                gone = covered(len(words), pos, pos + window)
                removed = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            for o, v in zip(out, (len(words) + removed, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None), strict=True):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("id", "n_words", "n_removed", "kept_sha256", "kept_text")
        return pa.table([pa.array(ids), *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], names=names)

    return with_texts(rows, hits, finish, RESULT, n)
