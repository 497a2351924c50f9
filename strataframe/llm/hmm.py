"""Language-model scores by a hidden Markov model over words, trained by Baum-Welch on all training documents.

The model's classes are the frequent words (``vocabulary`` at most, words of up
to 64 bytes), one class for all other words and the end of a text. Words of the
common class share its probability by their counts plus a half, unseen words
together by a half, so every text has an exact probability. Counts of all words
of all training documents come first; every round of Baum-Welch then adds up
expected counts of all training documents over all tasks. What is broadcast has
a bound: ``vocabulary`` words and ``vocabulary + 2`` classes by states. Counts
of other words meet the documents in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.cluster import Scratch
from strataframe.llm.rowwise import append_columns, fresh
from strataframe.llm.tokens import SPACE_RULE, Words, chunks, split_words, word_strings

VOCABULARY = 65_534  # with the two other classes, 16 bits name a class
WORD_BYTES = 64
STATES = 8
ROUNDS = 4
PRIOR = 1000.0  # words of the unigram distribution that every state sees besides its own
CHUNK_TOKENS = 500_000
RESCALE = 8  # places between two scalings: probabilities stay far within the range of doubles
_FLUSH_WORDS = 1 << 20
_SEED = 11


@dataclass
class Counts:
    """Training counts: frequent words in order, their counts, and what the base model needs."""

    words: list[bytes]
    counts: np.ndarray
    n: int  # tokens, ends included
    v: int  # distinct tokens, the end included
    ends: int

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    @property
    def common(self) -> float:
        """The counts of all words outside the vocabulary with their halves, and the half of unseen words."""
        rest = self.n - self.ends - int(self.counts.sum())
        return rest + 0.5 * (self.v - bool(self.ends) - len(self.words)) + 0.5

    def unigram(self) -> np.ndarray:
        """Base probability by class: words, all other words, the end."""
        return np.concatenate([self.counts + 0.5, [self.common, self.ends + 0.5]]) / self.total


@dataclass
class Model:
    """Probabilities of the first state, of the next state by state, and of the classes by state (classes x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[Words, pa.DictionaryArray]:
    w = split_words(data, off, SPACE_RULE, lower=True, hashed=False)
    return w, word_strings(w).dictionary_encode()


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) of all texts; tasks add up before the shuffle."""

    def run(batches):
        words, counts, size = [], [], 0

        def flush():
            table = pa.table({"word": pa.concat_arrays(words), "c": pa.concat_arrays(counts)}).group_by("word").aggregate([("c", "sum")])
            out = pa.table({"word": table["word"].cast(pa.string()), "c": table["c_sum"]})
            return out.combine_chunks().to_batches(max_chunksize=100_000)

        for batch in batches:
            for _, _, data, off in chunks(batch.column(0)):
                _, coded = tokens(data, off)
                words.append(coded.dictionary)
                counts.append(pa.array(np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)), pa.int64()))
                size += len(coded.dictionary)
                if size > _FLUSH_WORDS:
                    yield from flush()
                    words, counts, size = [], [], 0
        if size:
            yield from flush()

    return docs.select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` words: those above a count that leaves no more. Counts are compared by their first 11 binary digits.

    So the histogram of counts is bounded, and so is what the driver gets.
    """
    short = counts.where(F.octet_length("word") <= WORD_BYTES).withColumn("_drop", F.greatest(F.length(F.bin("c")) - 11, F.lit(0)))
    short = short.withColumn("_level", F.expr("shiftleft(shiftright(c, _drop), _drop)"))
    seen, least = 0, None
    for row in sorted(short.groupBy("_level").count().collect(), key=lambda r: -r[0]):
        seen += row[1]
        if seen > most:
            break
        least = row[0]
    if least is None:
        return []
    return sorted(((r.word, r.c) for r in short.where(F.col("_level") >= least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def train_counts(docs: DataFrame, table: DataFrame, most: int) -> Counts:
    ends = docs.count()
    n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = frequent(table, most)
    return Counts([w.encode() for w, _ in top], np.array([c for _, c in top], np.int64), n + ends, v + bool(ends), ends)


_RARE = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))


def encoded(docs: DataFrame, text_col: str, names: list[str], c: Counts) -> DataFrame:
    """``docs`` without the text, with ``names``: n_tokens, n_known and base sum of the frequent ones, classes as 16-bit numbers, other words with their number."""
    shared = docs.sparkSession.sparkContext.broadcast((c.words, np.log10(np.append(c.counts + 0.5, c.ends + 0.5) / c.total), c.ends))
    state: dict = {}
    rare_type = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def fn(texts):
        if not state:
            words, state["log"], state["ends"] = shared.value
            state["words"] = pa.array(words, pa.large_binary())
        known, m, ends = state["words"], len(state["words"]), state["ends"]
        out: list[list] = [[] for _ in names]
        for _, _, data, off in chunks(texts):
            w, coded = tokens(data, off)
            cls = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), m).to_numpy(zero_copy_only=False).astype(np.int64)
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, rows, n = cls[index], w.rows(), w.counts
            usual = ids < m
            out[0].append(pa.array(n + 1, pa.int64()))
            out[1].append(pa.array(np.bincount(rows[usual], minlength=len(n)) + bool(ends), pa.int64()))
            out[2].append(pa.array(np.bincount(rows[usual], state["log"][ids[usual]], minlength=len(n)) + state["log"][m]))
            with_end = np.insert(ids, w.first[1:], m + 1).astype(np.uint16)
            cut = (w.first + np.arange(len(w.first))).tolist()
            out[3].append(pa.array([with_end[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
            pairs, times = np.unique(rows[~usual] * max(1, len(coded.dictionary)) + index[~usual], return_counts=True)
            own = coded.dictionary.take(pa.array(pairs % max(1, len(coded.dictionary)))).cast(pa.string())
            flat = pa.StructArray.from_arrays([own, pa.array(times, pa.int64())], fields=list(rare_type))
            at = np.searchsorted(pairs // max(1, len(coded.dictionary)), np.arange(len(n) + 1))
            out[4].append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat))
        empty = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(rare_type)]
        return [pa.concat_arrays(x) if x else pa.array([], kind) for x, kind in zip(out, empty, strict=True)]

    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.BinaryType(), _RARE]
    return append_columns(docs, [text_col], [T.StructField(x, k) for x, k in zip(names, kinds, strict=True)], fn, drop=[text_col])


class Steps:
    """Texts side by side, the longest first: what stands at one place of all of them is together in the arrays."""

    def __init__(self, texts: list[np.ndarray]):
        size = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts that have a place t
        self.begin = np.append(0, np.cumsum(self.active))
        flat = np.concatenate([texts[k] for k in self.order])
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        text = np.repeat(np.arange(len(size)), size)
        at = self.begin[place] + text
        self.classes, self.text = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        self.classes[at], self.text[at] = flat, text

    def forward(self, m: Model, keep: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """(state probabilities, scale of every place, emissions). They are scaled to sum to 1 at every ``RESCALE``-th place and at ends; other scales are 1."""
        emit, ones = m.emit[self.classes], np.ones(len(m.start))
        alpha, scale = np.empty_like(emit) if keep else None, np.ones(len(emit))
        now = np.broadcast_to(m.start, (self.active[0], len(m.start)))
        active = self.active.tolist()
        for t, (a, n, stay) in enumerate(zip(self.begin.tolist(), active, [*active[1:], 0], strict=False)):
            now = (now[:n] @ m.move if t else now) * emit[a : a + n]
            if (first := 0 if t % RESCALE == 0 else stay) < n:
                s = now[first:] @ ones
                now[first:] /= s[:, None]
                scale[a + first : a + n] = s
            if keep:
                alpha[a : a + n] = now
        return alpha, scale, emit

    def log_likelihood(self, m: Model) -> np.ndarray:
        """Natural logarithm of the probability of every text, in the order they were given."""
        _, scale, _ = self.forward(m, keep=False)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.text, np.log(scale), minlength=len(self.order))
        return out

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, moves and classes by state, and the logarithm of the likelihood."""
        alpha, scale, emit = self.forward(m)
        ahead = np.divide(emit, scale[:, None], out=emit)  # becomes emission x backward / scale
        back, moves = np.ascontiguousarray(m.move.T), np.zeros_like(m.move)
        begin, active = self.begin.tolist(), self.active.tolist()
        for t in range(len(active) - 2, -1, -1):
            a, b, n = begin[t], begin[t + 1], active[t + 1]
            now, after = alpha[a : a + n], ahead[b : b + n]
            moves += now.T @ after
            beta = after @ back
            ahead[a : a + n] *= beta
            now *= beta  # ends keep theirs, as nothing follows
        classes = np.stack([np.bincount(self.classes, alpha[:, k], minlength=len(m.emit)) for k in range(alpha.shape[1])], axis=1)
        return alpha[: active[0]].sum(axis=0), m.move * moves, classes, float(np.log(scale).sum())


def grouped(column_batches, most: int = CHUNK_TOKENS):
    """Texts of classes, in lists of about ``most`` tokens, with how many rows each list has."""
    held, size = [], 0
    for column in column_batches:
        for raw in column.to_pylist():
            held.append(np.frombuffer(raw, np.uint16))
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def first_model(unigram: np.ndarray, states: int) -> Model:
    """States that like different words, chosen by a seeded generator, and that mostly stay."""
    likes = np.exp(np.random.Generator(np.random.PCG64(_SEED)).normal(size=(len(unigram), states)))
    emit = unigram[:, None] * likes
    stay = 0.9 if states > 1 else 1.0
    move = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(move, stay)
    return Model(np.full(states, 1 / states), move, emit / np.maximum(emit.sum(axis=0), 1e-300))


def next_model(start: np.ndarray, moves: np.ndarray, classes: np.ndarray, unigram: np.ndarray, prior: float = PRIOR) -> Model:
    return Model(
        (start + 1) / (start.sum() + len(start)), (moves + 1) / (moves.sum(axis=1, keepdims=True) + len(start)),
        (classes + prior * unigram[:, None]) / (classes.sum(axis=0) + prior),
    )


def one_round(coded: DataFrame, classes_col: str, m: Model, unigram: np.ndarray) -> tuple[Model, float]:
    """The model after one round over all rows of ``coded``, and the logarithm of the likelihood before it."""
    model, k = coded.sparkSession.sparkContext.broadcast(m), len(m.start)

    def run(batches):
        m, total = model.value, None
        for texts in grouped(b.column(0) for b in batches):
            own = Steps(texts).expected(m)
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is None:
            return
        start, moves, classes, ll = total
        seen = np.flatnonzero(classes.any(axis=1))
        rows = np.concatenate([classes[seen], moves, start[None], np.full((1, k), ll)])
        keys = np.concatenate([seen, -1 - np.arange(k + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(np.ascontiguousarray(rows[:, s])) for s in range(k)]], names=["key", *[f"s{s}" for s in range(k)]])

    parts = coded.select(classes_col).mapInArrow(run, "key long, " + ", ".join(f"s{s} double" for s in range(k)))
    sums = parts.groupBy("key").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toArrow()  # one row a class and state at most
    keys, rows = sums["key"].to_numpy(), np.stack([sums[f"s{s}"].to_numpy() for s in range(k)], axis=1).reshape(-1, k)
    table = {int(key): row for key, row in zip(keys[keys < 0], rows[keys < 0], strict=True)}
    none, classes = np.zeros(k), np.zeros_like(m.emit)
    classes[keys[keys >= 0]] = rows[keys >= 0]
    moves = np.stack([table.get(-1 - s, none) for s in range(k)])
    model.unpersist()
    return next_model(table.get(-1 - k, none), moves, classes, unigram), float(table.get(-2 - k, none)[0])


def score(
    docs: DataFrame, learn: Column, text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, vocabulary: int = VOCABULARY, history: list | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` without their text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after A-Z to a-z, then one end.
    Rows where ``learn`` holds are learnt from, all of them and each as often as
    it stands there; null is not learnt from. ``base_score`` is the unigram
    model's sum of log10 probabilities, each count plus a half; ``score`` is
    log10 of the probability of all tokens summed over all paths of states.
    Null and empty texts are the end alone. Without rows to learn from, ``score``
    equals ``base_score``. Columns of the five names are replaced. ``history``
    gets the likelihood before every round. The result reads tables of ``scratch``;
    whoever passes one closes it afterwards.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "hmm")
    key, learnt, known, base, classes, rare = fresh(docs, "row", "learn", "known", "base", "classes", "rare")
    (n_tokens,) = fresh(docs, "tokens")
    table = scratch.cut(count_words(docs.where(learn), text_col))
    c = train_counts(docs.where(learn), table, vocabulary)
    marked = encoded(docs.withColumn(learnt, F.coalesce(learn, F.lit(False))), text_col, [n_tokens, known, base, classes, rare], c)
    # texts of one length together: a task then has fewer places to go through
    coded = scratch.cut(marked.withColumn(key, F.monotonically_increasing_id()).sortWithinPartitions(n_tokens))
    unigram = c.unigram()
    m, own = first_model(unigram, states), coded.where(F.col(learnt))
    for _ in range(rounds):
        m, ll = one_round(own, classes, m, unigram)
        if history is not None:
            history.append(ll)
    rows = coded.select(key, F.explode(rare).alias("r")).select(key, "r.word", "r.n").join(table, "word", "left")
    counted = F.coalesce(F.col("c"), F.lit(0))
    sums = rows.groupBy(key).agg(
        F.sum("n").alias("rare_n"), F.sum(F.when(counted > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(counted + 0.5)).alias("rare_log"),
    )
    model = spark.sparkContext.broadcast(m)

    def forward(column):
        out = [Steps(texts).log_likelihood(model.value) for texts in grouped([column])]
        return [pa.array(np.concatenate(out) / np.log(10) if out else np.zeros(0))]

    scored = append_columns(coded.drop(rare, learnt), [classes], [T.StructField(rare, T.DoubleType())], forward, drop=[classes])
    both = scored.join(sums, key, "left").na.fill(0, ["rare_n", "rare_known", "rare_log"])
    names = {
        "n_tokens": F.col(n_tokens), "n_known": F.col(known) + F.col("rare_known"), "train_tokens": F.lit(c.n).cast("long"),
        "base_score": F.col(base) + F.col("rare_log") - F.col("rare_n") * float(np.log10(c.total)),
        "score": F.col(rare) + F.col("rare_log") - F.col("rare_n") * float(np.log10(c.common)),
    }
    kept = [F.col(f"`{x}`") for x in docs.columns if x != text_col and x.lower() not in names]
    return both.select(*kept, *[v.alias(k) for k, v in names.items()])
