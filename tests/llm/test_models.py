"""Periodic runs, language-model scores and hard negatives against brute force, and on edge cases; strings that fool one hash; scratch tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.llm import hmm, near, negatives, quality, queries_models, runs, substrings, suffixes, tokens
from strataframe.llm.cluster import Scratch

MORSE = [bin(k).count("1") & 1 for k in range(2048)]
PAIR = ["".join("ab"[b] for b in MORSE), "".join("ba"[b] for b in MORSE)]


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def made_text(r, k):
    parts = []
    for _ in range(r.randrange(0, 5)):
        unit = [f"w{r.randrange(k)}" for _ in range(r.randrange(1, 25))]
        unit = unit[: r.randrange(1, 4)] * r.randrange(1, 4) + unit if r.random() < 0.5 else unit
        parts += (unit * r.randrange(1, 9))[: r.randrange(1, 150)]
    return parts


def test_runs_are_those_of_a_plain_search():
    r, total = random.Random(3), 0
    for _ in range(300):
        docs = [made_text(r, r.choice([1, 2, 3, 40])) for _ in range(r.randrange(1, 5))]
        flat = [x for d in docs for x in d]
        codes = np.array([zlib.crc32(x.encode()) for x in flat], np.int64)
        table, cut = runs.find_runs(codes, np.append(0, np.cumsum([len(d) for d in docs])))
        for k, d in enumerate(docs):
            want = brute_runs(d)
            total += len(want)
            assert [tuple(x[1:]) for x in table[cut[k] : cut[k + 1]].tolist()] == want
    assert total > 500


def test_runs_on_edges(spark):
    texts = [None, "", " \t ", "a", "a a a a a", "a a a a a a", " x\ty " * 5, "a b " * 20_000, "é ß é ß é ß é ß", "a b a b a b a b c d c d c d c d", PAIR[0] + " " + PAIR[1]]
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)] + [(5, texts[5], "n", 1), (None, texts[6], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = runs.find(docs)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and got.count() == len(rows)
    for r in got.collect():
        words = (r.text or "").split()
        want = brute_runs(words) if len(words) < 1000 else [(0, 40_000, 2)]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == want
        assert r.collapsed == (collapsed(words, want) if len(words) < 1000 else "a b")
    assert runs.find(docs.limit(0)).count() == 0


def test_the_query_of_runs_repeats_words_as_told(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, " ".join(made_text(r, 30)) if k % 7 else None) for k in range(120)] + [(None, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries_models.op11_periodic_runs(spark, str(tmp_path)).collect()}
    turned = 0
    for k, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(k).encode()) if k is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w, turned = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], turned + 1
        want = brute_runs(w)
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (got[k].n_runs, got[k].start, got[k].length, got[k].period) == (len(want), *(best or (None,) * 3))
        assert got[k].exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert got[k].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert got[k].collapsed_sha256 == hashlib.sha256(collapsed(w, want).encode()).hexdigest()
    assert turned > 3


def small_model(r, classes, states):
    p = lambda *shape: (x := r.random(shape)) / x.sum(axis=0)
    return hmm.Model(p(states), p(states, states).T, p(classes, states))


def test_likelihood_and_expected_counts_are_sums_over_all_paths():
    r = np.random.default_rng(2)
    m = small_model(r, 5, 3)
    texts = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 2, 1, 6)]
    start, moves, classes, total = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    logs = []
    for t in texts:
        paths = {p: m.start[p[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(m.emit[c, s] for c, s in zip(t, p, strict=True)) for p in itertools.product(range(3), repeat=len(t))}
        whole = sum(paths.values())
        logs.append(math.log(whole))
        for p, w in paths.items():
            start[p[0]] += w / whole
            for a, b in itertools.pairwise(p):
                moves[a, b] += w / whole
            for c, s in zip(t, p, strict=True):
                classes[c, s] += w / whole
        total += logs[-1]
    steps = hmm.Steps(texts)
    assert steps.log_likelihood(m) == pytest.approx(logs)
    got = steps.expected(m)
    for a, b in zip(got, (start, moves, classes, total), strict=True):
        assert a == pytest.approx(b)


def test_long_texts_stay_in_range_and_rounds_raise_the_likelihood():
    r = np.random.default_rng(4)
    texts = [np.concatenate([r.choice([0, 1, 2], 30), r.choice([3, 4, 5], 30)] * 60).astype(np.uint16) for _ in range(4)] + [r.choice(6, 3).astype(np.uint16)]
    unigram = np.full(6, 1 / 6)
    m, seen = hmm.first_model(unigram, 2), []
    for _ in range(12):
        *sums, ll = hmm.Steps(texts).expected(m)
        seen.append(ll)
        m = hmm.next_model(*sums, unigram, prior=1.0)
    assert np.isfinite(seen).all() and all(b > a - 1 for a, b in itertools.pairwise(seen)) and seen[-1] > seen[0] + 1000


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()


@pytest.mark.parametrize("vocabulary", [1000, 3, 0])
def test_scores_of_all_rows(spark, vocabulary):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["The", "the", "sea", "ice", f"w{r.randrange(30)}"]) for _ in range(r.randrange(0, 40))) if k % 11 else None, "x") for k in range(60)]
    rows += [(7, rows[7][1], "x"), (None, "the the", "x"), (61, "unseen words only " * 3, "x"), (62, "long " * 30_000, "x"), (63, "y" * 100 + " the", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    learn, history = F.col("doc_id") % 5 != 1, []
    got = hmm.score(docs, learn, states=3, rounds=3, vocabulary=vocabulary, history=history)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.count() == len(rows)
    train = [t for k, t, _ in rows if k is not None and k % 5 != 1]
    c = Counter(w for t in train for w in words(t))
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    log = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    by = {}
    for k, t, _ in rows:
        w = words(t)
        by[k] = (len(w) + 1, sum(x in c for x in w) + 1, sum(log(c[x]) for x in w) + log(ends))
    for x in got.collect():
        assert (x.n_tokens, x.n_known, x.train_tokens) == (*by[x.doc_id][:2], n)
        assert x.base_score == pytest.approx(by[x.doc_id][2]) and math.isfinite(x.score) and x.score < 0
    assert len(history) == 3 and history[2] > history[0]
    none = hmm.score(docs, F.lit(False), states=3, rounds=1, vocabulary=vocabulary)
    assert all(x.score == pytest.approx(x.base_score) and x.n_known == 0 and x.train_tokens == 0 for x in none.collect())
    assert hmm.score(docs.limit(0), learn, states=2, rounds=1).count() == 0


def test_probabilities_of_all_words_add_up_to_one():
    c = hmm.Counts([b"the", b"sea"], np.array([10, 6]), n=10 + 6 + 5 + 4, v=2 + 3 + 1, ends=4)
    assert c.unigram().sum() == pytest.approx(1)
    assert c.common == pytest.approx(5 + 0.5 * 3 + 0.5)  # three other words with 5 in all, and the unseen ones


def test_held_out_texts_are_likelier_than_by_the_unigrams(spark):
    r = random.Random(1)
    kinds = [[f"{a}{k}" for k in range(40)] for a in "abc"]
    rows = [(k, " ".join(r.choice(kinds[k % 3]) for _ in range(60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = hmm.score(docs, F.col("doc_id") % 5 != 1, rounds=8).where("doc_id % 5 = 1").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] + 60 * 60 * 0.3


def brute_negatives(rows, is_anchor):
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = []
    for k, label, v in rows:
        if not is_anchor(k):
            continue
        every = sorted((-score(v, w), i, m) for i, m, w in rows if i != k)
        for s, p, _ in [x for x in every if x[2] == label][:5]:
            fit = [(t, i) for t, i, m in every if m != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(k, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 256.0])
def test_hard_negatives_are_those_of_a_plain_search(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 3)
    r = random.Random(int(scale))
    rows = [(k, r.randrange(3), [float(r.choice([-9, -2.5, 0, 0.25, 3, 3, 700])) for _ in range(r.choice([70, 70, 2]))]) for k in range(150)]
    rows += [(200 + k, 1, rows[5][2]) for k in range(30)]  # ties
    bad = [(300, None, [1.0]), (301, 1, None), (302, 1, [1.0, None]), (303, 1, [float("nan")]), (304, 1, [float("inf")]), (None, 1, [1.0]), (310, 2, [])]
    twice = [rows[10], (20, 9, [5.0])]  # the same again, and another row of an id that loses to the smaller label
    table = spark.createDataFrame([(*x, "s") for x in rows + bad + twice], "vec_id long, label int, embedding array<double>, score string")
    got = negatives.mine(table, F.col("id") % 10 == 0, F.col("label"), scale=scale)
    ints = [(k, m, [math.floor(scale * x) for x in v]) for k, m, v in [*rows, (310, 2, [])]]
    want = brute_negatives(ints, lambda k: k % 10 == 0)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 100
    assert negatives.mine(table.limit(0), F.col("id") % 10 == 0, F.col("label")).count() == 0


def test_products_of_residues_are_exact():
    r = np.random.default_rng(3)
    for top, dim in ((5, 3), (200, 64), (10**6, 200)):
        a, b = r.integers(-top, top + 1, (20, dim)), r.integers(-top, top + 1, (30, dim))
        a[0], b[0], b[1] = top, top, -top
        p = negatives.primes_for(dim * top * top)
        assert (negatives.products(a, b, p) == a @ b.T).all()
    assert len(negatives.primes_for(64 * 160 * 160)) == 3


def test_scores_beyond_64_bits_are_an_error(spark):
    table = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(OverflowError):
        negatives.mine(table, F.col("id") % 100 == 0, F.col("label"))


def test_strings_that_fool_polynomials_modulo_a_power_of_two(spark):
    """Thue-Morse words with their letters exchanged: equal by one family at 1,024 bytes and more, never by the other."""
    data = np.frombuffer("".join(PAIR).encode(), np.uint8)
    one, two = (tokens.span_hashes(data, np.array([0, 2048]), np.array([2048, 4096]), family=f) for f in tokens.FAMILIES)
    assert one[0] != one[1] and two[0] == two[1]
    w = [f"w{k}" for k in range(30)]
    texts = [" ".join([*w, PAIR[0], *w[::-1]]), " ".join([*w, PAIR[1], *w[::-1]])]
    docs = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, PAIR[0]), (3, PAIR[1])], "doc_id long, text string")
    sets = near.components(docs)
    assert {(r.id, r.component_id) for r in sets.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)} and sets.select("n_same").distinct().collect()[0][0] == 1
    kept = {r.id: r.n_removed for r in substrings.remove(docs).collect()}
    assert kept == {0: 0, 1: 60, 2: 0, 3: 0}
    both = spark.createDataFrame([(0, f"{PAIR[0]}\n{PAIR[1]}\n{PAIR[0]}")], "doc_id long, text string")
    assert quality.label_lines(both, quality.train(both, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))).first().n_dup_lines == 1
    once = "".join(PAIR[0][k] + chr(65 + k % 26) for k in range(1200))  # nothing of 400 bytes repeats between these two
    other = "".join(PAIR[1][k] + chr(65 + k % 26) for k in range(1200))
    raw = [once, other]
    got = {r.id: r.n_removed for r in suffixes.remove(spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")).collect()}
    seen = Counter(t[k : k + 400] for t in raw for k in range(len(t) - 399))
    gone = [len({p for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1 for p in range(k, k + 400)}) for t in raw]
    assert got == dict(enumerate(gone))


def left(spark, root):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def test_scratch_tables_go(spark):
    docs = spark.createDataFrame([(k, f"some words {k % 3} " * 200) for k in range(40)], "doc_id long, text string")
    for run in (substrings.remove, suffixes.remove, near.components):
        scratch = Scratch(spark, "test")
        assert run(docs, scratch=scratch).count() == 40 and left(spark, scratch.root)
        assert not spark.catalog.listTables()
        scratch.close()
        assert not left(spark, scratch.root)
    scratch = Scratch(spark, "test")
    kept = scratch.result(substrings.remove(docs, scratch=scratch).select("id", "n_words"))
    assert not left(spark, scratch.root) and kept.count() == 40
