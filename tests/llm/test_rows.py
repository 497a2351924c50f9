"""Per-document operators, chat, mixing and sharding on rows with nulls, empty and long texts, repeats and clashing names."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strataframe.llm import chat, decontaminate, licenses, mixing, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, source string, size string, n_words string, score string, shard string, kept string"
TEXTS = [
    "plain words stand here and nothing else happens", "", None, " \n\t", "one", "zwei drei\n\nzwei drei\nvier #*$%&|<>", "lang " * 30_000,
    "Licensed under the Apache License, Version 2.0.", "x\nReleased under the MIT license\nAll rights reserved.", "same line\nsame line\nsame line\r", "é ü ß 日本",
]
ROWS = [(k, t, ["a", "b", None, "a"][k % 4], "s", "w", "c", "h", "k") for k, t in enumerate(TEXTS)] + [(3, TEXTS[0], "a", None, None, None, None, None), (None, TEXTS[0], None, "s", "w", "c", "h", "k"), (3, TEXTS[0], "a", None, None, None, None, None)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_toxicity_learns_words_and_scores_all_rows(spark, docs, none):
    labels = [(k, int(k % 5 == 0)) for k in range(400)] + [(None, 1), (3, None), (5, 1)]
    texts = spark.createDataFrame([(k, f"the quiet text {k % 11} {'awful slur' if k % 5 == 0 else 'kind word'} ends") for k in range(400)], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    w = toxicity.train(texts, table, l1=1.0)
    got = {r.doc_id: r.score for r in toxicity.score(texts, w).collect()}
    assert all((got[k] > 0.7) == (k % 5 == 0) for k in got)
    again = {r.doc_id: r.score for r in toxicity.score(texts.repartition(3), toxicity.train(texts.repartition(5), table, l1=1.0)).collect()}
    assert got == again
    rows = toxicity.score(docs, w)
    assert rows.columns == [c for c in docs.columns if c != "score"] + ["score"] and rows.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in rows.collect()) and toxicity.score(none, w).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(texts, table.limit(0))).collect()} == {0.5}


def test_decontamination_on_edges(spark, docs, none):
    bench = spark.createDataFrame([(1, "PLAIN words, stand here"), (2, "one"), (None, "zwei drei vier"), (3, None), (4, ""), (5, " ".join(f"b{k}" for k in range(20)))], "item_id long, text string")
    for limit in (200_000, 2):  # one block, and many
        got = decontaminate.find(docs, bench, max_windows=limit)
        by = {(r.doc_id, r.text): r for r in got.collect()}
        assert got.count() == len(ROWS)
        assert by[0, TEXTS[0]].hit_items == ["1"] and [(s.first_word, s.end_word) for s in by[0, TEXTS[0]].hit_spans] == [(0, 4)]
        assert by[4, "one"].hit_items == ["2"] and by[2, None].n_words == 0 and by[2, None].hit_spans == []
        assert by[5, TEXTS[5]].hit_items == [] and by[5, TEXTS[5]].hit_spans[0].first_word == 2
    kept = decontaminate.drop_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 6, 7, 8, 9, 10}
    cut = {(r.doc_id, r.text) for r in decontaminate.remove_spans(decontaminate.find(docs, bench)).select("doc_id", "text").collect()}
    assert (0, " and nothing else happens") in cut and (4, "") in cut and (2, None) in cut
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).where("size(hit_spans) > 0").count() == 0


def test_license_scan(docs, none):
    got = {r.doc_id: (r.n_hits, r.licenses) for r in licenses.summary(licenses.scan(docs)).collect()}
    assert got[7] == (1, "Apache-2.0") and got[8] == (2, "MIT,all-rights-reserved") and got[2] == (0, "") and got[0][0] == 0
    assert licenses.scan(none).count() == 0


def test_license_wording_differences_are_exact():
    words = licenses.words
    assert licenses.differences(words("licensed under the old apache license version 2.0"), words(licenses.TEMPLATES["Apache-2.0"])) == (0, 1)
    s = licenses.Scanner(licenses.TEMPLATES, 0.2)
    for name, text in licenses.TEMPLATES.items():
        assert s.block(text)[0] == name and s.block(text)[2:] == (0, 0)
    assert s.block("We talked about the license of a car and went home") is None


def prose(n, r):
    return " ".join(r.choice(["river", "stone", "the", "of", "walks", "under", "with", "this"]) + str(r.randrange(50)) * r.randrange(2) for _ in range(n))


def license_hits(text):
    return [(h["line"], h["license"], h["different_words"], h["missing_words"]) for h in licenses.Scanner(licenses.TEMPLATES, 0.2).text(text)]


def test_license_scan_aligns_every_template_in_long_lines():
    r = random.Random(4)
    for name, text in licenses.TEMPLATES.items():
        assert license_hits(prose(3000, r) + " " + text + " " + prose(3000, r)) == [(0, name, 0, 0)]


def test_license_scan_of_wrapped_edited_and_several_notices():
    r = random.Random(4)
    for name, text in licenses.TEMPLATES.items():
        wrapped = "\n".join("# " + " ".join(text.split()[k : k + 5]) for k in range(0, len(text.split()), 5))
        assert license_hits(f"{prose(9, r)}\n{prose(9, r)}\n{wrapped}\n{prose(9, r)}") == [(2, name, 0, 0)]
    many = [n for n in licenses.TEMPLATES if n != "Apache-2.0"]
    assert license_hits(" ".join(prose(20, r) + " " + licenses.TEMPLATES[n] for n in many)) == [(0, n, 0, 0) for n in many]
    edited = "This software is licensed under the GNU General Public License version 3"
    assert license_hits(prose(40, r) + " " + edited + " " + prose(40, r)) == [(0, "GPL-3.0", 1, 1)]
    assert license_hits("All rights\nreserved.\nAll rights reserved") == [(0, "all-rights-reserved", 0, 0), (2, "all-rights-reserved", 0, 0)]


def test_quality_counts_and_model(spark, docs, none):
    good = "Here is a normal sentence with several different words number {}.\nAnd another line that follows it {}."
    bad = "BUY!! NOW!! {} *** $$$ ###\n| {} | x | y |"
    texts = spark.createDataFrame([(k, "\n".join((bad if k % 3 == 0 else good).format(k * 7 + j, j) for j in range(12))) for k in range(90)], "doc_id long, text string")
    labels = texts.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    model = quality.train(texts, labels)
    got = {r.doc_id: r.ok for r in quality.label_lines(texts, model).select("doc_id", (F.expr("2 * content_words >= n_words")).alias("ok")).collect()}
    assert all(ok == (k % 3 != 0) for k, ok in got.items())
    rows = quality.label_lines(docs, model)
    by = {(r.doc_id, r.text): r for r in rows.collect()}
    for (d, t), r in by.items():
        w = WORD.findall(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or ""))), d
    assert by[5, TEXTS[5]].n_dup_lines == 1 and by[9, TEXTS[9]].n_dup_lines == 1 and by[6, TEXTS[6]].n_repeat_words == 30_000
    assert quality.label_lines(none, model).count() == 0
    empty = quality.train(texts, labels.limit(0))
    assert quality.label_lines(texts, empty).where("content_words <> n_words").count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 9])
    u, tr = r.normal(size=(9, 2)), r.normal(size=(2, 2))
    got = quality.viterbi(u, tr, first)
    for a, b in zip(first, first[1:], strict=False):
        best = max(itertools.product((0, 1), repeat=b - a), key=lambda p: sum(u[a + k, x] for k, x in enumerate(p)) + sum(tr[x, y] for x, y in zip(p, p[1:], strict=False)), default=())
        assert tuple(got[a:b]) == best


def test_mixing(docs, none, spark):
    got = mixing.mix(docs)
    rows = got.collect()
    assert got.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken"] and len(rows) == len(ROWS)
    sizes = {}
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes.setdefault(r.source, []).append(r)
    for own in sizes.values():
        assert own[0].source_size == sum(r.size for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0
    out = mixing.materialise(got, docs.columns)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in rows)


def test_water_filling_caps_and_reshares(spark):
    s = spark.createDataFrame([("a", 1, 100), ("b", 2, 1000), ("c", 3, 10), ("d", 1, 0)], "source string, weight int, source_size long")
    got = {r.source: r.target for r in mixing.fill(s).collect()}
    assert got["c"] == 30 and got["d"] == 0 and got["a"] == 300 and got["b"] == pytest.approx(780)


def test_sharding(docs, none, spark):
    got = sharding.shard(docs, 5)
    rows = got.collect()
    assert got.columns == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(rows) == len(ROWS)
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert r.grown_shard in (r.shard, 5)
    assert sharding.shard(none).count() == 0
    ids = spark.range(60_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    big = sharding.shard(ids, 24)
    n = [r["count"] for r in big.groupBy("shard").count().collect()]
    assert len(n) == 24 and max(n) < 1.1 * 2500 and min(n) > 0.9 * 2500
    moved = big.where("grown_shard <> shard").count()
    assert 0.9 * 2400 < moved < 1.1 * 2400


def test_chat_collapses_snapshots(spark):
    def rows(c, turns):
        return [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]

    data = rows(1, ["a", "b"]) + rows(2, ["a", "b", "c"]) + rows(3, ["a", "b", "c", "d<|im_end|>"]) + rows(4, ["a", "x"]) + rows(5, ["a", "x"]) + rows(6, ["b", "a"])
    data += [(7, 0, None, None), (None, 0, "user", "q"), (8, None, "user", "z"), (8, 0, "user", "y"), (9, 0, "user", "r"), (9, 0, "user", "r")]
    conv = spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, a string")
    got = {r.conv_id: r for r in chat.render(conv).collect()}
    assert set(got) == {3, 4, 6, 7, None, 8, 9}
    assert got[3].n_turns == 4 and "d< |im_end| >" in got[3].rendered and got[4].n_copies == 2 and got[9].n_turns == 2
    assert got[7].rendered == "<|im_start|>unknown\n<|im_end|>\n" and got[8].rendered.index("y") < got[8].rendered.index("z")
    assert chat.render(conv.limit(0)).count() == 0


NAMES = "_id _rk _source _order _bucket _shard _size _crc _grown _inside _whole _part _take _score _n_words __source __size node slice hit_spans _hit_spans".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, f"text {k} " + "some words that stand here " * (k % 3), ["a", "b"][k % 2], *(f"{n}{k}" for n in NAMES)) for k in range(12)] + [(3, "text 3 ", "b", *(f"{n}3" for n in NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES))


def test_columns_of_any_name_pass_through(clashing, spark):
    from strataframe.llm import near

    def same(out):
        rows = out.collect()
        assert rows
        for r in rows:
            assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES if n in out.columns)
        return rows

    assert len(same(mixing.mix(clashing))) == len(same(sharding.shard(clashing, 3))) == 13
    same(mixing.materialise(mixing.mix(clashing), clashing.columns))
    bench = spark.createDataFrame([(1, "never seen"), (2, "text 5")], "item_id long, text string")
    assert {r.doc_id for r in same(decontaminate.drop_documents(clashing, bench))} == set(range(12)) - {5}
    assert len(same(near.keep_first(clashing))) == 12
    w = spark.createDataFrame([(-1, 0.5)], "feature long, weight double")
    assert len(same(toxicity.score(clashing, w, out="__s"))) == 13
    for limit in (200_000, 1):
        found = decontaminate.find(clashing.drop("hit_spans"), bench, max_windows=limit)
        assert len(same(found.drop("hit_spans"))) == 13


def test_shards_are_those_of_a_plain_jump_hash(spark):
    import xxhash

    def jump(key, shards):
        seed, at, nxt, n = 42, 0, 0, 0
        while nxt < shards:
            at, n = nxt, n + 1
            h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed) if key is not None else seed
            h = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), h)
            nxt = int((at + 1) / (((h >> 33) + 1) / float(1 << 31)))
        return at

    keys = [None, 0, -1, 2**62, *range(1, 800)]
    docs = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    for shards in (1, 3, 24, 700):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(docs, shards).collect()}
        assert got == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_toxicity_is_plain_ftrl(spark):
    """Weights and scores against a plain loop over dictionaries of hashed features."""
    import math

    from strataframe.llm.tokens import ALNUM_RULE, LOWER, mix, span_hashes
    import numpy as np

    bits, alpha, beta, l1, l2, epochs = 14, 0.5, 1.0, 0.4, 0.1, 3
    r = random.Random(5)
    vocab = ["vile", "nasty", "Kind", "good", "day", "é1", "tree", "x"]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(0, 25))) + "." * (k % 3), int(k % 4 == 0)) for k in range(60)]

    def word_hash(w):
        data = LOWER[np.frombuffer(w.encode(), np.uint8)]
        return span_hashes(data, np.array([0]), np.array([len(data)]))

    def feats(text):
        w = [word_hash(x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        out = {int(mix(h + toxicity._SALT[0])[0] >> np.uint64(64 - bits)) for h in w}
        for gap in (1, 2):
            out |= {int(mix(a * toxicity._SALT[gap] + b)[0] >> np.uint64(64 - bits)) for a, b in zip(w, w[gap:], strict=False)}
        return sorted(out)

    order = [x.doc_id for x in spark.createDataFrame([(k,) for k, *_ in rows], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()]
    by = {k: (t, y) for k, t, y in rows}
    z, n, bz, bn = {}, {}, 0.0, 0.0
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)
    for _ in range(epochs):
        for k in order:
            f, y = feats(by[k][0]), by[k][1]
            w = {x: weight(x) for x in f}
            b = -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for x in f:
                s = (math.sqrt(n.get(x, 0.0) + g * g) - math.sqrt(n.get(x, 0.0))) / alpha
                z[x] = z.get(x, 0.0) + g - s * w[x]
                n[x] = n.get(x, 0.0) + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b
            bn += g * g
    bias = -bz / ((beta + math.sqrt(bn)) / alpha)
    texts = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(texts, labels, bits=bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    got = {x.feature: x.weight for x in model.collect()}
    expected = {f: weight(f) for f in z if weight(f)} | {-1: bias}
    assert got.keys() == expected.keys() and all(got[f] == pytest.approx(expected[f]) for f in got)
    for x in toxicity.score(texts, model, bits=bits).collect():
        assert x.score == pytest.approx(1 / (1 + math.exp(-(sum(weight(f) for f in feats(x.text)) + bias))), abs=1e-6)


def test_quality_counts_are_those_of_plain_loops(spark):
    r = random.Random(2)
    words = ["a", "bé", "c#", "d", "|", "$%"]
    texts = ["\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 5))) + " " * r.randint(0, 1) for _ in range(r.randint(0, 12))) for _ in range(80)]
    texts += ["a b c a b c", "a b c d\na b c d", "x\n\nx\n", "\n", "", "a a a a", None, " \t\n", "same\r\nsame\r\nsame"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for x in quality.label_lines(docs, quality.train(docs, docs.select("doc_id", F.lit(1).alias("quality")).limit(0))).withColumn("base_failed", quality.base_failed()).collect():
        t = x.text or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        inside = {j for k, g in enumerate(tri) if tri.count(g) > 1 for j in range(k, k + 3)}
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)), t
        assert x.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_crf_fit_follows_the_gradient_of_the_likelihood():
    """The gradient that the fit uses, by brute force over all labellings of short chains."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    first = np.array([0, 3, 4, 8])
    x, y = rng.normal(size=(8, 3)), rng.integers(0, 2, 8)

    def loss(w, tr):
        total = 0.0
        for a, b in zip(first, first[1:], strict=False):
            u = x[a:b] @ w
            score = lambda p: sum(u[k, v] for k, v in enumerate(p)) + sum(tr[s, t] for s, t in zip(p, p[1:], strict=False))  # noqa: E731, B023
            total += score(tuple(y[a:b])) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=b - a)))
        return total / 8

    w, tr = quality.fit(x, y, first, rounds=400, rate=0.5, l2=0.0)
    best = loss(w, tr)
    for _ in range(60):  # a maximum: no step to a neighbour gains
        dw, dt = rng.normal(size=w.shape), rng.normal(size=tr.shape)
        assert loss(w + 1e-2 * dw, tr + 1e-2 * dt) <= best + 2e-3


def test_line_labels_find_the_lines_of_bad_documents_that_are_content():
    import numpy as np

    r = np.random.default_rng(3)
    good, x, first, truth = [], [], [0], []
    for k in range(60):
        kind = np.ones(8, int) if k % 3 else np.r_[np.ones(3, int), np.zeros(5, int)]  # bad documents: content, then junk
        x.append(np.stack([kind + 0.1 * r.normal(size=8), 1 - kind + 0.1 * r.normal(size=8), np.ones(8)], 1))
        good.append(np.full(8, k % 3 > 0))
        truth.append(kind)
        first.append(first[-1] + 8)
    label, w, tr = quality.line_labels(np.concatenate(x), np.concatenate(good), np.zeros(480, bool), np.array(first))
    assert (label == np.concatenate(truth)).mean() > 0.99
    assert (quality.viterbi(np.concatenate(x) @ w, tr, np.array(first)) == np.concatenate(truth)).mean() > 0.99


def test_common_lines_are_notices_and_not_lines_of_copies():
    import numpy as np

    notice, docs = 7, [[10 + k, 7, 30 + k] for k in range(6)] + [[90, 91, 92]] * 9
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    h = np.concatenate(docs).astype(np.uint64)
    assert set(h[quality.common_lines(first, h)].tolist()) == {notice}


def test_license_hits_are_those_of_a_search_without_short_cuts():
    """Every stretch of every template by plain alignment; those within the tolerance are ranked by the same rule."""
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "all-rights-reserved", "BSD-notice"]
    scanner = licenses.Scanner({n: licenses.TEMPLATES[n] for n in names}, 0.2)

    def common(a, b):  # longest common subsequence
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    def brute(text):
        own, found = licenses.words(text), []
        for t in scanner.templates:
            for a in range(len(own)):
                for b in range(a + 1, min(len(own), a + t.reach) + 1):
                    cost = len(t.words) + b - a - 2 * common(t.words, own[a:b])
                    if cost <= t.limit:
                        found.append((t.name, cost, a, b))
        return found

    r = random.Random(9)
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 3)):
            words = licenses.TEMPLATES[r.choice(names)].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(["extra", "licensed", "work", "the"])
            parts.append(prose(r.randint(0, 4), r) + " " + " ".join(words))
        text = "\n".join(parts)
        found, hits = brute(text), scanner.hits(text)
        assert bool(found) == bool(hits)
        spans = [m.span() for m in licenses._WORD.finditer(text.lower())]
        starts = [s for s, _ in spans]
        taken = []
        for _, at, name, _, other, missing in hits:
            a = starts.index(at)
            b = next(b for n, c, x, b in found if (n, c, x) == (name, other + missing, a))
            taken.append((a, b))
        assert all(b <= c for (_, b), (c, _) in zip(taken, taken[1:], strict=False))
        for _, _, a, b in found:  # whatever could be a hit overlaps one that stays
            assert any(a < y and x < b for x, y in taken), (text, found, hits)


def test_license_ranking_decides_between_an_edited_long_text_and_an_exact_short_one(monkeypatch):
    """BSD-3-Clause with three words changed holds BSD-notice word for word: what compression saves decides, and without it the short one stays."""
    text = licenses.TEMPLATES["BSD-3-Clause"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "OUR TEAM").replace("PROFITS", "GAINS")
    assert [h[1] for h in license_hits(text)] == ["BSD-3-Clause"]
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, raw, k, alone: 1)
    assert "BSD-notice" in [h[1] for h in license_hits(text)]


def test_a_text_of_many_notices_takes_time_in_proportion():
    import time

    took = []
    for n in (500, 2000):
        text, began = "\n".join([licenses.TEMPLATES["MIT"], "Licensed under CC BY-NC 4.0.", "All rights reserved."][k % 3] for k in range(n)), time.process_time()
        assert len(license_hits(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_a_folder_that_not_all_machines_share_is_refused():
    from types import SimpleNamespace

    from strataframe.llm.cluster import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)
