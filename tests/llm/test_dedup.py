"""Near duplicates, substrings and suffixes against brute force, with every edge case in one table."""

import hashlib
import random
import re

import numpy as np
import pytest

from strataframe.llm import near, rtree, spread, substrings, suffixes
from strataframe.llm.tokens import SPACE_RULE, chunks, ngrams, split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rk int, bucket string, node long"


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, line = make(60), make(9)
    rows = [(k, make(r.randint(1, 120))) for k in range(40)]
    rows += [(40 + k, make(10) + "\n" + shared + "\t" + make(r.randint(0, 30))) for k in range(6)]
    rows += [(50 + k, line + " " + make(30)) for k in range(5)]
    base = make(150).split()
    for k in range(12):
        own = list(base)
        for _ in range(k % 4):
            own[r.randrange(len(own))] = r.choice(vocab)
        rows.append((60 + k, " ".join(own)))
    rows += [(80, rows[3][1]), (81, rows[3][1]), (82, "Oneaea " * 300), (83, "a" * 1500), (84, make(3000)), (85, ""), (86, None), (87, "  \n\t "), (88, "one two"), (89, "ONE TWO"), (90, "x")]
    rows += [(None, make(80)), (None, rows[20][1]), (20, rows[20][1]), (85, "")]
    return [(d, t, 1, "b", 2) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_components_match_brute_force(docs):
    rows = [(d if d is not None else spread.NO_ID, shingles(t)) for d, t, *_ in corpus()]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), d), d)
    expected = sorted((d, len(s), least[root(k)]) for k, (d, s) in enumerate(rows))
    got = sorted((r.id, r.n_shingles, r.component_id) for r in near.components(docs).collect())
    assert got == expected


def test_keep_first_keeps_one_row_of_each_component(docs):
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 80 not in ids and 81 not in ids and 3 in ids and ids.count(20) == 1
    assert ids.count(85) == 2 and {86, 87} <= set(ids)  # without words: nothing to compare
    assert 88 in ids and 89 not in ids


def test_rtree_finds_every_pair_above_the_bound():
    r = np.random.default_rng(3)
    for n, g in ((5, 16), (300, 16), (400, 32)):
        points = r.poisson(3, (n, g)).astype(np.uint16)
        points[n // 2 :] = points[: n - n // 2]  # copies
        sizes = points.sum(1).astype(np.int64)
        tree = rtree.RTree(points, sizes)
        i, j, b = rtree.join(tree, tree)
        got = {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
        assert len(got) == len(i)
        low = np.minimum(points[:, None, :], points[None, :, :]).sum(2)
        ok = (low >= rtree.need(sizes[:, None], sizes[None, :])) & np.triu(np.ones((n, n), bool), 1)
        assert got >= {(x, y) for x, y in zip(*np.nonzero(ok), strict=True)}


def test_cells_beyond_the_block_size_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near, "MAX_CELL", 4)
    docs = spark.createDataFrame([(k, " ".join([f"a{j}" for j in range(40)] + [f"z{k}"])) for k in range(30)], "doc_id long, text string")
    assert {r.component_id for r in near.components(docs).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_the_last_round_of_large_cells_brings_together_every_pair_that_can_link(spark, monkeypatch, seed):
    monkeypatch.setattr(near, "MAX_CELL", 4)
    r = random.Random(seed)
    rows = [(c, 100 * c + k, r.choice([5, 20, 25, 26, 31, 32, 40, 100, 125, 156])) for c in range(3) for k in range(40)]
    label = {n: min(n % 100, 7) if r.random() < 0.7 else n for _, n, _ in rows}
    large = spark.createDataFrame(rows, "cell long, node long, n long")
    labels = spark.createDataFrame(list(label.items()), "node long, component long")
    cells = {}
    for x in near._dealt(large, "all", labels).collect():
        cells.setdefault(x.cell, set()).add(x.node)
    together = {(a, b) for own in cells.values() for a in own for b in own}
    for c, a, n in rows:
        for d, b, m in rows:
            if c == d and a < b and label[a] != label[b] and 4 * max(n, m) <= 5 * min(n, m):
                assert (a, b) in together


def two_shingle_cells(spark, sets, buckets=7):
    """The last round's cells of sets that all have the first hash of the first one among their first; components are the sets themselves."""
    from strataframe.llm.cluster import Scratch

    levels = np.zeros(1 << near.SKETCH_BITS, np.uint8)
    cell = int(near._large_name(sets[0][:1], sets[0][:1] % np.uint64(buckets))[0])
    large = spark.createDataFrame([(cell, k, len(s)) for k, s in enumerate(sets)], "cell long, node long, n long")
    hashes = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "node long, hashes binary")
    cells = {}
    for x in near._last(large, hashes, None, levels, buckets, Scratch(spark, "test")).collect():
        cells.setdefault(x.cell, set()).add(x.node)
    return cells


def test_sets_that_share_one_shingle_meet_by_two(spark, monkeypatch):
    monkeypatch.setattr(near, "MAX_CELL", 40)
    r = np.random.default_rng(5)
    hashes = lambda n: np.sort(np.append(r.integers(2**32, 2**64, n, dtype=np.uint64), np.uint64(12345)))
    work = []
    for n in (300, 1200):  # nothing else is shared: no pair is tried
        cells = two_shingle_cells(spark, [hashes(30) for _ in range(n)])
        work.append(sum(len(c) ** 2 for c in cells.values()))
    assert work[1] <= 4 * work[0] + 100 and work[1] < 1200
    base = hashes(40)
    sets = [hashes(40) for _ in range(50)] + [np.sort(np.append(np.delete(base, r.integers(1, 41, k)), r.integers(2**32, 2**64, k, dtype=np.uint64))) for k in range(9)]
    together = {(a, b) for c in two_shingle_cells(spark, sets).values() for a in c for b in c}
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert len(linked) > 5 and all(x in together for x in linked)


@pytest.mark.parametrize("seed", range(2))
def test_components_with_small_cells_at_most(spark, monkeypatch, seed):
    """Nearly every prefix shingle makes a large cell, and pairs of shingles do too."""
    monkeypatch.setattr(near, "MAX_CELL", 3)
    r = random.Random(seed)
    phrases = [" ".join(f"p{k}x{j}" for j in range(9)) for k in range(5)]
    rows = []
    for k in range(90):
        parts = r.sample(phrases, r.choice([1, 2, 3])) + [" ".join(f"u{r.randrange(12)}" for _ in range(r.choice([0, 1, 3])))]
        rows.append((k, " ".join(parts)))
    sets = {d: shingles(t) for d, t in rows}
    least = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    got = {x.id: x.component_id for x in near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == least


def test_blocks_between_jumps_in_size_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near, "MAX_CELL", 4)
    rows, families = [], []
    for f in range(12):  # in some, all prefix shingles of the four small sets are those of the three large ones
        base, more = [f"a{f}x{j}" for j in range(40)], [f"b{f}x{j}" for j in range(12)]
        for k in range(7):
            rows.append((10 * f + k, " ".join(base + (more if k > 3 else []) + [f"z{f}x{k}"])))
        families += [(10 * f, 4), (10 * f + 4, 3)]
    got = [r.component_id for r in near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((c, got.count(c)) for c in set(got)) == families


def test_very_long_texts_link(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(150_000)]
    near_copy = [w if r.random() > 0.015 else "changed" for w in words]
    far = [w if r.random() > 0.1 else "other" for w in words]
    rows = [(3, " ".join(words)), (2, " ".join(near_copy)), (9, " ".join(far)), (1, "a short text of its own")]
    sets = {d: shingles(t) for d, t in rows}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert link(3, 2) and not link(3, 9) and not link(2, 9)
    got = {x.id: (x.n_shingles, x.component_id) for x in near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(sets[1]), 1), 2: (len(sets[2]), 2), 3: (len(sets[3]), 2), 9: (len(sets[9]), 9)}


@pytest.mark.parametrize("most", [2, 8])
def test_large_families_of_near_copies(spark, monkeypatch, most):
    """Many copies of a short text among copies of a long one: one shingle is in both, and one document may join both families."""
    monkeypatch.setattr(near, "MAX_CELL", most)
    r = random.Random(most)
    short, long = [f"a{j}" for j in range(13)], [f"b{j}" for j in range(60)]
    rows = [(k, " ".join([*short, f"own{k}"])) for k in range(60)] + [(1000 + k, " ".join([*short, *long[: r.randint(50, 60)], f"more{k}"])) for k in range(80)]
    rows += [(5000 + k, " ".join(f"z{r.randrange(40)}" for _ in range(r.randint(5, 9)))) for k in range(30)]
    got = {x.id: x.component_id for x in near.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets, parent = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert got == {d: root(d) for d in ids}


def brute_words(rows, window):
    docs = [(d if d is not None else spread.NO_ID, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 4, 2])
def test_substrings_match_brute_force(docs, window):
    got = sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(docs, window).collect())
    assert got == brute_words([(d, t) for d, t, *_ in corpus()], window)


def test_difference_covers_cover():
    for period, offsets in substrings.COVERS.items():
        assert {(a - b) % period for a in offsets for b in offsets} == set(range(period))


def brute_bytes(rows, length):
    docs = [(d if d is not None else spread.NO_ID, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, b in docs:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [400, 64, 100])
def test_suffixes_match_brute_force(docs, length):
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(docs, length).collect())
    assert got == brute_bytes([(d, t) for d, t, *_ in corpus()], length)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near.components(none).collect() == [] and near.keep_first(none).collect() == []
    assert substrings.remove(none).collect() == [] and suffixes.remove(none).collect() == []


def test_words_split_as_the_regular_expression_does():
    texts = ["", " a  b\x0bc\x0cd\n", "é ü", "\tx", "y\r\nz " * 5, "a\x00b \x1fq"]
    import pyarrow as pa

    for limit in (1, 1 << 20):
        got = []
        for a, b, data, off in chunks(pa.array(texts), limit):
            w = split_words(data, off, SPACE_RULE, lower=False)
            for r in range(b - a):
                got.append([w.text(k).decode() for k in range(w.first[r], w.first[r + 1])])
            at, h = ngrams(w, 2)
            assert len(at) == sum(max(0, c - 1) for c in w.counts)
        assert got == [WORD.findall(t) for t in texts]


def test_suffixes_decide_by_whole_fingerprints(spark, monkeypatch):
    own = suffixes.span_hashes
    length = suffixes.LENGTH

    def alike(data, start, end, sums=None, family=0):  # strings of the full length differ in 16 bits of one family only
        h = own(data, start, end, sums, family)
        return np.where(end - start == length, h & np.uint64(0xFFFF if family == 1 else 0), h)

    monkeypatch.setattr(suffixes, "span_hashes", alike)
    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    shared = make(390)  # too short to be removed, long enough for its strings to be compared
    docs = spark.createDataFrame([(k, make(300) + shared + make(300)) for k in range(2)], "doc_id long, text string")
    assert [x.n_removed for x in suffixes.remove(docs).collect()] == [0, 0]


def hot_corpus():
    """A third and more of all rows share a passage, many are copies; names are drawn so that ids do not follow the order of rows."""
    r = random.Random(11)
    make = lambda n: " ".join(f"v{r.randrange(900)}" for _ in range(n))
    passage, copy = make(70), make(90)
    rows = [make(r.randint(5, 20)) + " " + passage + " " + make(r.randint(5, 20)) for _ in range(260)] + [copy] * 200 + [make(40) for _ in range(60)]
    return [((k * 7919) % 1009, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 30])
def test_frequent_fingerprints_and_many_buckets(spark, monkeypatch, bucket_bytes):
    rows = hot_corpus()
    monkeypatch.setattr(spread, "BUCKET_BYTES", bucket_bytes)  # 30: more buckets than a task packs for
    monkeypatch.setattr(spread, "FILES", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert sum(len(t) for _, t in rows) // 30 > spread.COARSE
    got = sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(docs).collect())
    assert got == brute_words(rows, 13)
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(docs).collect())
    assert got == brute_bytes(rows, 400)


def test_frequent_fingerprints_are_held_back():
    p = spread.Packer(4, split=True)
    fp = np.concatenate([np.full(200, 7), np.arange(100, 150)]).astype(np.uint64)
    p.add((fp % np.uint64(4)).astype(np.int64), fp=fp, rk=np.arange(250), pos=np.zeros(250, np.uint32))
    rows = spread.blob_table(p)
    kinds = rows.column("kind").to_pylist()
    held = spread.items(rows.column("payload").filter(rows.column("kind").to_numpy() == spread.HELD))
    told = spread.items(rows.column("payload").filter(rows.column("kind").to_numpy() == spread.SUMMARIES))
    assert kinds.count(spread.HELD) == 1 and len(held["rk"]) == 200 and told["count"].tolist() == [200] and (told["lo"][0], told["hi"][0]) == (0, 199)
