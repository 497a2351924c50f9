"""The pipeline stage by stage against brute force, on a small corpus of its own."""

import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for k in range(240):
        words = [f"w{(k * 31 + j * 17) % 401}" for j in range(30 + k % 50)]
        if k % 6 == 0:
            words[5:5] = ["vileword", "nastyword"]
        rows.append((k, " ".join(words), "en", ["a", "b", "c", None][k % 4], 0))
    item = " ".join(f"q{j}" for j in range(20))
    rows += [(300, rows[1][1], "en", "a", 0), (301, rows[2][1] + " tail", "en", "b", 0), (302, "x y " + item + " z", "en", "a", 0), (303, "", "en", "a", 0), (304, None, None, None, None), (1, rows[1][1], "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(240)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    seen, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, d).write.parquet(f"{d}/stage{k}")
        seen = spark.read.parquet(f"{d}/stage{k}")
        out.append((seen.columns, seen.collect()))
    return rows, out, d


def test_toxic_documents_go_and_clean_ones_stay(stages):
    rows, out, _ = stages
    assert out[0][0] == COLUMNS
    assert sorted(str(r.doc_id) for r in out[0][1]) == sorted(str(d) for d, t, *_ in rows if "vileword" not in (t or ""))


def test_one_row_of_each_group_stays(stages):
    _, out, _ = stages
    before = sorted(((r.doc_id, r.text) for r in out[0][1]), key=str)
    kept = sorted(((r.doc_id, r.text) for r in out[1][1]), key=str)
    assert out[1][0] == COLUMNS
    sets = [shingles(t) for _, t in before]
    parent = list(range(len(before)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(before)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    least = {}
    for k, row in enumerate(before):
        if sets[k]:
            least[root(k)] = min(least.get(root(k), row), row)
    assert kept == sorted([*least.values(), *(row for row, s in zip(before, sets, strict=True) if not s)], key=str)


def test_contaminated_documents_go(stages):
    _, out, _ = stages
    assert out[2][0] == COLUMNS
    assert {r.doc_id for r in out[1][1]} - {r.doc_id for r in out[2][1]} == {302}


def test_mix_meets_its_targets(stages):
    _, out, _ = stages
    assert out[3][0] == COLUMNS
    count = lambda rows: {s: sum(len(WORD.findall(r.text or "")) for r in rows if r.source == s) for s in {r.source for r in rows}}
    size, got = count(out[2][1]), count(out[3][1])
    total, level, weight = sum(size.values()), 0.0, {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    for _ in range(10):
        held = sum(3 * size[s] for s in size if weight[s] * level > 3 * size[s])
        level = (total - held) / sum(weight[s] for s in size if weight[s] * level <= 3 * size[s])
    for s in size:
        assert abs(got[s] - min(weight[s] * level, 3 * size[s])) <= 1


def test_shards_hold_every_row(stages):
    _, out, _ = stages
    assert len(out[4][1]) == len(out[3][1])
    for k in range(24):
        assert sorted(r.slot for r in out[4][1] if r.shard == k) == list(range(sum(r.shard == k for r in out[4][1])))
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in out[4][1])


def test_run_is_the_stages_in_order(spark, stages):
    _, out, d = stages
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, out[4][1]))
