import pytest

from quillmark.functions import text as T
from quillmark.operators import search as S


@pytest.fixture
def blocks(spark):
    rows = [("a#1", "a", [1.0, 0.0]), ("a#2", "a", [0.8, 0.6]), ("b#1", "b", [0.0, 1.0]), ("c#1", "c", [])]
    return spark.createDataFrame(rows, "entity_key string, source_path string, vec array<float>")


def test_nearest_to(blocks):
    assert [r.entity_key for r in S.nearest_to(blocks, "a#1", 5).collect()] == ["a#2", "b#1"]
    for key in ("c#1", "none"):
        with pytest.raises(ValueError):
            S.nearest_to(blocks, key)


def test_lookup(blocks):
    embed = lambda texts, role: [[1.0, 0.0] if t and role == "query" else None for t in texts]
    got = S.lookup("x", embed, [blocks, blocks.where("source_path = 'a'")], 2).collect()
    assert [(r.entity_key, round(r.score, 6)) for r in got] == [("a#1", 1.0), ("a#2", 0.8)]
    with pytest.raises(ValueError):
        S.lookup("", embed, [blocks])


def test_tiles_cover_all_pairs(spark, blocks):
    queries = blocks.where("size(vec) > 0").selectExpr("entity_key as query_id", "vec")
    want = sorted((r.query_id, r.entity_key, r.score) for r in S.nearest_many(queries, blocks, 3, pivots=1).collect())
    assert len(want) == 9
    for tiles in (None, 2, 5):
        assert sorted((r.query_id, r.entity_key, r.score) for r in S.nearest_many(queries, blocks, 3, pivots=tiles).collect()) == want


def test_exact_tokens_fall_back(spark):
    import pyspark.sql.functions as F

    def broken():
        raise OSError("no vocabulary")

    df = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    for build, want in ((lambda: lambda t: len(t.split()), [3, None, 0]), (broken, [4, None, 0])):
        got = df.select(T.count_tokens(F.col("text"), F.lit("tiktoken"), T.exact_counter(build)).alias("n")).collect()
        assert [r.n for r in got] == want


def _points(spark, n=600, dims=8, seed=2):
    import random

    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = [(f"f{i % 3}/n{i // 4}#b{i}", f"f{i % 3}/n{i // 4}", "source" if i % 4 == 0 else "block", [float(x + rnd.gauss(0, 0.15)) for x in centres[i % 12]]) for i in range(n)]
    rows += [("z#0", "z", "block", [0.0] * dims), ("short#0", "s", "block", [1.0]), ("null#0", "u", "block", None), ("dup#1", "d", "block", rows[0][3]), ("dup#2", "d", "block", rows[0][3])]
    return spark.createDataFrame(rows, "entity_key string, source_path string, entity_type string, vec array<float>"), rows


def _brute(rows, vec, k, own=None, folder=None, kind=None, least=None):
    import numpy as np

    q, out = np.asarray(vec, np.float32).astype(float), []
    for key, path, type_, v in rows:
        if v is None or len(v) != len(q):
            continue
        x = np.asarray(v, np.float32).astype(float)
        if not (x * x).sum() or path == own or (folder and not path.startswith(folder + "/")) or (kind and type_ != kind):
            continue
        s = round(float(q @ x / np.sqrt((q * q).sum()) / np.sqrt((x * x).sum())), 6)
        if least is None or s >= least:
            out.append((-s, key))
    return [(key, -s) for s, key in sorted(out)[:k]]


def test_pruned_neighbours_equal_brute_force(spark):
    from quillmark.operators import neighbours as N

    blocks, rows = _points(spark)
    picked = [r for i, r in enumerate(rows[:600]) if i % 7 == 0]
    settings = [(f"q{i}", r[1], r[3], 1 + i % 9, [None, "f1", "none"][i % 3], [None, "source", "block"][i % 4 % 3], [None, 0.5, 0.99][i % 5 % 3]) for i, r in enumerate(picked)]
    queries = spark.createDataFrame(settings, "query_id string, own string, vec array<float>, k int, folder string, kind string, least double")
    found = {}
    for r in N.nearest_many(queries, blocks, own="own", pivots=20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.entity_key, round(r.score, 6)))
    for q, own, vec, k, folder, kind, least in settings:
        want = _brute(rows, vec, k, own, folder, kind, least)
        assert [(key, s) for _, key, s in sorted(found.get(q, []))] == want, q
    plain = queries.select("query_id", "vec")
    assert N.share_compared(plain, blocks, 3, pivots=20).first().share < 0.5  # clustered vectors: most tiles aren't formed
    assert N.nearest_many(plain, blocks.limit(0), 3).count() == 0 and N.nearest_many(plain.limit(0), blocks, 3).count() == 0


def test_lookup_many_by_scope(spark):
    from quillmark.operators import jobs as J

    blocks, rows = _points(spark, 60, 2)
    found = J.Embedder(lambda: lambda texts, role: [[1.0, float(len(t))] if t != "bad" and role == "query" else None for t in texts], 2)
    texts = [("a", "x", "all"), ("b", "xyz", "notes"), ("c", "xy", "blocks"), ("d", "", "all"), ("e", "bad", "all")]
    hits, failed = S.lookup_many(spark.createDataFrame(texts, "query_id string, text string, scope string"), found, blocks, 4)
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.entity_key))
    for q, text, which in texts[:3]:
        want = _brute(rows, [1.0, len(text)], 4, kind={"notes": "source", "blocks": "block"}.get(which))
        assert [k for _, k in sorted(got[q])] == [k for k, _ in want]
    assert sorted(r.query_id for r in failed.collect()) == ["d", "e"]


def test_neighbours_by_blocks_and_slices(spark, monkeypatch):
    from quillmark.operators import neighbours as N

    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    monkeypatch.setattr(N, "SAMPLE", 32)
    blocks, rows = _points(spark, 400, 4, 5)
    more = [(f"same/{i:03}#b", f"same/{i % 2}", "block", [1.0, 2.0, 3.0, 4.0]) for i in range(150)] + [("inf#0", "inf", "block", [float("inf"), 0.0, 0.0, 1.0])]
    blocks = blocks.unionByName(spark.createDataFrame(more, blocks.schema))
    assert N.shape(151, 500, 4, 5, 4)[0] > 2  # several blocks
    asked = [r for r in rows[:400:3]] + more[:17]
    queries = spark.createDataFrame([(r[0], r[1], r[3]) for r in asked], "query_id string, own string, vec array<float>")
    found = {}
    for r in N.nearest_many(queries, blocks, 5, own="own").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.entity_key, round(r.score, 6)))
    for key, own, _, vec in asked:  # of 150 equal ones the first keys, of other notes; a vector without a direction is never found
        assert [x[1:] for x in sorted(found[key])] == _brute(rows + more[:-1], vec, 5, own), key


def test_copies_stay_in_proportion():
    from quillmark.operators import neighbours as N

    for queries, width, k in ((1.0, 64, 10), (0.2, 64, 15), (0.01, 12, 40)):
        copied = []
        for n in (100_000, 600_000):
            blocks, slices = N.shape(int(n * queries), n, width, k, 12)
            assert n * queries / blocks <= N.BLOCK_ROWS and blocks * slices >= 24
            copied.append(n * (4 * width + 80) * blocks + int(n * queries) * (4 * width + 100 + 60 * k) * slices)
        assert copied[1] <= 6.1 * copied[0]
