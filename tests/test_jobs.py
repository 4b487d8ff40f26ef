import pytest

from quillmark.operators import jobs as J
from quillmark.operators import store as ST


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise J.Transient("429", 0.5 if len(calls) == 1 else None)
        return ["ok"]

    assert J.with_retry(call, sleep=waits.append) == ["ok"] and waits == [0.5, 4.0]
    with pytest.raises(J.Transient):
        J.with_retry(lambda: (_ for _ in ()).throw(J.Transient()), sleep=lambda s: None)
    with pytest.raises(J.Fatal):
        J.with_retry(lambda: (_ for _ in ()).throw(J.Fatal()), sleep=lambda s: None)


def test_registry():
    J.register("h", J.hashing_embedder(8))
    J.register("h", J.Embedder(J.hashing_embedder(4).build, 4, {"m": 6}))
    assert J.embedder("h", "m")[1] == 6 and J.embedder("h", None, 5)[1] == 5 and J.embedder("h")[1] == 4
    with pytest.raises(KeyError):
        J.embedder("none")
    with pytest.raises(KeyError):
        J.embedder("h", "other")


def test_embed_partial(spark):
    def build():
        return lambda texts, role: [None if "bad" in t else [1.0, 2.0] for t in texts]

    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", ""), ("d", None)], "entity_key string, text string").coalesce(1)
    got = {r.entity_key: r.status for r in J.embed(df, J.Embedder(build, 2)).collect()}
    assert got == {"a": "ok", "b": "failed", "c": "skipped", "d": "skipped"}


def test_token_batches(spark):
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate([5, 5, 1, 20, 0, 9])], "shard int, pos int, tokens bigint")
    assert [r.batch for r in sorted(J.token_batches(rows, 10).collect(), key=lambda r: r.pos)] == [0, 0, 1, 2, 3, 3]


def test_refresh_and_versions(spark, tmp_path):
    table = ST.VersionedTable(spark, str(tmp_path / "emb"))
    blocks = spark.createDataFrame([("a", "one two", "h1", 7, True), ("b", "three", "h2", 5, True), ("c", "", "h3", 0, True)], "entity_key string, text string, read_hash string, length bigint, should_embed boolean")
    assert J.refresh(spark, blocks, table, J.hashing_embedder(), "m") == 1  # the empty text stays
    assert {r.entity_key for r in table.read().collect()} == {"a", "b"}
    before = table.read().count()
    with pytest.raises(Exception):
        table.write(spark.range(1).selectExpr("raise_error('no') as x"))
    assert table.read().count() == before


def test_refresh_in_parts(spark, tmp_path):
    table = ST.VersionedTable(spark, str(tmp_path / "emb"))
    blocks = spark.createDataFrame([(f"k{i}", f"text {i}", f"h{i}", 6, True) for i in range(9)], "entity_key string, text string, read_hash string, length bigint, should_embed boolean")
    writes = []
    plain = table.write
    table.write = lambda df: (writes.append(1), plain(df))
    assert J.refresh(spark, blocks, table, J.hashing_embedder(), "m", save_rows=3) == 0
    assert len(writes) == 3 and table.read().count() == 9


def test_upsert_repeated_keys(spark):
    stored = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    batch = spark.createDataFrame([("a", 2, 5), ("a", 3, 4), ("c", 4, 1), ("c", 4, 1)], "k string, v int, at int")
    assert sorted(map(tuple, ST.upsert(stored, batch, ["k"], "at").collect())) == [("a", 2, 5), ("b", 1, 1), ("c", 4, 1)]
    assert ST.upsert(stored, batch, ["k"]).count() == 3


def test_stale(spark):
    import pyspark.sql.functions as F

    rows = [("new", "old", 510, 500, 200, False), ("new", "old", 800, 500, 200, True), ("new", "old", 510, None, 200, True), ("h", "h", 1, 1, 0, False), (None, "h", 1, 1, 0, True), ("h", None, 1, 1, 0, True)]
    df = spark.createDataFrame(rows, "r string, e string, s bigint, es bigint, c int, want boolean")
    got = df.select("want", J.is_unembedded(F.col("r"), F.col("e"), F.col("s"), F.col("es"), F.lit(None).cast("int"), F.lit(4), F.col("c")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    # (hash moved, size moved by, dims, loaded) -> stale: a wrong length counts for moved content only where vectors are loaded
    cases = [(True, 10, 3, False, False), (True, 10, 3, True, True), (False, 0, 3, False, True), (False, 0, 0, False, False), (True, 500, 4, True, True)]
    for moved, by, dims, loaded, want in cases:
        stale = J.is_unembedded(F.lit("new" if moved else "old"), F.lit("old"), F.lit(500 + by), F.lit(500), F.lit(dims), F.lit(4), F.lit(200), loaded)
        assert spark.range(1).select(stale).first()[0] is want, (moved, by, dims, loaded)


def test_blobs(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0\0\x80?")), (2, bytearray(b"abc")), (3, None), (4, bytearray())], "k int, vec binary")
    got = {r.k: r.vec for r in ST.vectors_from_blobs(df).collect()}
    assert got == {1: [1.0], 2: None, 3: None, 4: None}


def test_answers_are_identified():
    keys = ["a", "b"]
    assert J.by_key(keys, [1, 2]) == {"a": 1, "b": 2}
    assert J.by_key(keys, [{"vec": 2, "key": "b"}, {"vec": 1, "index": 0}]) == {"a": 1, "b": 2}
    assert J.by_key(keys, [{"vec": 2, "key": "b", "index": 1}, {"vec": 1, "key": "a", "index": 0}]) == {"a": 1, "b": 2}
    wrong = [[1], [{"vec": 1}, {"vec": 2, "key": "b"}], [{"vec": 1, "key": "c"}, {"vec": 2, "key": "b"}], [{"vec": 1, "key": "a", "index": 1}, {"vec": 2, "key": "b"}], [{"vec": 1, "key": "a"}, {"vec": 2, "key": "a"}], [{"vec": 1, "index": 5}, {"vec": 2, "key": "b"}]]
    for answer in wrong:
        with pytest.raises(J.Fatal):
            J.by_key(keys, answer)


def test_batch_out_of_retries_ends_the_run(spark, tmp_path):
    def build():
        return lambda texts, role: [None if any("bad" in t for t in texts) else [1.0, 2.0] for _ in texts]

    rows = [(f"k{i}", "bad" if i == 5 else "good", f"h{i}", 4, True) for i in range(6)]
    blocks = spark.createDataFrame(rows, "entity_key string, text string, read_hash string, length bigint, should_embed boolean")
    parts = lambda key: blocks.where(f"entity_key = '{key}'").selectExpr("pmod(xxhash64(entity_key), 6) as p").first().p
    table = ST.VersionedTable(spark, str(tmp_path / "emb"))
    kept = {k for k in (f"k{i}" for i in range(5)) if parts(k) < parts("k5")}
    found = J.Embedder(build, 2)
    waits = J.with_retry.__defaults__
    J.with_retry.__defaults__ = (waits[0], lambda s: None)
    try:
        with pytest.raises(Exception, match="after 3 retries"):
            J.refresh(spark, blocks, table, found, "m", save_rows=1)
    finally:
        J.with_retry.__defaults__ = waits
    assert {r.entity_key for r in (table.read().collect() if kept else [])} >= kept
    got = {r.entity_key: r.status for r in J.embed(blocks.coalesce(1), found, batch=1, retries=0, halt=False).collect()}
    assert got == {**{f"k{i}": "ok" for i in range(5)}, "k5": "failed"}


def test_full_stamps_and_minor_changes(spark, tmp_path):
    schema = "entity_key string, text string, read_hash string, length bigint, mtime bigint, should_embed boolean"
    table = ST.VersionedTable(spark, str(tmp_path / "emb"))
    first = spark.createDataFrame([("a", "one two", "h1", 7, 5, True), ("b", "three", None, 5, 6, True)], schema)
    assert J.refresh(spark, first.where("entity_key = 'a'"), table, J.hashing_embedder(), "m", adapter="local") == 0
    row = table.read().first()
    assert (row.embed_size, row.embed_mtime, row.adapter, row.dims) == (7, 5, "local", 16)
    assert J.stamp(J.embed(first, J.hashing_embedder()), first, "m", 1).where("entity_key = 'b'").first().embed_size is None
    moved = spark.createDataFrame([("a", "one too", "h2", 9, 7, True)], schema)
    assert J.refresh(spark, moved, table, J.hashing_embedder(), "m", min_change=5) == 0 and table.read().first().embed_hash == "h1"
    assert J.refresh(spark, moved, table, J.hashing_embedder(), "m") == 0 and table.read().first().embed_hash == "h2"
    assert J.refresh(spark, moved, table, J.hashing_embedder(8), "m") == 0 and table.read().first().dims == 8


def test_token_batches_of_a_long_shard(spark):
    import random

    rnd = random.Random(3)
    sizes = [(s, i, rnd.choice([None, 0, 1, 3, 30, 200])) for s in (None, "x", "y") for i in range(3000)]
    got = {(r.shard, r.pos): r.batch for r in J.token_batches(spark.createDataFrame(sizes, "shard string, pos int, tokens bigint"), 100).collect()}
    for s in (None, "x", "y"):
        held, batch = 0, 0
        for shard, pos, n in sizes:
            if shard == s:
                n = max(n or 0, 1)
                if held and held + n > 100:
                    held, batch = 0, batch + 1
                held += n
                assert got[(s, pos)] == batch


def _bucket_blocks(spark, hashes: dict[str, str]):
    rows = [(k, f"text of {k}", h, 9, True) for k, h in hashes.items()] + [(None, "no key", "h", 6, True), ("empty", " ", "h", 1, True), ("small", "left out", "h", 8, False)]
    return spark.createDataFrame(rows, "entity_key string, text string, read_hash string, length bigint, should_embed boolean")


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_refresh_buckets_writes_what_is_touched(spark, tmp_path):
    path = tmp_path / "stamps"
    keys = [f"k{i}" for i in range(12)]
    found = J.hashing_embedder()
    first = J.refresh_buckets(spark, _bucket_blocks(spark, dict.fromkeys(keys, "a")), str(path), found, "m", updated_at=1, buckets=8, at_once=3)
    assert {(r.entity_key, r.embed_hash, r.updated_at) for r in first.collect()} == {(k, "a", 1) for k in keys}
    before = _files(path)
    blocks = _bucket_blocks(spark, dict.fromkeys(keys, "a") | {"k3": "b"})
    of = {r.entity_key: r.b for r in blocks.select("entity_key", J.bucket_of(blocks.entity_key, 8).alias("b")).collect()}
    second = J.refresh_buckets(spark, blocks, str(path), found, "m", updated_at=2, buckets=8, at_once=3)
    assert {(r.entity_key, r.embed_hash, r.updated_at) for r in second.collect()} == {(k, "ab"[k == "k3"], 1 + (k == "k3")) for k in keys}
    touched = {f"bucket={of['k3']}/", f"bucket={of['empty']}/"}  # what has no text stays queued
    assert {p for p, at in before.items() if _files(path).get(p) != at} == {p for p in before if any(t in p for t in touched)}
    other = J.refresh_buckets(spark, blocks, str(path), found, "m2", updated_at=3, buckets=8)  # another model stands beside the first
    assert sorted(other.groupBy("model_key").count().collect()) == [("m", 12), ("m2", 12)]


def test_refresh_buckets_keeps_what_was_saved(spark, tmp_path):
    path = str(tmp_path / "stamps")
    keys = [f"k{i}" for i in range(12)]
    blocks = _bucket_blocks(spark, dict.fromkeys(keys, "a"))
    of = {r.entity_key: r.b for r in blocks.select("entity_key", J.bucket_of(blocks.entity_key, 8).alias("b")).collect()}
    last = max(of[k] for k in keys)
    bad = {f"text of {k}" for k in keys if of[k] == last}

    def build():
        def embed(texts, role):
            if bad & set(texts):
                raise J.Fatal("wrong key")
            return [[1.0, 2.0] for _ in texts]

        return embed

    with pytest.raises(Exception, match="wrong key"):
        J.refresh_buckets(spark, blocks, path, J.Embedder(build, 2), "m", updated_at=1, buckets=8, at_once=1)
    stored = {r.entity_key for r in spark.read.parquet(path).collect()}
    assert stored == {k for k in keys if of[k] != last}
    done = J.refresh_buckets(spark, blocks, path, J.Embedder(lambda: lambda texts, role: [[1.0, 2.0] for _ in texts], 2), "m", updated_at=2, buckets=8)
    assert {(r.entity_key, r.updated_at) for r in done.collect()} == {(k, 1 if k in stored else 2) for k in keys}
    assert J.refresh_buckets(spark, blocks.limit(0), str(tmp_path / "none"), J.hashing_embedder(), "m").count() == 0


def test_texts_come_in_bounded_batches(spark):
    from quillmark.functions import text as T
    from quillmark.operators import jobs as J

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(400).selectExpr("cast(id as string) entity_key", "repeat(concat('word', id, ' '), 10000) text").coalesce(1)
    for use in (lambda: J.embed(df, J.hashing_embedder()), lambda: T.exact_counter(lambda: len)):
        spark.conf.unset(setting)
        use()
        sizes = df.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
        assert len(sizes) > 3 and max(r.n for r in sizes) < 2 * T.BATCH_BYTES


def test_refresh_buckets_reads_blocks_for_the_queue_only(spark, tmp_path):
    """however many saves a refresh makes, it derives each text at most twice and embeds it once, and its queue goes with it."""
    import pyspark.sql.functions as F

    read, called = tmp_path / "read", tmp_path / "called"

    def note(file, line):
        with open(file, "a") as f:
            f.write(line + "\n")

    @F.udf("string")
    def text(key):
        note(read, key)
        return f"text of {key}"

    def build(bad=None):
        def embed(texts, role):
            for t in texts:
                note(called, t)
            if bad in texts:
                raise J.Fatal("wrong key")
            return [[1.0, 2.0] for _ in texts]

        return embed

    keys = [f"k{i}" for i in range(24)]
    blocks = _bucket_blocks(spark, dict.fromkeys(keys, "a")).where("should_embed and text <> ' ' and entity_key is not null").withColumn("text", text.asNondeterministic()("entity_key"))
    folder = tmp_path / "tables"
    run = lambda found, at, **more: J.refresh_buckets(spark, blocks, str(folder / "stamps"), found, "m", updated_at=at, buckets=8, at_once=1, **more)
    there = lambda: [p.name for p in folder.iterdir() if not p.name.startswith(".")]
    good = J.Embedder(build, 2)
    part = {r.entity_key for r in run(good, 1, saves=2).collect()}
    assert 0 < len(part) < len(keys) and sorted(called.read_text().split("\n")[:-1]) == sorted(f"text of {k}" for k in part)
    read.unlink(), called.unlink()
    assert {r.entity_key for r in run(good, 2).collect()} == set(keys)
    assert sorted(called.read_text().split("\n")[:-1]) == sorted(f"text of {k}" for k in set(keys) - part)
    times = read.read_text().split("\n")[:-1]
    assert max(times.count(k) for k in keys) <= 2
    blocks = blocks.withColumn("read_hash", F.lit("b"))
    with pytest.raises(Exception, match="wrong key"):
        run(J.Embedder(lambda: build("text of k0"), 2), 3)
    assert there() == ["stamps"]


def test_refresh_buckets_stamps_what_was_read(spark, tmp_path):
    """Sizes and times go with a read hash only; without one the hash is the text's own."""
    rows = [("a", "one two", "h1", 7, 5, True), ("b", " three ", None, 7, 6, True), ("c", "four", "", 4, 7, True)]
    blocks = spark.createDataFrame(rows, "entity_key string, text string, read_hash string, length bigint, mtime bigint, should_embed boolean")
    got = J.refresh_buckets(spark, blocks, str(tmp_path / "s"), J.hashing_embedder(), "m", adapter="local", buckets=2, at_once=1).drop("updated_at")
    want = J.stamp(J.embed(blocks, J.hashing_embedder()), blocks, "m", 0, adapter="local").drop("updated_at")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.entity_key: (r.embed_size, r.embed_mtime) for r in got.collect()} == {"a": (7, 5), "b": (None, None), "c": (None, None)}


def test_not_blank(spark):
    from quillmark.functions import text as T

    odd = ["", " ", "\n", "\r\n", "\t\x0b\f", "\x85", " \x85\n", "​", "﻿ ", " 　 ", "   ", " a ", "\x00", "\n\n-", "😀", "\x1c", None]
    df = spark.createDataFrame([(t,) for t in odd] + [(chr(c),) for c in range(0x3100) if c != 0xD800], "t string")
    import pyspark.sql.functions as F

    assert df.where(~T.not_blank(F.col("t")).eqNullSafe(F.length(T.trim_all(F.col("t"))) > 0)).count() == 0
