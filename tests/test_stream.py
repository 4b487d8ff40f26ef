import random

from quillmark.operators import chunk as C
from quillmark.operators import store as ST
from quillmark.streaming import changes as M

EVENT = "ts timestamp, op string, path string, old_path string, text string"


def test_incremental_equals_rebuild(spark, tmp_path):
    import datetime as dt

    rnd = random.Random(5)
    text = lambda: "\n\n".join("x" * rnd.randrange(50, 220) for _ in range(3))
    notes = {f"n{i}.md": text() for i in range(6)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    table = ST.VersionedTable(spark, str(tmp_path / "blocks"))
    table.write(C.chunk_notes(frame(notes)))
    feed = tmp_path / "feed"
    for k in range(2):
        rows, at = [], dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
        for j, path in enumerate(rnd.sample(sorted(notes), 3)):
            op = rnd.choice(["modify", "delete", "rename"])
            when = at + dt.timedelta(seconds=20 * j)
            if op == "delete":
                notes.pop(path)
                rows.append((when, op, path, None, None))
            elif op == "modify":
                notes[path] = text()
                rows.append((when, op, path, None, notes[path]))
            else:
                notes[f"r{k}{j}.md"] = notes.pop(path)
                rows.append((when, op, f"r{k}{j}.md", path, notes[f"r{k}{j}.md"]))
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(str(feed))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(feed))
    M.incremental_refresh(stream, table, C.chunk_notes, str(tmp_path / "ck")).start().awaitTermination(120)
    want = {r.entity_key: r.text for r in C.chunk_notes(frame(notes)).collect()}
    assert {r.entity_key: r.text for r in table.read().collect()} == want


def test_delete_gives_way(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(t, "rename", "b.md", "a.md", ""), (t, "create", "a.md", None, ""), (t, "delete", "x.png", None, None)], EVENT)
    got = {r.path: r.action for r in M.latest_change(M.change_stream(ev)).collect()}
    assert got == {"a.md": "upsert", "b.md": "upsert"}


def _brute_firings(changes, gap):
    """One debounce timer over (ts, action, path): upserts put it off, deletes leave the set."""
    out, start, due, pending = [], None, None, {}
    for ts, action, path in sorted(changes):
        if due is not None and ts >= due:
            out += [(start, p) for p, a in pending.items() if a == "upsert"]
            start, due, pending = None, None, {}
        if action == "upsert":
            start, due = start or ts, ts + gap
        if due is not None:
            pending[path] = action
    return sorted(out + [(start, p) for p, a in pending.items() if a == "upsert"])


def _changes(seed, n=400):
    import datetime as dt

    rnd, at, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for _ in range(n):
        at += dt.timedelta(milliseconds=rnd.choice([0, 5, 900, 4000, 12_999, 13_000, 13_001, 40_000]))
        out.append((at, rnd.choice(["upsert", "upsert", "delete"]), f"n{rnd.randrange(30)}.md"))
    return sorted(set(out))


def test_one_debounce_batch(spark):
    import datetime as dt

    rows = _changes(1)
    got = M.last_of_firing(M.firings(spark.createDataFrame(rows, "ts timestamp, action string, path string"))).collect()
    assert sorted((r.session.start.replace(microsecond=r.session.start.microsecond // 1000 * 1000), r.path) for r in got) == _brute_firings(rows, dt.timedelta(seconds=13))


def test_one_debounce_stream(spark, tmp_path):
    import datetime as dt

    rows, schema = _changes(2, 200), "ts timestamp, action string, path string"
    end = (rows[-1][0] + dt.timedelta(hours=1), "delete", "end.md")  # lets the watermark pass
    later = (end[0] + dt.timedelta(hours=1), "delete", "end.md")
    parts = [rows[:70], rows[70:140], rows[140:], [end], [later]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "feed" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "feed"))
    seen = []

    def step(batch, _):
        seen.extend((r.session.start.replace(microsecond=r.session.start.microsecond // 1000 * 1000), r.path) for r in M.last_of_firing(batch).collect())

    query = M.firings(stream, watermark="1 second").writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert sorted(seen) == _brute_firings(rows, dt.timedelta(seconds=13))


def test_held_until_discovered(spark, tmp_path):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "ts timestamp, action string, path string"
    parts = [
        [(t(1), "upsert", "a.md"), (t(2), "delete", "b.md")],
        [(t(5), "discovered", None), (t(4), "upsert", "c.md"), (t(5), "upsert", "d.md"), (t(6), "upsert", "e.md")],
        [(t(3), "upsert", "late.md"), (t(7), "upsert", "a.md"), (t(9), "discovered", None)],
    ]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "feed" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "feed"))
    seen = []
    query = M.held_until_discovered(stream, shards=3).writeStream.foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(r[3] for r in seen if r[1] == "discovered") == [0, 1, 2]
    assert sorted((r[1], r[2]) for r in seen if r[1] != "discovered") == [("delete", "b.md"), ("upsert", "a.md"), ("upsert", "e.md")]


def test_embedding_refresh_equals_rebuild(spark, tmp_path):
    import datetime as dt
    import os

    import pyspark.sql.functions as F

    from quillmark.functions.text import content_hash
    from quillmark.operators import jobs as J

    rnd = random.Random(8)
    text = lambda: "\n\n".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) for _ in range(3))
    asked = str(tmp_path / "asked")
    os.mkdir(asked)

    def build():
        inner = J.hashing_embedder().build()

        def embed(texts, role):
            with open(os.path.join(asked, f"{os.getpid()}"), "a") as f:
                f.write("x" * len(texts))
            return inner(texts, role)

        return embed

    found, notes = J.Embedder(build, 16), {}
    table = M.BlockTable(spark, str(tmp_path / "blocks"), buckets=8)
    table.create()
    total = lambda: sum(os.path.getsize(os.path.join(asked, f)) for f in os.listdir(asked))
    for k in range(4):
        rows, at = [], dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
        for j in range(12 if not k else 2):
            when, path = at + dt.timedelta(seconds=j), f"n{j}.md" if not k else rnd.choice(sorted(notes))
            if k and rnd.random() < 0.4:
                notes.pop(path)
                rows.append((when, "delete", path, None, None))
            else:  # a change keeps the first paragraph
                notes[path] = text() if not k else notes[path].split("\n\n")[0] + "\n\n" + text()
                rows.append((when, "modify", path, None, notes[path]))
        spark.createDataFrame(rows, EVENT).coalesce(1).write.json(str(tmp_path / f"feed/{k}"))
        files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "blocks") for f in names if f.startswith("part-")}
        before, asked_before = files(), total()
        stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(str(tmp_path / "feed"))
        query = M.embedding_refresh(stream, table, C.paragraph_blocks, found, str(tmp_path / "ck")).start()
        query.awaitTermination(180)
        assert query.exception() is None
        touched = {os.path.dirname(f) for f in files() - before}
        assert len(touched) <= len({r[2] for r in rows})  # no other bucket is written
        if k:
            assert total() - asked_before < 4 * len(rows)  # what stayed isn't embedded again
        want = C.paragraph_blocks(spark.createDataFrame(list(notes.items()), "path string, text string"))
        want = {r.entity_key: (r.text, r.h) for r in want.select("entity_key", "text", content_hash(F.col("text")).alias("h")).collect()}
        got = table.read().collect()
        assert {r.entity_key: (r.text, r.embed_hash) for r in got} == want
        assert all(r.vec is not None and r.embed_size == len(r.text) for r in got)
    seen = {r.entity_key: r.vec for r in J.embed(table.read(), J.hashing_embedder()).collect()}
    assert all(seen[r.entity_key] == r.vec for r in table.read().collect())
