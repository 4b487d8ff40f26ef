import pyspark.sql.functions as F
import pytest

from quillmark.functions import text as T
from quillmark.operators import jobs as J
from quillmark.operators import report as R


def test_run_logs(spark):
    rows = [
        ("Completed in 18s\nAdapter: local-transformers\nChecks: 3/3 passed\nRESULT: PASS", None, 0),
        ("RESULT: PASS", None, 1),
        ("an error word", None, 0),
        ("RESULT: PARTIAL", "", 1),
        ("-", "result: fail", 0),
        ("RESULT: PASS", "UI FREEZE detected", 0),
        (None, None, None),
        ("embed_ready after 7s\nQueries with results: 4\nConnections: count=9", None, 2),
    ]
    df = spark.createDataFrame(rows, "out string, err string, code int")
    m = R.extract_metrics(F.col("out"))
    got = df.select(R.classify_log(F.col("out"), F.col("err"), F.col("code")).alias("class"), *(c.alias(k) for k, c in m.items())).collect()
    assert [r["class"] for r in got] == ["passed", "passed", "unknown", "partial", "failed", "freeze_detected", "unknown", "failed"]
    assert (got[0].seconds, got[0].checks, got[0].adapter) == (18, 3, "local-transformers")
    assert (got[7].seconds, got[7].queries, got[7].connections, got[7].adapter) == (7, 4, 9, None)
    ranked = spark.createDataFrame([("passed", 9, 0.0), ("unknown", 99, 0.0), ("failed", None, 2500.0), ("failed", 2, 0.0)], "class string, seconds bigint, ms double")
    assert [(r.severity, r.cost) for r in R.rank_runs(ranked).collect()] == [(3, 3), (3, 2), (1, 9), (0, 99)]


def test_latency(spark):
    cases = [("startup-core", 5.0, 0, 1, "responsive-but-degraded"), ("startup-core", 5.0, 1, 0, "interactive-blocker"), ("active-leaf-debounce", 5000.0, 0, 3, "background"), ("note-switch-indexed", 5.0, 0, 1, "interactive-blocker"), ("note-switch-indexed", 1200.0, 0, 0, "responsive-but-degraded"), ("note-switch-indexed", None, 0, 0, "responsive-but-degraded"), ("note-switch-indexed", 160.0, 0, 0, "background")]
    df = spark.createDataFrame([(i, s, ms, t, e, True) for i, (s, ms, t, e, _) in enumerate(cases)], "i int, state string, ms double, timeouts bigint, empty_polls bigint, frozen boolean")
    df = df.withColumns({"trigger_ms": F.col("ms") / 2, "settled_ms": F.lit(None).cast("double")})
    got = {r.i: r.impact for r in R.latency_impact(R.latency_summary(df, by=("i", "state"))).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}
    three = spark.createDataFrame([("s", x) for x in (120.0, 180.0, 160.0)], "state string, ms double").withColumns({"trigger_ms": F.lit(1.0), "settled_ms": F.lit(None).cast("double"), "timeouts": F.lit(0), "empty_polls": F.lit(0), "frozen": F.lit(False)})
    one = R.latency_impact(R.latency_summary(three)).first()
    assert (one.median, one.worst, one.p95, one.impact, one.trigger_median) == (160.0, 180.0, 178.0, "background", 1.0)


def test_states_and_causes(spark):
    df = spark.createDataFrame([("idle", None), ("error", None), ("error", "a/b"), ("running", "a/b"), ("idle", "a/b")], "phase string, print string")
    got = df.select(*(c.alias(k) for k, c in R.runtime_state(F.col("phase"), F.col("print")).items())).collect()
    assert [tuple(r) for r in got] == [("warming_up", "idle", "loading", "idle", False), ("unavailable", "failed", "unavailable", "error", False), ("ready", "failed", "degraded", "error", False), ("ready", "running", "ready", "embedding", True), ("ready", "idle", "ready", "idle", True)]
    df = spark.createDataFrame([("[download:quota] timed out",), ("cdn down",), ("HTTP 404",)], "m string")
    assert [r.c for r in df.select(T.error_cause(F.col("m")).alias("c")).collect()] == ["quota", "download", "unknown"]
    df = spark.createDataFrame([("r", 1, 10, "a"), ("r", 2, 15, "a"), ("r", 3, 30, "b")], "run_id string, seq int, ts bigint, state string")
    assert {(r.seq, r.duration_ms) for r in R.stage_durations(df).collect()} == {(1, 20), (3, 0)}


def test_embed_answers(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "entity_key string, text string").coalesce(1)
    with pytest.raises(Exception, match="1 results for 2 texts"):
        J.embed(df, J.Embedder(lambda: lambda texts, role: [[1.0]], 1)).collect()
    empty = J.embed(df, J.Embedder(lambda: lambda texts, role: [[] for _ in texts], 1), retries=0, halt=False).collect()
    assert {(r.status, r.error) for r in empty} == {("failed", "no vector in the batch")}


def test_last_json(spark):
    import pyspark.sql.functions as F

    rows = [('a {x} \n{"a": "p", "b": [{"s": 1}, {"s": 2}]}', '{"a": "p", "b": [{"s": 1}, {"s": 2}]}'), ("x {", None), (None, None), ('{"k": 1} tail', None), ('{"k": 1}, {"l": 2}', '{"l": 2}'), ("", None), ('{"k": [1', None), (" {} ", "{}")]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, out string").select("i", R.last_json(F.col("out")).alias("j")).collect()
    assert {r.i: r.j for r in got} == {i: r[1] for i, r in enumerate(rows)}


def test_percentiles_without_groups_in_one_place(spark):
    import random

    import numpy as np

    from quillmark.operators.percentiles import percentiles

    rnd, rows = random.Random(4), []
    for g, draw in {"a": lambda: rnd.gauss(0, 1e6), "b": lambda: float(rnd.randrange(3)), "c": lambda: 10.0 ** rnd.uniform(-200, 200), None: lambda: 5.0}.items():
        rows += [(g, draw()) for _ in range(700)]
    rows += [("d", None), ("e", 1.0), ("e", float("nan")), ("e", 2.0)]
    got = percentiles(spark.createDataFrame(rows, "g string, x double"), ("g",), "x", {"m": 0.5, "p": 0.95, "z": 1.0}, bins=16)
    want = {}
    for g in {r[0] for r in rows}:
        xs = [x for h, x in rows if h == g and x is not None and x == x]
        want[g] = tuple(np.percentile(xs, [50, 95, 100])) if xs else (None, None, None)
    for r in got.collect():
        assert tuple(r)[1:] == want[r.g] or np.allclose(tuple(r)[1:], want[r.g], rtol=1e-12), r
    assert got.count() == len(want)
