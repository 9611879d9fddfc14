import math

import pytest
from pyspark.sql import functions as F

from millrace import catalog, storage
from millrace.operators import compose, graph, reliability, rows, state
from millrace.plans.flow import Flow, FlowError
from millrace.sources import files

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.oracle_sql()[name])
    names = rel.columns
    want = sorted((tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in rel.fetchall()), key=repr)
    assert cols == sorted(names)
    assert got == want


def test_split_of_every_element(spark):
    table = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    got = {r.vec_id: list(r)[1:] for r in catalog.queries()["split_vec_all"](spark, DIR).collect()}
    assert got == table and {len(v) for v in got.values()} == {64}


def test_waves_and_cycles():
    f = Flow().node("a").node("b").node("c").node("d").edge("a", "b").edge("a", "c").edge("b", "d").edge("c", "d")
    assert f.waves() == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(FlowError):
        Flow().node("a").node("b").edge("a", "b").edge("b", "a").waves()
    with pytest.raises(FlowError):
        Flow().node("a").edge("a", "x").waves()
    with pytest.raises(FlowError):
        f.edge("a", "b")


def test_flow_pushes_the_guard_to_the_scan(spark):
    plan = catalog.entry(spark, DIR)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "GreaterThan(value" in plan


def test_inactive_node_and_flow_as_step(spark):
    inner = Flow().node("x", lambda d: d.withColumn("n", F.col("n") + 1)).node("off", lambda d: d.limit(0), active=False).edge("x", "off")
    outer = Flow().node("s").node("call", inner.as_step("x", "off")).edge("s", "call")
    assert [r.n for r in outer.plan(s=spark.range(3).toDF("n"))["call"].orderBy("n").collect()] == [1, 2, 3]


def test_branch_of_nulls_and_other_labels(spark):
    d = rows.decide(spark.createDataFrame([(None,), ("x",), ("y",)], "l string"), F.col("l"))
    parts = rows.branch(d, ["x", "else"])
    assert {k: sorted(r["_decision"] for r in v.collect()) for k, v in parts.items()} == {"x": ["x"], "else": ["no", "y"]}


def test_closure_of_a_cycle_and_of_nothing(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert sorted(map(tuple, graph.closure(e).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert graph.closure(e.limit(0)).count() == 0
    assert sorted(r.id for r in graph.cycle_members(e).collect()) == [1, 2]


def test_rounds_are_merged_not_broadcast(spark, monkeypatch):
    plans = []

    def noted(df):
        out = storage.kept(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # with what Spark changed as it ran
        return out

    for module in (compose, graph):
        monkeypatch.setattr(module, "kept", noted)
    assert {(r.k, r.round) for r in catalog.queries()["loop_until_dry"](spark, "/root/testdata/sf0.001").collect()} == {(k, k.bit_length() - 1) for k in range(1, 200)}
    e = spark.range(1, 20).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    assert graph.closure(e).count() == 190
    assert compose.loop(lambda seen, i: spark.range(i, i + 2).toDF("k"), max_iterations=3).count == 4
    assert len(plans) > 25 and not [p for p in plans if "BroadcastExchange" in p]


def test_loop_stops_at_the_cap(spark):
    step = lambda d: d.select((F.col("k") + 1).alias("k"))
    with pytest.raises(RuntimeError):
        compose.loop_until_dry(spark.range(1).toDF("k"), step, "k", max_rounds=3)
    out = compose.loop(lambda seen, i: spark.range(i, i + 1).toDF("k"), max_iterations=3)
    assert (out.stopped_by, out.iterations, out.count, out.dry_rounds) == ("max_iterations", 3, 3, 0)


def test_snapshot_is_not_computed_twice(spark, tmp_path):
    a = state.snapshot(spark.range(3), str(tmp_path), "run", "n")
    b = state.snapshot(spark.range(99), str(tmp_path), "run", "n")
    assert a.count() == b.count() == 3
    assert state.snapshot(spark.range(99), str(tmp_path), "next run", "n").count() == 99


def test_retry_and_containment():
    calls = []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert reliability.with_retry(action, 3, lambda n: 0) == 7
    assert files.inside("/a/b", "c/../d") == "/a/b/d"
    with pytest.raises(ValueError):
        files.inside("/a/b", "../c")


def test_files_round_trip(spark, tmp_path):
    files.write_lines(spark.createDataFrame([("x",)], "t string"), "t", str(tmp_path / "o"))
    found = files.glob(spark, str(tmp_path / "o"), "*.txt")
    assert found.count() >= 1
    assert "x\n" in [r.content for r in files.read_files(spark, str(tmp_path / "o")).collect()]


def test_empty_lists_failed_items_and_invalid_batches(spark):
    from pyspark.errors import PySparkException

    from millrace.operators import reduce

    d = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "t int, items array<int>")
    each = compose.map_items(d, F.col("items"), lambda x: x.withColumn("bad", F.col("item") > 1))
    assert sorted((r.t, r.results, r["count"], r.errors) for r in reduce.collected(each, ["t"], "pos", "item", "bad").collect()) == [(1, [1], 1, 1), (2, [], 0, 0), (3, [], 0, 0)]
    with pytest.raises(PySparkException):
        reduce.collected(each, ["t"], "pos", "item", "bad", fail=True).collect()
    pending, good, bad = (spark.createDataFrame(x, "t int, r string").select(*c) for x, c in (([(1, "")], ["t"]), ([(1, "a")], ["t", "r"]), ([(1, "a"), (9, "b")], ["t", "r"])))
    assert [tuple(r) for r in state.submit(pending, good, "t").collect()] == [(1, "a")]
    with pytest.raises(PySparkException):
        state.submit(pending, bad, "t").collect()


def test_guards_by_type(spark):
    d = spark.createDataFrame([(1, 5, "true", True, 0.0), (2, 0, "", None, None), (3, None, None, False, 1.5)], "k int, i int, t string, b boolean, x double")
    got = {c: [r["_decision"] for r in rows.decide(d, F.col(c)).orderBy("k").collect()] for c in "itbx"}
    assert got == {"i": ["yes", "no", "no"], "t": ["true", "", "no"], "b": ["yes", "no", "no"], "x": ["yes", "no", "yes"]}


def test_json_query_and_schema_errors(spark):
    from millrace.functions import text as tx

    body = '{"user": {"email": "a@b"}, "items": [{"name": "x", "done": true, "p": 2}, {"name": "y", "done": false, "p": 10}, {"name": 3}], "n": 1.50}'
    d = spark.createDataFrame([(body,)], "body string")
    ask = lambda q: d.select(tx.json_query(F.col("body"), q).alias("v")).first().v
    assert [ask(q) for q in ("user.email", "items[?done].name", "items[?p >= `10`].name", "items[*].name", "items[1].p", "items[?name == 'x'].p", "none.at.all", "n")] == ['"a@b"', '["x"]', '["y"]', '["x","y",3]', "10", "[2]", None, "1.5"]
    with pytest.raises(tx.UnsupportedQuery):
        tx.json_query(F.col("body"), "length(items)")
    with pytest.raises(Exception, match="MALFORMED"):
        spark.createDataFrame([("{no",)], "body string").select(tx.json_query(F.col("body"), "a")).collect()
    doc = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 3}, "c": {"type": "array", "maxItems": 1}, "s": {"pattern": "^x", "minLength": 3}}}
    errors = spark.createDataFrame([('{"a": 1, "c": [1, 2], "s": "y"}',), ('{"a": "t", "b": 0}',), ("[]",), ("{no",), (None,)], "body string").select(tx.schema_errors(F.col("body"), doc).alias("e")).collect()
    assert [[(x.instance_path, x.schema_path) for x in r.e] for r in errors] == [[("", "/required"), ("/a", "/properties/a/minimum"), ("/c", "/properties/c/maxItems"), ("/s", "/properties/s/pattern"), ("/s", "/properties/s/minLength")], [("/a", "/properties/a/type")], [("", "/type")], [("", "/type")], []]


def test_cycles_in_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (9, 7), (9, 8), (1, 10)], "src long, dst long")
    assert {r.id: r.component for r in graph.cycle_members(e).collect()} == {2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7}
    nodes = spark.range(1, 12).toDF("id")
    assert {r.id: r.wave for r in graph.waves(nodes, e).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 0, 7: 0, 8: 1, 9: 2, 10: 1, 11: 0}


def test_listened_lines_and_run_records(spark, tmp_path):
    from millrace.operators import trace
    from millrace.streaming import events as streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"k": 1}\nnoise\n  {"k": 2}\n')
    got = []
    streams.run_batches(streams.listen(spark, str(tmp_path / "in"), "k int"), lambda b, n: got.extend(r.k for r in b.collect()), str(tmp_path / "c"))
    assert sorted(got) == [1, 2]
    t = spark.createDataFrame([("r", "a", "completed", 0, 0), ("r", "b", "failed", 2, 1)], "run string, node string, state string, retries int, completion_order int")
    trace.run_record(t, "run", str(tmp_path / "runs"))
    trace.run_record(t, "run", str(tmp_path / "runs"))
    back = spark.read.json(str(tmp_path / "runs")).collect()
    assert len(back) == 2 and back[0].failed == back[0].completed == 1 and [x.node for x in back[0].trace] == ["a", "b"]


def test_failure_hook(spark):
    seen = []
    with pytest.raises(ZeroDivisionError):
        reliability.on_failure(lambda: 1 // 0, seen.append)
    assert len(seen) == 1 and reliability.on_failure(lambda: 3, seen.append) == 3
