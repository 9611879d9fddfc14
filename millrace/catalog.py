"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.functions import text as tx
from millrace.operators import compose, graph, history, reduce, reliability, rows, state, trace
from millrace.plans.flow import Flow
from millrace.sources import files
from millrace.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(table: str, sql: str | None):
    """Registers fn(df) over a table under the function's name."""

    def take(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        _QUERIES[fn.__name__] = run
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return take


def _query2(tables: tuple[str, ...], sql: str | None):
    def take(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        _QUERIES[fn.__name__] = run
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return take


def _bands(events: DataFrame) -> DataFrame:
    flow = (
        Flow("bands")
        .node("src", lambda d: d.withColumn("k", tx.json_path(F.col("props"), "k").cast("long")), guard=F.col("value") > 50)
        .node("high", lambda d: d.withColumn("band", F.lit("high")))
        .node("low", lambda d: d.withColumn("band", F.lit("low")))
        .node("count", lambda d: d.groupBy("event_type", "band").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum")))
        .edge("src", "high", "yes")
        .edge("src", "low", "no")
        .edge("high", "count")
        .edge("low", "count")
    )
    return flow.plan(src=events)["count"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, branch, label, converge, count: the flagship flow."""
    return _bands(spark.read.parquet(f"{sf_dir}/events.parquet"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@_query("events", f"SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, count(*) AS n, CAST(sum({_K}) AS BIGINT) AS k_sum FROM events GROUP BY 1, 2")
def flow_bands(df):
    return _bands(df)


@_query("region", "SELECT * FROM region")
def passthrough_region(df):
    return rows.passthrough(df)


@_query("nation", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def transform_rename(df):
    return rows.rename(df, {"n_nationkey": "id", "n_name": "name"})


@_query("customer", "SELECT c_custkey, concat(c_mktsegment, '|', c_name) AS merged FROM customer")
def merge_struct(df):
    m = rows.merge(df, ["c_name", "c_mktsegment"])
    return m.select("c_custkey", F.concat_ws("|", "merged.c_mktsegment", "merged.c_name").alias("merged"))


@_query("events", f"SELECT event_id, {_K} AS k FROM events")
def split_map(df):
    parsed = df.select("event_id", F.from_json("props", "k long").alias("p"))
    return rows.split_struct(parsed, "p")


@_query("embeddings", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS item_0, CAST(embedding[2] AS DOUBLE) AS item_1 FROM embeddings")
def split_vec(df):
    return rows.split_array(df.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", 2)


@_query("embeddings", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS item_{i}" for i in range(64)) + " FROM embeddings")
def split_vec_all(df):
    """Every element: as many columns as the longest array has."""
    n = df.agg(F.max(F.size("embedding"))).first()[0] or 0
    return rows.split_array(df.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", n)


@_query("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def gate_filter(df):
    return rows.gate(df, (F.col("l_quantity") > 25) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


@_query("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def guard_legacy_eq(df):
    return rows.gate(df, rows.equals_guard(F.col("o_orderstatus"), "F")).select("o_orderkey")


@_query("events", "SELECT event_type, count(*) FILTER (k NOT IN ('', 'false', '0')) AS n_true, count(*) AS n FROM (SELECT event_type, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events) GROUP BY 1")
def guard_truthy(df):
    return df.groupBy("event_type").agg(F.count_if(rows.truthy(tx.json_path(F.col("props"), "k"))).alias("n_true"), F.count("*").alias("n"))


@_query("orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
def branch_yes_no(df):
    return rows.branch_columns(df, F.col("o_totalprice") > 100000, {"yes": {"size": F.lit("big")}, "no": {"size": F.lit("small")}}).select("o_orderkey", "size")


@_query("events", "SELECT event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'B' ELSE 'rest' END AS lane FROM events")
def branch_else(df):
    return rows.branch_columns(df, F.col("event_type"), {k: {"lane": F.lit(v)} for k, v in (("click", "A"), ("purchase", "B"), ("else", "rest"))}).select("event_id", "lane")


@_query("orders", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS label, count(*) AS n FROM orders GROUP BY 1")
def branch_label3(df):
    label = F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 150000, "mid").otherwise("high")
    cases = {"low": {"label": F.lit("low")}, "mid": {"label": F.lit("mid")}, "else": {"label": F.lit("high")}}
    return rows.branch_columns(df, label, cases).groupBy("label").agg(F.count("*").alias("n"))


@_query2(("orders", "customer"), "SELECT coalesce(o.k, c_custkey) AS k, o.n, coalesce(o.note, c.c_name) AS c_name FROM (SELECT o_custkey AS k, count(*) AS n, CASE WHEN count(*) > 12 THEN 'many' END AS note FROM orders GROUP BY 1) o FULL JOIN customer c ON o.k = c.c_custkey")
def fan_in_overlay(orders, customer):
    counted = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.when(F.count("*") > 12, "many").alias("c_name"))
    return rows.fan_in([customer.select(F.col("c_custkey").alias("k"), "c_name"), counted], "k")


@_query("conversations", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def select_keys_join(df):
    turns = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(rows.keys_of(F.col("t"), "role"), ",").alias("roles"))


@_query("events", f"SELECT event_id, {_K} AS k FROM events WHERE {_K} > 10")
def json_path(df):
    return df.select("event_id", tx.json_path(F.col("props"), "k").cast("long").alias("k")).where("k > 10")


@_query("lineitem", "SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_quantity > 30 THEN l_partkey::VARCHAR END, ',' ORDER BY l_linenumber, l_quantity, l_partkey), '') AS parts FROM lineitem GROUP BY 1")
def json_filter_project(df):
    items = df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("i"))
    return items.select("l_orderkey", F.array_join(tx.where_project(F.col("i"), lambda x: x.getField("l_quantity") > 30, "l_partkey").cast("array<string>"), ",").alias("parts"))


@_query("customer", "SELECT c_custkey, 'Dear ' || c_name || ' of {' || c_mktsegment || '}' AS letter FROM customer")
def template_basic(df):
    return df.select("c_custkey", tx.prompt("Dear ", F.col("c_name"), " of {", F.col("c_mktsegment"), "}").alias("letter"))


@_query("orders", "SELECT o_orderkey, 'order' || CASE WHEN o_orderstatus = 'F' THEN ' done ' || o_orderpriority ELSE '' END AS note FROM orders")
def template_if(df):
    done = F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")
    return df.select("o_orderkey", tx.prompt("order", (done, [" done ", F.col("o_orderpriority")])).alias("note"))


@_query("part", "SELECT p_partkey, p_brand || ' {unknown} ' || p_size::VARCHAR AS line FROM part")
def interpolate_missing(df):
    return df.select("p_partkey", tx.interpolate("{p_brand} {unknown} {p_size}", {"p_brand": F.col("p_brand"), "p_size": F.col("p_size")}).alias("line"))


@_query("nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS keys FROM nation")
def context_keys(df):
    t = F.when(F.col("n_nationkey") % 2 == 0, "{ctx.b} and {ctx.a} and {ctx.b} {inputs.x}").otherwise("{ctx.b}")
    return df.select("n_nationkey", F.array_join(tx.context_keys(t), ",").alias("keys"))


@_query("events", "SELECT event_id, value BETWEEN 1 AND 90 AND event_type IN ('click', 'view', 'signup', 'purchase') AS validation_ok, (CASE WHEN value < 1 THEN 1 ELSE 0 END + CASE WHEN value > 90 THEN 1 ELSE 0 END + CASE WHEN event_type NOT IN ('click', 'view', 'signup', 'purchase') THEN 1 ELSE 0 END)::BIGINT AS n_errors FROM events")
def schema_validate_passthrough(df):
    v = F.col("value")
    errors = tx.validation([("/value", "minimum", v >= 1, "too small"), ("/value", "maximum", v <= 90, "too large"), ("/event_type", "enum", F.col("event_type").isin("click", "view", "signup", "purchase"), "not listed")])
    return df.select("event_id", errors.alias("e")).select("event_id", (F.size("e") == 0).alias("validation_ok"), F.size("e").cast("long").alias("n_errors"))


@_query("part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, p_size * 2 + 1 AS twice FROM part")
def script_if_chain(df):
    size = F.col("p_size")
    out = tx.map_result(df, {"class": tx.if_chain((size < 10, "small"), (size < 30, "medium"), otherwise="large"), "twice": size * 2 + 1})
    return out.select("p_partkey", "class", "twice")


@_query("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_tax > 0.04 AS taxed FROM lineitem")
def script_map_result(df):
    out = tx.map_result(df, {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "taxed": F.col("l_tax") > 0.04})
    return out.select("l_orderkey", "l_linenumber", "net", "taxed")


@_query("events", "SELECT event_id, count(*) OVER w AS count, string_agg(event_type, ',') OVER w AS accumulated FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def accumulate_running(df):
    a = reduce.accumulate(df, ["user_id"], ["ts", "event_id"], "event_type")
    return a.select("event_id", "count", F.array_join("accumulated", ",").alias("accumulated"))


@_query("events", "SELECT user_id, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def reduce_replace(df):
    return df.groupBy("user_id").agg(reduce.replace("event_id", "value").alias("last"))


@_query("conversations", "SELECT conv_id, string_agg(role, '/' ORDER BY turn) AS all_roles, count(*) AS n FROM conversations GROUP BY 1")
def reduce_append(df):
    return df.groupBy("conv_id").agg(F.array_join(reduce.append("turn", "role"), "/").alias("all_roles"), F.count("*").alias("n"))


@_query("events", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def reduce_merge(df):
    m = reduce.merge_rows(df.withColumn("m", F.create_map("event_type", "value")), ["user_id"], "event_id", "m")
    return m.select("user_id", F.explode("merged").alias("event_type", "value"))


@_query("conversations", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY 1")
def reduce_concat(df):
    return df.groupBy("conv_id").agg(reduce.concat("turn", "text").alias("joined"))


@_query("events", "WITH l AS (SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT event_type AS key, value FROM l UNION ALL SELECT 'wf:promoted:' || event_type, value FROM l")
def reduce_promote(df):
    return reduce.promote(df, "event_type", "event_id", "value")


@_query("lineitem", "SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS votes, count(*) FILTER (l_quantity > 25) >= 2 AS passed FROM lineitem GROUP BY 1")
def map_quorum(df):
    return reduce.quorum(df.withColumn("vote", F.col("l_quantity") > 25), ["l_orderkey"], "vote", 2)


@_query("lineitem", "SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_tax <= 0.06 THEN (l_linenumber * l_linenumber)::VARCHAR END, ',' ORDER BY l_linenumber), '') AS results, count(*) FILTER (l_tax <= 0.06) AS count, count(*) FILTER (l_tax > 0.06) AS errors FROM lineitem GROUP BY 1")
def map_collect(df):
    lists = df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_tax"))).alias("items"))
    each = compose.map_items(lists, F.col("items"), lambda d: d.withColumns({"squared": F.col("item.l_linenumber") * F.col("item.l_linenumber"), "failed": F.col("item.l_tax") > 0.06}))
    out = reduce.collected(each, ["l_orderkey"], "pos", "squared", "failed")
    return out.withColumn("results", F.array_join(F.col("results").cast("array<string>"), ","))


@_query("conversations", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS loop_index, role AS loop_item, (count(*) OVER (PARTITION BY conv_id))::BIGINT AS loop_total FROM conversations")
def foreach_index(df):
    lists = df.groupBy("conv_id").agg(reduce.append("turn", "role").alias("roles"))
    return compose.foreach(lists, F.col("roles")).select("conv_id", F.col("loop_index").cast("long").alias("loop_index"), "loop_item", F.col("loop_total").cast("long").alias("loop_total"))


@_query("conversations", "SELECT conv_id, 'body#iter:' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR AS key FROM conversations")
def parallel_loop_keys(df):
    lists = df.groupBy("conv_id").agg(reduce.append("turn", "role").alias("roles"))
    return compose.parallel_keys(compose.foreach(lists, F.col("roles")), "body", "loop_index").select("conv_id", "key")


_RACE = "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {}) AS p FROM lineitem{}) WHERE p = 1"


@_query("lineitem", _RACE.format("l_shipdate, l_linenumber", " WHERE l_returnflag <> 'R'"))
def race_first(df):
    return compose.race_first(df, ["l_orderkey"], ["l_shipdate", "l_linenumber"], F.col("l_returnflag") != "R").select("l_orderkey", "l_linenumber")


@_query("lineitem", _RACE.format("l_extendedprice DESC, l_linenumber", ""))
def race_criterion(df):
    return compose.race_best(df, ["l_orderkey"], F.col("l_extendedprice"), ["l_linenumber"]).select("l_orderkey", "l_linenumber")


@_query("part", "WITH RECURSIVE r(k, round) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT p_partkey, r.round + 1 FROM r JOIN part ON p_partkey IN (r.k * 2, r.k * 2 + 1)) SELECT k, round FROM r")
def loop_until_dry(df):
    """Reachability over the tree in which part k leads to parts 2k and 2k + 1."""
    edges = df.select(F.floor(F.col("p_partkey") / 2).alias("k"), F.col("p_partkey").alias("to"))
    start = df.sparkSession.range(1, 2).toDF("k")
    return compose.loop_until_dry(start, lambda d: d.join(edges.hint("merge"), "k").select(F.col("to").alias("k")), "k")


_POLL = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


@_query("events", f"SELECT user_id, coalesce(min(n) FILTER (event_type = 'purchase'), max(n)) AS attempts_used, min(n) FILTER (event_type = 'purchase') IS NULL AS timed_out FROM ({_POLL}) WHERE n <= 4 GROUP BY 1")
def poll_until_attempts(df):
    out = compose.poll_until(df, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", 4)
    return out.withColumn("attempts_used", F.col("attempts_used").cast("long"))


_EDGES = "SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 3 AND p_partkey % 5 <> 0"


def _edges(part: DataFrame) -> DataFrame:
    return part.where("p_partkey >= 3 AND p_partkey % 5 <> 0").select(F.floor(F.col("p_partkey") / 3).alias("src"), F.col("p_partkey").alias("dst"))


def _nodes(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("id"))


@_query("part", f"WITH RECURSIVE e AS ({_EDGES}), c(node, ancestor) AS (SELECT dst, src FROM e UNION ALL SELECT c.node, e.src FROM c JOIN e ON c.ancestor = e.dst) SELECT node, ancestor FROM c")
def ancestors(df):
    return graph.closure(_edges(df))


@_query("part", f"WITH RECURSIVE e AS ({_EDGES}), c(node, descendant) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT c.node, e.dst FROM c JOIN e ON c.descendant = e.src) SELECT node, descendant FROM c")
def descendants(df):
    return graph.descendants(_edges(df), df.sparkSession.range(1, 2).toDF("node"))


@_query("part", f"WITH RECURSIVE e AS ({_EDGES}), w(id, wave) AS (SELECT p_partkey, 0 FROM part UNION ALL SELECT e.dst, w.wave + 1 FROM w JOIN e ON w.id = e.src) SELECT id, max(wave) AS wave FROM w GROUP BY 1")
def waves(df):
    return graph.waves(_nodes(df), _edges(df))


@_query("part", f"WITH e AS ({_EDGES}) SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM e) AND p_partkey NOT IN (SELECT dst FROM e)")
def orphans(df):
    return graph.orphans(_nodes(df), _edges(df))


@_query("part", "SELECT p_partkey AS id, (p_partkey // 4) * 4 AS component FROM part WHERE p_partkey // 4 > 0 AND p_partkey % 4 < 3 AND (p_partkey // 4) * 4 + 2 <= (SELECT max(p_partkey) FROM part)")
def scc_members(df):
    """Each run of four parts has a ring over its first three."""
    base = df.where("p_partkey >= 4 AND p_partkey % 4 < 3").select(F.col("p_partkey").alias("src"))
    ring = base.select("src", F.when(F.col("src") % 4 == 2, F.col("src") - 2).otherwise(F.col("src") + 1).alias("dst"))
    return graph.cycle_members(ring)


@_query("part", f"WITH e AS ({_EDGES}), m AS (SELECT p_partkey AS id, p_partkey % 2 AS part FROM part), i AS (SELECT e.src, e.dst FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst AND a.part = b.part) SELECT id, part, id NOT IN (SELECT dst FROM i) AS is_entry, id NOT IN (SELECT src FROM i) AS is_exit FROM m")
def entry_exit(df):
    members = df.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2).alias("part"))
    into = graph.entries(members, _edges(df)).withColumn("is_entry", F.lit(True))
    out = graph.exits(members, _edges(df)).withColumn("is_exit", F.lit(True))
    return members.join(into, ["id", "part"], "left").join(out, ["id", "part"], "left").na.fill(False, ["is_entry", "is_exit"])


@_query("part", f"WITH e AS ({_EDGES}) SELECT p_partkey AS id, p_partkey NOT IN (SELECT dst FROM e) AS source, p_partkey NOT IN (SELECT src FROM e) AS sink FROM part")
def sources_sinks(df):
    n, e = _nodes(df), _edges(df)
    first, last = graph.sources(n, e).withColumn("source", F.lit(True)), graph.sinks(n, e).withColumn("sink", F.lit(True))
    return n.join(first, "id", "left").join(last, "id", "left").na.fill(False, ["source", "sink"])


@_query("part", f"WITH e AS ({_EDGES}) SELECT p_partkey AS id, 'in' AS port FROM part WHERE p_partkey NOT IN (SELECT dst FROM e)")
def missing_inputs(df):
    return graph.missing_inputs(_nodes(df).withColumn("port", F.lit("in")), _edges(df).withColumn("dst_port", F.lit("in")))


@_query("conversations", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def history_depth(df):
    return history.last_messages(df, "conv_id", "turn", 2).select("conv_id", "turn")


@_query("conversations", "SELECT conv_id, turn FROM (SELECT *, sum(strlen(text) // 4 + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE s <= 120 OR rn <= 2")
def history_budget(df):
    return history.within_budget(df, "conv_id", "turn", "text", 120).select("conv_id", "turn")


@_query("conversations", "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 OR turn % 4 = 1")
def history_ancestors(df):
    """Turns as nodes; every third has none, and the ancestors are those of the form 4n + 1."""
    messages = df.withColumn("node_id", F.when(F.col("turn") % 3 != 0, F.col("turn")))
    wanted = df.where("turn % 4 = 1").select(F.col("turn").alias("node_id")).distinct()
    return history.of_ancestors(messages, wanted).select("conv_id", "turn")


_FRAMES = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events"


@_query("events", f"SELECT event_id, frame_index FROM ({_FRAMES}) WHERE b = 0")
def ws_until_predicate(df):
    return history.bounded_frames(df, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", F.col("frame_index").cast("long").alias("frame_index"))


@_query("events", f"SELECT event_id, frame_index FROM ({_FRAMES}) WHERE b = 0 AND frame_index < 3")
def ws_max_frames(df):
    return history.bounded_frames(df, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3).select("event_id", F.col("frame_index").cast("long").alias("frame_index"))


_STATES = "SELECT user_id, event_id % 3 AS node, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retrying' ELSE 'other' END AS state FROM events"
_TRACE = f"""SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY first) - 1)::BIGINT AS completion_order FROM (SELECT user_id, node,
arg_max(state, seq) FILTER (state IN ('completed', 'failed')) AS state, arg_max(ts, seq) FILTER (state = 'running') AS started,
arg_max(ts, seq) FILTER (state IN ('completed', 'failed')) AS ended, count(*) FILTER (state = 'retrying') AS retries,
min(seq) FILTER (state IN ('completed', 'failed')) AS first FROM ({_STATES}) GROUP BY 1, 2) WHERE state IS NOT NULL"""


def _traced(df: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("view", "running", "purchase", "completed", "error", "failed", "signup", "retrying")])
    log = df.select("user_id", (F.col("event_id") % 3).alias("node"), F.col("event_id").alias("seq"), "ts", F.coalesce(names[F.col("event_type")], F.lit("other")).alias("state"))
    out = trace.trace(log, "user_id", "node", "seq", "ts", "state")
    return out.withColumn("completion_order", F.col("completion_order").cast("long"))


@_query("events", f"SELECT user_id, node, state, started, ended, retries, completion_order FROM ({_TRACE})")
def trace_from_events(df):
    return _traced(df)


@_query("events", f"SELECT user_id, node, completion_order FROM ({_TRACE}) WHERE state = 'failed'")
def trace_failed(df):
    return _traced(df).where("state = 'failed'").select("user_id", "node", "completion_order")


@_query("events", f"SELECT user_id, node, (row_number() OVER (PARTITION BY user_id ORDER BY completion_order) - 1)::BIGINT AS completion_order FROM ({_TRACE}) WHERE node <> 1")
def trace_scoped(df):
    wanted = df.sparkSession.createDataFrame([(0,), (2,)], "node long")
    return trace.scoped(_traced(df), wanted, "user_id", "node").select("user_id", "node", F.col("completion_order").cast("long").alias("completion_order"))


@_query("nation", "SELECT n_nationkey, least(100 * power(2.0, n_nationkey), 60000.0)::BIGINT AS exponential_ms, 100::BIGINT AS fixed_ms FROM nation")
def retry_delays(df):
    n = F.col("n_nationkey")
    return df.select("n_nationkey", reliability.delay_ms(n).alias("exponential_ms"), reliability.delay_ms(n, "fixed").alias("fixed_ms"))


@_query("events", "SELECT event_id, CASE event_type WHEN 'error' THEN value > 20 WHEN 'view' THEN true WHEN 'signup' THEN true ELSE false END AS retryable FROM events")
def retryable(df):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "signup", "adapter").otherwise("cancelled")
    return df.select("event_id", reliability.retryable(kind, F.col("value") > 20).alias("retryable"))


@_query("events", "SELECT event_id, status = 429 OR status BETWEEN 500 AND 599 AS again FROM (SELECT event_id, 400 + event_id % 200 AS status FROM events)")
def retry_status(df):
    return df.select("event_id", reliability.retry_status(400 + F.col("event_id") % 200, [429]).alias("again"))


@_query("part", "SELECT p_partkey, try_cast(substr(p_brand, 7) || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS BIGINT) AS value, try_cast(substr(p_brand, 7) || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS BIGINT) IS NULL AS _caught_error FROM part")
def catch_error(df):
    raw = F.concat(F.substring("p_brand", 7, 99), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""))
    c = reliability.caught(raw.try_cast("long"), raw, "not a number")
    return df.select("p_partkey", c["value"].alias("value"), c["_caught_error"].alias("_caught_error"))


@_query("part", "SELECT p_partkey, coalesce(try_cast(CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_size::VARCHAR END AS BIGINT), -1) AS value FROM part")
def fallback_value(df):
    raw = F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_size").cast("string"))
    return df.select("p_partkey", reliability.fallback(raw.try_cast("long"), F.lit(-1).cast("long")).alias("value"))


@_query("events", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'kind ' || (value > 50)::VARCHAR END AS failure_reason, 'load' AS _error_node FROM events")
def error_simplify(df):
    bad = F.col("event_type") == "error"
    failed = df.select("event_id", F.when(bad, "long message").alias("error"), F.when(bad, F.concat(F.lit("kind "), (F.col("value") > 50).cast("string"))).alias("error_type"), bad.alias("recoverable"))
    return rows.error_transform(rows.error_transform(failed, "simplify"), "enrich", "load", {"error": "failure_reason"})


@_query("documents", "SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'legal' WHEN contains(text, 'the') THEN 'english' ELSE 'other' END AS answer FROM documents")
def mock_llm_route(df):
    return df.select("doc_id", rows.route_first_match(F.coalesce("text", F.lit("")), [("License", "legal"), ("the", "english")], "other").alias("answer"))


@_query2(("nation", "region"), "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN r_name WHEN n_regionkey < 4 THEN 'shared' ELSE 'inherited' END AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def blackboard_scope_lookup(nation, region):
    own = region.where("r_regionkey < 2").select(F.col("r_regionkey").cast("string").alias("scope"), F.lit("k").alias("key"), F.col("r_name").alias("value"))
    other = nation.sparkSession.createDataFrame([("global", "k", "shared"), ("parent", "k", "never"), ("parent", "p", "inherited")], "scope string, key string, value string")
    asked = nation.select("n_nationkey", F.col("n_regionkey").cast("string").alias("scope"), F.when(F.col("n_regionkey") < 4, "k").otherwise("p").alias("key"))
    return state.scoped_lookup(asked, "key", "scope", own.union(other)).select("n_nationkey", "value")


@_query2(("orders", "customer"), "SELECT o_orderkey, c_acctbal AS response FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_acctbal > 0")
def suspend_resume(orders, customer):
    _, pending = state.suspend(orders, F.col("o_orderstatus") == "O")
    answers = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("response"))
    return state.resume(pending, answers, "o_custkey").select("o_orderkey", "response")


@_query2(("orders", "customer"), "SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def suspend_unanswerable(orders, customer):
    _, pending = state.suspend(orders, F.col("o_orderstatus") == "O")
    return state.unanswerable(pending, customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@_query("customer", "SELECT c_custkey, 'GET' || chr(10) || '/' || c_mktsegment || chr(10) || 'a:1' || chr(10) || 'host:x' || chr(10) || sha256(c_name) AS canonical FROM customer")
def auth_canonical(df):
    headers = F.create_map(F.lit("Host"), F.lit(" x"), F.lit("A"), F.lit("1"))
    return df.select("c_custkey", files.canonical_request(F.lit("get"), F.concat(F.lit("/"), "c_mktsegment"), headers, F.col("c_name")).alias("canonical"))


@_query("pages", "SELECT page_id, host = 'example.org' OR ends_with(host, '.example.org') AS sent FROM (SELECT page_id, lower(split_part(split_part(url, '/', 3), ':', 1)) AS host FROM pages)")
def cookie_domain(df):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return df.select("page_id", files.domain_matches(host, F.lit(".Example.org")).alias("sent"))


@_query("events", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS latest FROM events GROUP BY 1")
def stream_event_totals(df):
    folder = storage.new_folder(df.sparkSession, "totals")
    t = streams.to_table(streams.totals(_stream(df), ["event_type"], "value"), ["event_type"], f"{folder}/out", f"{folder}/checkpoint")
    return t.select("event_type", "n", F.round("total", 4).alias("total"), "latest")


def _stream(df: DataFrame) -> DataFrame:
    """The files of a table as a stream."""
    found = df.inputFiles()
    path, name = found[0].rsplit("/", 1)
    return streams.read_events(df.sparkSession, path, df.schema, name if len(found) == 1 else "*.parquet")


@_query("events", f"SELECT CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'dead letter' END AS target, count(*) AS n, sum(CASE event_type WHEN 'click' THEN {_K} + 1 WHEN 'purchase' THEN 2 * ({_K} + 1) END)::BIGINT AS total FROM events GROUP BY 1")
def stream_routing(df):
    """purchase enters the flow in its middle: its plan is what lies behind that node."""
    flow = Flow().node("click", lambda d: d.withColumn("k", tx.json_path(F.col("props"), "k").cast("long") + 1)).node("double", lambda d: d.withColumn("k", F.col("k") * 2)).edge("click", "double")
    middle = lambda d: flow.plan(only_reached=True, double=d.withColumn("k", tx.json_path(F.col("props"), "k").cast("long") + 1))["double"]
    first = lambda d: flow.plan(only_reached=True, click=d)["click"]
    folder = storage.new_folder(df.sparkSession, "routed")
    out = streams.run_routed(_stream(df), "event_type", {"click": first, "purchase": middle}, f"{folder}/out", f"{folder}/checkpoint")
    return out.groupBy(F.col("where").alias("target")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@_query("events", "SELECT CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'dead letter' END AS target, count(*) AS n FROM events GROUP BY 1")
def event_routing(df):
    known, dead = streams.route(df, "event_type", ["click", "purchase"])
    parts = [d.select(F.lit(k).alias("target")) for k, d in [*known.items(), ("dead letter", dead)]]
    return rows.converge(parts).groupBy("target").agg(F.count("*").alias("n"))


@_query("part", f"WITH e AS ({_EDGES}) SELECT src AS id, 'next' AS kind, dst AS other FROM e WHERE src % 2 = 0 UNION SELECT dst, 'previous', src FROM e WHERE dst % 2 = 0")
def neighbours(df):
    even = _nodes(df).where("id % 2 = 0").union(df.sparkSession.range(1).toDF("id"))
    after = graph.successors(_edges(df), even).select("id", F.lit("next").alias("kind"), F.col("successor").alias("other"))
    return after.union(graph.predecessors(_edges(df), even).select("id", F.lit("previous").alias("kind"), F.col("predecessor").alias("other")))


@_query("part", "SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 0")
def self_loops(df):
    return graph.self_loops(_edges(df).union(df.where("p_partkey % 7 = 0").select("p_partkey", "p_partkey")))


_LAST = "(SELECT max(p_partkey) FROM part)"


@_query("part", f"SELECT p_partkey AS id, CASE WHEN p_partkey < 4 OR p_partkey % 4 = 3 OR (p_partkey // 4) * 4 + 2 > {_LAST} THEN CASE WHEN p_partkey >= 4 AND p_partkey % 4 = 1 THEN 1 ELSE 0 END ELSE p_partkey % 4 END::INTEGER AS wave FROM part")
def waves_cyclic(df):
    """Each run of four parts has a ring over its first three; waves begin at the smallest."""
    base = df.where("p_partkey >= 4 AND p_partkey % 4 < 3").select(F.col("p_partkey").alias("src"))
    ring = base.select("src", F.when(F.col("src") % 4 == 2, F.col("src") - 2).otherwise(F.col("src") + 1).alias("dst"))
    return graph.waves(_nodes(df), ring)


_PORTS = f"WITH e AS ({_EDGES}), t AS (SELECT src, dst, CASE src % 5 WHEN 0 THEN 'lost' ELSE 'out' END AS src_port, CASE dst % 7 WHEN 0 THEN 'lost' ELSE 'in' END AS dst_port FROM e)"


@_query("part", _PORTS + """ SELECT src, dst, CASE WHEN src_port = 'lost' OR (dst_port = 'lost' AND dst % 2 = 0) THEN 'PortNotFound' ELSE 'PortTypeMismatch' END AS error,
CASE WHEN src_port = 'lost' THEN src WHEN dst_port = 'lost' AND dst % 2 = 0 THEN dst END AS id, CASE WHEN src_port = 'lost' OR (dst_port = 'lost' AND dst % 2 = 0) THEN 'lost' END AS port
FROM t WHERE src_port = 'lost' OR (dst % 2 = 0 AND (dst_port = 'lost' OR src % 3 = 0))""")
def port_check(df):
    """Sources give vec<text>, vec<i64> or any; even targets take vec<f32>, odd ones declare nothing."""
    e = _edges(df).withColumns({"src_port": F.when(F.col("src") % 5 == 0, "lost").otherwise("out"), "dst_port": F.when(F.col("dst") % 7 == 0, "lost").otherwise("in")})
    kind = F.when(F.col("id") % 3 == 0, "vec<text>").when(F.col("id") % 3 == 1, "vec<i64>").otherwise("any")
    ids = _nodes(df)
    ports = ids.select("id", F.lit("out").alias("direction"), F.lit("out").alias("port"), kind.alias("type")).union(ids.where("id % 2 = 0").select("id", F.lit("in"), F.lit("in"), F.lit("vec<f32>")))
    return graph.port_errors(ports, e).select("src", "dst", "error", "id", "port")


@_query("part", "SELECT p_size AS k, CASE WHEN p_size = 0 THEN 'no' ELSE 'yes' END AS by_int, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'no' END AS by_text, count(*) AS n FROM (SELECT p_size % 4 AS p_size FROM part) GROUP BY 1")
def guard_int(df):
    d = df.select((F.col("p_size") % 4).alias("k"))
    d = rows.decide(d, F.col("k"), "by_int")
    return rows.decide(d, F.when(F.col("k") % 2 == 0, "true"), "by_text").groupBy("k", "by_int", "by_text").agg(F.count("*").alias("n"))


@_query("events", "SELECT event_id, CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'Later' ELSE CASE WHEN value > 50 THEN 'yes' ELSE 'no' END END AS taken FROM events")
def guard_model_fallback(df):
    said = F.when(F.col("event_type") == "click", " YES ").when(F.col("event_type") == "view", "Later").when(F.col("event_type") == "error", "")
    return df.select("event_id", rows.model_guard(said, F.when(F.col("value") > 50, "yes").otherwise("no")).alias("taken"))


@_query("nation", "SELECT n_nationkey, n_name AS from_inputs, 'a+b' AS joined, 'results.none.x' AS literal, '/out' AS dir FROM nation")
def select_paths(df):
    views = {"inputs": F.to_json(F.struct(F.struct(F.col("n_name").alias("name")).alias("n"))), "results": F.lit('{"list": [{"k": "a"}, {"k": 1}, {"x": "c"}, {"k": "b"}]}'), "output_dir": F.lit("/out")}
    return df.select("n_nationkey", rows.select_path(views, "inputs.n.name").alias("from_inputs"), rows.select_path(views, "results.list", "k", "+").alias("joined"), rows.select_path(views, "results.none.x").alias("literal"), rows.select_path(views, "output_dir").alias("dir"))


@_query("lineitem", "SELECT l_orderkey, coalesce('[' || string_agg(CASE WHEN l_quantity > 30 THEN l_partkey::VARCHAR END, ',' ORDER BY l_linenumber, l_partkey) || ']', '[]') AS parts FROM lineitem GROUP BY 1")
def json_query_filter(df):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("quantity"))))
    body = df.groupBy("l_orderkey").agg(F.to_json(F.struct(lines.alias("items"))).alias("body"))
    return body.select("l_orderkey", tx.json_query(F.col("body"), "items[?quantity > `30`].l_partkey").alias("parts"))


@_query("events", "SELECT event_id, value BETWEEN 5 AND 90 AND event_type IN ('click', 'view') AS validation_ok, concat_ws(',', CASE WHEN value < 5 THEN '/value minimum' END, CASE WHEN value > 90 THEN '/value maximum' END, CASE WHEN event_type NOT IN ('click', 'view') THEN '/type enum' END) AS failures FROM events")
def schema_document(df):
    doc = {"type": "object", "required": ["value", "type"], "properties": {"value": {"type": "number", "minimum": 5, "maximum": 90}, "type": {"enum": ["click", "view"], "minLength": 2}}}
    body = F.to_json(F.struct("value", F.col("event_type").alias("type")))
    out = tx.validated(df, tx.schema_errors(body, doc))
    return out.select("event_id", "validation_ok", F.array_join(F.transform("validation_error", lambda e: F.concat_ws(" ", e.getField("instance_path"), e.getField("keyword"))), ",").alias("failures"))


@_query("part", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'double' WHEN 2 THEN 'boolean' ELSE 'text' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS as_long, CASE WHEN p_partkey % 4 = 1 THEN p_partkey + 0.5 END::DOUBLE AS as_double FROM part")
def typed_scalars(df):
    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, key).when(F.col("p_partkey") % 4 == 1, F.concat(key, F.lit(".5"))).when(F.col("p_partkey") % 4 == 2, "true").otherwise(F.concat(F.lit("n"), key))
    return df.select("p_partkey", tx.typed_scalar(text).alias("t")).select("p_partkey", "t.kind", F.col("t.long").alias("as_long"), F.col("t.double").alias("as_double"))


@_query("nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS got, n_nationkey % 2 = 0 AS has FROM nation")
def context_lookup(df):
    ctx = F.create_map(F.concat(F.lit("k"), (F.col("n_nationkey") % 2).cast("string")), F.col("n_name"))
    return df.select("n_nationkey", tx.ctx_get(ctx, "k0").alias("got"), tx.ctx_has(ctx, "k0").alias("has"))


@_query("part", "SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, p_brand || '/' || p_size::VARCHAR AS joined FROM part")
def script_strings(df):
    return tx.map_result(df, {"up": F.upper("p_name"), "n": F.length("p_name").cast("long"), "joined": F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"))}).select("p_partkey", "up", "n", "joined")


@_query("conversations", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) || ',end' AS pushed, count(*) + 1 AS n FROM conversations GROUP BY 1")
def script_arrays(df):
    lists = df.groupBy("conv_id").agg(reduce.append("turn", "role").alias("r"))
    pushed = F.array_append("r", F.lit("end"))
    return tx.map_result(lists, {"pushed": F.array_join(pushed, ","), "n": F.size(pushed).cast("long")}).select("conv_id", "pushed", "n")


@_query("conversations", "SELECT conv_id, string_agg(role || ',' || turn::VARCHAR, ',' ORDER BY turn) AS flat FROM conversations GROUP BY 1")
def reduce_flatten(df):
    pairs = df.withColumn("pair", F.array("role", F.col("turn").cast("string")))
    return pairs.groupBy("conv_id").agg(F.array_join(reduce.flatten("turn", "pair"), ",").alias("flat"))


@_query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS count, 0::BIGINT AS errors FROM orders")
def map_empty_list(df):
    """A token with an empty or null list keeps its row, with no results."""
    items = F.when(F.col("o_orderkey") % 3 != 0, F.array("o_custkey", "o_orderkey")).when(F.col("o_orderkey") % 2 == 0, F.array().cast("array<bigint>"))
    each = compose.map_items(df.select("o_orderkey", items.alias("items")), F.col("items"), lambda d: d.withColumn("failed", F.lit(False)))
    return reduce.collected(each, ["o_orderkey"], "pos", "item", "failed").select("o_orderkey", "count", "errors")


@_query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'completed' END AS state, CASE WHEN o_orderkey % 3 <> 0 THEN 'body#iter:0' END AS key FROM orders")
def parallel_loop_states(df):
    items = F.when(F.col("o_orderkey") % 3 != 0, F.array("o_custkey"))
    return compose.parallel_loop(df, items, lambda d: d, "body").select("o_orderkey", "state", "key")


@_query("conversations", "WITH s AS (SELECT role, count(*) AS calls, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY 1) SELECT * FROM s")
def usage_by_role(df):
    calls = df.select("role", F.length("text").cast("long").alias("tokens_in"), F.lit(None).cast("long").alias("tokens_out"), F.lit(1.0).alias("ms"))
    return reduce.usage(calls, ["role"], "tokens_in", "tokens_out", "ms").select("role", "calls", "tokens")


@_query("conversations", "SELECT conv_id, string_agg(turn::VARCHAR || ':' || role, ',' ORDER BY turn) AS outputs FROM conversations GROUP BY 1")
def subgraph_outputs(df):
    out = reduce.node_outputs(df, ["conv_id"], "turn", ["role"])
    text = F.transform(F.array_sort(F.map_entries("outputs")), lambda e: F.concat(e.getField("key").cast("string"), F.lit(":"), e.getField("value").getField("role")))
    return out.select("conv_id", F.array_join(text, ",").alias("outputs"))


_DOUBLED = "WITH RECURSIVE r(k, n) AS (SELECT 1::BIGINT, 1 UNION ALL SELECT k * 2, n + 1 FROM r WHERE n < {})"


@_query("region", _DOUBLED.format(5) + " SELECT 'until' AS stopped_by, 5::BIGINT AS iterations, count(*) AS count, sum(k)::BIGINT AS total FROM r")
def loop_until_count(df):
    """One new number a round until five are there."""
    out = _doubling(df, until=lambda d, n: d.count() >= 5)
    return _loop_row(df, out)


@_query("region", _DOUBLED.format(4) + " SELECT 'break' AS stopped_by, 4::BIGINT AS iterations, count(*) AS count, sum(k)::BIGINT AS total FROM r")
def loop_break(df):
    return _loop_row(df, _doubling(df, break_on=F.col("k") == 8))


@_query("region", "SELECT 'until_dry' AS stopped_by, 6::BIGINT AS iterations, 4::BIGINT AS count, 15::BIGINT AS total")
def loop_dry_rounds(df):
    """Beyond 8 the step repeats itself: two dry rounds end it."""
    return _loop_row(df, compose.loop(lambda seen, i: df.sparkSession.range(1).select(F.lit(min(2**i, 8)).cast("long").alias("k")), F.col("k"), until_dry=2))


def _doubling(df: DataFrame, **how) -> compose.Loop:
    return compose.loop(lambda seen, i: df.sparkSession.range(1).select(F.lit(2**i).cast("long").alias("k")), F.col("k"), **how)


def _loop_row(df: DataFrame, loop: compose.Loop) -> DataFrame:
    sums = loop.collected.agg(F.sum("k").alias("total"))
    return sums.select(F.lit(loop.stopped_by).alias("stopped_by"), F.lit(loop.iterations).cast("long").alias("iterations"), F.lit(loop.count).cast("long").alias("count"), "total")


@_query("part", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN p_size ELSE p_size + 10 * ((49 - p_size) // 10) END::BIGINT AS size FROM part")
def while_guard(df):
    """Adds 10 to sizes below 40 as long as there are any."""
    grow = lambda d: d.withColumn("size", F.when(F.col("size") < 40, F.col("size") + 10).otherwise(F.col("size")))
    start = df.select("p_partkey", F.col("p_size").cast("long").alias("size"))
    return compose.while_(start, lambda d: not d.where("size < 40").isEmpty(), grow)[0]


@_query("nation", "SELECT n_nationkey, n_nationkey * 8 AS value FROM nation")
def repeat_three_times(df):
    start = df.select("n_nationkey", F.col("n_nationkey").cast("long").alias("value"))
    return compose.repeat(start, 3, lambda d: d.withColumn("value", F.col("value") * 2))


@_query2(("orders", "customer"), "SELECT o_orderkey, c_acctbal AS response FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def submit_batch(orders, customer):
    """Only customers that wait are answered, so the batch holds."""
    _, pending = state.suspend(orders, F.col("o_orderstatus") == "O")
    waiting = customer.join(pending.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return state.submit(pending, waiting.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("response")), "o_custkey").select("o_orderkey", "response")


@_query("nation", "SELECT 'k' || (n_nationkey % 5)::VARCHAR AS key, max(n_nationkey)::VARCHAR AS value FROM nation GROUP BY 1 UNION ALL SELECT 'only', 'config'")
def layered_inputs(df):
    config = df.where("n_nationkey < 10").select(F.concat(F.lit("k"), (F.col("n_nationkey") % 5).cast("string")).alias("key"), F.lit("old").alias("value"))
    latest = df.groupBy(F.concat(F.lit("k"), (F.col("n_nationkey") % 5).cast("string")).alias("key")).agg(F.max("n_nationkey").cast("string").alias("value"))
    only = df.sparkSession.range(1).select(F.lit("only").alias("key"), F.lit("config").alias("value"))
    return state.layered(config.union(only), latest)


@_query("orders", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'cached' ELSE 'call' END AS answered FROM orders")
def memo_lookup(df):
    """Every fourth customer is cached; those divisible by 3 alone had answers that have expired."""
    key = F.sha2(F.to_json(F.struct("o_custkey")), 256)
    cache = df.where("o_custkey % 4 = 0 OR o_custkey % 3 = 0").select(key.alias("key"), F.when(F.col("o_custkey") % 4 == 0, F.lit("2024-01-01 00:00:00")).otherwise("2023-01-01 00:00:00").cast("timestamp").alias("at"), F.lit("r").alias("response")).distinct()
    hit, miss = state.memo(df.select("o_orderkey", "o_custkey"), cache, ["o_custkey"], F.lit("2024-01-01 00:01:00").cast("timestamp"), 3600)
    return hit.select("o_orderkey", F.lit("cached").alias("answered")).union(miss.select("o_orderkey", F.lit("call").alias("answered")))


@_query("events", f"SELECT user_id, node, retries > 0 AS retried, state FROM ({_TRACE}) WHERE retries > 0 UNION ALL SELECT user_id, node, NULL, state FROM ({_TRACE}) WHERE state = 'completed'")
def trace_filters(df):
    t = _traced(df)
    return trace.only(t, "retried").select("user_id", "node", F.lit(True).alias("retried"), "state").union(trace.only(t, "completed").select("user_id", "node", F.lit(None).cast("boolean"), "state"))


@_query("events", "SELECT event_id FROM events WHERE event_id > 100")
def events_since(df):
    return trace.since(rows.observed(df, "seen"), "event_id", 100).select("event_id")


@_query("customer", "SELECT c_custkey, 'authorization: Bearer ' || c_name AS bearer, 'x-seg: ' || c_mktsegment AS fixed FROM customer")
def auth_headers(df):
    line = lambda h: F.concat(h.getField("name"), F.lit(": "), h.getField("value"))
    return df.select("c_custkey", line(files.bearer(F.col("c_name"))).alias("bearer"), line(files.static_header(F.lit("X-Seg"), F.col("c_mktsegment"))).alias("fixed"))


@_query("region", "SELECT r_regionkey, 'f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8' AS mac FROM region")
def auth_hmac(df):
    """The well-known value for this key and sentence."""
    return df.select("r_regionkey", files.hmac(F.lit("The quick brown fox jumps over the lazy dog"), b"key").alias("mac"))


@_query("nation", "SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN 'a=new; t=' || n_regionkey::VARCHAR END AS cookie, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey::VARCHAR END AS token FROM nation")
def cookie_jar(df):
    """Regions are runs; odd ones' cookies belong to another domain."""
    runs = df.select(F.col("n_regionkey").alias("run")).distinct()
    domain = F.when(F.col("run") % 2 == 0, ".x.org").otherwise("y.org").alias("domain")
    put = lambda name, value, seq: runs.select("run", F.lit(name).alias("name"), value.alias("value"), domain, F.lit(seq).alias("seq"))
    jar = put("a", F.lit("old"), 1).union(put("a", F.lit("new"), 2)).union(put("t", F.col("run").cast("string"), 3))
    asked = df.select("n_nationkey", F.col("n_regionkey").alias("run"), F.lit("api.x.org:80").alias("host"))
    return files.cookie_headers(asked, jar, "host", ("t", "token")).select("n_nationkey", "cookie", "token")


@_query("nation", "SELECT n_nationkey, n_name AS label, length(n_name) AS n FROM nation")
def flow_ports(df):
    """Named ports: the target sees only what its edges bring, under its own names."""
    flow = Flow().node("in").node("out", lambda d: d.withColumn("n", F.length("label").cast("long"))).edge("in", "out", ports={"n_nationkey": "n_nationkey", "n_name": "label"})
    return flow.plan(**{"in": df})["out"]


@_query2(("nation", "region"), "SELECT n_nationkey AS id, upper(n_name) AS name, CASE WHEN r_regionkey IS NOT NULL THEN lower(r_name) END AS region FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def subgraph_call(nation, region):
    """A flow of two sources, called with tables by name; its sinks stand side by side."""
    flow = Flow().node("n", lambda d: d.withColumn("name", F.upper("name"))).node("r", lambda d: d.withColumn("region", F.lower("region"))).node("named").node("regional").edge("n", "named").edge("r", "regional")
    return flow.invoke({"n": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "r": region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region"))}, "id")


@_query("region", "SELECT 'r' || r_regionkey::VARCHAR || '/name.txt' AS path, strlen(r_name)::BIGINT AS bytes_written, r_name AS content FROM region")
def files_written(df):
    """One file for each row, then found by a glob and read back."""
    folder = storage.new_folder(df.sparkSession, "files")
    done = files.write_files(df.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("/name.txt")).alias("path"), "r_name"), "path", "r_name", folder)
    back = files.read_files(df.sparkSession, f"{folder}/*/*.txt").select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("path"), "content")
    return done.join(back, "path").select("path", "bytes_written", "content")


@_query("nation", "SELECT n_nationkey, n_name FROM nation")
def resumed_snapshot(df):
    """A node's output is kept for its run; the second ask reads it."""
    folder = storage.new_folder(df.sparkSession, "run")
    state.snapshot(df.select("n_nationkey", "n_name"), folder, "run-1", "load")
    return state.snapshot(df.select("n_nationkey", "n_name").where("false"), folder, "run-1", "load")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
