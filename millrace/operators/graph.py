"""Graph analytics on an edge table (src, dst): closures, levels, and checks, as joins and rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import kept


def successors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, successor) of the nodes in column id of ``of``."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("successor")).join(of.select("id"), "id", "left_semi").distinct()


def predecessors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, predecessor) of the nodes in column id of ``of``."""
    return edges.select(F.col("dst").alias("id"), F.col("src").alias("predecessor")).join(of.select("id"), "id", "left_semi").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, ancestor) for every path of one edge or more; cycles are fine. start: a column node to restrict to.

    Semi-naive: each round extends only the pairs that the round before found, and writes only the new ones. The edges and
    what is known are merged, not broadcast: they would go through the driver once a round."""
    step = edges.select("src", "dst").distinct()
    pairs = step.select(F.col("dst").alias("node"), F.col("src").alias("ancestor"))
    rounds = [kept(pairs.join(start.select("node").distinct(), "node", "left_semi") if start is not None else pairs)]
    while True:
        found = rounds[-1].join(step.hint("merge"), F.col("ancestor") == F.col("dst")).select("node", F.col("src").alias("ancestor")).distinct()
        new = kept(found.join(_union(rounds).hint("merge"), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return _union(rounds)
        rounds.append(new)


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, descendant), start nodes included as their own."""
    back = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
    return back.withColumnRenamed("ancestor", "descendant").union(start.select("node", F.col("node").alias("descendant"))).distinct()


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, wave): the length of the longest path that leads to each node.

    Waves are peeled off: nodes without an incoming edge go, with their edges, and only what they led to can be
    next. Where cycles are left to peel, their back edges are dropped (``without_back_edges``) and it begins anew."""
    left = kept(edges.select("src", "dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").distinct())
    ready = kept(nodes.select("id").distinct().join(left.select(F.col("dst").alias("id")), "id", "left_anti"))
    done, wave = [], 0
    while True:
        if ready.isEmpty():
            if left.isEmpty():
                return _union(done) if done else nodes.select("id", F.lit(0).alias("wave")).limit(0)
            back = left.join(without_back_edges(left), ["src", "dst"], "left_anti")
            return waves(nodes, kept(edges.select("src", "dst").join(back, ["src", "dst"], "left_anti")))
        done.append(ready.select("id", F.lit(wave).alias("wave")))
        gone = ready.select(F.col("id").alias("src"))
        freed = left.join(gone, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        rest = kept(left.join(gone, "src", "left_anti"))
        ready, left, wave = kept(freed.join(rest.select(F.col("dst").alias("id")), "id", "left_anti")), rest, wave + 1


def without_back_edges(edges: DataFrame) -> DataFrame:
    """edges but for those that lead, inside a cycle's component, to the same or a smaller node: no cycle is left."""
    of = cycle_members(edges)
    a, b = of.toDF("src", "_a"), of.toDF("dst", "_b")
    marked = edges.join(a, "src", "left").join(b, "dst", "left")
    return marked.where(~F.coalesce((F.col("_a") == F.col("_b")) & (F.col("dst") <= F.col("src")), F.lit(False))).select("src", "dst")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select(F.col("src").alias("id")).distinct()


def _spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, label): the smallest label of start (id, label) that reaches each node along the edges, its own included."""
    now = kept(start)
    while True:
        pushed = now.join(edges.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), "label")
        new = kept(now.union(pushed).groupBy("id").agg(F.min("label").alias("label")))
        if new.join(now, ["id", "label"], "left_anti").isEmpty():
            return new
        now = new


def cycle_members(edges: DataFrame) -> DataFrame:
    """(id, component): nodes that reach themselves, with the smallest node that they share a cycle with.

    Strongly connected components by labels: what cannot lie on a cycle is trimmed, each node takes the smallest
    node that reaches it, and those that reach that node back, among equal labels, are its component."""
    loops = edges.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")).distinct()
    left, found = kept(edges.where("src <> dst").select("src", "dst").distinct()), []
    while True:
        while True:  # trimming
            kept_edges = left.join(left.select(F.col("dst").alias("src")), "src", "left_semi").join(left.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
            less = kept(kept_edges)
            if less.count() == left.count():
                break
            left = less
        if left.isEmpty():
            out = _union([loops, *found])
            return out.groupBy("id").agg(F.min("component").alias("component"))
        ids = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        color = _spread(left, ids.withColumn("label", F.col("id")))
        c = color.withColumnRenamed("label", "color")
        same = left.join(c.toDF("src", "_a"), "src").join(c.toDF("dst", "_b"), "dst").where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = c.where("id = color").select("id", F.col("id").alias("label"))
        back = kept(_spread(kept(same), roots).select("id", F.col("label").alias("component")))
        found.append(back)
        left = kept(left.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti"))


def entries(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (id, part) of which no edge comes from the same part."""
    m = members.select(F.col("id").alias("src"), F.col("part").alias("part"))
    inner = edges.join(m, "src").join(members.select(F.col("id").alias("dst"), F.col("part").alias("p2")), "dst").where("part = p2")
    return members.join(inner.select(F.col("dst").alias("id"), "part").distinct(), ["id", "part"], "left_anti")


def exits(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (id, part) of which no edge leads to the same part."""
    return entries(members, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def missing_inputs(ports: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared input ports (id, port) that no edge (dst, dst_port) feeds."""
    fed = edges.select(F.col("dst").alias("id"), F.col("dst_port").alias("port"))
    return ports.join(fed, ["id", "port"], "left_anti")


def port_errors(ports: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, src_port, dst, dst_port, error, id, port) of edges that name unknown ports or join unlike types.

    ports: (id, direction 'in' or 'out', port, type). A node that declares no port of a direction takes any name there; an unknown
    source port hides what is wrong with the target. Types: equal ones go together, any with every type, i64 into f32, and
    vec<..> and map<..> if what they hold does."""
    out, into = (ports.where(F.col("direction") == d).select(F.col("id").alias(e), F.col("port").alias(f"{e}_port"), F.col("type").alias(f"_{e}_type")) for d, e in (("out", "src"), ("in", "dst")))
    declares = lambda p, e: p.select(e, F.lit(True).alias(f"_{e}_has")).distinct()
    e = edges.join(out, ["src", "src_port"], "left").join(into, ["dst", "dst_port"], "left").join(declares(out, "src"), "src", "left").join(declares(into, "dst"), "dst", "left")
    lost = lambda x: F.col(f"_{x}_has").isNotNull() & F.col(f"_{x}_type").isNull()
    parts = lambda x: F.split(F.regexp_replace(x, ">+$", ""), "<")

    def step(state, p):  # 0 alike so far, 1 alike whatever follows, 2 unlike
        a, b = p.getField("a"), p.getField("b")
        alike = (a == b) | ((a == "i64") & (b == "f32"))
        return F.when(state != 0, state).when((a == "any") | (b == "any"), 1).when(F.coalesce(alike, F.lit(False)), 0).otherwise(2)

    levels = F.zip_with(parts("_src_type"), parts("_dst_type"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    unlike = F.aggregate(levels, F.lit(0), step) == 2
    error = F.when(lost("src") | lost("dst"), "PortNotFound").when(unlike, "PortTypeMismatch")
    at = lambda a, b: F.when(lost("src"), F.col(a)).when(lost("dst"), F.col(b))
    return e.select("src", "src_port", "dst", "dst_port", error.alias("error"), at("src", "dst").alias("id"), at("src_port", "dst_port").alias("port")).where("error IS NOT NULL")
