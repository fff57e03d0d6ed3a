"""Walks over an edge table (src, dst) as rounds of joins: closure, levels, shortest paths, leaves, simplification.

A round joins the newest frontier, never what was found before, with the edges, and drops what is known already; it ends
when the frontier is empty. Each round is checkpointed to the shared folder: plans stay short, and a lost executor costs
one round. Cycles and self-loops end by themselves.

Lineage graphs are often small, and a job for each hop then costs more than the walk. Graphs of up to LOCAL_EDGES distinct
edges (at most LOCAL_ROWS rows of result) are walked on the driver instead, with the same results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import shared_folder


LOCAL_EDGES, LOCAL_ROWS = 5_000, 1_000_000


def _small(*frames: DataFrame) -> list[list[tuple]] | None:
    """The distinct rows of frames that are all within LOCAL_EDGES rows; reads no more than that."""
    out = []
    for df in frames:
        rows = df.limit(LOCAL_EDGES + 1).toArrow() if LOCAL_EDGES else None
        if rows is None or rows.num_rows > LOCAL_EDGES:
            return None
        listed = zip(*(c.to_pylist() for c in rows.columns))
        out.append(list({_key(r): r for r in listed}.values()))
    return out


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame from rows of plain columns, by way of Arrow."""
    empty = spark.createDataFrame([], schema)
    types = to_arrow_schema(empty.schema)
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, types)], names=types.names), empty.schema)


def _key(row: tuple) -> tuple:
    return tuple(tuple(v) if isinstance(v, list) else v for v in row)


def _adjacent(edges: list[tuple]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    return out


def _reach_locally(edges: list[tuple], starts: list, most: int | None) -> list[tuple] | None:
    nxt, rows = _adjacent(edges), []
    for s in starts:
        seen, frontier, depth = {s}, [s], 0
        rows.append((s, s, 0))
        while frontier and (most is None or depth < most):
            depth += 1
            new = []
            for n in frontier:
                for m in nxt.get(n, ()):
                    if m not in seen:
                        seen.add(m)
                        new.append(m)
            rows += [(s, n, depth) for n in new]
            frontier = new
            if len(rows) > LOCAL_ROWS:
                return None
    return rows


def _levels_locally(edges: list[tuple]) -> list[tuple]:
    nxt, waits = _adjacent(edges), {}
    for a, b in edges:
        waits.setdefault(a, 0)
        waits[b] = waits.get(b, 0) + 1
    ready, level, out = [n for n, k in waits.items() if not k], 0, []
    while ready:
        out += [(n, level) for n in ready]
        new = []
        for n in ready:
            for m in nxt.get(n, ()):
                waits[m] -= 1
                if not waits[m]:
                    new.append(m)
        ready, level = new, level + 1
    done = {n for n, _ in out}
    return out + [(n, None) for n in waits if n not in done]


def _node_type(edges: DataFrame, column: str = "src") -> str:
    return edges.schema[column].dataType.simpleString()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None, through: Column | None = None) -> DataFrame:
    """(start, node, depth): what each start reaches and in how few steps, itself at depth 0.

    ``through`` says of a ``node`` whether the walk goes on from it; ``most`` bounds the steps."""
    pairs = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    if through is None and (own := _small(pairs, starts.select(F.col(starts.columns[0])))) is not None:
        rows = _reach_locally(own[0], [r[0] for r in own[1]], most)
        if rows is not None:
            t = _node_type(edges)
            return _frame(edges.sparkSession, rows, f"start {t}, node {t}, depth int")
    e = cut(pairs.distinct())
    new = cut(starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    found, depth = new, 0
    while most is None or depth < most:
        depth += 1
        goes = new if through is None or depth == 1 else new.where(through)
        step = goes.join(e, goes["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = cut(step.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            break
        found = found.union(new)
    return found


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def leaves(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth) of reached nodes from which no edge leads on (a start without edges is its own leaf)."""
    found = reach(edges, starts)
    return found.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("start", "node", "depth")


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """One row (path, length), or none: fewest steps, of those the path least by its nodes."""
    spark = edges.sparkSession
    pairs = edges.select("src", "dst")
    if (own := _small(pairs)) is not None:
        nxt, newest, known = _adjacent(own[0]), {start: [start]}, {start}
        while newest and goal not in newest:
            step: dict[str, list[str]] = {}
            for n, way in newest.items():
                for m in nxt.get(n, ()):
                    if m not in known:
                        step[m] = min(step.get(m, way + [m]), way + [m])
            known |= set(step)
            newest = step
        found = [(newest[goal], len(newest[goal]) - 1)] if goal in newest else []
        return spark.createDataFrame(found, "path array<string>, length int")
    e = cut(pairs.distinct())
    new = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = new.select("node")
    while new.limit(1).count():
        hit = new.where(F.col("node") == goal)
        if hit.limit(1).count():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        step = new.join(e, new["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = cut(step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
        seen = seen.union(new.select("node"))
    return spark.createDataFrame([], "path array<string>, length int")


def simplify(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept nodes that are joined by a path over others only; a walk ends at the first kept node."""
    if (own := _small(edges.select("src", "dst"), kept.select(F.col(kept.columns[0])))) is not None:
        inside, nxt, rows = {r[0] for r in own[1]}, _adjacent(own[0]), []
        for start in inside:
            seen, todo = set(), list(nxt.get(start, ()))
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen.add(at)
                    if at in inside:
                        rows.append((start, at))
                    else:
                        todo += nxt.get(at, ())
        t = _node_type(edges)
        return _frame(edges.sparkSession, rows, f"src {t}, dst {t}")
    keep = kept.select(F.col(kept.columns[0]).alias("node")).distinct().withColumn("keeps", F.lit(True))
    marked = edges.select("src", "dst").distinct()
    inner = marked.join(keep.withColumnRenamed("node", "src").withColumnRenamed("keeps", "from_kept"), "src", "left")
    first = inner.where("from_kept").select(F.col("src").alias("start"), F.col("dst").alias("node"))
    on = cut(inner.where("from_kept IS NULL").select("src", "dst"))
    new = cut(first.distinct())
    found = new
    while True:
        step = new.join(on, new["node"] == on["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = cut(step.join(found, ["start", "node"], "left_anti"))
        if not new.limit(1).count():
            break
        found = found.union(new)
    return found.join(keep, "node").select(F.col("start").alias("src"), F.col("node").alias("dst")).distinct()


def sources_and_sinks(edges: DataFrame) -> DataFrame:
    """(node, is_source, is_sink) of every node."""
    both = edges.select(F.col("src").alias("node"), F.lit(0).alias("incoming"), F.lit(1).alias("outgoing")).union(edges.select(F.col("dst"), F.lit(1), F.lit(0)))
    return both.groupBy("node").agg((F.max("incoming") == 0).alias("is_source"), (F.max("outgoing") == 0).alias("is_sink"))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the highest of them. Nodes on or behind a cycle have none."""
    pairs = edges.select("src", "dst").where("src <> dst")
    if (own := _small(pairs)) is not None:
        return _frame(edges.sparkSession, _levels_locally(own[0]), f"node {_node_type(edges)}, level int")
    e = cut(pairs.distinct())
    waiting = e.select(F.col("dst").alias("node"), F.lit(1).alias("k")).union(e.select(F.col("src").alias("node"), F.lit(0).alias("k"))).groupBy("node").agg(F.sum("k").alias("waits"))
    done, level = None, 0
    while True:
        waiting = cut(waiting)  # nodes without a level, and how many of their predecessors have none
        ready = waiting.where("waits = 0").select("node")
        if not ready.limit(1).count():
            break
        at = ready.withColumn("level", F.lit(level))
        done = at if done is None else done.union(at)
        less = e.join(ready.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        waiting = waiting.where("waits > 0").join(less, "node", "left").select("node", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"))
        level += 1
    loops = waiting.select("node", F.lit(None).cast("int").alias("level"))
    return loops if done is None else done.union(loops)


def split_by_sinks(edges: DataFrame, sinks: list[list[str]]) -> DataFrame:
    """(node, part): each node goes to the first group of sinks that it leads to."""
    spark = edges.sparkSession
    groups = spark.createDataFrame([(s, i) for i, g in enumerate(sinks) for s in g], "start string, part int")
    back = reach(reversed_edges(edges), groups.select("start"))
    return back.join(groups, "start").groupBy("node").agg(F.min("part").alias("part"))


def propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Metadata (pii, owner, tags) carried along edges in order of level: pii by or, tags by union, an owner only where
    all predecessors agree and none was given. Rows of one node are one: pii by or, tags by union, the owner if they name
    just one; pii is never null and tags are sorted, never null."""
    nodes = nodes.groupBy("node").agg(
        F.max(F.coalesce("pii", F.lit(False))).alias("pii"),
        F.when(F.countDistinct("owner") == 1, F.min("owner")).alias("owner"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"),
    )
    own = _small(nodes.select("node", "pii", "owner", "tags"), edges.select("src", "dst"))
    if own is not None:
        return edges.sparkSession.createDataFrame(_propagate_locally(*own), "node string, pii boolean, owner string, tags array<string>")
    order = cut(levels(edges))
    top = order.agg(F.max("level")).first()[0]
    state = cut(nodes.select("node", "pii", "owner", "tags"))
    for level in range(1, (top or 0) + 1):
        at = order.where(F.col("level") == level).select(F.col("node").alias("dst"))
        into = edges.select("src", "dst").distinct().join(at, "dst").join(state.withColumnRenamed("node", "src"), "src")
        got = into.groupBy("dst").agg(
            F.max(F.coalesce("pii", F.lit(False))).alias("g_pii"),
            F.when(F.countDistinct("owner") == 1, F.when(F.count("owner") == F.count(F.lit(1)), F.min("owner"))).alias("g_owner"),
            F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>"))))).alias("g_tags"),
        )
        joined = state.join(got.withColumnRenamed("dst", "node"), "node", "left")
        state = cut(joined.select(
            "node", (F.coalesce("pii", F.lit(False)) | F.coalesce("g_pii", F.lit(False))).alias("pii"), F.coalesce("owner", "g_owner").alias("owner"),
            F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("g_tags", F.array().cast("array<string>")))).alias("tags"),
        ))
    return state


def _propagate_locally(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    state = {n: (bool(pii), owner, set(tags or ())) for n, pii, owner, tags in nodes}
    before: dict[str, list[str]] = {}
    for a, b in edges:
        if a in state:
            before.setdefault(b, []).append(a)
    for n, level in sorted(((n, lv) for n, lv in _levels_locally([e for e in edges if e[0] != e[1]]) if lv), key=lambda x: x[1]):
        sources = [state[s] for s in before.get(n, ())]
        if n in state and sources:
            pii, owner, tags = state[n]
            owners = {o for _, o, _ in sources}
            state[n] = (pii or any(p for p, _, _ in sources), owner if owner is not None else next(iter(owners)) if len(owners) == 1 else None, tags.union(*(t for _, _, t in sources)))
    return [(n, pii, owner, sorted(tags)) for n, (pii, owner, tags) in state.items()]


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
