"""Queries over lineage graphs: a sample warehouse on the test tables, and the same walks over graphs in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..govern import frames
from ..graph import traverse
from ..lineage import Pipeline
from ..sources import table
from . import expected

TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}

STATEMENTS = [
    ("stg_customer", """CREATE TABLE staging.customer AS
SELECT
  c_custkey AS customer_id, -- Key of the customer [owner: crm, tags: key]
  c_name AS name, -- Full name [pii: true, owner: crm, tags: contact]
  c_acctbal AS balance, -- Account balance [owner: finance]
  c_nationkey AS nation_id
FROM customer"""),
    ("stg_orders", """CREATE TABLE staging.orders AS
WITH lines AS (
  SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_returnflag <> 'R'
)
SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, sum(lines.net) AS revenue
FROM orders o JOIN lines ON o.o_orderkey = lines.l_orderkey
GROUP BY o.o_orderkey, o.o_custkey"""),
    ("mart_revenue", """CREATE TABLE mart.revenue AS
SELECT c.customer_id, c.name, n.n_name AS nation, sum(o.revenue) AS revenue, count(o.order_id) AS n_orders
FROM staging.customer c
JOIN staging.orders o ON o.customer_id = c.customer_id
LEFT JOIN nation n ON n.n_nationkey = c.nation_id
GROUP BY c.customer_id, c.name, n.n_name"""),
    ("mart_nation", """CREATE TABLE mart.nation AS
SELECT nation, sum(revenue) AS revenue, row_number() OVER (ORDER BY sum(revenue) DESC) AS place FROM mart.revenue GROUP BY nation"""),
]

CHANGED = [(q, s.replace("c_acctbal AS balance", "c_acctbal * 100 AS balance").replace("count(o.order_id) AS n_orders", "max(o.order_id) AS last_order")) for q, s in STATEMENTS]


def warehouse(spark: SparkSession, statements: list | None = None) -> Pipeline:
    return Pipeline(spark, statements or STATEMENTS, schemas=TABLES)


def _values(columns: dict[str, str], rows: list[tuple]) -> str:
    """Expected rows, written out, as SQL."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    listed = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
    return f"SELECT {listed} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def lineage_trace_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ultimate sources of the mart's revenue."""
    start = spark.createDataFrame([("mart.revenue.revenue",)], "node string")
    return traverse.leaves(traverse.reversed_edges(warehouse(spark).edges()), start).select(F.col("node").alias("source"), "depth")


def lineage_trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("lineitem.l_discount",)], "node string")
    return traverse.leaves(warehouse(spark).edges(), start).select(F.col("node").alias("sink"), "depth")


def lineage_full_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("mart.nation.revenue",)], "node string")
    return traverse.reach(traverse.reversed_edges(warehouse(spark).edges()), start).select("node", "depth")


def lineage_full_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("customer.c_name",), ("orders.o_orderkey",)], "node string")
    return traverse.reach(warehouse(spark).edges(), start)


def lineage_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.shortest_path(warehouse(spark).edges(), "lineitem.l_extendedprice", "mart.nation.revenue")
    return found.select(F.array_join("path", " > ").alias("path"), "length")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed edges of the staging statement over orders."""
    return warehouse(spark).edges().where("query_id = 'stg_orders'").select("src", "dst", "edge_type")


def graph_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark)
    return traverse.simplify(w.edges(), w.nodes().where("full_name NOT LIKE '%:%'").select("full_name")).where("src LIKE 'lineitem.%'")


def graph_sources_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.sources_and_sinks(warehouse(spark).table_edges())


def table_topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.levels(warehouse(spark).table_edges())


def pipeline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.split_by_sinks(warehouse(spark).table_edges(), [["staging.orders"], ["mart.nation"]])


def metadata_comment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = warehouse(spark).nodes().where("owner IS NOT NULL")
    return own.select("full_name", "description", "owner", F.coalesce("pii", F.lit(False)).alias("pii"), F.array_join("tags", " ").alias("tags"))


def metadata_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark)
    nodes = w.nodes().select(F.col("full_name").alias("node"), "pii", "owner", "tags")
    value = w.edges().where("edge_type NOT IN ('where_filter', 'join_predicate')")
    return traverse.propagate(nodes, value).where("node LIKE 'mart.%'").select("node", "pii", "owner", F.array_join("tags", " ").alias("tags"))


def pipeline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = warehouse(spark), warehouse(spark, CHANGED)
    return frames.version_diff(a.nodes(), a.edges(), b.nodes(), b.edges())


def observed_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.observed_joins(warehouse(spark).join_predicates())


def candidate_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark, [*STATEMENTS, ("mart_contact", "CREATE TABLE mart.contact AS SELECT customer_id AS cid, name AS contact_name FROM staging.customer")])
    return frames.candidate_joins(w.nodes(), w.edges())


def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark)
    columns = w.nodes().where("full_name NOT LIKE '%:%'").select("table_name", "column_name", "description")
    return frames.keyword_rank(columns, "revenue by nation and customer name", w.table_edges())


def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.search_columns(warehouse(spark).nodes(), "REV")


def governance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.coverage(warehouse(spark).nodes())


def list_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.tag_counts(warehouse(spark).nodes())


def export_columns_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = warehouse(spark).nodes().where("layer = 'output'")
    return own.select("full_name", "table_name", "column_name", "layer", "node_type", "owner")


# walks over graphs in the data


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order: an edge for each reference."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = nation.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    e = e.union(customer.select(key("n", "c_nationkey"), key("c", "c_custkey")))
    return e.union(orders.select(key("c", "o_custkey"), key("o", "o_orderkey")))


_TRADE = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each region reaches, by depth."""
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return traverse.reach(_trade(spark, sf_dir), starts).groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n"))


def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.levels(_trade(spark, sf_dir)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def graph_simplify_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to orders, with nations and customers left out."""
    e = _trade(spark, sf_dir)
    kept = e.select(F.col("src").alias("node")).union(e.select("dst")).where("node LIKE 'r%' OR node LIKE 'o%'").distinct()
    return traverse.simplify(e, kept)


QUERIES = {
    f.__name__: f
    for f in (
        lineage_trace_backward, lineage_trace_forward, lineage_full_backward, lineage_full_forward, lineage_shortest_path, lineage_edges, graph_simplify, graph_sources_sinks, table_topo_levels, pipeline_split,
        metadata_comment_parse, metadata_propagate, pipeline_diff, observed_joins, candidate_joins, keyword_rank, search_columns, governance_quality, list_tags, export_columns_csv, graph_closure, graph_levels, graph_simplify_data,
    )
}

ORACLE = {
    "graph_closure": f"""WITH RECURSIVE {_TRADE}, t(start, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT t.start, e.dst, t.depth + 1 FROM t JOIN e ON t.node = e.src)
SELECT start, depth, count(*) AS n FROM t GROUP BY start, depth""",
    "graph_levels": f"""WITH RECURSIVE {_TRADE}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), t(node, level) AS (SELECT node, 0 FROM v WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, t.level + 1 FROM t JOIN e ON t.node = e.src)
SELECT level, count(*) AS n FROM (SELECT node, max(level) AS level FROM t GROUP BY node) GROUP BY level""",
    "graph_simplify_data": "SELECT DISTINCT 'r' || n_regionkey AS src, 'o' || o_orderkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
}


ORACLE |= {name: _values(columns, rows) for name, (columns, rows) in expected.ROWS.items()}


def _walk(start: list[str], back: bool, edges: list[tuple[str, str]] = expected.EDGES) -> str:
    """e (src, dst) and t (start, node, depth), every walk from the starts, as DuckDB's recursion finds them."""
    e = [(b, a) for a, b in edges] if back else edges
    listed = ", ".join(f"('{a}', '{b}')" for a, b in e)
    starts = ", ".join(f"('{s}')" for s in start)
    return f"""WITH RECURSIVE e(src, dst) AS (VALUES {listed}), s(node) AS (VALUES {starts}),
w(start, node, depth) AS (SELECT node, node, 0 FROM s UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON w.node = e.src WHERE w.depth < 30),
t AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY start, node)
"""


_NODES = sorted({n for e in expected.TABLE_EDGES for n in e})
ORACLE |= {
    "lineage_trace_backward": _walk(["mart.revenue.revenue"], True) + "SELECT node AS source, depth FROM t WHERE node NOT IN (SELECT src FROM e)",
    "lineage_trace_forward": _walk(["lineitem.l_discount"], False) + "SELECT node AS sink, depth FROM t WHERE node NOT IN (SELECT src FROM e)",
    "lineage_full_backward": _walk(["mart.nation.revenue"], True) + "SELECT node, depth FROM t",
    "lineage_full_forward": _walk(["customer.c_name", "orders.o_orderkey"], False) + "SELECT start, node, depth FROM t",
    "lineage_shortest_path": _walk(["lineitem.l_extendedprice"], False)
    + ", p(node, path, length) AS (SELECT 'lineitem.l_extendedprice', 'lineitem.l_extendedprice', 0 UNION ALL SELECT e.dst, p.path || ' > ' || e.dst, p.length + 1 FROM p JOIN e ON p.node = e.src) SELECT path, length FROM p WHERE node = 'mart.nation.revenue' ORDER BY length, path LIMIT 1",
    "graph_simplify": _walk([n for n in sorted({a for a, _ in expected.EDGES}) if n.startswith("lineitem.")], False)
    + ", i(start, node) AS (SELECT s.node, e.dst FROM s JOIN e ON e.src = s.node UNION SELECT i.start, e.dst FROM i JOIN e ON e.src = i.node WHERE i.node LIKE '%:%') SELECT start AS src, node AS dst FROM i WHERE node NOT LIKE '%:%'",
    "graph_sources_sinks": _walk(_NODES, False, expected.TABLE_EDGES) + "SELECT node, node NOT IN (SELECT dst FROM e) AS is_source, node NOT IN (SELECT src FROM e) AS is_sink FROM s",
    "table_topo_levels": _walk([n for n in _NODES if n not in {b for _, b in expected.TABLE_EDGES}], False, expected.TABLE_EDGES) + "SELECT node, max(depth) AS level FROM w GROUP BY node",
    "pipeline_split": _walk(["staging.orders", "mart.nation"], True, expected.TABLE_EDGES) + "SELECT node, min(CASE start WHEN 'staging.orders' THEN 0 ELSE 1 END) AS part FROM t GROUP BY node",
}
