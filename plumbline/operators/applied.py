"""Queries over the DataFrame operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import Pipeline
from ..sources import read_external, register, shared_folder, table
from . import changes, special


def _money(df: DataFrame, c: str) -> F.Column:
    return df[c].cast("decimal(18,2)")


def tvf_read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_external(spark, "read_parquet", f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")


def _written(spark: SparkSession, df: DataFrame, form: str) -> str:
    path = f"{shared_folder(spark)}/{form}-{uuid.uuid4().hex}"
    df.write.format(form).option("header", True).save(path)
    return path


def tvf_read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, table(spark, sf_dir, "nation"), "csv")
    return read_external(spark, "read_csv", path).select("n_nationkey", "n_name")


def tvf_read_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, table(spark, sf_dir, "nation"), "json")
    return read_external(spark, "read_ndjson", path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


def tvf_read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document: an array of rows."""
    rows = table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    return read_external(spark, "read_json", _written(spark, rows, "text")).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made by CREATE TABLE AS, rows inserted, and a view over it, all by running the pipeline; the view's rows."""
    name = f"made_{uuid.uuid4().hex}"
    statements = [
        ("make", f"CREATE TABLE {name} USING parquet LOCATION '{shared_folder(spark)}/{name}' AS SELECT s_suppkey AS id, s_name AS name FROM supplier"),
        ("add", f"INSERT INTO {name} SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000"),
        ("show", f"CREATE OR REPLACE TEMPORARY VIEW view_of_{name} AS SELECT id, name FROM {name}"),
    ]
    register(spark, sf_dir, " ".join(s for _, s in statements))
    out = Pipeline(spark, statements).run()
    if out["failed"]:
        raise RuntimeError(str(out["failed"]))
    return spark.table(f"view_of_{name}")


def window_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return special.over_groups(part, F.count(F.lit(1)), ["p_brand"], [F.col("p_size").asc()], 2, 1, "n")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return special.asof_join(clicks, bought, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    source = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return changes.merge(target, source, ["id"], delete_when=F.col("s_bal") < 0)


def update_emulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    return changes.update(part, part["p_size"] > 25, {"p_size": part["p_size"] + 100, "p_brand": F.lower("p_brand")})


def delete_emulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return changes.delete(orders, F.nullif(orders["o_orderstatus"], F.lit("P")) == "F")


def scd2_merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_nationkey <> 3").select("c_custkey", "c_name", "c_mktsegment", F.lit(1).alias("start_time"), F.lit(None).cast("int").alias("end_time"), F.lit(True).alias("is_active"))
    new = c.select("c_custkey", "c_name", F.when(c["c_acctbal"] < 0, "AT RISK").otherwise(c["c_mktsegment"]).alias("c_mktsegment"))
    return changes.scd2(old, new, "c_custkey", ["c_name", "c_mktsegment"], F.lit(2))


def latest_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return changes.latest_writer_before(e.where("event_type = 'purchase'"), e.where("event_type IN ('view', 'purchase')"), "user_id", "event_id")


def recursive_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statuses, priorities and segments reach each other over shared orders: a cyclic graph, closed."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    edges = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.col("o_orderpriority").alias("a"), F.col("c_mktsegment").alias("b")).distinct()
    edges = edges.union(edges.select("b", "a")).distinct()
    return special.recursive_distinct(edges, lambda new: new.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))


QUERIES = {
    f.__name__: f
    for f in (tvf_read_parquet, tvf_read_csv, tvf_read_ndjson, tvf_read_json, insert_select, window_groups, join_asof, merge_upsert, update_emulated, delete_emulated, scd2_merge_insert, latest_writer, recursive_union_distinct)
}

ORACLE = {
    "tvf_read_csv": "SELECT n_nationkey, n_name FROM nation",
    "tvf_read_ndjson": "SELECT n_nationkey, n_name FROM nation",
    "tvf_read_json": "SELECT n_nationkey, n_name FROM nation",
    "insert_select": "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000",
    "tvf_read_parquet": "SELECT s_suppkey, s_nationkey FROM supplier",
    "window_groups": "SELECT p_partkey, p_brand, p_size, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM part",
    "join_asof": """WITH p AS (SELECT user_id, ts, max(event_id) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT c.event_id, p.last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts""",
    "merge_upsert": """WITH s AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_nationkey < 5)
SELECT coalesce(t.s_suppkey, s.id) AS id, CASE WHEN s.id IS NULL THEN t.s_name ELSE s.name END AS name, CASE WHEN s.id IS NULL THEN t.s_acctbal ELSE s.bal END AS bal
FROM supplier t FULL OUTER JOIN s ON t.s_suppkey = s.id WHERE NOT (t.s_suppkey IS NOT NULL AND s.id IS NOT NULL AND s.bal < 0)""",
    "update_emulated": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN lower(p_brand) ELSE p_brand END AS p_brand FROM part",
    "delete_emulated": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)",
    "scd2_merge_insert": """WITH old AS (SELECT * FROM customer WHERE c_nationkey <> 3), new AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'AT RISK' ELSE c_mktsegment END AS seg FROM customer)
SELECT o.c_custkey, o.c_name, o.c_mktsegment, 1 AS start_time, CASE WHEN n.seg <> o.c_mktsegment THEN 2 END AS end_time, n.seg = o.c_mktsegment AS is_active FROM old o JOIN new n ON n.c_custkey = o.c_custkey
UNION ALL SELECT n.c_custkey, n.c_name, n.seg, 2, CAST(NULL AS INT), true FROM new n LEFT JOIN old o ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR o.c_mktsegment <> n.seg""",
    "latest_writer": """SELECT user_id, event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer
FROM events WHERE event_type IN ('view', 'purchase')""",
    "recursive_union_distinct": """WITH RECURSIVE e AS (SELECT DISTINCT o_orderpriority AS a, c_mktsegment AS b FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t(a, b) AS (SELECT a, b FROM g UNION SELECT t.a, g.b FROM t JOIN g ON t.b = g.a) SELECT a, b FROM t""",
}
