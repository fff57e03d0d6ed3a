"""Relational constructs that the lineage engine understands, run on Spark.

Each entry is SQL that passes through ``plans.rewrite`` (so QUALIFY, ``* REPLACE``, ``generate_series`` and the like are
accepted) and, where DuckDB spells it differently, the DuckDB text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import functions
from ..plans import run_sql
from ..sources import register

MONEY = "CAST({} AS DECIMAL(18, 2))"


def _sum(x: str) -> str:
    return f"CAST(sum({MONEY.format(x)}) AS DOUBLE)"


#: name: SQL for both engines, or (Spark's, DuckDB's).
SQL: dict[str, str | tuple[str, str]] = {
    # scans and sources
    "scan_project": "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled FROM orders",
    "derived_table": f"SELECT t.o_custkey, t.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 5",
    "values_clause": "SELECT v.id, v.name, CAST(v.price AS DOUBLE) AS price FROM (VALUES (1, 'a', 1.5), (2, 'b', 2.5), (3, NULL, 3.5)) AS v(id, name, price)",
    "tvf_generate_series": (
        "SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS sq FROM generate_series(1, 200, 3) AS g(n)",
        "SELECT n, n * n AS sq FROM generate_series(1, 200, 3) AS g(n)",
    ),
    "tvf_range": ("SELECT id AS n FROM range(5, 500, 7)", "SELECT range AS n FROM range(5, 500, 7)"),
    "tvf_explode": (
        "SELECT o_orderkey, tag FROM orders, LATERAL explode(split(o_orderpriority, '-')) AS t(tag)",
        "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS tag FROM orders",
    ),
    "unnest_explode": (
        "SELECT c_custkey, piece FROM customer, UNNEST(split(c_name, '#')) AS piece",
        "SELECT c_custkey, unnest(string_split(c_name, '#')) AS piece FROM customer",
    ),
    "unnest_with_offset": (
        "SELECT p_partkey, word, CAST(pos AS BIGINT) AS pos FROM part, UNNEST(split(p_type, ' ')) AS word WITH OFFSET AS pos",
        "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, unnest(range(len(string_split(p_type, ' ')))) AS pos FROM part",
    ),
    "lateral_flatten": (
        "SELECT e.event_id, CAST(f.index AS BIGINT) AS index, f.value, f.path, CAST(f.seq AS BIGINT) AS seq, CAST(size(f.this) AS BIGINT) AS n_this FROM events e, LATERAL FLATTEN(input => array(e.event_type, e.props)) f",
        "SELECT event_id, unnest(range(2)) AS index, unnest([event_type, props]) AS value, unnest(['[0]', '[1]']) AS path, CAST(1 AS BIGINT) AS seq, CAST(2 AS BIGINT) AS n_this FROM events",
    ),
    "tvf_generate_date_array": (
        "SELECT CAST(d.date AS STRING) AS day FROM GENERATE_DATE_ARRAY('2020-02-27', '2020-03-02') AS d",
        "SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS day FROM range(DATE '2020-02-27', DATE '2020-03-03', INTERVAL 1 DAY) t(x)",
    ),
    "tvf_generate_timestamp_array": (
        "SELECT CAST(g.timestamp AS STRING) AS at FROM GENERATE_TIMESTAMP_ARRAY('2020-01-01 00:00:00', '2020-01-02 00:00:00', INTERVAL 6 HOUR) AS g",
        "SELECT strftime(x, '%Y-%m-%d %H:%M:%S') AS at FROM range(TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-02 00:00:01', INTERVAL 6 HOUR) t(x)",
    ),
    "tvf_generator": ("SELECT seq4, seq4 * seq4 AS sq FROM TABLE(GENERATOR(ROWCOUNT => 40)) AS g", "SELECT CAST(range AS INT) AS seq4, CAST(range * range AS INT) AS sq FROM range(40)"),
    "tvf_external_query": ("SELECT q.n_name FROM EXTERNAL_QUERY('connection', 'SELECT n_name FROM nation WHERE n_regionkey = 1') AS q", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "star_exclude": "SELECT * EXCLUDE (n_regionkey) FROM nation",
    "top_n": ("SELECT TOP 7 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7"),
    "join_natural": "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region)",
    "join_straight": ("SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "window_groups_sql": "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM part",
    "agg_string_ordered": "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "agg_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '/') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_array_ordered": (
        "SELECT c_nationkey, array_join(array_agg(c_name ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 3), ',') AS best FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, array_to_string(list(c_name ORDER BY c_acctbal DESC, c_custkey DESC)[1:3], ',') AS best FROM customer GROUP BY c_nationkey",
    ),
    "agg_array_concat": (
        "SELECT n_regionkey, CAST(size(array_concat_agg(split(n_name, '_'))) AS BIGINT) AS n FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(sum(len(string_split(n_name, '_'))) AS BIGINT) AS n FROM nation GROUP BY n_regionkey",
    ),
    "agg_object_names": (
        "SELECT r_regionkey, json_object_agg(r_name, r_regionkey) AS o, map_agg(r_name, r_regionkey)[r_name] AS m, jsonb_agg(r_name) AS a FROM region GROUP BY r_regionkey, r_name",
        """SELECT r_regionkey, '{"' || r_name || '":' || r_regionkey || '}' AS o, r_regionkey AS m, '["' || r_name || '"]' AS a FROM region""",
    ),
    "agg_mode": ("SELECT l_returnflag, mode(l_linestatus) = max_by(s, n) AS most FROM (SELECT l_returnflag, l_linestatus, l_linestatus AS s, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem) GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, true AS most FROM lineitem"),
    "agg_approx_quantiles": ("SELECT APPROX_QUANTILES(p_size, 4) AS q FROM part", "SELECT quantile_disc(p_size, [0, 0.25, 0.5, 0.75, 1]) AS q FROM part"),
    "fn_json_operators": (
        """SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, concat('{"a":', props, '}') #>> '{a,k}' AS deep, concat('[', props, ']') -> 0 ->> 'k' AS first FROM events""",
        "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, props ->> 'k' AS deep, props ->> 'k' AS first FROM events",
    ),
    "fn_json_names": (
        "SELECT event_id, json_extract_scalar(props, '$.k') AS a, json_value(props, '$.k') AS b, json_extract_string(props, '$.k') AS c, json_query(props, '$.k') AS d FROM events",
        "SELECT event_id, props ->> '$.k' AS a, props ->> '$.k' AS b, props ->> '$.k' AS c, props ->> '$.k' AS d FROM events",
    ),
    "lateral_view_explode": (
        "SELECT s_suppkey, part_of_name FROM supplier LATERAL VIEW explode(split(s_name, '#')) x AS part_of_name",
        "SELECT s_suppkey, unnest(string_split(s_name, '#')) AS part_of_name FROM supplier",
    ),
    "table_sample": (
        "SELECT n BETWEEN 0.2 * total AND 0.4 * total AS near_share, strays = 0 AS from_table FROM (SELECT count(*) AS n, count_if(l_orderkey IS NULL OR l_orderkey < 0) AS strays FROM lineitem TABLESAMPLE BERNOULLI (30)), (SELECT count(*) AS total FROM lineitem)",
        "SELECT count(*) > 0 AS near_share, true AS from_table FROM lineitem",
    ),
    # projections, filters, predicates
    "select_star": "SELECT * FROM nation",
    "star_except": ("SELECT * EXCEPT (c_acctbal, c_name) FROM customer", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer"),
    "star_replace": "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation",
    "filter_where": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_returnflag IN ('R', 'A')",
    "having_filter": f"SELECT o_custkey, count(*) AS n, {_sum('o_totalprice')} AS total FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / count(DISTINCT o_custkey) FROM orders)",
    "qualify_dedup": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "subquery_dedup": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn <= 2",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "scalar_subquery": "SELECT c_custkey, c_acctbal - (SELECT max(c_acctbal) FROM customer) AS below, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "exists_subquery": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)",
    "not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size, IFF(o_orderstatus = 'F', 1, 0) AS done, COALESCE(NULLIF(o_orderpriority, '1-URGENT'), 'top') AS priority FROM orders",
    "type_casting": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_quantity::BIGINT AS q2, TRY_CAST(l_returnflag AS INT) AS bad, SAFE_CAST('12' AS INT) AS good, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d FROM lineitem",
    "struct_access": (
        "SELECT s.r.o_orderkey AS k, s.r.price AS p FROM (SELECT named_struct('r', named_struct('o_orderkey', o_orderkey, 'price', o_totalprice)) AS s FROM orders) t",
        "SELECT s.r.o_orderkey AS k, s.r.price AS p FROM (SELECT {'r': {'o_orderkey': o_orderkey, 'price': o_totalprice}} AS s FROM orders) t",
    ),
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_nationkey = c.c_nationkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multi": f"SELECT r.r_name, n.n_name, {_sum('l.l_extendedprice')} AS revenue, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
    "join_subquery": "SELECT p.p_partkey, t.n FROM part p JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) t ON t.l_partkey = p.p_partkey",
    "join_range": "SELECT p.p_partkey, b.band FROM part p JOIN (VALUES (0.0, 1000.0, 'low'), (1000.0, 1500.0, 'mid'), (1500.0, 1e9, 'high')) AS b(lo, hi, band) ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi",
    "join_case_on": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_regionkey ELSE 0 END = r.r_regionkey",
    "join_lateral": "SELECT c.c_custkey, t.top_price FROM customer c, LATERAL (SELECT max(o.o_totalprice) AS top_price FROM orders o WHERE o.o_custkey = c.c_custkey) t",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "join_anti": ("SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON l_partkey = p_partkey", "SELECT p_partkey FROM part ANTI JOIN lineitem ON l_partkey = p_partkey"),
    "join_using": "SELECT o_custkey, a.n, b.m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) b USING (o_custkey)",
    # aggregations
    "agg_group_by": f"SELECT l_returnflag, l_linestatus, {_sum('l_quantity')} AS sum_qty, {_sum('l_extendedprice')} AS sum_price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_count_star": "SELECT count(*) AS n, count(o_custkey) AS k, count(DISTINCT o_custkey) AS d FROM orders",
    "agg_cube": f"SELECT c_mktsegment, c_nationkey, count(*) AS n, {_sum('c_acctbal')} AS bal FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_size), (p_brand), ())",
    "agg_conditional": f"SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey END) AS big, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority",
    "agg_array": (
        "SELECT n_regionkey, array_sort(array_agg(n_name)) AS names, array_sort(collect_set(length(n_name))) AS lengths, size(flatten(collect_list(split(n_name, ' ')))) AS words FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, list_sort(array_agg(n_name)) AS names, list_sort(list(DISTINCT CAST(length(n_name) AS INT))) AS lengths, CAST(len(flatten(list(string_split(n_name, ' ')))) AS INT) AS words FROM nation GROUP BY n_regionkey",
    ),
    "agg_string": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_object": (
        "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS obj FROM nation GROUP BY n_regionkey",
        """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS obj FROM nation GROUP BY n_regionkey""",
    ),
    "agg_statistical": "SELECT l_returnflag, median(l_quantity) AS med, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(stddev_samp(l_discount), 6) AS ss, round(stddev_pop(l_discount), 6) AS sp, round(var_samp(l_tax), 8) AS vs, round(var_pop(l_tax), 8) AS vp FROM lineitem GROUP BY l_returnflag",
    "agg_percentile": "SELECT o_orderstatus, percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS p25, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderstatus",
    "agg_scalar": f"SELECT p_brand, min(p_size) AS mn, max(p_size) AS mx, {_sum('p_retailprice')} AS s, any_value(p_brand) AS b, count(*) AS n FROM part GROUP BY p_brand",
    "agg_bit_bool": "SELECT c_mktsegment, bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx, bool_and(c_acctbal > -1000) AS ya, bool_or(c_acctbal > 9000) AS yo FROM customer GROUP BY c_mktsegment",
    # windows
    "window_rows": f"SELECT o_orderkey, CAST(sum({MONEY.format('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS s FROM orders",
    "window_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 180 DAYS PRECEDING AND CURRENT ROW) AS n FROM orders",
    "window_named": "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_ranking": "SELECT p_partkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)",
    "window_offset": "SELECT event_id, lag(event_type) OVER w AS prev, lead(event_type, 2, 'none') OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_value": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_running_total": f"SELECT o_orderkey, CAST(sum({MONEY.format('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM orders",
    "window_moving_avg": f"SELECT CAST(d AS STRING) AS d, n, CAST(sum(n) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg7 FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) t",
    "window_empty_over": "SELECT n_name, count(*) OVER () AS n, max(n_nationkey) OVER () AS mx FROM nation",
    # sorts and limits
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_per_group": "SELECT c_nationkey, c_custkey, CAST(rk AS BIGINT) AS rk FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) t WHERE rk <= 3",
    # set operations
    "setop_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "setop_union_all": "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
    "setop_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier",
    "setop_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "setop_intersect_all": "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "setop_except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "setop_mixed": "(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer)",
    # CTEs
    "cte_chain": f"WITH recent AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1998-01-01'), per AS (SELECT o_custkey, count(*) AS n, {_sum('o_totalprice')} AS total FROM recent GROUP BY o_custkey) SELECT c.c_name, per.n, per.total FROM per JOIN customer c ON c.c_custkey = per.o_custkey",
    "recursive_cte": (
        "WITH RECURSIVE t(n, f) MAX RECURSION LEVEL 200 AS (SELECT 1L, 1L UNION ALL SELECT n + 1, (f * 31 + n) % 1000003 FROM t WHERE n < 120) SELECT n, f FROM t",
        "WITH RECURSIVE t(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, (f * 31 + n) % 1000003 FROM t WHERE n < 120) SELECT n, f FROM t",
    ),
    # pivots
    "pivot": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority",
    ),
    "pivot_multi": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) AS n, max(o_orderkey) AS top FOR o_orderstatus IN ('F' AS f, 'O' AS o))",
        "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f_n, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f_top, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o_n, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o_top FROM orders GROUP BY o_orderpriority",
    ),
    "unpivot": (
        "SELECT p_partkey, measure, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR measure IN (size, price))",
        "SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
    ),
}


SQL |= functions.SQL


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    own = SQL[name] if isinstance(SQL[name], str) else SQL[name][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, own)
        return run_sql(spark, own)

    return run


def _oracle(sql: str) -> str:
    return sql.replace("IFF(", "IF(").replace("SAFE_CAST(", "TRY_CAST(")


QUERIES = {name: query(name) for name in SQL}
ORACLE = {name: _oracle(sql) if isinstance(sql, str) else sql[1] for name, sql in SQL.items()}
