"""Scalar functions of the reference's corpus, run on Spark and compared with DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQL: dict[str, str | tuple[str, str]] = {
    "fn_string": (
        "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, c_name || '/' || c_mktsegment AS j, concat(c_name, '-', c_custkey) AS c, split(c_name, '#')[1] AS tail, length(c_name) AS n, trim('  x ') AS t, replace(c_name, 'Customer', 'C') AS r, lpad(c_mktsegment, 12, '.') AS p FROM customer",
        "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, c_name || '/' || c_mktsegment AS j, concat(c_name, '-', c_custkey) AS c, string_split(c_name, '#')[2] AS tail, CAST(length(c_name) AS INT) AS n, trim('  x ') AS t, replace(c_name, 'Customer', 'C') AS r, lpad(c_mktsegment, 12, '.') AS p FROM customer",
    ),
    "fn_regex": (
        r"SELECT p_partkey, regexp_like(p_type, '^[A-Z]') AS m, regexp_extract(p_name, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[0-9]', '9') AS masked, p_brand RLIKE '[13]$' AS odd FROM part",
        r"SELECT p_partkey, regexp_matches(p_type, '^[A-Z]') AS m, regexp_extract(p_name, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[0-9]', '9', 'g') AS masked, regexp_matches(p_brand, '[13]$') AS odd FROM part",
    ),
    "fn_hash": (
        "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM customer",
        "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer",
    ),
    "fn_date": (
        "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS mon, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, dayofweek(o_orderdate) - 1 AS dow, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS due, CAST(last_day(o_orderdate) AS STRING) AS eom FROM orders",
        "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS mon, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofweek(o_orderdate) AS INT) AS dow, CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS days, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS due, CAST(last_day(o_orderdate) AS VARCHAR) AS eom FROM orders",
    ),
    "fn_math": "SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18, 4)), 1) AS DOUBLE) AS r, greatest(p_size, 25) AS g, least(p_size, 25) AS l, abs(p_size - 25) AS a, p_size % 7 AS m, p_size / 4 AS d, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, power(p_size, 2) AS p FROM part",
    "fn_conditional": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s, if(o_totalprice > 150000, 'hi', 'lo') AS b, ifnull(nullif(o_orderpriority, '5-LOW'), 'none') AS p, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c FROM orders",
    "fn_array": (
        "SELECT p_partkey, split(p_type, ' ')[0] AS first, element_at(split(p_type, ' '), -1) AS last, size(split(p_type, ' ')) AS n, array_contains(split(p_type, ' '), 'TIN') AS tin, array_join(array_sort(split(p_type, ' ')), '+') AS sorted, array_join(slice(split(p_type, ' '), 1, 2), ' ') AS two FROM part",
        "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, string_split(p_type, ' ')[-1] AS last, CAST(len(string_split(p_type, ' ')) AS INT) AS n, list_contains(string_split(p_type, ' '), 'TIN') AS tin, array_to_string(list_sort(string_split(p_type, ' ')), '+') AS sorted, array_to_string(string_split(p_type, ' ')[1:2], ' ') AS two FROM part",
    ),
    "fn_map_struct": (
        "SELECT s_suppkey, map('k', s_nationkey, 'b', 7)['k'] AS k, element_at(map('k', s_nationkey), 'zz') AS none, named_struct('a', s_name, 'b', s_acctbal).a AS a, struct(s_suppkey AS x).x AS x FROM supplier",
        "SELECT s_suppkey, s_nationkey AS k, CAST(NULL AS INT) AS none, s_name AS a, s_suppkey AS x FROM supplier",
    ),
    "fn_transform": (
        "SELECT n_nationkey, array_join(transform(split(n_name, '_'), x -> lower(x)), '.') AS low, aggregate(transform(sequence(1, n_nationkey + 1), x -> x * x), 0, (a, x) -> a + x) AS sq, size(filter(split(n_name, ''), c -> c = 'N')) AS ns FROM nation",
        "SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, '_'), lambda x: lower(x)), '.') AS low, CAST(list_sum(list_transform(range(1, n_nationkey + 2), lambda x: x * x)) AS INT) AS sq, CAST(length(n_name) - length(replace(n_name, 'N', '')) AS INT) AS ns FROM nation",
    ),
    "fn_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k + 1 AS k1, get_json_object(props, '$.missing') AS none, t.v AS tupled FROM events, LATERAL json_tuple(props, 'k') AS t(v)",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1, json_extract_string(props, '$.missing') AS none, json_extract_string(props, '$.k') AS tupled FROM events",
    ),
    "fn_variant": (
        "SELECT event_id, CAST(parse_json(props):k AS BIGINT) AS k, CAST(variant_get(parse_json(props), '$.k', 'int') AS BIGINT) * 2 AS doubled FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS doubled FROM events",
    ),
}


def json_path(path: str) -> str:
    """The path of a JSON function as $.a.b: brackets, quotes and leading dots are one spelling."""
    import re

    parts = re.findall(r"""\[\s*['"]?([^\]'"]+)['"]?\s*\]|([^.\[\]$:'"{},\s]+)""", path)
    out = "$"
    for bracket, plain in parts:
        p = bracket or plain
        out += f"[{p}]" if p.isdigit() or p == "*" else f".{p}"
    return out


def approx_quantiles(column: Column, n: int) -> Column:
    """n + 1 boundaries of n equal parts."""
    return F.percentile_approx(column, [i / n for i in range(n + 1)], 10_000)
