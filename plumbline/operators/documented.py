"""Small statements and pipelines whose lineage, issues and products were written down by hand from their text.

Each entry's expected rows stand next to its statement, so they can be checked by reading; none was recorded from the
engine. Queries return what the engine makes of the statement, oracles the rows written here.
"""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..export import dot, files, orchestrators
from ..govern import frames
from ..graph import traverse
from ..lineage import LineageBuilder, Pipeline, templates
from ..lineage.paths import read_sql_files
from ..lineage.registry import AGGREGATE_TYPE, TVF_COLUMNS
from ..lineage.trace import Tracer
from ..plans import rewrite
from ..tools import context, create_registry, server
from ..tools.agent import ask
from ..tools.catalog import generate_descriptions
from ..tools.safety import check_sql, for_prompt

Rows = list[tuple]


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(columns: dict[str, str], rows: Rows) -> str:
    """Rows as SQL."""
    listed = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
    if not rows:
        return f"SELECT {listed} FROM (SELECT {', '.join(f'NULL AS {c}' for c in columns)}) WHERE false"
    return f"SELECT {listed} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(columns)})"


_SPARK = {"VARCHAR": "string", "BIGINT": "long", "BOOLEAN": "boolean"}


def frame(spark: SparkSession, columns: dict[str, str], rows: Rows) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{c} {_SPARK[t]}" for c, t in columns.items()))


EDGE = {"src": "VARCHAR", "dst": "VARCHAR", "edge_type": "VARCHAR"}

#: name: (statement, columns of tables, edges). What each edge says: the column read, the column it goes into, how.
EDGES: dict[str, tuple[str, dict[str, list[str]], Rows]] = {
    "case_schema_qualification": (
        "SELECT x, y FROM a JOIN b ON a.id = b.id", {"a": ["id", "x"], "b": ["id", "y"]},
        [("a.x", "output.x", "direct_column"), ("b.y", "output.y", "direct_column")],
    ),
    "case_nested_access": ("SELECT after.id, arr[0] AS f FROM raw", {}, [("raw.after", "output.id", "direct_column"), ("raw.arr", "output.f", "expression")]),
    "case_json_operators": ("SELECT j ->> 'a' AS a, j #>> '{b,c}' AS c FROM raw", {}, [("raw.j", "output.a", "expression"), ("raw.j", "output.c", "expression")]),
    "case_straight_join": ("SELECT b.y FROM a STRAIGHT_JOIN b ON a.id = b.id", {}, [("b.y", "output.y", "direct_column"), ("a.id", "output.y", "join_predicate"), ("b.id", "output.y", "join_predicate")]),
    "case_window_frame": (
        "SELECT sum(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM t", {},
        [("t.v", "output.s", "window"), ("t.k", "output.s", "window"), ("t.d", "output.s", "window"), ("t.v", "output.s", "window_aggregate"), ("t.k", "output.s", "window_partition"), ("t.d", "output.s", "window_order")],
    ),
    "case_positional_union": (
        "SELECT a, b FROM t UNION ALL SELECT c, d FROM u", {},
        [("t.a", "branch_0.a", "direct_column"), ("t.b", "branch_0.b", "direct_column"), ("u.c", "branch_1.c", "direct_column"), ("u.d", "branch_1.d", "direct_column"),
         ("branch_0.a", "output.a", "union"), ("branch_1.c", "output.a", "union"), ("branch_0.b", "output.b", "union"), ("branch_1.d", "output.b", "union")],
    ),
    "case_delete_using": ("DELETE FROM t USING s WHERE t.id = s.id", {}, [("s.id", "t.id", "merge_match")]),
    "case_update_from": ("UPDATE t SET v = s.w FROM s WHERE t.id = s.id", {}, [("s.id", "t.id", "merge_match"), ("s.w", "t.v", "merge_update")]),
    "case_exclude": ("SELECT * EXCLUDE (b) FROM t", {"t": ["a", "b", "c"]}, [("t.a", "output.a", "star_passthrough"), ("t.c", "output.c", "star_passthrough")]),
    "case_cube": (
        "SELECT r, sum(s) AS t FROM d GROUP BY ROLLUP (r, p)", {},
        [("d.r", "output.r", "direct_column"), ("d.s", "output.t", "aggregate"), ("d.r", "output.t", "grouping_rollup"), ("d.p", "output.t", "grouping_rollup")],
    ),
    "case_scalar_subquery": ("SELECT (SELECT max(c) AS m FROM u) AS x FROM t", {}, [("u.c", "select_subq_0.m", "aggregate"), ("select_subq_0.m", "output.x", "expression")]),
    "case_qualify": (
        "SELECT c, o FROM t QUALIFY row_number() OVER (PARTITION BY c ORDER BY d) = 1", {},
        [("t.c", "output.c", "direct_column"), ("t.o", "output.o", "direct_column"), ("t.c", "output.c", "qualify_partition"), ("t.d", "output.c", "qualify_order")],
    ),
    "case_table_engine": (
        "CREATE OR REPLACE TABLE mart.x ENGINE = MergeTree() ORDER BY tuple() AS SELECT c.id, count(o.id) AS n FROM cust c, ord o WHERE o.cid = c.id GROUP BY c.id", {},
        [("cust.id", "output.id", "direct_column"), ("ord.id", "output.n", "aggregate"), ("ord.cid", "output.id", "where_filter"), ("cust.id", "output.id", "where_filter"), ("ord.cid", "output.n", "where_filter"), ("cust.id", "output.n", "where_filter")],
    ),
}

ISSUE = {"severity": "VARCHAR", "category": "VARCHAR"}

#: name: (statement, columns of tables, issues).
ISSUES: dict[str, tuple[str, dict[str, list[str]], Rows]] = {
    "issue_star_of_several_sources": ("SELECT * FROM a, b", {"a": ["x"], "b": ["y"]}, [("error", "unqualified_star_multiple_tables")]),
    "issue_star_without_schema": ("SELECT * FROM t", {}, [("info", "star_without_schema")]),
    "issue_star_with_empty_schema": ("SELECT * FROM t", {"t": []}, [("warning", "missing_schema_info")]),
    "issue_unqualified_column": ("SELECT x FROM a JOIN b ON a.id = b.id", {}, [("warning", "unqualified_column")]),
    "issue_missing_alias": ("SELECT a + 1 FROM t", {}, [("info", "missing_alias")]),
    "issue_duplicate_column": ("SELECT y AS d, z AS d FROM t", {}, [("warning", "duplicate_column")]),
}

SHOP = [
    ("stg", "CREATE TABLE stg.o AS SELECT id, cust, amount * 2 AS amount FROM raw.o WHERE state = 'ok'"),
    ("cust", "CREATE TABLE stg.c AS SELECT id, name, -- Full name [pii: true, owner: crm]\n city FROM raw.c"),
    ("mart", "CREATE TABLE mart.r AS SELECT c.name, sum(o.amount) AS revenue FROM stg.o o JOIN stg.c c ON o.cust = c.id GROUP BY c.name"),
    ("again", "CREATE TABLE mart.u AS SELECT id, name FROM stg.c JOIN mart.r USING (name)"),
]
#: Which table of SHOP derives from which.
SHOP_TABLES = [("raw.o", "stg.o"), ("raw.c", "stg.c"), ("stg.o", "mart.r"), ("stg.c", "mart.r"), ("stg.c", "mart.u"), ("mart.r", "mart.u")]


def shop(spark: SparkSession) -> Pipeline:
    return Pipeline(spark, SHOP)


Made = Callable[[SparkSession, str], Rows]
#: name: (columns, how the rows are made, the rows written down).
CASES: dict[str, tuple[dict[str, str], Made, Rows]] = {}


def case(name: str, columns: dict[str, str], rows: Rows) -> Callable[[Made], Made]:
    def keep(make: Made) -> Made:
        CASES[name] = (columns, make, rows)
        return make

    return keep


TABLE_PAIR = {"src": "VARCHAR", "dst": "VARCHAR"}
FULL_NAME, SAID = {"full_name": "VARCHAR"}, {"said": "VARCHAR"}


def _pairs(p: Pipeline) -> Rows:
    return [(s, q.destination) for q in p.queries.values() for s in q.sources if q.destination]


@case("source_sql_directory", TABLE_PAIR, SHOP_TABLES)
def _(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        for i, (name, sql) in enumerate(SHOP):
            with open(os.path.join(folder, f"{i}_{name}.sql"), "w") as f:
                f.write(sql)
        return _pairs(Pipeline.from_sql_files(spark, folder))


@case("source_dbt_project", {"src": "VARCHAR", "dst": "VARCHAR"}, [("raw.a", "staging.stg_a"), ("staging.stg_a", "marts.m")])
def _(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        for layer, name, sql in (("staging", "stg_a", "SELECT id FROM {{ source('raw', 'a') }}"), ("marts", "m", "SELECT id FROM {{ ref('stg_a') }}")):
            os.makedirs(os.path.join(folder, layer))
            with open(os.path.join(folder, layer, f"{name}.sql"), "w") as f:
                f.write(sql)
        given = {"source": lambda s, t: f"{s}.{t}", "ref": lambda m: f"staging.{m}"}
        return _pairs(Pipeline.from_dbt_models(spark, folder, template_context=given))


@case("source_collections", {"kind": "VARCHAR", "n_statements": "BIGINT"}, [("tuples", 4), ("dict", 4), ("list", 4), ("string", 4), ("json", 4)])
def _(spark, sf_dir):
    own = {
        "tuples": Pipeline.from_tuples(spark, SHOP), "dict": Pipeline.from_dict(spark, dict(SHOP)), "list": Pipeline.from_sql_list(spark, [s for _, s in SHOP]),
        "string": Pipeline.from_sql_string(spark, ";\n".join(s for _, s in SHOP)), "json": Pipeline.from_json(spark, json.loads(json.dumps(shop(spark).to_json()))),
    }
    return [(k, len(p.queries)) for k, p in own.items()]


@case("sink_json_export", TABLE_PAIR, SHOP_TABLES)
def _(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "p.json")
        files.write_json(shop(spark), path)
        return _pairs(Pipeline.from_json_file(spark, path))


@case("sink_tables_csv", {"line": "VARCHAR"}, [("mart.r",), ("mart.u",), ("raw.c",), ("raw.o",), ("stg.c",), ("stg.o",)])
def _(spark, sf_dir):
    return [(line.split(",")[0],) for line in files.tables_csv(shop(spark)).splitlines()[1:]]


@case("sink_dot_table_dependencies", {"arrows": "BIGINT", "boxes": "BIGINT"}, [(6, 6)])
def _(spark, sf_dir):
    lines = dot.table_dependencies(shop(spark)).splitlines()
    return [(sum(" -> " in x for x in lines), sum("[label=" in x and " -> " not in x for x in lines))]


@case("sink_dot_structure", SAID, [("c -> output",), ("t -> c",)])
def _(spark, sf_dir):
    found = dot.structure_from_lineage(LineageBuilder(spark, "WITH c AS (SELECT a FROM t) SELECT a FROM c").build())
    return [(x.strip().rstrip(";").replace('"', ""),) for x in found.splitlines() if " -> " in x]


@case("safe_file_reading", {"name": "VARCHAR", "refused": "BOOLEAN"}, [("a.sql", False), ("../x.sql", True), ("*.py", True)])
def _(spark, sf_dir):
    out = []
    with tempfile.TemporaryDirectory() as folder:
        with open(os.path.join(folder, "a.sql"), "w") as f:
            f.write("SELECT 1")
        for pattern in ("a.sql", "../x.sql", "*.py"):
            try:
                read_sql_files(folder, pattern)
                out.append((pattern, False))
            except ValueError:
                out.append((pattern, True))
    return out


@case("tvf_default_columns", {"function": "VARCHAR", "columns": "VARCHAR"}, [
    ("generate_series", "generate_series"), ("generate_date_array", "date"), ("generate_timestamp_array", "timestamp"), ("sequence", "value"), ("generator", "seq4"), ("range", "range"),
    ("flatten", "value index key path this"), ("explode", "col"), ("posexplode", "pos col"),
])
def _(spark, sf_dir):
    return [(f, " ".join(c)) for f, c in TVF_COLUMNS.items() if not f.endswith("_outer")]


@case("aggregate_registry", {"function": "VARCHAR", "kind": "VARCHAR"}, [
    ("array_agg", "array"), ("array_concat_agg", "array"), ("collect_list", "array"), ("collect_set", "array"), ("string_agg", "string"), ("listagg", "string"), ("group_concat", "string"),
    ("object_agg", "object"), ("map_agg", "object"), ("json_agg", "object"), ("jsonb_agg", "object"), ("json_object_agg", "object"), ("jsonb_object_agg", "object"),
    ("percentile_cont", "statistical"), ("percentile_disc", "statistical"), ("approx_quantiles", "statistical"), ("median", "statistical"), ("mode", "statistical"), ("corr", "statistical"),
    ("covar_pop", "statistical"), ("covar_samp", "statistical"), ("stddev", "statistical"), ("variance", "statistical"), ("sum", "scalar"), ("count", "scalar"), ("avg", "scalar"), ("min", "scalar"), ("max", "scalar"),
    ("any_value", "scalar"), ("bit_and", "scalar"), ("bit_or", "scalar"), ("bit_xor", "scalar"),
])
def _(spark, sf_dir):
    return [(f, AGGREGATE_TYPE.get(f)) for f, _ in CASES["aggregate_registry"][2]]


@case("aggregate_specification", {"dst": "VARCHAR", "src": "VARCHAR", "edge_type": "VARCHAR"}, [("output.s", "t.x", "aggregate"), ("output.s", "t.o", "aggregate"), ("output.a", "t.y", "aggregate"), ("output.a", "t.o", "aggregate"), ("output.d", "t.z", "aggregate")])
def _(spark, sf_dir):
    g = LineageBuilder(spark, "SELECT string_agg(x, ',' ORDER BY o) AS s, array_agg(y ORDER BY o DESC LIMIT 3) AS a, count(DISTINCT z) AS d FROM t").build()
    return [(e.dst, e.src, e.edge_type) for e in g.edges]


@case("window_output_names", {"column_name": "VARCHAR"}, [("a",), ("_col1",)])
def _(spark, sf_dir):
    b = LineageBuilder(spark, "SELECT a, row_number() OVER (ORDER BY a) FROM t")
    b.build()
    return [(c,) for c in b.units["main"].columns]


@case("issue_count_star_of_several_sources", {"full_name": "VARCHAR", "warned": "BOOLEAN"}, [("output.n", True), ("output.m", False)])
def _(spark, sf_dir):
    several = LineageBuilder(spark, "SELECT count(*) AS n FROM a JOIN b ON a.id = b.id").build()
    one = LineageBuilder(spark, "SELECT count(*) AS m FROM a").build()
    return [(n.full_name, bool(n.warnings)) for g in (several, one) for n in g.nodes.values() if n.layer == "output"]


@case("lineage_statement_backward", {"part": "VARCHAR", "name": "VARCHAR"}, [("input", "t.x"), ("cte", "c"), ("path", "t.x > c.y > output.z")])
def _(spark, sf_dir):
    found = Tracer(LineageBuilder(spark, "WITH c AS (SELECT x AS y FROM t) SELECT y AS z FROM c").build()).lineage(["z"], False)
    return [*(("input", n) for n in found["required_inputs"]), *(("cte", c) for c in found["required_ctes"]), *(("path", " > ".join([p["input"], *p["intermediate"], p["output"]])) for p in found["paths"])]


@case("lineage_statement_forward", {"part": "VARCHAR", "name": "VARCHAR"}, [("output", "output.p"), ("output", "output.q")])
def _(spark, sf_dir):
    found = Tracer(LineageBuilder(spark, "SELECT a + 1 AS p, a * b AS q, b AS r FROM t").build()).lineage(["a"], True)
    return [("output", n) for n in found["impacted_outputs"]]


@case("lineage_table_walk", {"table_name": "VARCHAR", "column_name": "VARCHAR"}, [("mart.r", "revenue"), ("stg.o", "amount"), ("raw.o", "amount"), ("raw.o", "state")])
def _(spark, sf_dir):
    return [(t, c) for t, c, _ in Tracer(shop(spark).graph).tables("mart.r.revenue", False)]


@case("lineage_simplified_statement", TABLE_PAIR, [("t.x", "q_result.z")])
def _(spark, sf_dir):
    return Pipeline(spark, [("q", "WITH c AS (SELECT x AS y FROM t) SELECT y AS z FROM c")]).simplified()


@case("pipeline_run_order", {"query_id": "VARCHAR", "place": "BIGINT"}, [("stg", 0), ("cust", 0), ("mart", 1), ("again", 2)])
def _(spark, sf_dir):
    p, ran = shop(spark), []
    names = {q.sql: q.query_id for q in p.queries.values()}
    out = p.run(lambda sql: ran.append(names[sql]))
    level = {q: i for i, own in enumerate(p.execution_levels()) for q in own}
    assert sorted(ran) == sorted(out["completed"]) and [level[q] for q in ran] == sorted(level[q] for q in ran)
    return [(q, level[q]) for q in ran]


@case("observed_joins_using", {"a": "VARCHAR", "b": "VARCHAR", "n_queries": "BIGINT"}, [("stg.c.id", "stg.o.cust", 1), ("mart.r.name", "stg.c.name", 1)])
def _(spark, sf_dir):
    return [tuple(r) for r in frames.observed_joins(shop(spark).join_predicates()).collect()]


@case("lineage_expansion", {"table_name": "VARCHAR", "depth": "BIGINT"}, [("mart.u", 0), ("mart.r", 1), ("stg.c", 1), ("stg.o", 2), ("raw.c", 2)])
def _(spark, sf_dir):
    found = frames.expand_tables(shop(spark).table_edges(), spark.createDataFrame([("mart.u",)], "table_name string"), 2)
    assert sorted(r.table_name for r in found.collect()) == sorted(context.expand_with_lineage(shop(spark), ["mart.u"], 2))
    return [tuple(r) for r in found.collect()]


@case("prompt_text", {"line": "VARCHAR"}, [
    ("How tables derive:",), ("  raw.c -> stg.c (by cust)",), ("  raw.o -> stg.o (by stg)",), ("Where columns come from:",), ("  stg.o.id <- raw.o.id, raw.o.state",),
])
def _(spark, sf_dir):
    p = shop(spark)
    text = context.relationship_context(p, ["raw.o", "stg.o", "raw.c", "stg.c"]) + "\n" + context.lineage_context(p, "stg.o", ["id"])
    return [(x,) for x in text.splitlines()]


@case("tool_lineage", FULL_NAME, [("raw.o.amount",), ("raw.o.state",)])
def _(spark, sf_dir):
    found = create_registry(shop(spark)).run("trace_backward", table="stg.o", column="amount")
    return [(f"{n['table']}.{n['column']}",) for n in found.data]


@case("tool_sql_generation", SAID, [("SELECT name FROM mart.r",), ("refused",)])
def _(spark, sf_dir):
    good = create_registry(shop(spark), lambda prompt: "```sql\nSELECT name FROM mart.r\n```").run("generate_sql", question="names?")
    bad = create_registry(shop(spark), lambda prompt: "DROP TABLE mart.r").run("generate_sql", question="names?")
    return [(good.data["sql"],), ("refused" if not bad.success else "taken",)]


@case("description_generation", {"full_name": "VARCHAR", "description": "VARCHAR", "source": "VARCHAR"}, [("stg.c.id", "The id", "generated"), ("stg.c.name", "Full name", None), ("stg.c.city", "The city", "generated")])
def _(spark, sf_dir):
    p = Pipeline(spark, [SHOP[1]])
    generate_descriptions(p, lambda prompt: f"The {prompt.split('column ')[1].split(' in ')[0].rpartition('.')[2]}")
    return [(n.full_name, n.metadata.description, n.description_source if n.metadata.description != "Full name" else None) for n in p.graph.nodes.values() if n.table_name == "stg.c"]


@case("prompt_sanitising", {"given": "VARCHAR", "said": "VARCHAR"}, [("a<b>c", "a&lt;b&gt;c"), ("x​y", "xy"), ("plain", "plain")])
def _(spark, sf_dir):
    return [(t, for_prompt(t)) for t in ("a<b>c", "x​y", "plain")]


@case("sql_checking", {"sql": "VARCHAR", "allowed": "BOOLEAN"}, [("SELECT 1", True), ("DELETE FROM t", False), ("SELECT 1; SELECT 2", False), ("SELEKT", False)])
def _(spark, sf_dir):
    return [(s, check_sql(spark, s) is None) for s in ("SELECT 1", "DELETE FROM t", "SELECT 1; SELECT 2", "SELEKT")]


@case("agent_tools_chosen", {"question": "VARCHAR", "tool": "VARCHAR"}, [
    ("Where does mart.r.revenue come from?", "trace_backward"), ("What is affected by raw.o.amount?", "trace_forward"), ("Which tables are there?", "list_tables"), ("Which columns hold pii?", "find_pii_columns"),
])
def _(spark, sf_dir):
    registry = create_registry(shop(spark))
    return [(q, ask(registry, q).tool) for q, _ in CASES["agent_tools_chosen"][2]]


@case("context_server", {"id": "BIGINT", "said": "VARCHAR"}, [(1, "plumbline"), (2, "raw.o.id"), (3, "-32601"), (4, "pipeline://schema")])
def _(spark, sf_dir):
    calls = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/call", "params": {"name": "trace_backward", "arguments": {"table": "stg.o", "column": "id"}}},
        {"id": 3, "method": "nothing"}, {"id": 4, "method": "resources/list"},
    ]
    out = io.StringIO()
    server.serve(create_registry(shop(spark)), io.StringIO("\n".join(json.dumps({"jsonrpc": "2.0"} | c) for c in calls)), out)
    said = {}
    for reply in map(json.loads, out.getvalue().splitlines()):
        r = reply.get("result", {})
        said[reply["id"]] = str(reply["error"]["code"]) if "error" in reply else r["serverInfo"]["name"] if "serverInfo" in r else r["resources"][0]["uri"] if "resources" in r else "raw.o.id" if '"raw.o"' in r["content"][0]["text"] and '"id"' in r["content"][0]["text"] else "?"
    return sorted(said.items())


@case("orchestrator_definitions", {"kind": "VARCHAR", "tasks": "BIGINT"}, [("airflow", 4), ("dagster", 4), ("prefect", 4), ("kestra", 4), ("mage", 4)])
def _(spark, sf_dir):
    p = shop(spark)
    return [
        ("airflow", orchestrators.airflow_dag(p, "d").count("@task(")), ("dagster", orchestrators.dagster_assets(p).count("@asset")), ("prefect", orchestrators.prefect_flow(p, "f").count("@task")),
        ("kestra", sum(orchestrators.kestra_flow(p, "f", "n").count(f"id: {q}\n") + orchestrators.kestra_flow(p, "f", "n").count(f'id: "{q}"') > 0 for q in p.queries)), ("mage", len(orchestrators.mage_blocks(p))),
    ]


@case("templates_resolved", SAID, [("SELECT * FROM db.a JOIN t_dev",)])
def _(spark, sf_dir):
    return [(templates.resolve("SELECT * FROM {{ ref('a') }} JOIN t_{{ env }}", {"env": "dev", "ref": lambda m: f"db.{m}"}),)]


@case("command_line_analyze", {"key": "VARCHAR", "n": "BIGINT"}, [("queries", 4), ("tables", 6)])
def _(spark, sf_dir):
    p = shop(spark).to_json()
    return [("queries", len(p["queries"])), ("tables", len(p["tables"]))]


@case("ddl_without_query", {"query_id": "VARCHAR", "errors": "BIGINT"}, [("db", 0), ("table", 0)])
def _(spark, sf_dir):
    p = Pipeline(spark, [("db", "CREATE DATABASE IF NOT EXISTS raw"), ("table", "CREATE TABLE raw.t (id String, at DateTime, n Nullable(UInt32)) ENGINE = MergeTree() ORDER BY id")], dialect="clickhouse")
    return [(q, sum(i.severity == "error" and i.query_id == q for i in p.graph.issues)) for q in ("db", "table")]


@case("dialect_rewrites", {"given": "VARCHAR", "said": "VARCHAR"}, [
    ("SELECT TOP 3 a FROM t", "SELECT a FROM t LIMIT 3"), ("SELECT a FROM t TABLESAMPLE BERNOULLI (10)", "SELECT a FROM t TABLESAMPLE (10 PERCENT)"),
    ("SELECT dateDiff('day', a, b) AS d FROM t", "SELECT dateDiff(DAY, a, b) AS d FROM t"), ("SELECT j -> 'a' ->> 'b' AS x FROM t", "SELECT GET_JSON_OBJECT(GET_JSON_OBJECT(j, '$.a'), '$.b') AS x FROM t"),
    ("SELECT group_concat(a SEPARATOR ';') AS x FROM t", "SELECT LISTAGG(a, ';') AS x FROM t"), ("SELECT transform(a, x -> 1) AS y FROM t", "SELECT transform(a, x -> 1) AS y FROM t"),
])
def _(spark, sf_dir):
    return [(s, rewrite(s)) for s, _ in CASES["dialect_rewrites"][2]]


#: All edges of SHOP, by statement: what is read, what it goes into, how. A filter touches every output; a join's columns
#: touch the outputs that name its right side; grouping leaves no edge of its own.
@case("shop_edges", EDGE, [
    ("raw.o.id", "stg.o.id", "direct_column"), ("raw.o.cust", "stg.o.cust", "direct_column"), ("raw.o.amount", "stg.o.amount", "expression"),
    ("raw.o.state", "stg.o.id", "where_filter"), ("raw.o.state", "stg.o.cust", "where_filter"), ("raw.o.state", "stg.o.amount", "where_filter"),
    ("raw.c.id", "stg.c.id", "direct_column"), ("raw.c.name", "stg.c.name", "direct_column"), ("raw.c.city", "stg.c.city", "direct_column"),
    ("stg.c.name", "mart.r.name", "direct_column"), ("stg.o.amount", "mart.r.revenue", "aggregate"), ("stg.o.cust", "mart.r.name", "join_predicate"), ("stg.c.id", "mart.r.name", "join_predicate"),
    ("stg.c.id", "mart.u.id", "direct_column"), ("stg.c.name", "mart.u.name", "direct_column"),
])
def _(spark, sf_dir):
    return [(r.src, r.dst, r.edge_type) for r in shop(spark).edges().collect()]


@case("shop_sources_of_all_outputs", {"output": "VARCHAR", "source": "VARCHAR"}, [
    ("stg.o.id", "raw.o.id"), ("stg.o.id", "raw.o.state"), ("stg.o.cust", "raw.o.cust"), ("stg.o.cust", "raw.o.state"), ("stg.o.amount", "raw.o.amount"), ("stg.o.amount", "raw.o.state"),
    ("stg.c.id", "raw.c.id"), ("stg.c.name", "raw.c.name"), ("stg.c.city", "raw.c.city"), ("mart.r.name", "raw.c.name"), ("mart.r.name", "raw.c.id"), ("mart.r.name", "raw.o.cust"), ("mart.r.name", "raw.o.state"),
    ("mart.r.revenue", "raw.o.amount"), ("mart.r.revenue", "raw.o.state"), ("mart.u.id", "raw.c.id"), ("mart.u.name", "raw.c.name"),
])
def _(spark, sf_dir):
    p = shop(spark)
    starts = p.nodes().where("layer = 'output'").selectExpr("full_name AS node")
    found = traverse.reach(traverse.reversed_edges(p.edges()), starts)
    return [(r.start, r.node) for r in found.collect() if r.node.startswith("raw.")]


@case("shop_comments", {"full_name": "VARCHAR", "description": "VARCHAR", "owner": "VARCHAR", "pii": "BOOLEAN"}, [("stg.c.name", "Full name", "crm", True)])
def _(spark, sf_dir):
    return [(r.full_name, r.description, r.owner, r.pii) for r in shop(spark).nodes().where("owner IS NOT NULL OR description IS NOT NULL OR pii").collect()]


#: Personal data spreads along values, both to what is made of it and to what it is made of.
@case("shop_personal_data", FULL_NAME, [("stg.c.name",), ("raw.c.name",), ("mart.r.name",), ("mart.u.name",)])
def _(spark, sf_dir):
    p = shop(spark)
    p.propagate_metadata()
    return [(n.full_name,) for n in p.pii_columns()]


@case("shop_columns_csv", {"full_name": "VARCHAR"}, [
    (f"{t}.{c}",) for t, own in (("raw.o", "id cust amount state"), ("raw.c", "id name city"), ("stg.o", "id cust amount"), ("stg.c", "id name city"), ("mart.r", "name revenue"), ("mart.u", "id name")) for c in own.split()
])
def _(spark, sf_dir):
    lines = list(csv.reader(io.StringIO(files.columns_csv(shop(spark)))))
    return [(dict(zip(lines[0], x))["full_name"],) for x in lines[1:]]


@case("shop_coverage", {"table_name": "VARCHAR", "n_columns": "BIGINT", "described": "BIGINT", "owned": "BIGINT"}, [("raw.o", 4, 0, 0), ("raw.c", 3, 0, 0), ("stg.o", 3, 0, 0), ("stg.c", 3, 1, 1), ("mart.r", 2, 0, 0), ("mart.u", 2, 0, 0)])
def _(spark, sf_dir):
    return [(r.table_name, r.n_columns, r.described, r.owned) for r in frames.coverage(shop(spark).nodes()).collect()]


@case("shop_search", {"table_name": "VARCHAR", "column_name": "VARCHAR"}, [("raw.c", "name"), ("stg.c", "name"), ("mart.r", "name"), ("mart.u", "name")])
def _(spark, sf_dir):
    return [tuple(r) for r in frames.search_columns(shop(spark).nodes(), "NAM").collect()]


@case("shop_difference", {"full_name": "VARCHAR", "change": "VARCHAR", "field": "VARCHAR"}, [
    ("stg.o.amount", "modified", "expression"), ("mart.r.revenue", "removed", None), ("mart.r.best", "added", None),
])
def _(spark, sf_dir):
    changed = [(q, s.replace("amount * 2 AS", "amount * 3 AS").replace("sum(o.amount) AS revenue", "max(o.amount) AS best")) for q, s in SHOP]
    a, b = shop(spark), Pipeline(spark, changed)
    return [tuple(r) for r in frames.version_diff(a.nodes(), a.edges(), b.nodes(), b.edges()).collect()]


#: id of a customer comes unchanged from raw.c.id into two tables of which neither feeds the other; so does no other column.
@case("shop_candidate_joins", {"left_table": "VARCHAR", "left_column": "VARCHAR", "right_table": "VARCHAR", "right_column": "VARCHAR"}, [("mart.v", "who", "mart.w", "id")])
def _(spark, sf_dir):
    p = Pipeline(spark, [("c", "CREATE TABLE stg.c AS SELECT id, city FROM raw.c"), ("v", "CREATE TABLE mart.v AS SELECT id AS who FROM stg.c"), ("w", "CREATE TABLE mart.w AS SELECT id, upper(city) AS city FROM stg.c")])
    return [(r.left_table, r.left_column, r.right_table, r.right_column) for r in frames.candidate_joins(p.nodes(), p.edges()).collect()]


#: revenue: 1 in mart.r's columns. name: 1 in raw.c, stg.c (and a half for its description), mart.r and mart.u. Half of the best
#: neighbour's own score is added.
@case("shop_keyword_rank", {"table_name": "VARCHAR", "twice": "BIGINT"}, [("raw.c", 4), ("stg.c", 5), ("mart.r", 6), ("mart.u", 4), ("raw.o", 0), ("stg.o", 2)])
def _(spark, sf_dir):
    p = shop(spark)
    columns = p.nodes().where("full_name NOT LIKE '%:%'").select("table_name", "column_name", "description")
    return [(r.table_name, int(r.score * 2 + 0.5)) for r in frames.keyword_rank(columns, "revenue by name", p.table_edges()).collect()]


@case("shop_levels", {"table_name": "VARCHAR", "level": "BIGINT"}, [("raw.o", 0), ("raw.c", 0), ("stg.o", 1), ("stg.c", 1), ("mart.r", 2), ("mart.u", 3)])
def _(spark, sf_dir):
    return [(r.node, r.level) for r in traverse.levels(shop(spark).table_edges()).collect()]


def _edges(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, schemas, _ = EDGES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, EDGE, [(e.src, e.dst, e.edge_type) for e in LineageBuilder(spark, sql, schemas).build().edges])

    return query


def _issues(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, schemas, _ = ISSUES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, ISSUE, [(i.severity, i.category) for i in LineageBuilder(spark, sql, schemas).build().issues])

    return query


def _case(name: str) -> Callable[[SparkSession, str], DataFrame]:
    columns, make, _ = CASES[name]
    return lambda spark, sf_dir: frame(spark, columns, make(spark, sf_dir))


QUERIES = {n: _edges(n) for n in EDGES} | {n: _issues(n) for n in ISSUES} | {n: _case(n) for n in CASES}
ORACLE = {n: values(EDGE, rows) for n, (_, _, rows) in EDGES.items()} | {n: values(ISSUE, rows) for n, (_, _, rows) in ISSUES.items()} | {n: values(columns, rows) for n, (columns, _, rows) in CASES.items()}
