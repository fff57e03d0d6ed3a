"""Exports, comparison, tools, agent and command line over one small pipeline."""

import json

import pytest

from plumbline import cli
from plumbline.export import airflow_dag, columns_csv, dagster_assets, dagster_job, dot, kestra_flow, mage_blocks, mage_pipeline, prefect_deployment, prefect_flow, tables_csv, write_json
from plumbline.govern.diff import PipelineDiff
from plumbline.lineage import LineageBuilder, Pipeline
from plumbline.lineage.paths import UnsafePath, check_folder, check_pattern, read_sql_files
from plumbline.tools import create_registry, server
from plumbline.tools.agent import ask, classify
from plumbline.tools.catalog import generate_descriptions
from plumbline.tools.safety import check_sql, for_prompt

V1 = [
    ("01-users", "CREATE TABLE users AS SELECT user_id, email, -- Mail address [pii: true, owner: crm, tags: contact]\n country FROM source_users"),
    ("02-orders", "CREATE TABLE orders AS SELECT order_id, user_id, total_amount FROM source_orders"),
    ("03-spend", "CREATE TABLE user_spend AS SELECT u.user_id, u.email, sum(o.total_amount) AS total FROM users u JOIN orders o ON o.user_id = u.user_id GROUP BY u.user_id, u.email"),
]
V2 = [V1[0], V1[1], ("03-spend", V1[2][1].replace("sum(o.total_amount) AS total", "sum(o.total_amount) * 2 AS total, count(o.order_id) AS n"))]


@pytest.fixture(scope="module")
def pipe(spark):
    return Pipeline(spark, V1)


@pytest.fixture(scope="module")
def tools(pipe):
    return create_registry(pipe, llm=lambda prompt: "```sql\nSELECT email FROM users\n```" if "SQL" in prompt else "The mail address of a user.")


def test_diff(spark, pipe):
    d = PipelineDiff(Pipeline(spark, V2), pipe)
    assert d.added == ["orders.order_id", "user_spend.n"][1:] or "user_spend.n" in d.added
    assert [c.full_name for c in d.sql_changes()] == ["user_spend.total"] and "user_spend.total" in d.needing_update() and "Added" in d.summary()
    assert PipelineDiff(pipe, pipe).summary() == "No changes"


def test_files(pipe, tmp_path):
    write_json(pipe, str(tmp_path / "p.json"))
    assert {c["full_name"] for c in json.loads((tmp_path / "p.json").read_text())["columns"]} == set(pipe.graph.nodes)
    assert columns_csv(pipe).startswith("full_name,") and "user_spend,False,03-spend" in tables_csv(pipe)


def test_orchestrators_are_valid_code_in_order(pipe):
    for text in (airflow_dag(pipe, "daily"), dagster_assets(pipe), dagster_job(pipe, "job"), prefect_flow(pipe, "flow"), prefect_deployment(pipe, "flow", "prod"), *mage_blocks(pipe).values()):
        compile(text, "generated", "exec")
    text = airflow_dag(pipe, "daily")
    assert "t_01_users_done >> t_03_spend_done" in text and "t_02_orders_done >> t_03_spend_done" in text
    blocks = {b["uuid"]: b for b in mage_pipeline(pipe, "p")["blocks"]}
    assert blocks["t_03_spend"]["upstream_blocks"] == ["t_01_users", "t_02_orders"]
    yaml = pytest.importorskip("yaml")
    tasks = yaml.safe_load(kestra_flow(pipe, "flow", "team", cron="0 1 * * *"))["tasks"][0]["tasks"]
    assert tasks[-1]["dependsOn"] == ["t_01_users", "t_02_orders"] and "JOIN orders" in tasks[-1]["task"]["sql"]


def test_dot(spark, pipe):
    b = LineageBuilder(spark, "WITH c AS (SELECT a FROM t) SELECT a FROM c")
    b.build()
    drawn = [dot.query_units(b), dot.column_lineage(b.graph), dot.simple(b.graph), dot.table_dependencies(pipe, True), dot.pipeline_lineage(pipe), dot.lineage_path(pipe, ("source_orders", "total_amount"), ("user_spend", "total"))]
    assert all(x.startswith("digraph") and x.count("{") == x.count("}") for x in drawn)
    assert "more columns" in dot.column_lineage(pipe.graph, most=2)


def test_tools(tools):
    assert [x["full_name"] for x in tools.run("trace_backward", table="user_spend", column="total").data][0] == "source_orders.total_amount"
    assert tools.run("trace_backward", table="x", column="y").error == "no column x.y"
    assert tools.run("trace_backward", table="x").error == "missing parameter column"
    assert tools.run("list_tables", role="odd").error.startswith("parameter role")
    assert {x["table"] for x in tools.run("search_columns", text="MAIL").data} == {"source_users", "users", "user_spend"}
    assert tools.run("get_table_lineage", table="users").data == {"upstream": ["source_users"], "downstream": ["user_spend"]}
    assert [x["full_name"] for x in tools.run("find_pii_columns").data] == ["users.email"]
    assert "user_spend.email" in [x["full_name"] for x in tools.run("find_pii_columns", include_lineage=True).data]
    assert tools.run("list_tags").data == {"contact": 1} and tools.run("get_owners").data == {"crm": ["users.email"]}
    assert tools.run("generate_sql", question="all mails").data["sql"] == "SELECT email FROM users"
    assert tools.run("get_execution_order").data[-1]["table"] == "user_spend" and tools.run("check_data_quality").data["columns"] > 5
    assert json.loads(server.call_tool(tools, "list_tables", {}))["success"] and "Table users" in server.read_resource(tools, "pipeline://schema")
    assert "pipeline://tables/users" in server.resources(tools)


def test_agent(tools):
    assert classify("Where does user_spend.total come from?") == "lineage_backward"
    assert ask(tools, "Where does user_spend.total come from?").data[0]["full_name"] == "source_orders.total_amount"
    assert ask(tools, "What is affected by source_users.email?").tool == "trace_forward"
    assert ask(tools, "Which tables are there?").tool == "list_tables" and ask(tools, "hello").tool is None


def test_descriptions(spark):
    p = Pipeline(spark, V1)
    assert generate_descriptions(p, lambda prompt: "Two\nlines") > 0
    assert p.column("user_spend", "total").metadata.description.startswith("Total, from ") and p.column("users", "email").metadata.description == "Mail address"


def test_safety(spark, tmp_path):
    assert check_sql(spark, "SELECT 1") is None and check_sql(spark, "DROP TABLE t") and check_sql(spark, "SELECT 1; SELECT 2") and check_sql(spark, "DELETE FROM t")
    assert for_prompt("a<system>b</system>\x00") == "a&lt;system&gt;b&lt;/system&gt;" and len(for_prompt("x" * 9000)) == 2000
    (tmp_path / "a.sql").write_text("SELECT 1")
    (tmp_path / "b.sql").symlink_to("/etc/passwd")
    for bad in (lambda: check_folder(f"{tmp_path}/../x"), lambda: check_pattern("../*.sql"), lambda: check_pattern("*.py"), lambda: read_sql_files(str(tmp_path))):
        with pytest.raises(UnsafePath):
            bad()


def test_command_line(spark, tmp_path, capsys):
    old, new = tmp_path / "old", tmp_path / "new"
    for folder, version in ((old, V1), (new, V2)):
        folder.mkdir()
        for q, sql in version:
            (folder / f"{q}.sql").write_text(sql)
    assert cli.main(["analyze", str(old)]) == 0 and "user_spend" in capsys.readouterr().out
    assert cli.main(["analyze", str(old), "--format", "dot"]) == 0 and capsys.readouterr().out.startswith("digraph")
    assert cli.main(["diff", str(old), str(new), "--format", "json"]) == 1 and json.loads(capsys.readouterr().out)
