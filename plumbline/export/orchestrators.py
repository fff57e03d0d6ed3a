"""Definitions of a pipeline's runs for orchestrators, as text. Statements keep their order of dependencies."""

from __future__ import annotations

import json
import re
import textwrap

from ..lineage import Pipeline


def safe(name: str) -> str:
    s = re.sub(r"\W+", "_", name).strip("_").lower() or "task"
    return f"t_{s}" if s[0].isdigit() else s


def _tasks(p: Pipeline) -> list[tuple[str, str, str, list[str]]]:
    """(name, id, SQL, names that it waits for) in order; names are unique."""
    deps, names = p.dependencies(), {}
    for q in p.execution_order():
        n, i = safe(q), 2
        while n in names.values():
            n = f"{safe(q)}_{i}"
            i += 1
        names[q] = n
    return [(names[q], q, p.queries[q].sql, [names[d] for d in deps[q]]) for q in names]


def _runner() -> str:
    return "from pyspark.sql import SparkSession\n\n\ndef run_sql(sql):\n    SparkSession.builder.getOrCreate().sql(sql).collect()\n"


def airflow_dag(p: Pipeline, dag_id: str, schedule: str | None = "@daily", owner: str = "data", retries: int = 1) -> str:
    out = ["from datetime import datetime", "", "from airflow.decorators import dag, task", _runner(), "", f"@dag(dag_id={dag_id!r}, schedule={schedule!r}, start_date=datetime(2024, 1, 1), catchup=False, default_args={{'owner': {owner!r}, 'retries': {retries}}})", f"def {safe(dag_id)}():"]
    for name, q, sql, _ in _tasks(p):
        out += [f"    @task(task_id={q!r})", f"    def {name}():", f"        run_sql({sql!r})", ""]
    out += [f"    {n}_done = {n}()" for n, *_ in _tasks(p)]
    out += [f"    {d}_done >> {n}_done" for n, _, _, deps in _tasks(p) for d in deps]
    return "\n".join([*out, "", "", f"{safe(dag_id)}()", ""])


def dagster_assets(p: Pipeline, group: str = "pipeline") -> str:
    out = ["from dagster import Definitions, asset", _runner()]
    for name, _, sql, deps in _tasks(p):
        out += ["", f"@asset(group_name={group!r}, deps=[{', '.join(deps)}])", f"def {name}():", f"    run_sql({sql!r})", ""]
    return "\n".join([*out, "", f"defs = Definitions(assets=[{', '.join(n for n, *_ in _tasks(p))}])", ""])


def dagster_job(p: Pipeline, job: str) -> str:
    out = ["from dagster import In, Nothing, job, op", _runner()]
    for name, _, sql, deps in _tasks(p):
        ins = ", ".join(f"{d!r}: In(Nothing)" for d in deps)
        out += ["", f"@op(ins={{{ins}}})", f"def {name}():", f"    run_sql({sql!r})", ""]
    out += ["", "@job", f"def {safe(job)}():"]
    return "\n".join(out + [f"    {n}_done = {n}({', '.join(f'{d}={d}_done' for d in deps)})" for n, _, _, deps in _tasks(p)] + [""])


def prefect_flow(p: Pipeline, flow: str, retries: int = 1) -> str:
    out = ["from prefect import flow, task", _runner()]
    for name, q, sql, _ in _tasks(p):
        out += ["", f"@task(name={q!r}, retries={retries})", f"def {name}():", f"    run_sql({sql!r})", ""]
    out += ["", f"@flow(name={flow!r})", f"def {safe(flow)}():"]
    out += [f"    {n}_done = {n}.submit(wait_for=[{', '.join(f'{d}_done' for d in deps)}])" for n, _, _, deps in _tasks(p)]
    return "\n".join([*out, f"    return [x.result() for x in ({', '.join(f'{n}_done' for n, *_ in _tasks(p))},)]", ""])


def prefect_deployment(p: Pipeline, flow: str, name: str, cron: str = "0 0 * * *", pool: str = "default") -> str:
    return prefect_flow(p, flow) + f'\n\nif __name__ == "__main__":\n    {safe(flow)}.deploy(name={name!r}, work_pool_name={pool!r}, cron={cron!r})\n'


def kestra_flow(p: Pipeline, flow: str, namespace: str, cron: str | None = None, connection: str = "jdbc:hive2://localhost:10000") -> str:
    out = [f"id: {safe(flow)}", f"namespace: {namespace}", "tasks:", "  - id: dag", "    type: io.kestra.plugin.core.flow.Dag", "    tasks:"]
    for name, _, sql, deps in _tasks(p):
        out += ["      - task:", f"          id: {name}", "          type: io.kestra.plugin.jdbc.Query", f"          url: {connection}", "          sql: |", textwrap.indent(sql, " " * 12)]
        if deps:
            out += [f"        dependsOn: {json.dumps(deps)}"]
    if cron:
        out += ["triggers:", "  - id: schedule", "    type: io.kestra.plugin.core.trigger.Schedule", f'    cron: "{cron}"']
    return "\n".join([*out, ""])


def mage_pipeline(p: Pipeline, name: str) -> dict:
    tasks = _tasks(p)
    below = {n: [m for m, _, _, deps in tasks if n in deps] for n, *_ in tasks}
    return {"name": name, "type": "python", "uuid": safe(name), "blocks": [{"uuid": n, "name": q, "type": "data_loader" if not deps else "transformer", "language": "python", "upstream_blocks": deps, "downstream_blocks": below[n]} for n, q, _, deps in tasks]}


def mage_blocks(p: Pipeline) -> dict[str, str]:
    out = {}
    for name, _, sql, deps in _tasks(p):
        kind = "data_loader" if not deps else "transformer"
        args = ", ".join(["*args", "**kwargs"])
        out[name] = f"{_runner()}\n\n@{kind}\ndef {name}({args}):\n    run_sql({sql!r})\n    return {{}}\n"
    return out
