"""The tools."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from typing import Any

from ..lineage import Pipeline
from ..lineage.model import ColumnNode
from . import context
from .base import NotFound, ParameterSpec, Tool
from .safety import check_sql, for_prompt

P = ParameterSpec
_TABLE, _COLUMN = P("table", "string", "table name"), P("column", "string", "column name")


def _column(p: Pipeline, table: str, column: str) -> ColumnNode:
    n = p.column(table, column)
    if n is None:
        raise NotFound(f"no column {table}.{column}")
    return n


def _table(p: Pipeline, name: str):
    t = next((t for k, t in p.tables.items() if k.lower() == name.lower()), None)
    if t is None:
        raise NotFound(f"no table {name}")
    return t


def _named(n: ColumnNode) -> dict:
    return {"table": n.table_name, "column": n.column_name, "full_name": n.full_name, "expression": n.expression, "query_id": n.query_id}


def _trace(forward: bool) -> Callable:
    def run(p: Pipeline, table: str, column: str, full: bool = False):
        n = _column(p, table, column)
        found = p.tracer.walk(n.full_name, forward)[0][1:] if full else [x for x in p.tracer.leaves(n.full_name, forward) if x is not n]
        return [_named(x) for x in found], f"{len(found)} columns {'after' if forward else 'behind'} {table}.{column}"

    return run


def _path(p: Pipeline, from_table: str, from_column: str, to_table: str, to_column: str):
    edges = p.tracer.path(_column(p, from_table, from_column).full_name, _column(p, to_table, to_column).full_name)
    return [{"from": e.src, "to": e.dst, "edge_type": e.edge_type, "query_id": e.query_id} for e in edges], f"{len(edges)} steps" if edges else "no path"


def _table_lineage(p: Pipeline, table: str, direction: str = "both"):
    t = _table(p, table)
    out: dict[str, list[str]] = {}
    if direction in ("upstream", "both"):
        out["upstream"] = sorted({s for q in p.queries.values() if q.destination == t.name for s in q.sources if s != t.name})
    if direction in ("downstream", "both"):
        out["downstream"] = sorted({q.destination for q in p.queries.values() if t.name in q.sources and q.destination and q.destination != t.name})
    return out, ", ".join(f"{len(v)} {k}" for k, v in out.items())


def _list_tables(p: Pipeline, role: str = "all"):
    found = [{"table": t.name, "role": t.role, "columns": len(t.columns), "created_by": t.created_by} for t in p.tables.values() if role in ("all", t.role)]
    return found, f"{len(found)} tables"


def _schema(p: Pipeline, table: str):
    t = _table(p, table)
    out = []
    for c in t.columns:
        n = p.column(t.name, c)
        m = n.metadata if n else None
        out.append({"column": c, "expression": n.expression if n else "", "description": m.description if m else None, "owner": m.owner if m else None, "pii": bool(m and m.pii), "tags": sorted(m.tags) if m else []})
    return {"table": t.name, "role": t.role, "columns": out}, f"{len(out)} columns"


def _relationships(p: Pipeline, table: str | None = None):
    found = [{"source": s, "target": q.destination, "query_id": q.query_id, "operation": q.operation} for q in p.queries.values() if q.destination for s in q.sources]
    found = [r for r in found if table is None or table in (r["source"], r["target"])]
    return found, f"{len(found)} relationships"


def _search(p: Pipeline, text: str, limit: int = 50):
    hits = dict.fromkeys((n.table_name, n.column_name) for n in p.graph.nodes.values() if ":" not in n.full_name and text.lower() in n.column_name.lower())
    found = [{"table": t, "column": c} for t, c in list(hits)[:limit]]
    return found, f"{len(found)} of {len(hits)} columns"


def _order(p: Pipeline):
    order = p.execution_order()
    return [{"position": i, "query_id": q, "operation": p.queries[q].operation, "table": p.queries[q].destination} for i, q in enumerate(order)], f"{len(order)} statements"


def _pii(p: Pipeline, include_lineage: bool = False):
    found = {n.full_name: n for n in p.pii_columns()}
    if include_lineage:
        for n in list(found.values()):
            found |= {x.full_name: x for x in p.tracer.walk(n.full_name, True)[0]}
    return [_named(n) for n in found.values()], f"{len(found)} columns with personal data"


def _owners(p: Pipeline, owner: str | None = None):
    by: dict[str, list[str]] = {}
    for n in p.graph.nodes.values():
        if n.metadata.owner and owner in (None, n.metadata.owner):
            by.setdefault(n.metadata.owner, []).append(n.full_name)
    return by, f"{len(by)} owners"


def _by_tag(p: Pipeline, tag: str):
    found = p.columns_by_tag(tag)
    return [_named(n) for n in found], f"{len(found)} columns tagged {tag}"


def _tags(p: Pipeline):
    return dict(sorted(Counter(t for n in p.graph.nodes.values() for t in n.metadata.tags).items())), "tags"


def _quality(p: Pipeline, table: str | None = None):
    own = [n for n in p.graph.nodes.values() if ":" not in n.full_name and table in (None, n.table_name)]
    share = lambda k: round(100 * k / len(own), 1) if own else 0.0
    out = {
        "columns": len(own), "described_percent": share(sum(bool(n.metadata.description) for n in own)), "owned_percent": share(sum(bool(n.metadata.owner) for n in own)),
        "pii_without_owner": [n.full_name for n in own if n.metadata.pii and not n.metadata.owner], "issues": Counter(i.severity for i in p.graph.issues),
    }
    return out, f"{len(own)} columns checked"


ALL_TOOLS = (
    Tool("trace_backward", "Where a column comes from", (_TABLE, _COLUMN, P("full", "boolean", "all columns on the way", False, False)), _trace(False)),
    Tool("trace_forward", "What a column reaches", (_TABLE, _COLUMN, P("full", "boolean", "all columns on the way", False, False)), _trace(True)),
    Tool("get_lineage_path", "A shortest path between two columns", (P("from_table"), P("from_column"), P("to_table"), P("to_column")), _path),
    Tool("get_table_lineage", "Tables next to a table", (_TABLE, P("direction", "string", "which way", False, "both", ("upstream", "downstream", "both"))), _table_lineage),
    Tool("list_tables", "All tables", (P("role", "string", "role", False, "all", ("all", "source", "intermediate", "final")),), _list_tables),
    Tool("get_table_schema", "Columns of a table", (_TABLE,), _schema),
    Tool("get_relationships", "Which tables feed which", (P("table", "string", "one table", False),), _relationships),
    Tool("search_columns", "Columns by part of their name", (P("text"), P("limit", "integer", "most results", False, 50)), _search),
    Tool("get_execution_order", "Statements in order", (), _order),
    Tool("find_pii_columns", "Columns with personal data", (P("include_lineage", "boolean", "and all they reach", False, False),), _pii),
    Tool("get_owners", "Columns by owner", (P("owner", "string", "one owner", False),), _owners),
    Tool("get_columns_by_tag", "Columns with a tag", (P("tag"),), _by_tag),
    Tool("list_tags", "Tags and how often they occur", (), _tags),
    Tool("check_data_quality", "How much is described and owned", (P("table", "string", "one table", False),), _quality),
)


def _generate(p: Pipeline, question: str, strategy: str = "direct", llm: Callable[[str], str] | None = None):
    """SQL for a question: with all tables in the prompt, or with those that the model picks first."""
    tables = None
    if strategy == "two_stage":
        said = llm(f"Which of these tables are needed to answer the question? Answer with a JSON list.\nTables: {', '.join(p.tables)}\nQuestion: {for_prompt(question)}")
        try:
            tables = [t for t in json.loads(re.search(r"\[.*\]", said, re.S).group()) if t in p.tables]
        except (AttributeError, ValueError):
            tables = None
        tables = tables or context.tables_by_keywords(p, question)
    prompt = f"Write one SQL query (SELECT only) for the question.\n{context.schema_context(p, tables)}\n{context.join_context(p)}\nQuestion: {for_prompt(question)}\nSQL:"
    text = llm(prompt)
    m = re.search(r"```(?:sql)?\s*(.*?)```", text, re.S)
    sql = (m.group(1) if m else text).strip()
    problem = check_sql(p.spark, sql)
    if problem:
        raise NotFound(f"refused: {problem}")
    return {"sql": sql, "tables": tables or list(p.tables)}, "generated"


def _explain(p: Pipeline, sql: str, llm: Callable[[str], str] | None = None):
    return {"explanation": llm(f"Explain this SQL in plain words.\n{for_prompt(sql, 5000)}\n{context.schema_context(p)}").strip()}, "explained"


def _describe(p: Pipeline, table: str, column: str, llm: Callable[[str], str] | None = None):
    text = describe_column(p, _column(p, table, column), llm)
    return {"description": text}, "described"


LLM_TOOLS = (
    Tool("generate_sql", "SQL for a question", (P("question"), P("strategy", "string", "how tables are chosen", False, "direct", ("direct", "two_stage"))), _generate, True),
    Tool("explain_query", "What a statement does", (P("sql"),), _explain, True),
    Tool("describe_column", "A description of a column", (_TABLE, _COLUMN), _describe, True),
)


def describe_column(p: Pipeline, n: ColumnNode, llm: Callable[[str], str] | None) -> str:
    """One sentence from a model, checked; without one, or if it fails, what the name and expression say."""
    sources = [p.graph.nodes[e.src] for e in p.graph.edges_to(n.full_name) if e.src in p.graph.nodes]
    plain = f"{n.column_name.replace('_', ' ').capitalize()}" + (f", from {', '.join(dict.fromkeys(s.full_name for s in sources))}" if sources else "")
    if llm is None:
        return plain
    known = "; ".join(f"{s.full_name}: {for_prompt(s.metadata.description or 'no description', 200)}" for s in sources[:10])
    said = llm(f"Describe the column {n.full_name} in one sentence of at most 15 words.\nExpression: {for_prompt(n.expression, 1000)}\nSources: {known}").strip()
    return said if said and len(said) <= 300 and "<" not in said and "\n" not in said else plain


def generate_descriptions(p: Pipeline, llm: Callable[[str], str] | None, overwrite: bool = False) -> int:
    """Descriptions for all columns without one, in order of statements; returns how many were made."""
    done = 0
    for n in p.graph.nodes.values():
        if n.layer == "output" and (overwrite or not n.metadata.description):
            n.metadata.description, n.description_source = describe_column(p, n, llm), "generated" if llm else "fallback"
            done += 1
    return done


def answer(registry: Any, question: str) -> Any:
    from .agent import ask

    return ask(registry, question)
