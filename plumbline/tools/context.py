"""Text about a pipeline for prompts, kept within budgets."""

from __future__ import annotations

import re

from ..lineage import Pipeline

MAX_TABLES, MAX_COLUMNS, MAX_JOINS = 20, 50, 30


def tables_by_keywords(p: Pipeline, question: str, most: int = 8, least: int = 3) -> list[str]:
    """Tables that share words with a question: two for the name, one for a column, a half for a description; neighbours
    get half."""
    words = set(re.findall(r"[a-z0-9]+", question.lower()))
    split = lambda s: set(re.findall(r"[a-z0-9]+", (s or "").lower()))
    own = {}
    for t in p.tables.values():
        score = 2.0 * len(words & split(t.name))
        for c in t.columns:
            n = p.column(t.name, c)
            score += len(words & split(c)) + 0.5 * len(words & split(n.metadata.description if n else ""))
        own[t.name] = score
    near = dict(own)
    for q in p.queries.values():
        for s in q.sources:
            if q.destination and s in own and q.destination in own:
                near[s] = max(near[s], own[s] + own[q.destination] / 2)
                near[q.destination] = max(near[q.destination], own[q.destination] + own[s] / 2)
    ranked = sorted(near, key=lambda t: -near[t])
    chosen = [t for t in ranked if near[t] > 0][:most]
    return chosen + [t for t in ranked if t not in chosen][: max(0, least - len(chosen))]


def expand_with_lineage(p: Pipeline, tables: list[str], depth: int = 1) -> list[str]:
    """The tables, then what they derive from, level by level, up to ``depth`` levels; each once."""
    created = {q.destination: q for q in p.queries.values() if q.destination and q.is_ddl}
    ordered, level = list(dict.fromkeys(tables)), list(tables)
    for _ in range(depth):
        level = [s for t in level if t in created for s in sorted(created[t].sources) if s not in ordered]
        level = list(dict.fromkeys(level))
        ordered += level
    return ordered


def relationships(p: Pipeline, tables: list[str] | None = None) -> list[dict]:
    """Which table derives from which, among the given ones."""
    out = []
    for q in p.queries.values():
        for s in sorted(q.sources):
            if q.destination and q.is_ddl and (tables is None or {s, q.destination} <= set(tables)):
                out.append({"source": s, "target": q.destination, "type": "derives_from", "query_id": q.query_id})
    return out


def relationship_context(p: Pipeline, tables: list[str] | None = None) -> str:
    found = relationships(p, tables)
    return "\n".join(["How tables derive:", *(f"  {r['source']} -> {r['target']} (by {r['query_id']})" for r in found)]) if found else ""


def lineage_context(p: Pipeline, table: str, columns: list[str] | None = None) -> str:
    """For each column of a table, the source columns that it comes from in the end."""
    out = []
    for c in (columns or p.tables[table].columns)[:MAX_COLUMNS]:
        ends = sorted({n.full_name for n in p.trace_backward(table, c)} - {f"{table}.{c}"})
        if ends:
            out.append(f"  {table}.{c} <- {', '.join(ends)}")
    return "\n".join(["Where columns come from:", *out]) if out else ""


def schema_context(p: Pipeline, tables: list[str] | None = None) -> str:
    out = []
    for name in (tables or list(p.tables))[:MAX_TABLES]:
        t = p.tables[name]
        out.append(f"Table {t.name} ({t.role}):")
        for c in t.columns[:MAX_COLUMNS]:
            n = p.column(t.name, c)
            notes = [x for x in (n.metadata.description, "personal data" if n.metadata.pii else None) if x] if n else []
            out.append(f"  - {c}" + (f": {'; '.join(notes)}" if notes else ""))
    return "\n".join(out)


def join_context(p: Pipeline) -> str:
    """Joins that statements make, each once."""
    seen = {}
    for e in p.graph.edges:
        if e.edge_type == "join_predicate" and e.info.get("join_condition"):
            seen.setdefault((e.query_id, e.info["join_condition"]), set()).add(e.src)
    pairs = dict.fromkeys(tuple(sorted(v)) for v in seen.values() if len(v) == 2 and not any(":" in x for x in v))
    return "\n".join(["Joins seen:", *(f"  {a} = {b}" for a, b in list(pairs)[:MAX_JOINS])]) if pairs else ""
