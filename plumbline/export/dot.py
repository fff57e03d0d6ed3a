"""Graphs as DOT text; no library is needed to write it."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..lineage import ColumnEdge, LineageBuilder, Pipeline
from ..lineage.model import ColumnGraph

_COLOURS = {"input": "#dbeafe", "cte": "#fef3c7", "subquery": "#fef3c7", "output": "#dcfce7", "correlation": "#fce7f3"}


def _id(name: str) -> str:
    return re.sub(r"\W", "_", name)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _graph(name: str, body: Iterable[str]) -> str:
    return "\n".join([f"digraph {name} {{", "  rankdir=LR;", '  node [shape=box, style="rounded,filled", fillcolor=white];', *(f"  {x}" for x in body), "}"])


def query_units(builder: LineageBuilder) -> str:
    """Units of a statement and what they read."""
    body = []
    for u in builder.units.values():
        label = "\n".join([u.unit_id, u.unit_type, ", ".join(u.columns[:8])])
        body.append(f"{_id(u.unit_id)} [label={_quoted(label)}];")
        body += [f"{_id('table_' + t)} [label={_quoted(t)}, shape=cylinder];" for t in dict.fromkeys(u.tables)]
        body += [f"{_id('table_' + t)} -> {_id(u.unit_id)};" for t in dict.fromkeys(u.tables)]
        body += [f"{_id(x)} -> {_id(u.unit_id)};" for x in dict.fromkeys(u.units)]
    return _graph("query_units", body)


def column_lineage(graph: ColumnGraph, most: int = 100, clusters: bool = True) -> str:
    """Columns by table with typed edges; beyond ``most`` columns the rest is named in a note."""
    nodes = list(graph.nodes.values())
    shown = {n.full_name for n in nodes[:most]}
    body: list[str] = []
    tables: dict[str, list] = {}
    for n in nodes[:most]:
        tables.setdefault(n.table_name, []).append(n)
    for t, own in tables.items():
        lines = [f"{_id(n.full_name)} [label={_quoted(n.column_name)}, fillcolor={_quoted(_COLOURS.get(n.layer, 'white'))}];" for n in own]
        body += [f"subgraph cluster_{_id(t)} {{ label={_quoted(t)}; {' '.join(lines)} }}"] if clusters else lines
    for e in graph.edges:
        if e.src in shown and e.dst in shown:
            style = ", style=dashed" if e.edge_type.endswith(("filter", "predicate", "order", "partition")) else ""
            body.append(f"{_id(e.src)} -> {_id(e.dst)} [label={_quoted(e.edge_type)}{style}];")
    if len(nodes) > most:
        body.append(f"note [label={_quoted(f'{len(nodes) - most} more columns')}, shape=note];")
    return _graph("column_lineage", body)


def simple(graph: ColumnGraph) -> str:
    """Inputs and outputs alone."""
    ends = {n.full_name for n in graph.nodes.values() if n.layer in ("input", "output")}
    body = [f"{_id(n)} [label={_quoted(n)}];" for n in sorted(ends)]
    for start in sorted(ends):
        seen, todo = set(), [e.dst for e in graph.edges_from(start)]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            if at in ends:
                body.append(f"{_id(start)} -> {_id(at)};")
            else:
                todo += [e.dst for e in graph.edges_from(at)]
    return _graph("simple_lineage", body)


def path(edges: list[ColumnEdge]) -> str:
    body = [f"{_id(n)} [label={_quoted(n)}];" for n in dict.fromkeys(x for e in edges for x in (e.src, e.dst))]
    return _graph("path", body + [f"{_id(e.src)} -> {_id(e.dst)} [label={_quoted(e.edge_type)}];" for e in edges])


def table_dependencies(pipeline: Pipeline, with_levels: bool = False) -> str:
    body = [f"{_id(t.name)} [label={_quoted(t.name)}, fillcolor={_quoted({'source': '#dbeafe', 'final': '#dcfce7'}.get(t.role, 'white'))}];" for t in pipeline.tables.values()]
    body += [f"{_id(s)} -> {_id(q.destination)} [label={_quoted(q.query_id)}];" for q in pipeline.queries.values() if q.destination for s in q.sources if s != q.destination]
    if with_levels:
        for i, level in enumerate(pipeline.execution_levels()):
            own = [pipeline.queries[q].destination for q in level if pipeline.queries[q].destination]
            body.append(f"subgraph level_{i} {{ rank=same; {' '.join(_id(t) + ';' for t in own)} }}")
    return _graph("tables", body)


def pipeline_lineage(pipeline: Pipeline, most: int = 300) -> str:
    return column_lineage(pipeline.graph, most)


def lineage_path(pipeline: Pipeline, src: tuple[str, str], dst: tuple[str, str]) -> str:
    return path(pipeline.path(src, dst))


def structure_from_lineage(graph: ColumnGraph) -> str:
    """Units of a statement as boxes, as its column lineage tells them: what each reads and how many columns it gives."""
    units: dict[str, int] = {}
    for n in graph.nodes.values():
        units[n.table_name] = units.get(n.table_name, 0) + 1
    of = {n.full_name: n.table_name for n in graph.nodes.values()}
    edges = dict.fromkeys((of[e.src], of[e.dst]) for e in graph.edges if e.src in of and e.dst in of and of[e.src] != of[e.dst])
    body = []
    for unit, columns in units.items():
        said = f"{unit} ({columns})"
        body.append(f"{_id(unit)} [label={_quoted(said)}];")
    return _graph("structure", [*body, *(f"{_id(a)} -> {_id(b)};" for a, b in edges)])
