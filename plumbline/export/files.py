"""JSON that can be read back, and CSV of columns and tables."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

from ..lineage import Pipeline


def write_json(pipeline: Pipeline, path: str, indent: int = 2) -> None:
    Path(path).write_text(json.dumps(pipeline.to_json(), indent=indent, default=str))


def _csv(header: list[str], rows: list[list]) -> str:
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def columns_csv(pipeline: Pipeline) -> str:
    header = ["full_name", "table_name", "column_name", "query_id", "node_type", "expression", "description", "owner", "pii", "tags"]
    rows = [[n.full_name, n.table_name, n.column_name, n.query_id, n.node_type, n.expression, n.metadata.description or "", n.metadata.owner or "", n.metadata.pii or False, ",".join(sorted(n.metadata.tags))] for n in pipeline.graph.nodes.values()]
    return _csv(header, sorted(rows))


def tables_csv(pipeline: Pipeline) -> str:
    rows = [[t.name, t.is_source, t.created_by or "", len(t.columns), t.description or ""] for t in pipeline.tables.values()]
    return _csv(["table_name", "is_source", "created_by", "n_columns", "description"], sorted(rows))
