"""Rows of the lineage graph, and their Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .metadata import ColumnMetadata


@dataclass
class ColumnNode:
    """A column at one place; its full name is its identity."""

    full_name: str
    table_name: str
    column_name: str
    query_id: str = ""
    unit_id: str = ""
    node_type: str = "base_column"
    layer: str = "input"
    expression: str = ""
    metadata: ColumnMetadata = field(default_factory=ColumnMetadata)
    is_star: bool = False
    except_columns: list[str] = field(default_factory=list)
    literal_values: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    description_source: str | None = None
    seq: int = 0


@dataclass
class ColumnEdge:
    """A dependency between columns; (src, dst, edge_type) is its identity. ``info`` holds what only some kinds have."""

    src: str
    dst: str
    edge_type: str
    query_id: str = ""
    context: str = ""
    expression: str = ""
    edge_role: str | None = None
    info: dict[str, Any] = field(default_factory=dict)
    seq: int = 0

    @property
    def key(self) -> tuple[str, str, str]:
        return self.src, self.dst, self.edge_type


@dataclass
class Issue:
    severity: str
    category: str
    message: str
    query_id: str = ""
    location: str = ""
    suggestion: str = ""


@dataclass
class Unit:
    """One SELECT, set operation, pivot or merge, with what it reads and gives."""

    unit_id: str
    name: str
    unit_type: str
    columns: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    units: list[str] = field(default_factory=list)
    joins: list[dict] = field(default_factory=list)
    where: str | None = None
    group_by: dict | None = None
    windows: list[dict] = field(default_factory=list)
    qualify: dict | None = None
    recursive: dict | None = None
    set_type: str | None = None


class ColumnGraph:
    """Nodes and edges of one statement or a pipeline, in order of insertion, with neighbours by name."""

    def __init__(self):
        self.nodes: dict[str, ColumnNode] = {}
        self.edges: list[ColumnEdge] = []
        self.issues: list[Issue] = []
        self._keys: set[tuple] = set()
        self._in: dict[str, list[ColumnEdge]] = {}
        self._out: dict[str, list[ColumnEdge]] = {}

    def add_node(self, node: ColumnNode) -> ColumnNode:
        if node.full_name not in self.nodes:
            node.seq = len(self.nodes)
            self.nodes[node.full_name] = node
        return self.nodes[node.full_name]

    def add_edge(self, edge: ColumnEdge) -> None:
        if edge.key not in self._keys:
            self._keys.add(edge.key)
            edge.seq = len(self.edges)
            self.edges.append(edge)
            self._in.setdefault(edge.dst, []).append(edge)
            self._out.setdefault(edge.src, []).append(edge)

    def edges_to(self, name: str) -> list[ColumnEdge]:
        return self._in.get(name, [])

    def edges_from(self, name: str) -> list[ColumnEdge]:
        return self._out.get(name, [])

    def layer(self, layer: str) -> list[ColumnNode]:
        return [n for n in self.nodes.values() if n.layer == layer]


NODE_SCHEMA = "full_name string, table_name string, column_name string, query_id string, unit_id string, node_type string, layer string, expression string, is_star boolean, description string, description_source string, owner string, pii boolean, tags array<string>, custom_metadata map<string,string>, warnings array<string>, seq int"
EDGE_SCHEMA = "src string, dst string, edge_type string, query_id string, context string, expression string, edge_role string, info map<string,string>, seq int"
ISSUE_SCHEMA = "severity string, category string, message string, query_id string, location string, suggestion string"


def node_rows(graph: ColumnGraph) -> list[tuple]:
    return [
        (n.full_name, n.table_name, n.column_name, n.query_id, n.unit_id, n.node_type, n.layer, n.expression, n.is_star, n.metadata.description, n.description_source, n.metadata.owner, n.metadata.pii,
         sorted(n.metadata.tags), {k: str(v) for k, v in n.metadata.custom.items()}, n.warnings, n.seq)
        for n in graph.nodes.values()
    ]


def edge_rows(graph: ColumnGraph) -> list[tuple]:
    return [(e.src, e.dst, e.edge_type, e.query_id, e.context, e.expression, e.edge_role, {k: str(v) for k, v in e.info.items() if v is not None}, e.seq) for e in graph.edges]


def nodes_frame(spark: SparkSession, graph: ColumnGraph) -> DataFrame:
    return spark.createDataFrame(node_rows(graph), NODE_SCHEMA)


def edges_frame(spark: SparkSession, graph: ColumnGraph) -> DataFrame:
    return spark.createDataFrame(edge_rows(graph), EDGE_SCHEMA)
