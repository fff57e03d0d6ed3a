"""Column lineage: statements parsed by Catalyst into graphs, and pipelines of them."""

from .builder import LineageBuilder
from .model import ColumnEdge, ColumnGraph, ColumnNode, Issue, Unit
from .pipeline import Pipeline, Query, Table
from .trace import Tracer

__all__ = ["LineageBuilder", "ColumnEdge", "ColumnGraph", "ColumnNode", "Issue", "Unit", "Pipeline", "Query", "Table", "Tracer"]
