"""Catalyst's parser as a front end: SQL text to a tree of plain Python nodes. No catalog is needed.

The parser hangs off the classic session; all use of that private API is in this module.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Node:
    """A plan or expression: short class name, fields, and the children that no field refers to by number."""

    name: str
    fields: dict[str, Any]
    children: list["Node"] = field(default_factory=list)

    def get(self, key: str, default: Any = None) -> Any:
        v = self.fields.get(key, default)
        return default if v is None else v

    def parts(self, key: str = "nameParts") -> list[str]:
        return name_parts(self.fields.get(key))

    def walk(self, into_plans: bool = False) -> Iterator["Node"]:
        """This expression and all below it; subqueries' plans are entered only on request."""
        yield self
        for c in self.children:
            yield from c.walk(into_plans)
        for key, v in self.fields.items():
            if key == "plan" and not into_plans:
                continue
            for n in _nodes(v):
                if not any(n is c for c in self.children):
                    yield from n.walk(into_plans)


def _nodes(v: Any) -> Iterator[Node]:
    if isinstance(v, Node):
        yield v
    elif isinstance(v, list):
        for x in v:
            yield from _nodes(x)


def name_parts(v: Any) -> list[str]:
    """Parts of an identifier, which the JSON holds as text in brackets."""
    if isinstance(v, list):
        return [str(x) for x in v]
    if not v:
        return []
    text = str(v)
    return [p.strip() for p in (text[1:-1] if text.startswith("[") and text.endswith("]") else text).split(",")]


def _is_tree(v: Any) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(x, dict) and "class" in x for x in v)


def _value(v: Any) -> Any:
    if _is_tree(v):
        return _tree(v)
    if isinstance(v, list):
        return [_value(x) for x in v]
    if isinstance(v, dict):
        if "product-class" in v:
            return {k: _value(x) for k, x in v.items() if k != "product-class"}
        return v
    return v


def _tree(flat: list[dict]) -> Node:
    """The JSON is a list in pre-order; each entry says how many children follow."""
    at = 0

    def read() -> Node:
        nonlocal at
        raw = flat[at]
        at += 1
        node = Node(raw["class"].rpartition(".")[2], {k: _value(v) for k, v in raw.items() if k not in ("class", "num-children")})
        node.children = [read() for _ in range(raw["num-children"])]
        for k, v in raw.items():
            if k in _ORDINAL and isinstance(v, int) and not isinstance(v, bool) and v < len(node.children):
                node.fields[k] = node.children[v]
            elif k in _ORDINALS and isinstance(v, list) and v and all(isinstance(x, int) for x in v):
                node.fields[k] = [node.children[x] for x in v]
        return node

    return read()


_ORDINAL = {"child", "left", "right", "query", "name", "table", "targetTable", "sourceTable", "key", "value", "windowFunction", "windowSpec", "frameSpecification", "lower", "upper", "condition", "extraction", "plan"}
_ORDINALS = {"children", "arguments", "assignments", "partitionSpec", "orderSpec"}


def parse(spark: SparkSession, sql: str) -> Node:
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    return _tree(json.loads(plan.toJSON()))
