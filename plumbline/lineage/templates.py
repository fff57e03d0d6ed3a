"""Placeholders in SQL text: {{ name }}, {{ a.b }}, {{ f('x') }} and {name}, without a template library."""

from __future__ import annotations

import ast
import re
from typing import Any

_TEMPLATE = re.compile(r"\{\{\s*(.+?)\s*\}\}|(?<![{'\"$])\{([A-Za-z_][\w.]*)\}(?!\})", re.S)
_BLOCK = re.compile(r"\{%.*?%\}|\{#.*?#\}", re.S)


def is_templated(sql: str) -> bool:
    return bool(_TEMPLATE.search(sql))


def _evaluate(expression: str, context: dict[str, Any]) -> Any:
    """Names, attributes, items, literals and calls of the context's functions; nothing else."""

    def go(n: ast.AST) -> Any:
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name):
            return context[n.id]
        if isinstance(n, ast.Attribute) and not n.attr.startswith("_"):
            base = go(n.value)
            return base[n.attr] if isinstance(base, dict) else getattr(base, n.attr)
        if isinstance(n, ast.Subscript):
            return go(n.value)[go(n.slice)]
        if isinstance(n, ast.Call):
            f = go(n.func)
            if not callable(f):
                raise ValueError(f"{ast.unparse(n.func)} is no function")
            return f(*(go(a) for a in n.args), **{k.arg: go(k.value) for k in n.keywords if k.arg})
        if isinstance(n, (ast.List, ast.Tuple)):
            return [go(x) for x in n.elts]
        raise ValueError(f"not allowed in a template: {ast.unparse(n)}")

    return go(ast.parse(expression, mode="eval").body)


def resolve(sql: str, context: dict[str, Any]) -> str:
    """What the context knows is put in; other placeholders stay."""

    def one(m: re.Match) -> str:
        try:
            return str(_evaluate(m.group(1) or m.group(2), context))
        except (KeyError, AttributeError, SyntaxError):
            return m.group()

    return _TEMPLATE.sub(one, _BLOCK.sub("", sql))


def tokenized(sql: str) -> tuple[str, dict[str, str]]:
    """Placeholders as names that parse (__TMPL_0__), and what they stand for."""
    found: dict[str, str] = {}

    def one(m: re.Match) -> str:
        name = f"__TMPL_{len(found)}__"
        found[name] = m.group()
        return name

    return _TEMPLATE.sub(one, _BLOCK.sub("", sql)), found


def restored(text: str, found: dict[str, str]) -> str:
    for name, said in found.items():
        text = text.replace(name, said)
    return text
