"""Questions in plain words, classified by patterns and answered by a tool."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .base import ToolRegistry


@dataclass
class Answer:
    question_type: str
    text: str
    data: Any = None
    tool: str | None = None
    suggestions: list[str] = field(default_factory=list)


_KINDS: tuple[tuple[str, str], ...] = (
    ("sql_generate", r"\b(write|generate|create)\b.*\b(sql|query)\b"),
    ("sql_explain", r"\bexplain\b.*\b(sql|query|select)\b"),
    ("pii", r"\b(pii|personal|sensitive)\b"),
    ("owners", r"\b(owner|owns|owned)\b"),
    ("lineage_forward", r"\b(impact\w*|affect\w*|downstream|reach\w*|depends on|used by|feeds?)\b"),
    ("lineage_backward", r"\b(come from|comes from|source of|sources of|upstream|derived|lineage|origin|where does)\b"),
    ("schema_columns", r"\b(columns?|schema|fields?)\b.*\b(of|in|does)\b"),
    ("search_columns", r"\b(search|find|which)\b.*\bcolumns?\b"),
    ("list_tables", r"\btables?\b"),
)


def classify(question: str) -> str:
    q = question.lower()
    return next((kind for kind, pattern in _KINDS if re.search(pattern, q)), "general")


def _names(registry: ToolRegistry, question: str) -> tuple[str | None, str | None]:
    """The longest table and column of the pipeline that the question names."""
    q = question.lower()
    for t in sorted(registry.pipeline.tables.values(), key=lambda t: -len(t.name)):
        for c in sorted(t.columns, key=len, reverse=True):
            if f"{t.name}.{c}".lower() in q:
                return t.name, c
    table = next((t for t in sorted(registry.pipeline.tables, key=len, reverse=True) if t.lower() in q), None)
    pool = registry.pipeline.tables[table].columns if table else [c for t in registry.pipeline.tables.values() for c in t.columns]
    column = next((c for c in sorted(set(pool), key=len, reverse=True) if re.search(rf"\b{re.escape(c.lower())}\b", q)), None)
    if column and not table:
        table = next(t.name for t in registry.pipeline.tables.values() if column in t.columns)
    return table, column


def ask(registry: ToolRegistry, question: str) -> Answer:
    kind = classify(question)
    table, column = _names(registry, question)
    call: tuple[str, dict] | None = None
    if kind in ("lineage_backward", "lineage_forward") and table:
        way = kind.rpartition("_")[2]
        call = (f"trace_{way}", {"table": table, "column": column}) if column else ("get_table_lineage", {"table": table, "direction": "upstream" if way == "backward" else "downstream"})
    elif kind == "pii":
        call = ("find_pii_columns", {})
    elif kind == "owners":
        call = ("get_owners", {})
    elif kind == "schema_columns" and table:
        call = ("get_table_schema", {"table": table})
    elif kind in ("search_columns", "schema_columns"):
        m = re.search(r"['\"](\w+)['\"]", question)
        word = m.group(1) if m else question.rstrip("?. ").split()[-1]
        call = ("search_columns", {"text": word})
    elif kind == "list_tables":
        call = ("list_tables", {})
    elif kind == "sql_generate" and registry.llm:
        call = ("generate_sql", {"question": question})
    elif kind == "sql_explain" and registry.llm:
        call = ("explain_query", {"sql": question})
    if call is None:
        return Answer(kind, "No tool answers this; name a table or a column.", suggestions=registry.names())
    result = registry.run(call[0], **call[1])
    return Answer(kind, result.message if result.success else result.error, result.data, call[0])
