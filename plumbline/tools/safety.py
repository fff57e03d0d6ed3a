"""Text for prompts made harmless, and generated SQL checked by its plan."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession

from ..lineage.catalyst import parse
from ..plans import rewrite, split_statements

_READS = {"Project", "Aggregate", "UnresolvedWith", "Union", "Distinct", "Intersect", "Except", "Sort", "GlobalLimit", "LocalLimit", "Offset", "UnresolvedHaving", "WithWindowDefinition", "UnresolvedInlineTable", "LocalRelation", "Filter"}


def for_prompt(text: str | None, most: int = 2000) -> str:
    """Normalised, without control characters and tags, cut to a length."""
    s = unicodedata.normalize("NFKC", text or "")
    s = "".join(c for c in s if c in "\n\t" or unicodedata.category(c)[0] != "C")
    s = re.sub(r"<(/?)(\w[^>]*)>", r"&lt;\1\2&gt;", s)
    return s if len(s) <= most else s[: most - 3] + "..."


def check_sql(spark: SparkSession, sql: str) -> str | None:
    """Why a statement must not be run, or None: it has to be one query that only reads."""
    parts = split_statements(sql)
    if len(parts) != 1:
        return "not exactly one statement"
    try:
        plan = parse(spark, rewrite(parts[0]))
    except Exception as e:  # noqa: BLE001 - whatever the parser says
        return f"it does not parse: {str(e).splitlines()[0]}"
    return None if plan.name in _READS else f"it is not a query but {plan.name}"
