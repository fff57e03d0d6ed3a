"""Runnable operators, by query name, and DuckDB SQL for each."""

from . import applied, documented, lineage, relational

QUERIES = {**relational.QUERIES, **applied.QUERIES, **lineage.QUERIES, **documented.QUERIES}
ORACLE = {**relational.ORACLE, **applied.ORACLE, **lineage.ORACLE, **documented.ORACLE}
