"""Spark against DuckDB, for every query that has an oracle outside the text operators."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.operators import ORACLE, QUERIES
from plumbline.sources import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    return repr(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(_norm(r[columns.index(c)]) for c in order) for r in found.fetchall())
    got = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    assert got == want


def test_every_query_is_named_once():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_the_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_the_text_operators(spark, sf, monkeypatch):
    """Whether the folder, the pipeline's file or both are gone, all other queries are there and run."""
    real = entry.importlib.util.find_spec
    for gone in (("plumbline.llm",), ("plumbline.llm.queries",), ("plumbline.llm", "corpus_pipeline"), ("corpus_pipeline",)):
        monkeypatch.setattr(entry.importlib.util, "find_spec", lambda m, gone=gone: None if any(m == g or m.startswith(f"{g}.") for g in gone) else real(m))
        found = entry.queries()
        assert set(QUERIES) <= set(found) and "pipeline" not in found and set(entry.oracle_sql()) <= set(found)
        if gone != ("corpus_pipeline",):
            assert set(found) == set(QUERIES)
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_text_operators():
    root = Path(entry.__file__).parent / "plumbline"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", path.read_text()), path
