"""Rewrites of SQL that Spark's parser lacks."""

import pytest

from plumbline.lineage import templates
from plumbline.plans import rewrite, split_statements, tokenize
from plumbline.plans.rewrite import UnsupportedSQL


def test_statements_are_split_outside_literals():
    assert split_statements("SELECT ';' AS a; -- x; y\nSELECT 2 /* ; */;\n;") == ["SELECT ';' AS a", "-- x; y\nSELECT 2 /* ; */"]


def test_literals_and_comments_are_left_alone():
    assert rewrite("SELECT 'IFF(a)' AS x -- QUALIFY\nFROM t") == "SELECT 'IFF(a)' AS x -- QUALIFY\nFROM t"


def test_qualify_in_a_subquery(spark):
    sql = "SELECT k FROM (SELECT k, v FROM VALUES (1, 2), (1, 3), (2, 1) AS t(k, v) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1) q WHERE v > 1"
    assert [r.k for r in spark.sql(rewrite(sql)).collect()] == [1]


def test_two_qualifies_in_a_union(spark):
    one = "SELECT k, v FROM VALUES (1, 2), (1, 3) AS t(k, v) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v) = 1"
    assert [tuple(r) for r in spark.sql(rewrite(f"{one} UNION ALL {one}")).collect()] == [(1, 2), (1, 2)]


def test_replace_and_names(spark):
    got = spark.sql(rewrite("SELECT * REPLACE (a + 1 AS a), IFF(b > 1, 'x', 'y') AS c, SAFE_CAST('q' AS INT) AS d FROM VALUES (1, 2) AS t(a, b)")).first()
    assert got.asDict() == {"b": 2, "a": 2, "c": "x", "d": None}


def test_asof_is_refused():
    with pytest.raises(UnsupportedSQL):
        rewrite("SELECT * FROM a ASOF JOIN b ON a.t >= b.t")


def test_generate_series_and_offset(spark):
    assert [r.n for r in spark.sql(rewrite("SELECT n FROM generate_series(1, 5, 2) AS g(n)")).collect()] == [1, 3, 5]
    got = spark.sql(rewrite("SELECT x, p FROM (SELECT array('a', 'b') AS xs) t, UNNEST(xs) AS x WITH OFFSET AS p")).collect()
    assert [tuple(r) for r in got] == [("a", 0), ("b", 1)]


def test_named_window_with_a_frame(spark):
    sql = "SELECT sum(v) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM VALUES (1, 1), (2, 2), (3, 3) AS t(k, v) WINDOW w AS (ORDER BY k)"
    assert sorted(r.s for r in spark.sql(rewrite(sql)).collect()) == [1, 3, 5]


def test_templates():
    context = {"env": "dev", "ref": lambda m: f"db.{m}", "cfg": {"schema": "raw"}}
    assert templates.resolve("SELECT * FROM {{ ref('a') }} JOIN {{ cfg.schema }}.b JOIN t_{env}", context) == "SELECT * FROM db.a JOIN raw.b JOIN t_dev"
    assert templates.resolve("{{ __import__('os') }} {{ missing }}", context) == "{{ __import__('os') }} {{ missing }}"
    text, found = templates.tokenized("SELECT * FROM {{ x }}.t")
    assert text == "SELECT * FROM __TMPL_0__.t" and templates.restored(text, found) == "SELECT * FROM {{ x }}.t"
    assert len(tokenize("a -- c\nb", keep=("comment",))) == 3
