"""Analytics over node and edge tables as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import traverse

#: Edge types that hand a column on unchanged.
IDENTITY = ("direct_column", "star_passthrough", "union", "pivot_passthrough", "unpivot_passthrough", "cross_query")


def version_diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(full_name, change, field): columns added, removed, or changed in expression or sources."""

    def side(nodes: DataFrame, edges: DataFrame, p: str) -> DataFrame:
        sources = edges.groupBy(F.col("dst").alias("full_name")).agg(F.array_sort(F.collect_set("src")).alias(f"{p}_sources"))
        return nodes.select("full_name", F.col("expression").alias(f"{p}_expression"), F.lit(True).alias(f"{p}_here")).join(sources, "full_name", "left")

    both = side(old_nodes, old_edges, "old").join(side(new_nodes, new_edges, "new"), "full_name", "full")
    fields = F.array_compact(F.array(
        F.when(~F.col("old_expression").eqNullSafe(F.col("new_expression")), F.lit("expression")),
        F.when(~F.col("old_sources").eqNullSafe(F.col("new_sources")), F.lit("source_columns")),
    ))
    changes = F.when(F.col("old_here").isNull(), F.array(F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("field"))))
    changes = changes.when(F.col("new_here").isNull(), F.array(F.struct(F.lit("removed").alias("change"), F.lit(None).cast("string").alias("field"))))
    changes = changes.otherwise(F.transform(fields, lambda f: F.struct(F.lit("modified").alias("change"), f.alias("field"))))
    return both.select("full_name", F.explode(changes).alias("c")).select("full_name", "c.change", "c.field")


def candidate_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of tables with columns that come unchanged from one source column, where neither table feeds the other."""
    physical = nodes.where(~F.col("full_name").contains(":")).select("full_name", "table_name", "column_name")
    same = edges.where(F.col("edge_type").isin(*IDENTITY) | (F.col("edge_type") == "expression") & F.col("expression").rlike(r"^[\w.]+$") & (F.element_at(F.split("expression", "[.]"), -1) == F.element_at(F.split("src", "[.]"), -1)))
    origin = traverse.reach(same, physical.select("full_name").join(same.select(F.col("dst").alias("full_name")).distinct(), "full_name", "left_anti"))
    known = origin.select("start", F.col("node").alias("full_name")).join(physical, "full_name")
    a = known.select("start", F.col("table_name").alias("left_table"), F.col("column_name").alias("left_column"))
    b = known.select("start", F.col("table_name").alias("right_table"), F.col("column_name").alias("right_column"))
    pairs = a.join(b, "start").where("left_table < right_table").select("left_table", "left_column", "right_table", "right_column").distinct()
    table_of = nodes.select("full_name", "table_name")
    hops = edges.join(table_of.withColumnRenamed("full_name", "src"), "src").withColumnRenamed("table_name", "s").join(table_of.withColumnRenamed("full_name", "dst"), "dst").where("s <> table_name").select(F.col("s").alias("src"), F.col("table_name").alias("dst")).distinct()
    fed = traverse.reach(hops, pairs.select("left_table").union(pairs.select("right_table")).distinct()).where("depth > 0").select(F.col("start").alias("left_table"), F.col("node").alias("right_table"))
    related = fed.union(fed.select("right_table", "left_table")).distinct()
    return pairs.join(related, ["left_table", "right_table"], "left_anti")


def observed_joins(predicates: DataFrame) -> DataFrame:
    """(a, b, n_queries): pairs of columns that statements join on by equality or USING, each once however it is written, and in
    how many statements."""
    on = predicates.distinct()
    # USING (x, y) says several equalities: sides are matched by name
    name = F.when(F.col("said").startswith("USING"), F.element_at(F.split("src", "[.]"), -1)).otherwise(F.lit(""))
    left, right = (on.where(F.col("side") == s).select("query_id", "said", name.alias("name"), F.col("src").alias(s)) for s in ("left", "right"))
    equal = (F.col("said").startswith("USING") | (F.size(F.split("said", " = ")) == 2)) & ~F.col("left").contains(":") & ~F.col("right").contains(":")
    pairs = left.join(right, ["query_id", "said", "name"]).where(equal)
    return pairs.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "query_id").groupBy("a", "b").agg(F.count_distinct("query_id").alias("n_queries"))


def expand_tables(table_edges: DataFrame, selected: DataFrame, depth: int = 1) -> DataFrame:
    """(table_name, depth): the selected tables and what they derive from, up to ``depth`` steps back, each at its nearest."""
    start = selected.select(F.col("table_name").alias("node"))
    found = traverse.reach(traverse.reversed_edges(table_edges), start, depth)
    return found.groupBy(F.col("node").alias("table_name")).agg(F.min("depth").alias("depth"))


def keyword_rank(columns: DataFrame, question: str, neighbours: DataFrame | None = None) -> DataFrame:
    """(table_name, score): words of a question found in a table's name count two, in a column one, in a description a half;
    half of a table's score goes on to its neighbours."""
    words = F.array(*(F.lit(w) for w in sorted(set(question.lower().split()))))

    def hits(c: str) -> F.Column:
        return F.size(F.array_intersect(words, F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^a-z0-9]+")))

    scored = columns.groupBy("table_name").agg((F.max(hits("table_name")) * 2.0 + F.sum(hits("column_name")) * 1.0 + F.sum(hits("description")) * 0.5).alias("own"))
    if neighbours is None:
        return scored.select("table_name", F.col("own").alias("score"))
    both = neighbours.select("src", "dst").union(neighbours.select("dst", "src")).distinct()
    spread = both.join(scored.withColumnRenamed("table_name", "src"), "src").groupBy(F.col("dst").alias("table_name")).agg((F.max("own") * 0.5).alias("near"))
    return scored.join(spread, "table_name", "left").select("table_name", (F.col("own") + F.coalesce("near", F.lit(0.0))).alias("score"))


def search_columns(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Physical columns whose name holds the text; each once, then cut to the limit."""
    found = nodes.where(~F.col("full_name").contains(":") & F.contains(F.lower("column_name"), F.lit(text.lower()))).select("table_name", "column_name").distinct()
    return found.orderBy("table_name", "column_name").limit(limit)


def coverage(nodes: DataFrame) -> DataFrame:
    """By table: columns, and how many have a description, an owner, and personal data."""
    own = nodes.where(~F.col("full_name").contains(":"))
    return own.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count("description").alias("described"), F.count("owner").alias("owned"),
        F.sum(F.coalesce(F.col("pii"), F.lit(False)).cast("long")).alias("pii"),
    )


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
