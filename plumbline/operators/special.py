"""Operators that Spark SQL has no words for: frames by groups, as-of joins, recursion without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over_groups(df: DataFrame, aggregate: Column, partition: list[str], order: list[Column], before: int, after: int, name: str) -> DataFrame:
    """A frame GROUPS BETWEEN before PRECEDING AND after FOLLOWING: peers are numbered densely, and the numbers ranged over."""
    numbered = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("_peer").rangeBetween(-before, after)
    return numbered.withColumn(name, aggregate.over(frame)).drop("_peer")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, columns: list[str]) -> DataFrame:
    """For each left row the columns of the last right row at or before it, by one window over both sides.

    Neither side is expanded, so no row meets more than its own key's rows in order."""
    l = left.select("*", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_found"))
    keep = [c for c in left.columns if c not in by]
    r = right.select(*by, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in keep), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_found"))
    upto = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.select(*by, *keep, "_at", "_side", "_found").unionByName(r)
    return both.withColumn("_found", F.last("_found", ignorenulls=True).over(upto)).where("_side = 1").select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in columns))


def recursive_distinct(base: DataFrame, step, most: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: ``step`` maps the newest rows to the next; ends when nothing new comes.

    Each round is checkpointed, so plans stay short and a lost executor costs no more than a round."""
    from ..graph.traverse import cut

    found = new = cut(base.distinct())
    for _ in range(most):
        new = cut(step(new).distinct().join(found, found.columns, "left_anti"))
        if not new.limit(1).count():
            return found
        found = found.union(new)
    raise RuntimeError(f"no fixpoint after {most} rounds")
