"""Writes as DataFrame operators: merge, update, delete and slowly changing dimensions without a transactional table.

Each gives the table after the statement; the caller writes it where it belongs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update(df: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """UPDATE: rows for which the condition is true get new values; null conditions change nothing."""
    return df.select(*(F.when(condition, assignments[c]).otherwise(df[c]).alias(c) if c in assignments else df[c] for c in df.columns))


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE: rows for which the condition is not true stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def merge(target: DataFrame, source: DataFrame, keys: list[str], update_columns: list[str] | None = None, delete_when: Column | None = None, insert: bool = True) -> DataFrame:
    """MERGE on equal keys: matched rows take the source's columns or go, unmatched source rows come in.

    One full outer join; ``delete_when`` may use the source's columns as ``s_<name>``. Null keys match nothing."""
    columns = update_columns if update_columns is not None else [c for c in source.columns if c not in keys]
    s = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns), F.lit(True).alias("s_here"))
    t = target.select("*", F.lit(True).alias("t_here"))
    on = [t[k] == s[f"s_{k}"] for k in keys]
    both = t.join(s, on, "full" if insert else "left")
    if delete_when is not None:
        both = both.where(~F.coalesce(F.col("t_here") & F.col("s_here") & delete_when, F.lit(False)))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"s_{c}")).alias(c))
        elif c in source.columns:
            new = F.col(f"s_{c}")
            out.append(F.when(F.col("t_here").isNull(), new).when(F.col("s_here") & F.lit(c in columns), new).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def scd2(dimension: DataFrame, latest: DataFrame, key: str, tracked: list[str], at: Column, start: str = "start_time", end: str = "end_time", active: str = "is_active") -> DataFrame:
    """Slowly changing dimension, type 2: active rows whose tracked columns changed are closed, and a new one opened."""
    now = latest.select(F.col(key).alias("n_key"), *(F.col(c).alias(f"n_{c}") for c in tracked))
    same = [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in tracked]
    differs = ~F.reduce(F.array(*same), F.lit(True), lambda a, b: a & b)
    closing = F.col(active) & F.col("n_key").isNotNull() & differs
    old = dimension.join(now, F.col(key) == F.col("n_key"), "left")
    kept = old.select(key, *tracked, start, F.when(closing, at).otherwise(F.col(end)).alias(end), F.when(closing, False).otherwise(F.col(active)).alias(active))
    current = dimension.where(F.col(active)).select(F.col(key).alias("c_key"), *(F.col(c).alias(f"c_{c}") for c in tracked))
    unchanged = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in tracked]
    fresh = latest.join(current, [F.col(key) == F.col("c_key"), *unchanged], "left_anti")
    opened = fresh.select(key, *tracked, at.alias(start), F.lit(None).cast(dimension.schema[end].dataType).alias(end), F.lit(True).alias(active))
    return kept.unionByName(opened)


def latest_writer_before(writers: DataFrame, readers: DataFrame, key: str, order: str) -> DataFrame:
    """For each reading statement the last earlier one that wrote the same key; null if there was none."""
    w = writers.select(F.col(key).alias(key), F.col(order).alias("o"), F.col(order).alias("written"), F.lit(0).alias("reads"))
    r = readers.select(F.col(key).alias(key), F.col(order).alias("o"), F.lit(None).cast(writers.schema[order].dataType).alias("written"), F.lit(1).alias("reads"))
    # at one order the read comes first: a statement doesn't read what it writes itself
    at = Window.partitionBy(key).orderBy("o", F.col("reads").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return w.unionByName(r).withColumn("writer", F.last("written", ignorenulls=True).over(at)).where("reads = 1").select(key, F.col("o").alias(order), "writer")
