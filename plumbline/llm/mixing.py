"""Mixing sources to target weights by capped water-filling.

Targets: a source gets its share of the budget by weight, but no more than ``max_epochs`` times its own size; what it
cannot take is shared again by weight until no target is above its cap. The level at which this ends has a closed form
over the sources in order of cap over weight. Ranks and running sums over the sources, of which there may be as many as
domains, are sums within ranges of the order, moved on by the sums of the ranges before.

Sample: every document is taken floor(target / size of its source) times, and once more if it comes before its source's
threshold in an order by a seeded hash of id and text, placed so that the words taken come within half a document of the
target. The threshold is found without sorting a source: words are summed by source and hash bucket first, and only the
one bucket in which the threshold lies is ordered. A source with a third of all rows is thus spread over all its buckets.
Rows of one id and text count as one entry with a number; where the threshold falls inside it, as many as are needed go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
_BITS, _BUCKET_BITS = 52, 12
#: The table of sources is broadcast up to this many rows (of some 100 bytes) and joined by shuffle beyond it.
BROADCAST_SOURCES = 20_000


def hashed(id_col: F.Column, text_col: F.Column, seed: int) -> F.Column:
    """52 bits of an MD5 of seed, id and text, which any SQL engine can repeat."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long")


_SOURCE = ["s_null", "s_key"]


def _keys(source: F.Column) -> list[F.Column]:
    return [source.isNull().alias("s_null"), F.coalesce(source, F.lit("")).alias("s_key")]


def running(df: DataFrame, order: list[F.Column | str], sums: dict[str, F.Column]) -> DataFrame:
    """df with, for each of ``sums``, the sum of all rows before in the order. Rows are cut into ranges; what goes through the
    driver is one row for each range."""
    ranged = cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(*(F.sum(c).alias(n) for n, c in sums.items())).orderBy("range").collect()
    own, before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), {n: 0 for n in sums}
    moved = []
    for row in totals:
        moved.append((row["range"], *before.values()))
        before = {n: v + (row[n] or 0) for n, v in before.items()}
    offsets = df.sparkSession.createDataFrame(moved, "range int, " + ", ".join(f"off_{n} long" for n in sums))
    return ranged.join(F.broadcast(offsets), "range").select(*df.columns, *((F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"off_{n}")).alias(n) for n, c in sums.items()))


def water_fill(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to one row (s_null, s_key, source_size) for each source."""
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    ranked = running(totals, _SOURCE, {"rank": F.lit(1).cast("long")})
    capped = ranked.select(
        *_SOURCE, "source_size", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * max_epochs).alias("cap")
    )
    order = [F.col("cap").cast("double") / F.col("weight").cast("double"), F.col("s_null"), F.col("s_key")]
    level = cut(running(capped, order, {"before": F.col("cap"), "lighter": F.col("weight")}))
    total, weight = level.agg(F.sum("source_size"), F.sum("weight")).first()
    level = level.withColumn("level", (F.lit(total or 0) - F.col("before")).cast("double") / (F.lit(weight or 0) - F.col("lighter")).cast("double"))
    free = level.where(F.col("weight").cast("double") * F.col("level") <= F.col("cap").cast("double"))
    first = free.agg(F.min_by("level", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))).first()[0]
    fits = F.col("weight").cast("double") * F.lit(first).cast("double")
    return level.select(*_SOURCE, "source_size", F.when(fits > F.col("cap").cast("double"), F.col("cap").cast("double")).otherwise(fits).alias("target"))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    u = hashed(df[id_col], df[text_col], seed)
    own = df.select(df[id_col].cast("long").alias("doc_id"), *_keys(df[source_col]), n_words(df[text_col]).alias("size"), u.alias("u"), F.shiftright(u, _BITS - _BUCKET_BITS).alias("bucket"))
    return cut(own)


_ENTRY = ["u", "doc_id", "size"]


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: source_size, target, whole repetitions, the last entry (u, doc_id, size) that gets one more,
    and how many of that entry's rows get it."""
    by = _SOURCE
    buckets = sizes.groupBy(*by, "bucket").agg(F.sum("size").alias("words"))
    targets = water_fill(buckets.groupBy(*by).agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(targets.withColumn("whole", ratio).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = buckets.withColumn("before", before).join(targets, by).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))).select(*by, "bucket", "before", "need")
    inside = sizes.join(at, [*by, "bucket"]).groupBy(*by, "bucket", *_ENTRY).agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("need").alias("need"))
    order = Window.partitionBy(*by, "bucket").orderBy("u", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    # row i of an entry (from 0) is taken if first + i * size + size / 2 < need
    most = F.when(F.col("size") > 0, F.ceil((F.col("need") - F.col("first")) / F.col("size") - 0.5)).otherwise(F.when(F.col("first") < F.col("need"), F.col("n")).otherwise(0))
    taken = inside.withColumn("first", first).withColumn("k", F.least(F.greatest(most, F.lit(0)), F.col("n")).cast("long")).where("k > 0")
    last = taken.groupBy(*by).agg(F.max(F.struct(*_ENTRY, "k", "n")).alias("last"))
    # the bucket's first document may lie beyond the need: then all earlier buckets are taken, and nothing of this one
    edge = at.select(*by, F.struct(F.shiftleft(F.col("bucket"), _BITS - _BUCKET_BITS).alias("u"), F.lit(None).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n")).alias("edge"))
    return targets.join(edge, by, "left").join(last, by, "left").select(*by, "source_size", "target", "whole", F.coalesce("last", "edge").alias("last"))


def with_copies(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds ``copies`` to rows that hold s_null, s_key, u, doc_id and size."""
    small = plans.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    mine, last = F.struct(*_ENTRY), F.struct(*(F.col(f"last.{c}").alias(c) for c in _ENTRY))
    joined = rows.join(F.broadcast(plans) if small else plans, _SOURCE)
    there = F.col("last").isNotNull()
    split = there & (mine == last) & (F.col("last.k") < F.col("last.n"))
    extra = F.when(there & (mine <= last) & (F.col("last.k") > 0), 1).when(there & (mine < last), 1).otherwise(0)
    kept = [*rows.columns, "source_size", "target"]
    some = plans.where("last.k > 0 AND last.k < last.n").limit(1).count()
    if not some:
        return joined.select(*kept, (F.col("whole") + extra).cast("long").alias("copies"))
    # equal rows of an entry inside which the threshold lies: numbered by where they lie, and so many taken
    where = cut(joined.where(split).withColumn("range", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    by = [*_SOURCE, "range"]
    offset = F.coalesce(F.sum("here").over(Window.partitionBy(*_SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = where.groupBy(*by).agg(F.count(F.lit(1)).alias("here")).withColumn("off", offset).drop("here")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("row")) + F.col("off")
    equal = where.join(offsets, by).select(*kept, (F.col("whole") + (place <= F.col("last.k")).cast("long")).alias("copies"))
    rest = joined.where(~F.coalesce(split, F.lit(False)))
    return rest.select(*kept, (F.col("whole") + extra).cast("long").alias("copies")).unionByName(equal)


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    Null text has size 0; null sources are one source, the last; a null id is ordered as the text 'null'; rows that share an
    id are ordered by a hash of their texts too, and of rows equal in id, text and source as many are taken as the target
    needs; a text of any length is one document; an empty table gives no rows; extra columns are not read.
    """
    sizes = sized(df, id_col, text_col, source_col, seed)
    found = with_copies(sizes, cut(plan(sizes, weights, max_epochs)))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as the plan takes it, with its columns; nulls, ties, repeated rows and empty tables
    as in mix_plan. Texts are not shuffled, but for rows equal in id and text among which the threshold falls."""
    plans = cut(plan(sized(df, id_col, text_col, source_col, seed), weights, max_epochs))
    own = [df[c].alias(f"own_{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*own, *_keys(df[source_col]), hashed(df[id_col], df[text_col], seed).alias("u"), df[id_col].cast("long").alias("doc_id"), n_words(df[text_col]).alias("size"))
    taken = with_copies(rows, plans).where(F.col("copies") > 0)
    copies = taken.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return copies.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(df.columns)))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS u
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t),
l AS (SELECT *, row_number() OVER o AS place,
             CAST(total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
               / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM r WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST)),
f AS (SELECT source, source_size, CASE WHEN weight * final > cap THEN CAST(cap AS DOUBLE) ELSE weight * final END AS target
      FROM (SELECT *, min_by(level, place) FILTER (WHERE weight * level <= cap) OVER () AS final FROM l)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM f),
x AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS need,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN before + size / 2 < need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
