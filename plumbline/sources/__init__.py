"""Tables for queries: Parquet, CSV and JSON files as temporary views."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Makes a view of each test table that the SQL names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_external(spark: SparkSession, function: str, path: str) -> DataFrame:
    """What the table functions read_csv, read_parquet, read_json and read_ndjson name."""
    reader = spark.read
    if function == "read_csv":
        return reader.option("header", True).option("inferSchema", True).csv(path)
    if function == "read_parquet":
        return reader.parquet(path)
    if function == "read_json":
        return reader.option("multiLine", True).json(path)
    if function == "read_ndjson":
        return reader.json(path)
    raise ValueError(f"no reader for {function}")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: the one the cluster names in spark.checkpoint.dir; without one (tests, a
    laptop) a local folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return sc._jsc.sc().getCheckpointDir().get()
