"""What several of the text operators share: word rules, Arrow plumbing, a place for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contract: a run of anything but space and the five control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

Batches = Iterator[pa.RecordBatch]


def ascii_lower(data: bytes) -> bytes:
    return data.translate(_LOWER)


def words_of(data: bytes) -> list[bytes]:
    """``bytes.split`` without arguments parts at exactly the six characters that WORD excludes."""
    return data.split()


def n_words(column) -> F.Column:
    """Words of a text as a JVM expression; null counts as no words."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def texts(rows: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in rows.column(name).to_pylist()]


def text_bytes(rows: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [t or b"" for t in rows.column(name).cast(pa.binary()).to_pylist()]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder that the cluster names in spark.checkpoint.dir; without one (tests, a laptop) a local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the loss of executors and ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read from there; and where it is."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Takes a folder that ``written`` made away."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
