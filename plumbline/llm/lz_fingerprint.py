"""Lempel-Ziv phrase fingerprints: a text is parsed into dictionary phrases (each is the shortest string not met as a
phrase before), the set of phrases is hashed, and a one-permutation minimum hash of it is kept. Two fingerprints agree
in about as many places as the phrase sets share of their union, which is near for texts that compress well together.

The neighbour of a document in the order of ids is found without a global sort: ids are cut at quantiles into buckets, an
id that many rows share is cut further by a hash of their texts, every bucket is ordered by itself, and the largest
document below a bucket is sent to it as a guest. Texts are shuffled once; a task holds two documents; equal texts that
follow each other are parsed once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Batches, batch

BINS = 128
#: Buckets for each task: their hashes spread the more evenly over tasks the more there are.
SPREAD = 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def parse(data: bytes, at: int, phrases: set, ends: list) -> int:
    """Goes on parsing at a byte; adds phrases and their ends, and returns where the unfinished last phrase begins.

    All prefixes of a phrase are phrases, so the search may begin at the usual length and go up or down."""
    n, add, end = len(data), phrases.add, ends.append
    while at < n:
        j = at + 4
        if data[at:j] in phrases:
            j += 1
            while j <= n and data[at:j] in phrases:
                j += 1
            if j > n:
                break
        else:
            j -= 1
            while j > at and data[at:j] not in phrases:
                j -= 1
            j += 1
            if j > n:
                break
        add(data[at:j])
        end(j)
        at = j
    return at


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 4096)
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(m, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def phrase_hashes(data: bytes, ends: list[int]) -> np.ndarray:
    """A 64-bit hash of each phrase, from prefix sums of a polynomial, in blocks of bounded size."""
    out, e, first, start = [], np.array(ends, np.int64), 0, 0
    while first < len(e):
        last = max(int(np.searchsorted(e, start + _BLOCK, "right")), first + 1)
        own = np.frombuffer(data, np.uint8, int(e[last - 1]) - start, start).astype(np.uint64)
        up, down = _power(len(own) + 1)
        stops = e[first:last] - start
        starts = np.r_[0, stops[:-1]]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own + np.uint64(1)) * up[: len(own)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        out.append(h ^ (h >> np.uint64(31)))
        start, first = int(e[last - 1]), last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each of BINS ranges of hashes the low byte of the least one; -1 for none."""
    h = np.sort(hashes)
    at = np.searchsorted(h, _EDGES)
    here = at < np.r_[at[1:], len(h)]
    out = np.full(BINS, -1, np.int16)
    out[here] = (h[at[here]] & np.uint64(0xFF)).astype(np.int16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the union; a byte agrees by chance once in 256, which is taken out. Two empty sets are alike."""
    n = int(np.count_nonzero((a >= 0) | (b >= 0)))
    if not n:
        return 1.0
    same = int(np.count_nonzero((a == b) & (a >= 0))) / n
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def text_of(sig: np.ndarray) -> str:
    return "".join("--" if v < 0 else f"{v:02x}" for v in sig.tolist())


class Parsed:
    """A text parsed to its cut (before the last third of its code points) and to its end."""

    def __init__(self, text: str):
        self.n = len(text)
        self.tail = self.n // 3
        self.kept = text[: self.n - self.tail].encode()
        self.phrases, self.ends = set(), []
        self.at = parse(self.kept, 0, self.phrases, self.ends)
        self.data = text.encode()
        self.head = None
        self.signature = self._finish(self.data)

    def _finish(self, data: bytes) -> np.ndarray:
        ends = list(self.ends)
        parse(data, self.at, set(self.phrases), ends)
        return signature(phrase_hashes(data, ends))

    def edited(self, following: str) -> tuple[bytes, np.ndarray]:
        data = self.kept + following[: self.tail].encode()
        return data, self._finish(data)


def fingerprint(text: str | None) -> str:
    return text_of(Parsed(text or "").signature)


_FIELDS = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in _FIELDS])


def _pairs(batches: Batches) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    same: tuple[str, tuple] | None = None  # a text followed by itself, and what that gives

    def settle(doc, text: str, own: Parsed, following: str, then: Parsed) -> None:
        nonlocal same
        if following is text or following == text:
            if same is None or same[0] != text:
                same = (text, paired(own, following, then))
            done.append((doc, *same[1]))
        else:
            done.append((doc, *paired(own, following, then)))

    bucket, waiting = None, None
    for rows in batches:
        for own_bucket, guest, doc, text in zip(*(rows.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            if own_bucket != bucket:
                bucket, waiting = own_bucket, None
            elif waiting is None and guest:
                continue  # the guest has been used
            now = waiting[2] if waiting and waiting[1] == text else Parsed(text)
            if waiting:
                settle(*waiting, text, now)
            waiting = None if guest else (doc, text, now)
        if done:
            yield batch(_SCHEMA, [list(c) for c in zip(*done)])
            done.clear()


def paired(own: Parsed, following: str, then: Parsed) -> tuple:
    data, sig = own.edited(following)
    return own.n, hashlib.sha256(data).hexdigest(), text_of(own.signature), text_of(sig), likeness(own.signature, sig), likeness(own.signature, then.signature)


_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _cuts(quantiles: list[int], nulls: int, rows: int, n: int) -> list[tuple[int, int]]:
    """Upper ends (id, hash) of all buckets but the last, in order. An id that is several quantiles is cut by hashes."""
    often: dict[int, int] = {}
    for q in quantiles:
        often[q] = often.get(q, 0) + 1
    if nulls:
        often[_LOW] = often.get(_LOW, 0) + nulls * n // max(rows, 1) + 1
    out = []
    for q, times in sorted(often.items()):
        out += [(q, _LOW + (1 << 64) * j // times) for j in range(1, times)]
        out.append((q, _HIGH))
    return out


def _bucket_of(place: F.Column, cuts: list[tuple[int, int]]) -> F.Column:
    """How many cuts lie below (id, hash), by bisection in one constant array, whatever their number."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    ends = cuts + [(_HIGH, _HIGH)] * ((1 << steps) - 1 - len(cuts))
    table = F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in ends])), "array<struct<k:bigint,h:bigint>>")
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(steps))))
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.element_at(table, at + half) < place, half).otherwise(0))


def fingerprinted(df: DataFrame, text_col: str = "text", column: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each text in a further column (a column of that name is replaced).

    A null text is an empty one, whose fingerprint has no bytes; texts of any length are parsed whole; repeated rows get
    equal fingerprints; an empty table stays empty. Narrow: no shuffle."""
    kept = [c for c in df.columns if c != column or c == text_col]
    own = df.select(*(df[c].alias(f"own_{i}") for i, c in enumerate(kept)), df[text_col].cast("string").alias("text"))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = pa.array([fingerprint(t) for t in rows.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], found], names=[*rows.schema.names[:-1], "found"])

    found = own.mapInArrow(run, StructType([*own.schema.fields[:-1], StructField("found", StringType())]))
    return found.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)), F.col("found").alias(column))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the head of the next document's.

    Next is in descending id, after the last the first; rows of one id follow each other by descending XXH64 (seed 42,
    signed) of their texts, then by text; a null id comes last. A null text is an empty one, whose fingerprint has no bytes;
    a single row is its own next; texts of any length are parsed whole; an empty table gives no rows. Other columns are not
    read.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), F.coalesce(df[id_col].cast("long"), F.lit(_LOW)).alias("key"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = n_buckets or SPREAD * tasks
    total, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    quantiles = rows.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 and total > nulls else []
    cuts = _cuts([int(q) for q in quantiles], nulls if n > 1 else 0, total, n)
    split = sorted({k for k, h in cuts if h != _HIGH})
    # texts are hashed here for ids that are split alone; there are at most as many as buckets
    part = F.when(F.col("key").isin(split), F.xxhash64("text")).otherwise(F.lit(0)) if split else F.lit(0)
    rows = rows.withColumn("place", F.struct(F.col("key").alias("k"), part.cast("long").alias("h")))
    rows = rows.withColumn("bucket", _bucket_of(F.col("place"), cuts))
    # one row for each bucket
    tops = rows.groupBy("bucket").agg(F.max("place").alias("top")).orderBy("bucket").collect()
    goes = spark.createDataFrame([(r["top"]["k"], r["top"]["h"], tops[(i + 1) % len(tops)]["bucket"]) for i, r in enumerate(tops)], "k long, h long, to int")
    both = rows.join(F.broadcast(goes.select(F.struct("k", "h").alias("top"), "to")), F.col("place") == F.col("top"), "left").select(
        F.explode(F.when(F.col("to").isNull(), F.array(F.struct("bucket", F.lit(False).alias("guest")))).otherwise(
            F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"))))).alias("b"),
        "key", "doc_id", "text",
    ).select("b.bucket", "b.guest", "key", "doc_id", "text")
    ordered = both.repartition(tasks, "bucket").sortWithinPartitions("bucket", "guest", F.col("key").desc(), F.xxhash64("text").desc(), "text")
    return ordered.select("bucket", "guest", "doc_id", "text").mapInArrow(_pairs, ", ".join(f"{n} {t}" for n, t in _FIELDS))
