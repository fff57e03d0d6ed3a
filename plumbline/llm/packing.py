"""Harmonic packing of documents into fixed-length training sequences.

A document's ids, an end id after them, are cut into whole sequences and a tail; the tail into pieces. A piece of
length n belongs to the class k = capacity // n, and a bin of class k is full with exactly k pieces, whatever else comes:
no search, one open bin for each class. As cuts are free, a tail gives up its largest exact share capacity // k until
what is left is short (or wastes little), so that bins are full to within a few per cent. Every task fills its own bins
from its own rows, without a shuffle; what it has open at its end goes together by first fit, decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Batches, batch, texts
from .token_counts import Encoder

CAPACITY = 1024
#: Tails up to this many ids are not cut further; the waste of a bin of class k is below 1 in k + 1.
SHORT = 64
#: A piece may leave this many ids of its bin empty without being cut.
SLACK = 20
_BITS = 33


def cut_lengths(n: int, capacity: int = CAPACITY, short: int = SHORT, slack: int = SLACK) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest <= short or capacity - k * rest <= slack:
            out.append(rest)
            break
        share = capacity // (k + 1)
        out.append(share)
        rest -= share
    return out


class Bins:
    """Open bins of one task. ``emit`` gets each full bin as a list of pieces; a piece is (length, anything)."""

    def __init__(self, capacity: int, emit: Callable[[list], None]):
        self.capacity, self.emit, self.open = capacity, emit, {}

    def add(self, length: int, piece) -> None:
        k = self.capacity // length
        own = self.open.setdefault(k, [])
        own.append((length, piece))
        if len(own) == k:
            del self.open[k]
            self.emit(own)

    def close(self) -> None:
        """First fit, decreasing, over the few pieces that are left: fewer than k in each class."""
        rest, room, bins = sorted((p for own in self.open.values() for p in own), key=lambda p: -p[0]), [], []
        for p in rest:
            i = next((i for i, free in enumerate(room) if free >= p[0]), None)
            if i is None:
                room.append(self.capacity)
                bins.append([])
                i = len(bins) - 1
            room[i] -= p[0]
            bins[i].append(p)
        self.open = {}
        for own in bins:
            self.emit(own)


def packer(encoder: Encoder, capacity: int, end_id: int, keep_ids: bool) -> Callable[[Batches], Batches]:
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << _BITS
        done: list[tuple] = []

        def emit(own: list) -> None:
            nonlocal serial
            offset = 0
            for length, (doc, start, crc, total, ids) in own:
                done.append((doc, start, length, crc, total, serial, offset) + ((ids,) if keep_ids else ()))
                offset += length
            serial += 1

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)] if done else [[] for _ in schema]
            done.clear()
            return batch(schema, columns)

        bins = Bins(capacity, emit)
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), texts(rows)):
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                raw, at = memoryview(ids).cast("B"), 0
                for n in cut_lengths(len(ids), capacity):
                    bins.add(n, (doc, at, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids), ids[at : at + n].astype(np.int32) if keep_ids else None))
                    at += n
                if len(done) >= (2_000 if keep_ids else 20_000):
                    yield flush()
        bins.close()
        yield flush()

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, encoder: Encoder | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.

    Null and empty texts are a document of the end id alone; a null doc_id stays null; repeated rows are packed again;
    other columns are neither read nor returned; an empty table gives no pieces. Sequences of one task are numbered from
    its partition's number times 2^33, so a task that runs again gives the same numbers. Narrow: no shuffle.
    """
    slim = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return slim.mapInArrow(packer(encoder or Encoder(), capacity, end_id, keep_ids), schema)
