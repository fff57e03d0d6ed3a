"""Near-duplicates by SimHash: fingerprints that differ in at most RADIUS bits are linked, and links are followed.

Distinct fingerprints are indexed, so copies meet once however many there are. The 64 bits are cut into ``blocks``;
fingerprints within the radius agree in at least ``blocks - RADIUS`` of them, so they meet in the shard of some choice of
that many blocks and their values. Each shard is a BK-tree (children keyed by their Hamming distance to the parent), and
only edges within the radius are followed. How finely to cut follows from the number of fingerprints alone; every cut is
exact. Shards are spread over the cluster rather than broadcast, as all trees together grow with the corpus. A shard that
is larger than expected is dealt to several parts of bounded size, and every two parts meet in a cell of their own, where
one is a tree and the other asks it; so no task holds more than two parts, however many fingerprints lie near each other.

A pair is counted only in the first shard where it meets. Hits are streamed: a shard keeps, for each fingerprint, the
number of documents linked and the group so far, never the pairs, and returns one edge to the least fingerprint of the
group. Groups are then joined over all shards by alternating large and small stars, each round checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, ascii_lower, batch, cut, text_bytes, words_of

RADIUS = 6
SEED = 42
#: Fingerprints that a shard should hold on average, and from which on it is salted into trees of this size.
SHARD, HOT = 512, 8192
_PART = 65_536
#: (query, node) pairs that are compared at once.
_FRONTIER = 65_536


def fingerprint(data: bytes) -> int:
    """Of a UTF-8 text: majority of the bits of its shingles' XXH64, as an unsigned number; no words: zero."""
    words = words_of(ascii_lower(data))
    if not words:
        return 0
    n, ones, digest = max(len(words) - 1, 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, _PART):
        part = words[i : i + _PART + 1]
        shingles = map(b" ".join, zip(part, part[1:])) if len(words) > 1 else words
        h = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">u8")[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_ROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("fp", pa.int64())])


def _fingerprinted(batches: Batches) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield batch(_ROW, [rows.column(0), rows.column(1), _signed([fingerprint(t) for t in text_bytes(rows)])])


def _digest(text: F.Column) -> F.Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, its fingerprint as a signed long and, if wanted, the MD5 of its text; null texts are empty."""
    named = _digest(df[text_col]) if digest else F.lit(None).cast("string")
    slim = df.select(df[id_col].cast("long").alias("doc_id"), named.alias("digest"), df[text_col].cast("string").alias("text"))
    return slim.mapInArrow(_fingerprinted, "doc_id long, digest string, fp long").select("doc_id", "fp", *["digest"] * digest)


class Cut:
    """Blocks of the 64 bits, and all choices of ``pick`` of them: what any two fingerprints within the radius share."""

    def __init__(self, blocks: int, radius: int = RADIUS):
        self.pick = blocks - radius
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
        self.choices = list(combinations(range(blocks), self.pick))

    @staticmethod
    def bits(blocks: int, radius: int = RADIUS) -> float:
        return 64 * (blocks - radius) / blocks

    def keys(self, fp: F.Column) -> F.Column:
        """For each choice its number and the chosen bits."""

        def signed(m: int) -> int:
            return m - (1 << 64) if m >> 63 else m

        return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(signed(reduce(int.__or__, (self.masks[b] for b in c))))).alias("part")) for i, c in enumerate(self.choices)))

    def must_differ(self) -> np.ndarray:
        """For each choice, masks of the blocks before its last that it leaves out: a pair that agrees in a choice meets there
        first if it differs in each of them. Rows are filled up with all bits, in which unequal fingerprints differ."""
        out = np.full((len(self.choices), len(self.masks) - self.pick), np.uint64((1 << 64) - 1))
        for i, c in enumerate(self.choices):
            for j, b in enumerate(b for b in range(c[-1]) if b not in c):
                out[i, j] = self.masks[b]
        return out


def cut_for(n: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """The fewest blocks with which n evenly spread fingerprints give shards of at most ``shard``."""
    blocks = radius + 1
    while n / 2 ** Cut.bits(blocks, radius) > shard and comb(blocks + 1, radius) <= 1000:
        blocks += 1
    return blocks


class Trees:
    """BK-trees of many shards, grown together level by level."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        shards, self.roots, own = np.unique(shard, return_index=True, return_inverse=True)
        self.shards = shards
        parent = self.roots[own]
        active = np.setdiff1d(np.arange(len(fp)), self.roots, assume_unique=True)
        keys, children = [], []
        while len(active):
            key = parent[active] * 65 + np.bitwise_count(fp[active] ^ fp[parent[active]])
            edge, first, where = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(active[first])
            rest = np.ones(len(active), bool)
            rest[first] = False
            parent[active] = active[first][where]
            active = active[rest]
        keys, children = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def near(self, fp: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of all nodes within the radius in the queries' own shards, a bounded number at a time."""
        at = np.searchsorted(self.shards, shard)
        there = np.flatnonzero((at < len(self.shards)) & (self.shards[np.minimum(at, len(self.shards) - 1)] == shard)) if len(self.shards) else np.zeros(0, np.int64)
        frontier = [(there, self.roots[at[there]])]
        while frontier:  # depth first: a node has at most 2 * radius + 1 children to follow
            query, node = frontier.pop()
            if len(query) > _FRONTIER:
                frontier.append((query[_FRONTIER:], node[_FRONTIER:]))
                query, node = query[:_FRONTIER], node[:_FRONTIER]
            d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield query[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - lo
            if n.any():
                frontier.append((np.repeat(query, n), self.children[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]))


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the least one that is reachable over the edges."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            return label


_FOUND = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])


def _search(cutting: Cut, radius: int) -> Callable[[Batches], Batches]:
    differ = cutting.must_differ()

    def shards(rows: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        same = np.r_[False, np.logical_and.reduce([rows[c][1:] == rows[c][:-1] for c in ("choice", "part", "cell")])]
        shard, fp = np.cumsum(~same), rows["fp"].view(np.uint64)
        nodes, asks = np.flatnonzero(rows["tree"]), np.flatnonzero(rows["asks"])
        value, own = np.unique(fp.view(np.int64), return_inverse=True)
        label, n = np.arange(len(value)), np.zeros(len(value), np.int64)
        linked = np.zeros(len(value), bool)
        for query, node in Trees(fp[nodes], shard[nodes]).near(fp[asks], shard[asks], radius):
            query, node = asks[query], nodes[node]
            x = fp[query] ^ fp[node]
            mine = x != 0
            for j in range(differ.shape[1]):
                mine &= x & differ[rows["choice"][query], j] != 0
            query, node = query[mine], node[mine]
            a, b = own[query], own[node]
            n += np.bincount(a, rows["weight"][node], len(n)).astype(np.int64)
            once = np.flatnonzero(~(rows["tree"][query] & rows["asks"][query]))  # two parts meet here alone
            n += np.bincount(b[once], rows["weight"][query[once]], len(n)).astype(np.int64)
            linked[a] = linked[b] = True
            apart = label[a] != label[b]
            if apart.any():
                label = least_reachable(len(value), label[a[apart]], label[b[apart]])[label]
        if not linked.any():
            return None
        return batch(_FOUND, [value[linked], n[linked], value[label[linked]]])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by shard; whole shards are searched as soon as enough rows are there."""
        waiting: dict[str, np.ndarray] | None = None
        for rows in batches:
            new = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "part", "cell", "fp", "weight", "tree", "asks")}
            waiting = new if waiting is None else {c: np.concatenate([waiting[c], new[c]]) for c in new}
            if len(waiting["fp"]) < 50_000:
                continue
            last = np.ones(len(waiting["fp"]), bool)
            for c in ("choice", "part", "cell"):
                last &= waiting[c] == waiting[c][-1]
            whole = int(np.argmax(last))
            if whole and (found := shards({c: v[:whole] for c, v in waiting.items()})):
                yield found
            waiting = {c: v[whole:] for c, v in waiting.items()}
        if waiting is not None and len(waiting["fp"]) and (found := shards(waiting)):
            yield found

    return run


def linked(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """From distinct (fp, weight): fp, n (weight of the others within the radius in one shard), least (of its group there)."""
    cutting = Cut(cut_for(fps.count(), radius, shard), radius)
    rows = fps.select(F.explode(cutting.keys(F.col("fp"))).alias("k"), "fp", "weight").select("k.choice", "k.part", "fp", "weight")
    large = cut(rows.groupBy("choice", "part").count().where(F.col("count") > hot).withColumn("parts", F.ceil(F.col("count") / hot)).drop("count"))
    if large.limit(1).count():
        dealt = rows.join(large, ["choice", "part"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("home", F.pmod(F.xxhash64("fp"), F.col("parts")))
        others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        cells = dealt.select("choice", "part", "fp", "weight", "home", F.explode(others).alias("other"))
        cell = F.struct(F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"))
        # the lower part is the tree, the higher asks; a part that meets itself does both
        rows = cells.select("choice", "part", F.to_json(cell).alias("cell"), "fp", "weight", (F.col("home") <= F.col("other")).alias("tree"), (F.col("home") >= F.col("other")).alias("asks"))
    else:
        rows = rows.select("choice", "part", F.lit("").alias("cell"), "fp", "weight", F.lit(True).alias("tree"), F.lit(True).alias("asks"))
    # a row here is many comparisons, so tasks are not put together by their bytes
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "choice", "part", "cell").sortWithinPartitions("choice", "part", "cell", "fp")
    return ordered.mapInArrow(_search(cutting, radius), "fp long, n long, least long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each vertex of edges (u, v): the least vertex that is reachable, by alternating stars."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())

    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        was, now = now, state(edges)
        if was == now:
            return edges.select("u", F.col("v").alias("root"))


def _with_groups(docs: DataFrame, by_fp: DataFrame) -> DataFrame:
    """docs joined to by_fp on fp. A fingerprint that more than one document in 10,000 has (at most 10,000 of them) is sent to
    all tasks, so that no task gets all its documents; the rest is shuffled."""
    most = docs.count() // 10_000
    common = by_fp.where(F.col("weight") > most).limit(10_000)
    marked = docs.join(F.broadcast(common.withColumnRenamed("fp", "common")), F.col("fp") == F.col("common"), "left")
    rest = marked.where("common IS NULL").select(*docs.columns).join(by_fp, "fp")
    columns = [*docs.columns, "n_near", "component_id"]
    return marked.where("common IS NOT NULL").select(*columns).unionByName(rest.select(*columns))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int = SHARD, hot: int = HOT, digest: bool = False) -> DataFrame:
    """doc_id, fp, n_near, component_id for each row and, if wanted, the MD5 of the text.

    Null, empty and wordless texts have fingerprint zero and are linked like any other; a text of any length is read whole,
    in parts; repeated rows are documents of their own; a null id never names a component unless all ids of it are null; an
    empty table gives no rows; other columns are not read.
    """
    docs = cut(fingerprints(df, id_col, text_col, digest))
    fps = cut(docs.groupBy("fp").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("first_doc")))
    found = cut(linked(fps.select("fp", "weight"), radius, shard, hot))
    near = found.groupBy("fp").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("fp").alias("u"), F.col("least").alias("v")))
    # every linked fingerprint but the least of its group has a root; a root is its own
    member = roots.union(roots.select("root", "root")).distinct().withColumnRenamed("u", "fp")
    first = member.join(fps, "fp").groupBy("root").agg(F.min("first_doc").alias("group_doc"))
    group = member.join(first, "root").select("fp", "group_doc")
    by_fp = fps.join(near, "fp", "left").join(group, "fp", "left").select(
        "fp", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_near"), F.coalesce("group_doc", "first_doc").alias("component_id")
    )
    return _with_groups(docs, cut(by_fp))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without near-duplicates: of each group the row with the least id stays, with all its columns under their names.

    Of rows that share that id, the one with the least MD5 of the text stays; of rows that share both, one. Null ids come
    last. Texts are fingerprinted once and shuffled once, to where their group has chosen."""
    found = near_duplicates(df, id_col, text_col, digest=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"), F.col("digest").alias("keep_digest"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("null "), F.col("fp")))
    best = cut(found.groupBy(group.alias("g")).agg(F.min(order).alias("b")).select("b.keep_id", "b.keep_digest"))
    again = found.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count() > 0
    own = df.select(*(df[c].alias(f"own_{i}") for i, c in enumerate(df.columns)), df[id_col].cast("long").alias("key_id"), _digest(df[text_col]).alias("key_digest"))
    kept = own.join(best.hint("shuffle_hash"), own["key_id"].eqNullSafe(best["keep_id"]) & (own["key_digest"] == best["keep_digest"]), "left_semi")
    if again:
        kept = kept.dropDuplicates(["key_id", "key_digest"])
    return kept.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(df.columns)))
