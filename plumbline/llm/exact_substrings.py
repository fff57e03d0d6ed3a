"""Removal of repeated byte strings, as a suffix array finds them, without one suffix array of the corpus.

Every start of a LENGTH-byte window has an anchor: the leftmost least hash among the window's K-byte strings. Equal
windows have equal anchors at equal offsets, so only suffixes that share an anchor need be sorted together, and anchors are
one byte in (LENGTH - K) / 2 or so. Three passes:

1. A run is all windows of one anchor, and its context their bytes. Runs are grouped by anchor and hash of the context:
   all but the first of equal contexts are repeated throughout, and an anchor with one context is done.
2. What is left of an anchor, its different contexts, is a group of suffixes: a mergesort orders them by their first
   LENGTH bytes. Two suffixes are compared by their longest common extension, which a binary search over hashes of their
   prefixes finds; equal ones are verified byte by byte, and the later is repeated and takes no further part. Groups are
   keyed by the hash of the 78 bytes that a third of an anchor's windows have in common, so a passage shared by many texts
   doesn't bring all that surrounds it into one group.
3. Each document joins its repeated windows, and what they cover is cut out.

A sample tells which anchors are in very many texts. Their runs are grouped by anchor and context at once, and the windows
of their contexts dealt by hash to several groups, so that no group of suffixes outgrows a task.

All passes depend on window contents alone, so a huge text is read in segments that overlap by one window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import Batches, batch, cut, text_bytes

LENGTH, K = 100, 32
SPAN = LENGTH - K + 1
#: Offsets of an anchor in its windows are split into parts of this size, each with a key of its own.
PART = 23
#: Bytes that are read at once.
SEGMENT = 1 << 20
#: Anchors to compare, and later spans to remove (some 30 bytes each), are sent to all tasks up to this number, and joined to
#: the texts by a shuffle beyond it.
BROADCAST_ROWS = 2_000_000
#: Suffixes of an anchor with more contexts than this, by the sample of one text in SAMPLE, are dealt to several groups. The
#: table of such anchors has HEAVY rows at most.
HOT_CONTEXTS, SAMPLE, HEAVY = 20_000, 64, 1_000_000
#: Contexts that are sorted at once.
SLICE = 16_000
_FLAG = 1 << 40

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & (1 << 64) - 1, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP = _powers(_BASE, SEGMENT * 2 + LENGTH + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SEGMENT * 2 + LENGTH + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _UP[: len(data)], out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
    """Mixed polynomial hashes of the strings of one length at some starts."""
    if isinstance(starts, slice):
        n = len(sums) - length
        return _mix((sums[length:] - sums[:n]) * _DOWN[:n])
    return _mix((sums[starts + length] - sums[starts]) * _DOWN[starts])


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor, and the hashes of all K-byte strings. Needs LENGTH bytes at least."""
    h = string_hashes(sums, slice(None), K)
    least = _sliding_min(h, SPAN)
    n = len(least)
    at = np.zeros(n, np.int64)
    # windows in which the minimum has just come in at the right, or left at the left, begin a run of one anchor
    new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    ends = np.r_[new[1:], n]
    pending, value = new, least[new]
    # within a run of one minimum the anchor is the first place that holds it, until the run passes that place
    place = _first_equal(h, pending, value)
    while len(pending):
        stop = np.minimum(place + 1, ends)
        _fill(at, pending, stop, place)
        more = stop < ends
        pending, ends, value = stop[more], ends[more], value[more]
        place = _first_equal(h, pending, value)
    return at, h


def _first_equal(h: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    place = start.copy()
    todo = np.flatnonzero(h[place] != value)
    while len(todo):
        place[todo] += 1
        todo = todo[h[place[todo]] != value[todo]]
    return place


def _fill(out: np.ndarray, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> None:
    n = stop - start
    out[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(value, n)


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) such that every window lies in exactly one by its start."""
    if len(data) >= LENGTH:
        for start in range(0, len(data) - LENGTH + 1, SEGMENT):
            yield start, data[start : start + SEGMENT + LENGTH - 1]


def groups_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Segments of several texts put together into arrays of bounded size: bytes, and (text, offset in it, start, windows)."""
    parts, where, size = [], [], 0
    for i, data in enumerate(texts):
        for offset, own in segments(data):
            if size + len(own) > SEGMENT + LENGTH and parts:
                yield np.frombuffer(b"".join(parts), np.uint8), where
                parts, where, size = [], [], 0
            where.append((i, offset, size, len(own) - LENGTH + 1))
            parts.append(own)
            size += len(own)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), where


def _runs(data: np.ndarray, where: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, not across segments: first window, number of windows, anchor, its hash, segment; and
    the prefix sums."""
    sums = prefix_sums(data)
    at, h = anchors(sums)
    starts = np.array([w[2] for w in where], np.int64)
    inside = np.zeros(len(at), bool)
    for _, _, s, n in where:
        inside[s : s + n] = True
    change = np.r_[True, at[1:] != at[:-1]] | np.r_[True, inside[1:] != inside[:-1]]
    change[starts] = True
    first = np.flatnonzero(change)
    count = np.diff(np.r_[first, len(at)])
    keep = inside[first]
    first, count = first[keep], count[keep]
    return first, count, at[first], h[at[first]], np.searchsorted(starts, first, "right") - 1, sums


def _contexts_of(sums: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return _mix((sums[first + count + LENGTH - 1] - sums[first]) * _DOWN[first] ^ count.astype(_U))


class Heavy:
    """Anchors (40 bits) with very many contexts, and to how many groups their suffixes are dealt."""

    def __init__(self, anchor: np.ndarray, groups: np.ndarray):
        order = np.argsort(anchor)
        self.anchor, self.groups = anchor[order], groups[order]

    def dealt(self, h: np.ndarray) -> np.ndarray:
        """The number of groups of each anchor, by its hash."""
        own = (h >> _U(24)).view(np.int64)
        if not len(self.anchor):
            return np.ones(len(own), np.int64)
        at = np.minimum(np.searchsorted(self.anchor, own), len(self.anchor) - 1)
        return np.where(self.anchor[at] == own, self.groups[at], 1)


_RUN = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("shape", pa.int64())])


def _run_rows(heavy: Callable[[], Heavy]) -> Callable[[Batches], Batches]:
    """Runs of each text: anchor, hash of the context, place, and shape: first window, its anchor's offset from there and number
    of windows as one number. Of an anchor's hash, which only brings runs together, 40 bits are kept; that of a heavy one
    is told apart by its context too, and flagged."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            docs, tags = (rows.column(c).to_numpy() for c in ("doc", "tag"))
            for data, where in groups_of(text_bytes(rows)):
                first, count, at, h, segment, sums = _runs(data, where)
                text, offset, start = (np.array([w[j] for w in where], np.int64)[segment] for j in range(3))
                context = _contexts_of(sums, first, count)
                anchor = (h >> _U(24)).view(np.int64)
                often = heavy().dealt(h) > 1
                if often.any():
                    anchor[often] = (_mix(h[often] ^ context[often]) >> _U(24)).view(np.int64) | _FLAG
                yield batch(_RUN, [anchor, context.view(np.int64), docs[text], tags[text], first - start + offset << 14 | at - first << 7 | count])

    return run


def _anchors_of(batches: Batches) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for data, where in groups_of(text_bytes(rows)):
            yield pa.record_batch([(_runs(data, where)[3] >> _U(24)).view(np.int64)], ["anchor"])


_SORTED = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("shape", pa.int64()), ("copy", pa.bool_())])


def _sort_out(batches: Batches) -> Iterator[pa.RecordBatch]:
    """From runs ordered by anchor, context and place: copies of an earlier run, and first runs of contexts that share an
    anchor with another context, or whose anchor is heavy. Holds one run over, whatever the size of a group."""
    last: tuple | None = None  # the row before
    waiting: tuple | None = None  # the first run of its anchor, while that has one context
    for rows in batches:
        own = [rows.column(x).to_numpy() for x in _RUN.names]
        if not len(own[0]):
            continue
        a, c, d, t, s = own
        pa_, pc, pd, pt, ps = (np.r_[[v], x[:-1]] for v, x in zip(last or [x[0] for x in own], own))
        new_anchor, new_context, same = a != pa_, (a != pa_) | (c != pc), (a == pa_) & (c == pc) & (d == pd) & (t == pt) & (s == ps)
        if last is None:
            new_anchor[0] = new_context[0] = True
            same[0] = False
        copies = ~new_context & ~same
        group = np.cumsum(new_anchor)  # 0 is the anchor that goes on from before
        firsts = np.flatnonzero(new_context)
        size = np.bincount(group[firsts], minlength=group[-1] + 1)
        several = (size > 1) | (np.bincount(group, a & _FLAG) > 0)
        if size[0]:
            several[0] = True  # it had a context before
        out = np.zeros(len(a), bool)
        out[firsts] = several[group[firsts]]
        found = [[x[copies], x[out]] for x in (d, t, s)]
        is_copy = [np.ones(copies.sum(), bool), np.zeros(out.sum(), bool)]
        if waiting is not None and size[0]:
            for x, v in zip(found, waiting):
                x.append(np.array([v]))
            is_copy.append(np.zeros(1, bool))
        end = group[-1]
        if end > 0 or size[0]:
            mine = firsts[group[firsts] == end]
            waiting = tuple(x[mine[0]] for x in (d, t, s)) if len(mine) == 1 and not several[end] else None
        last = tuple(x[-1] for x in own)
        if sum(map(len, is_copy)):
            yield batch(_SORTED, [*(np.concatenate(x).astype(np.int64) for x in found), np.concatenate(is_copy)])


_CONTEXT = pa.schema([(c, pa.int64()) for c in ("key", "doc", "tag", "start", "deal", "deals")] + [("bytes", pa.binary())])


def _contexts(places_of: Callable[[pa.RecordBatch], Callable[[int], np.ndarray]], heavy: Callable[[], Heavy]) -> Callable[[Batches], Batches]:
    """Windows around the wanted anchors of each text, in parts: key, place, first window, the bytes of all its windows; those
    of a heavy anchor once for each group to which some of its windows are dealt."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            wanted = places_of(rows)
            docs, tags, own = rows.column("doc").to_numpy(), rows.column("tag").to_numpy(), text_bytes(rows)
            places = [wanted(i) for i in range(len(docs))]
            own = [t if len(p) else b"" for t, p in zip(own, places)]
            for data, where in groups_of(own):
                first, count, at, h, segment, sums = _runs(data, where)
                text, offset, start = (np.array([w[j] for w in where], np.int64) for j in range(3))
                keep = np.zeros(len(first), bool)
                place = at - start[segment] + offset[segment]
                for s in range(len(where)):
                    lo, hi = np.searchsorted(segment, s), np.searchsorted(segment, s, "right")
                    keep[lo:hi] = np.isin(place[lo:hi], places[text[s]])
                first, count, at, h, segment = (v[keep] for v in (first, count, at, h, segment))
                groups, raw = heavy().dealt(h), data.tobytes()
                out: list[list] = [[] for _ in _CONTEXT]
                # offsets of the anchor in its windows fall from at - first to at - last
                for part in range((SPAN + PART - 1) // PART):
                    low, high = part * PART, min((part + 1) * PART, SPAN) - 1
                    lo = np.maximum(first, at - high)
                    hi = np.minimum(first + count - 1, at - low)
                    mine = np.flatnonzero(lo <= hi)
                    if not len(mine):
                        continue
                    core = string_hashes(sums, at[mine] - low, LENGTH - (high - low))
                    key = _mix(core ^ _mix(h[mine] + _U(part)))
                    lo, hi, seg, deals = lo[mine], hi[mine], segment[mine], groups[mine]
                    row, deal = _deal(sums, lo, hi, deals)
                    key = np.where(deals[row] > 1, _mix(key[row] + _mix(deal.astype(_U) + _U(1))), key[row])
                    of = text[seg[row]]
                    for column, v in zip(out, (key.view(np.int64), docs[of], tags[of], (lo - start[seg] + offset[seg])[row], deal, deals[row])):
                        column.append(v)
                    out[6] += [raw[a : b + LENGTH] for a, b in zip(lo[row].tolist(), hi[row].tolist())]
                if out[6]:
                    yield batch(_CONTEXT, [*(np.concatenate(c) for c in out[:6]), out[6]])

    return run


def _deal(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, deals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) for each group that some window of the row is dealt to, by the window's hash."""
    row = np.flatnonzero(deals <= 1)
    many = np.flatnonzero(deals > 1)
    if not len(many):
        return row, np.zeros(len(row), np.int64)
    n = (hi - lo + 1)[many]
    each = np.repeat(many, n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[each]
    group = (string_hashes(sums, window, LENGTH) % deals[each].astype(_U)).astype(np.int64)
    pairs = np.unique(np.stack([each, group], axis=1), axis=0)
    return np.r_[row, pairs[:, 0]], np.r_[np.zeros(len(row), np.int64), pairs[:, 1]]


class Suffixes:
    """Suffixes of one array of bytes, ordered by their first LENGTH bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, prefix_sums(data)
        self.eights = np.ndarray((max(len(data) - 7, 0),), ">u8", data, 0, (1,))

    def common(self, a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
        """Length of the longest common extension of a and b, which have ``known`` bytes in common and LENGTH not: binary search
        over the hashes of their prefixes."""
        low, high = np.full(len(a), known), np.full(len(a), LENGTH - 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = (self.sums[a + middle] - self.sums[a]) * _DOWN[a] == (self.sums[b + middle] - self.sums[b]) * _DOWN[b]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the LENGTH bytes at a and b are the same, byte by byte (eight at a time)."""
        same = np.ones(len(a), bool)
        for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            same &= self.eights[a + j] == self.eights[b + j]
        return same

    def compare(self, a: np.ndarray, b: np.ndarray, hash_a: np.ndarray, hash_b: np.ndarray, known: int = 8) -> np.ndarray:
        """-1, 0 or 1 for each pair of starts. Where hashes collide, bytes decide."""
        out = np.zeros(len(a), np.int8)
        alike = np.flatnonzero(hash_a == hash_b)
        wrong = alike[~self.verified(a[alike], b[alike])]
        other = np.flatnonzero(hash_a != hash_b)
        x, y = a[other], b[other]
        n = self.common(x, y, known)
        p, q = self.data[x + n].astype(np.int16), self.data[y + n].astype(np.int16)
        out[other] = np.sign(p - q)
        for i in [*wrong.tolist(), *other[p == q].tolist()]:
            u, v = (self.data[s[i] : s[i] + LENGTH].tobytes() for s in (a, b))
            out[i] = (u > v) - (u < v)
        return out

    def repeats(self, start: np.ndarray, group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which suffixes have an equal one before them in their group, of suffixes in the order of their places.

        Suffixes with the same first eight bytes are merged from runs of one to a single run, all groups level by level; of two
        equal ones the earlier goes on."""
        again = np.zeros(len(start), bool)
        head = self.eights[start].astype(_U)
        order = np.lexsort((head, group))
        new = np.r_[True, (head[order][1:] != head[order][:-1]) | (group[order][1:] != group[order][:-1])]
        bucket = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        run = np.arange(len(order)) - first[bucket]  # number of its run in the bucket; suffixes of a run are in order
        while True:
            most = np.zeros(bucket[-1] + 1 if len(bucket) else 0, np.int64)
            np.maximum.at(most, bucket, run)
            active = most[bucket] > 0
            order, bucket, run = order[active], bucket[active], run[active]
            if not len(order):
                return again
            edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (run[1:] != run[:-1])])
            number = np.cumsum(np.r_[False, (bucket[1:] != bucket[:-1]) | (run[1:] != run[:-1])])
            end = np.r_[edge[1:], len(order)]
            right = np.flatnonzero(run % 2 == 1)  # each looks for its place in the run before its own
            low, high = edge[number[right] - 1], end[number[right] - 1]
            found = np.full(len(right), -1)
            todo = np.arange(len(right))
            while len(todo):
                middle = (low[todo] + high[todo]) >> 1
                x, y = order[right[todo]], order[middle]
                c = self.compare(start[x], start[y], hashes[x], hashes[y])
                low[todo], high[todo] = np.where(c > 0, middle + 1, low[todo]), np.where(c < 0, middle, high[todo])
                found[todo[c == 0]] = middle[c == 0]
                todo = todo[(c != 0) & (low[todo] < high[todo])]
            equal = np.flatnonzero(found >= 0)
            x, y = order[right[equal]], order[found[equal]]
            again[np.maximum(x, y)] = True
            order[found[equal]] = np.minimum(x, y)
            place = 2 * np.arange(len(order)) + 1
            place[right] = 2 * low
            stay = np.ones(len(order), bool)
            stay[right[equal]] = False
            order, bucket, run, place = order[stay], bucket[stay], run[stay] // 2, place[stay]
            merged = np.argsort(place, kind="stable")
            order, bucket, run = order[merged], bucket[merged], run[merged]


_RANGE = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])


class _Compare:
    """Contexts come ordered by key and place. Of a key that goes on, the distinct windows met so far are kept: their hashes in
    order, and their bytes."""

    def __init__(self):
        self.last: tuple | None = None  # key and place of the row before
        self._begin(None)

    def _begin(self, key: int | None) -> None:
        self.key, self.hashes, self.bytes = key, np.zeros(0, _U), np.zeros((0, LENGTH), np.uint8)

    def _known(self, data: np.ndarray, window: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which windows of the key that goes on were met in earlier slices."""
        known = np.zeros(len(window), bool)
        if len(self.hashes):
            lo, hi = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
            while (there := np.flatnonzero((lo < hi) & ~known)).size:
                for i in range(0, len(there), 20_000):
                    x = there[i : i + 20_000]
                    known[x] = (data[window[x][:, None] + np.arange(LENGTH)] == self.bytes[lo[x]]).all(axis=1)
                lo[there] += 1
        return known

    def _keep(self, data: np.ndarray, window: np.ndarray, hashes: np.ndarray) -> None:
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.bytes = every[order], np.concatenate([self.bytes, data[window[:, None] + np.arange(LENGTH)]])[order]

    def rows(self, key: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, deal: np.ndarray, deals: np.ndarray, raw: list[bytes]) -> pa.RecordBatch | None:
        multiple = np.r_[False, key[1:] == key[:-1]]
        multiple[:-1] |= multiple[1:]
        if self.key is not None:
            multiple |= key == self.key
        multiple[-1] = True  # the next slice may go on with it
        # a row that is there again, as its document is, says nothing new
        places = (key, doc, tag, start)
        multiple[1:] &= np.logical_or.reduce([v[1:] != v[:-1] for v in places])
        multiple[0] &= self.last != tuple(int(v[0]) for v in places)
        self.last = tuple(int(v[-1]) for v in places)
        pick = np.flatnonzero(multiple)
        if not len(pick):
            return None
        key, doc, tag, start, deal, deals = (v[pick] for v in (key, doc, tag, start, deal, deals))
        raw = [raw[i] for i in pick.tolist()]
        n = np.fromiter((len(r) - LENGTH + 1 for r in raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        row = np.repeat(np.arange(len(raw)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        suffixes, window, position = Suffixes(data), begin[row] + within, start[row] + within
        hashes = string_hashes(suffixes.sums, window, LENGTH)
        mine = np.flatnonzero((deals[row] <= 1) | (hashes % deals[row].astype(_U) == deal[row].astype(_U)))
        row, window, position, hashes = row[mine], window[mine], position[mine], hashes[mine]
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])[row]
        again = suffixes.repeats(window, group, hashes)
        on = np.flatnonzero((key[row] == self.key) & ~again) if self.key is not None else np.zeros(0, np.int64)
        again[on] = self._known(data, window[on], hashes[on])
        if key[-1] != self.key:
            self._begin(key[-1])
        rest = np.flatnonzero((key[row] == self.key) & ~again)
        self._keep(data, window[rest], hashes[rest])
        hit = np.flatnonzero(again)
        if not len(hit):
            return None
        run = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (row[hit][1:] != row[hit][:-1]) | (np.diff(position[hit]) != 1)])
        x = hit[run]
        return batch(_RANGE, [doc[row[x]], tag[row[x]], position[x], np.diff(np.r_[run, len(hit)])])


def _compare(batches: Batches) -> Iterator[pa.RecordBatch]:
    state = _Compare()
    for rows in batches:
        for i in range(0, rows.num_rows, SLICE):
            own = rows.slice(i, SLICE)
            found = state.rows(*(own.column(c).to_numpy() for c in _CONTEXT.names[:-1]), own.column("bytes").to_pylist())
            if found:
                yield found


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans covered by windows, from (first window, number of windows); maximal and in order."""
    out: list[list[int]] = []
    for start, windows in sorted(ranges):
        end = start + windows - 1 + LENGTH
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_MERGED = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _merge(batches: Batches) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        spans = [covered(list(zip(s, n))) for s, n in zip(rows.column("starts").to_pylist(), rows.column("sizes").to_pylist())]
        yield batch(_MERGED, [rows.column("doc"), rows.column("tag"), [[a for a, _ in x] for x in spans], [[b for _, b in x] for x in spans]])


class ByPlace:
    """Values by (doc, tag) in sorted arrays, for lookups of many rows at once."""

    def __init__(self, doc: np.ndarray, tag: np.ndarray, *values: np.ndarray):
        order = np.lexsort((*reversed(values), tag, doc))
        self.doc, self.tag, *self.values = (v[order] for v in (doc, tag, *values))
        self.tagged = bool(len(tag)) and bool((tag != 0).any())

    def bounds(self, rows: pa.RecordBatch) -> tuple[list[int], list[int]]:
        doc, tag = rows.column("doc").to_numpy(), rows.column("tag").to_numpy()
        lo, hi = np.searchsorted(self.doc, doc), np.searchsorted(self.doc, doc, "right")
        if self.tagged:
            for i in np.flatnonzero(lo < hi).tolist():
                own = self.tag[lo[i] : hi[i]]
                lo[i], hi[i] = lo[i] + np.searchsorted(own, tag[i]), lo[i] + np.searchsorted(own, tag[i], "right")
        return lo.tolist(), hi.tolist()


Spans = Callable[[pa.RecordBatch], list[list[tuple[int, int]]]]


def _cut_out(spans_of: Spans, passed: int) -> Callable[[Batches], Batches]:
    """The first ``passed`` columns as they come, then begins and ends of what goes, and the bytes that stay."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            begins, ends, kept = [], [], []
            for data, spans in zip(text_bytes(rows), spans_of(rows)):
                own = [(a, min(b, len(data))) for a, b in spans if a < len(data)]
                begins.append([a for a, _ in own])
                ends.append([b for _, b in own])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *ends[-1]], [*begins[-1], len(data)])))
            added = [pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*rows.columns[:passed], *added], names=[*rows.schema.names[:passed], "begins", "ends", "kept"])

    return run


def heavy_anchors(docs: DataFrame) -> Heavy:
    """Anchors with more than HOT_CONTEXTS runs, as far as a sample of the texts tells; only the layout hangs on them."""
    counts = docs.sample(1 / SAMPLE, seed=1).select("text").mapInArrow(_anchors_of, "anchor long").groupBy("anchor").count()
    found = counts.where(F.col("count") * SAMPLE > HOT_CONTEXTS).orderBy(F.col("count").desc(), "anchor").limit(HEAVY).toArrow()
    return Heavy(found.column("anchor").to_numpy(), found.column("count").to_numpy() * SAMPLE // HOT_CONTEXTS + 1)


def repeated_windows(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, heavy: Heavy | None = None) -> DataFrame:
    """(doc, tag, start, windows): runs of windows that also start earlier, from (doc, tag, text) with no null."""
    context = docs.sparkSession.sparkContext
    sent_heavy = context.broadcast(heavy or heavy_anchors(docs))
    own_heavy = lambda: sent_heavy.value
    runs = docs.mapInArrow(_run_rows(own_heavy), "anchor long, context long, doc long, tag long, shape long")
    ordered = runs.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "tag", "shape")
    sorted_out = cut(ordered.mapInArrow(_sort_out, "doc long, tag long, shape long, copy boolean"))
    start, count = F.shiftright("shape", 14), F.col("shape").bitwiseAND(127)
    copies = sorted_out.where("copy").select("doc", "tag", start.alias("start"), count.alias("windows"))
    shared = sorted_out.where("NOT copy").select("doc", "tag", (start + F.shiftright("shape", 7).bitwiseAND(127)).alias("place"))

    schema = "key long, doc long, tag long, start long, deal long, deals long, bytes binary"
    if shared.count() <= broadcast_rows:
        table = shared.toArrow()
        sent = context.broadcast(ByPlace(*(table.column(c).to_numpy() for c in ("doc", "tag", "place"))))

        def by_table(rows: pa.RecordBatch) -> Callable[[int], np.ndarray]:
            lo, hi = sent.value.bounds(rows)
            return lambda i: sent.value.values[0][lo[i] : hi[i]]

        contexts = docs.mapInArrow(_contexts(by_table, own_heavy), schema)
    else:

        def by_row(rows: pa.RecordBatch) -> Callable[[int], np.ndarray]:
            own = rows.column("places")
            return lambda i: np.array(own[i].as_py(), np.int64)

        wanted = shared.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))
        contexts = docs.join(wanted.hint("shuffle_hash"), ["doc", "tag"]).mapInArrow(_contexts(by_row, own_heavy), schema)
    ordered = contexts.repartition("key").sortWithinPartitions("key", "doc", "tag", "start")
    return copies.union(ordered.mapInArrow(_compare, "doc long, tag long, start long, windows long"))


def _placed(df: DataFrame, id_col: str, text_col: str) -> tuple[F.Column, F.Column]:
    """doc and tag of each row: its place in the order of all. Ids that are not repeated need no tag."""
    doc = F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63)).cast("long"))
    several = df.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").limit(1).count() > 0
    tag = F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))) if several else F.lit(0).cast("long")
    return doc, tag


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, heavy: Heavy | None = None) -> DataFrame:
    """df with three further columns: begins and ends of the spans of bytes that go from each text, and kept, the bytes that stay.

    A byte goes if a LENGTH-byte string over it also starts earlier: in an earlier document, or in the same before. Documents
    are ordered by id, null first; those that share an id by the XXH64 (seed 42, signed) of their texts, each with its own
    spans; rows equal in id and text are one document, with equal results. A null text is an empty one; texts of any length
    are read whole; columns named begins, ends or kept are replaced; other columns stay; an empty table gives no rows.
    """
    doc, tag = _placed(df, id_col, text_col)
    docs = df.select(doc.alias("doc"), tag.alias("tag"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    found = repeated_windows(docs, broadcast_rows, heavy)
    lists = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "windows")).alias("r")).select("doc", "tag", F.col("r.start").alias("starts"), F.col("r.windows").alias("sizes"))
    merged = cut(lists.mapInArrow(_merge, "doc long, tag long, begins array<long>, ends array<long>"))
    names = [c for c in df.columns if c not in ("begins", "ends", "kept")]
    own = df.select(*(df[c].alias(f"own_{i}") for i, c in enumerate(names)), doc.alias("doc"), tag.alias("tag"), df[text_col].cast("string").alias("text"))
    spans = [StructField(c, ArrayType(LongType())) for c in ("begins", "ends")]
    result = StructType([*own.schema.fields[: len(names)], *spans, StructField("kept", BinaryType())])
    if (merged.agg(F.sum(F.size("begins"))).first()[0] or 0) <= broadcast_rows:
        table = merged.select("doc", "tag", F.explode(F.arrays_zip("begins", "ends")).alias("s")).select("doc", "tag", "s.begins", "s.ends").toArrow()
        sent = df.sparkSession.sparkContext.broadcast(ByPlace(*(table.column(c).to_numpy() for c in ("doc", "tag", "begins", "ends"))))

        def by_table(rows: pa.RecordBatch) -> list[list[tuple[int, int]]]:
            begins, ends = sent.value.values
            return [list(zip(begins[a:b].tolist(), ends[a:b].tolist())) for a, b in zip(*sent.value.bounds(rows))]

        cut_texts = own.mapInArrow(_cut_out(by_table, len(names)), result)
    else:

        def by_row(rows: pa.RecordBatch) -> list[list[tuple[int, int]]]:
            return [list(zip(a or (), b or ())) for a, b in zip(rows.column("begins").to_pylist(), rows.column("ends").to_pylist())]

        cut_texts = own.join(merged.hint("shuffle_hash"), ["doc", "tag"], "left").select(*own.columns, "begins", "ends").mapInArrow(_cut_out(by_row, len(names)), result)
    return cut_texts.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(names)), "begins", "ends", "kept")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, heavy: Heavy | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, from without_repeats, whose rules hold for nulls, ties,
    repeated rows and empty tables; other columns are not read."""
    slim = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    found = without_repeats(slim, "doc_id", "text", broadcast_rows, heavy)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
