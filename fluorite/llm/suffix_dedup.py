"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Texts are
written once, compressed, as a table bucketed by a partition number p that has nothing to do with their ids; three passes
read it in place (a cogroup with the few facts each p needs), so texts are shuffled once.

* Equal texts are one: all but those with the smallest id of a text are copies, and lose every byte.
* Every window of ``length`` bytes is named by the least hash of its ``gram``-byte strings, so equal windows have equal
  names. Consecutive windows of one name are a segment.
* Pass 1: names and the number of documents with them go to hashed buckets (once per p); those in two documents or more
  come back.
* Pass 2: each p sends the distinct segments of such names, each with its smallest doc_id, to the buckets of the names.
  Segments with equal hashes are compared byte by byte there. Where all segments of a name are equal, all their windows
  are shared. The others are one collection: its suffixes are sorted by ``length`` bytes, and from the transform,
  intervals of suffixes with a common prefix (of 28 bytes at first, as the sort has left them) are expanded breadth-first
  by backward extension, prefix length by prefix length, stopping at ``length``. An interval there is one repeated string, and the smallest doc_id of its segments holds for each of them.
* Pass 3: each p gets back, for each window of its segments, that smallest doc_id, and removes.

A name in more than ``hot`` documents (a passage in a third of a corpus has such names, and where it ends its segments
all differ) would be one large transform in one task. Its windows are sent one by one instead, each named by its own hash
and compared by 96 bits of two hashes: equal ones meet, the others spread over all buckets. No bucket gets a segment or
window more than once from a p.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; a null id counts as the smallest id; rows
with equal ids are one document for the comparison (repeated rows get the same result); an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_of, by_number, bytes_of, eights, first_bytes, hash_grams, hash_ranges, ints, mapped, mix, new_path, partitions, pieces, real_id, rows_of, safe_id, squeezed, stored, u64, unsqueezed

_SPAN = 1 << 18  # bytes of segments in one transform, at most, unless one name has more
_CHUNK = 1 << 20  # bytes of text in one row of the table (a longer document is one row)
_SLICE = 1 << 18  # bytes of text whose windows are hashed at once


# --------------------------------------------------------------------------------------------------- the texts
_TEXTS = pa.schema([("p", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary()), ("data", pa.binary())])


def _pack(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = int(mix(np.array([TaskContext.get().partitionId()], np.uint64))[0] >> np.uint64(33))  # rows go round all p from here
        for batch in batches:
            for piece in pieces(batch, _CHUNK):
                raw, at = bytes_of(piece.column("text"))
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                p = number % n
                yield rows_of(_TEXTS, [(p, ints(piece, "doc_id").astype(np.int64).tobytes(), np.diff(at).tobytes(), b"".join(digests), squeezed(raw))])
                number += 1

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("p", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64())])
    for batch in batches:
        for p, ids, digests in zip(*(batch.column(c).to_pylist() for c in ("p", "ids", "digests"))):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), p, np.int32)), pa.array([digests[32 * i : 32 * i + 32] for i in range(len(ids))], pa.binary()), pa.array(ids)], schema=schema)


class Part:
    """The texts of one p: ids, digests, and the number of those that are no copies; slices of these with their bytes."""

    def __init__(self, texts: pa.Table, side: pa.Table):
        self.texts = texts
        marked = side.filter(pc.is_valid(side.column("digest")))
        self.firsts = dict(zip(marked.column("digest").to_pylist(), marked.column("least").to_pylist()))

    def slices(self, copies: bool = False) -> Iterator[tuple]:
        """(ids, digests, is a copy, bytes, offsets): slices of at most _SLICE bytes or one text; copies only if asked for."""
        for row in self.texts.select(["ids", "sizes", "digests", "data"]).to_batches():
            for ids, sizes, digests, data in zip(*(row.column(c) for c in range(4))):
                ids, sizes, digests = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int64), digests.as_py()
                raw = unsqueezed(data.as_buffer(), np.uint8)
                digests = [digests[32 * i : 32 * i + 32] for i in range(len(ids))]
                copy = np.array([self.firsts.get(d, i) < i for d, i in zip(digests, ids.tolist())], bool)
                ends = np.cumsum(sizes)
                if not copies and copy.any():
                    raw = raw[np.repeat(~copy, sizes)]
                    ids, sizes, digests = ids[~copy], sizes[~copy], [d for d, c in zip(digests, copy) if not c]
                    ends, copy = np.cumsum(sizes), np.zeros(len(ids), bool)
                start = 0
                while start < len(ids):
                    before = int(ends[start] - sizes[start])
                    stop = max(start + 1, int(np.searchsorted(ends, before + _SLICE, side="right")))
                    at = np.concatenate([[0], ends[start:stop] - before])
                    yield ids[start:stop], digests[start:stop], copy[start:stop], raw[before : before + int(at[-1])], at
                    start = stop


def segments(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window + 1) of each segment of all texts, and raw by eights."""
    view = eights(raw)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, view
    least = hash_grams(view, gram)
    width, covered = length - gram + 1, 1
    while covered * 2 <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < width:
        least = np.minimum(least[: len(least) - (width - covered)], least[width - covered :])
    windows = len(raw) - length + 1
    inside = np.ones(windows, bool)  # windows within one text
    for end in at[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    first = np.flatnonzero(new)
    return least[first], first, np.flatnonzero(stop) + 1, view


def _short(names: np.ndarray, n: int) -> np.ndarray:
    """Bucket and low half of a name, in one integer."""
    return buckets_of(names, n).astype(np.uint64) << np.uint64(32) | names & u64(0xFFFFFFFF)


def _lows(names: np.ndarray) -> bytes:
    """Ascending 32-bit names, as the compressed steps from each to the next."""
    return squeezed(np.diff(names.astype(np.uint32), prepend=np.uint32(0)))


def _names(data: bytes, bucket: int) -> np.ndarray:
    return np.cumsum(unsqueezed(data, np.uint32), dtype=np.uint64) | u64(bucket << 32)


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


# ------------------------------------------------------------------------------------------- names in two documents
_SIDE_SQL = "p int, digest binary, least long, bucket int, names binary, hot binary, keys binary, counts binary, values binary"
_ASK = pa.schema([("bucket", pa.int32()), ("p", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])
_NAMES = pa.schema([("p", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("hot", pa.binary())])


def _ask(length: int, gram: int, n: int):
    """Pass 1: the names of a p, and in how many of its documents each is."""

    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        held, out = [np.zeros(0, np.uint64)], []
        for ids, _, _, raw, at in Part(texts, side).slices():
            names, first, _, _ = segments(raw, at, length, gram)
            names = _short(names, n)
            owner = np.searchsorted(at, first, side="right")
            order = np.argsort(names, kind="stable")  # an owner's places ascend
            names, owner = names[order], owner[order]
            held.append(names[np.concatenate([[True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])] if len(names) else names)
        names, counts = np.unique(np.concatenate(held), return_counts=True)
        bounds = np.searchsorted(names, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        if len(names):
            p = texts.column("p")[0].as_py()
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[b], bounds[b + 1])
                out.append((b, p, _lows(names[part] & u64(0xFFFFFFFF)), squeezed(np.minimum(counts[part], 65535).astype(np.uint16))))
        return pa.Table.from_batches([rows_of(_ASK, out)])

    return run


def _shared_names(hot: int):
    """For each p, its names that are in two documents, and those of them that are in more than hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, p, names, counts in zip(*(batch.column(c).to_pylist() for c in _ASK.names)):
                held.setdefault(b, []).append((p, _names(names, 0), unsqueezed(counts, np.uint16)))
        for b, rows in held.items():
            every = np.concatenate([r[1] for r in rows])
            order = np.argsort(every, kind="stable")
            every = every[order]
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            total = np.add.reduceat(np.concatenate([r[2] for r in rows])[order].astype(np.int64), edge)
            several, many = every[edge[total > 1]], every[edge[total > hot]]
            for p, names, _ in rows:
                mine = names[_member(several, names)]
                if len(mine):
                    yield rows_of(_NAMES, [(p, b, _lows(mine), _lows(mine[_member(many, mine)]))])

    return run


# ---------------------------------------------------------------------------------------------- segments to buckets
_OUT = pa.schema([("bucket", pa.int32()), ("p", pa.int32()), ("names", pa.binary()), ("hashes", pa.binary()), ("firsts", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("hot", pa.binary())])


def _asked(side: pa.Table, column: str) -> np.ndarray:
    """All names of a column of side, ascending."""
    rows = side.filter(pc.is_valid(side.column(column)))
    parts = [_names(x, b or 0) for b, x in zip(rows.column("bucket").to_pylist(), rows.column(column).to_pylist())]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _windows(raw: np.ndarray, view: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, hash, place) of each window of some segments."""
    place = gather(first, last - first)
    hashes = hash_ranges(raw, place, place + length, view)
    return _short(mix(hashes ^ u64(0x5851F42D4C957F2D)), n), hashes, place


def _send(length: int, gram: int, n: int):
    """Pass 2: the distinct segments of shared names, or, of hot names, windows, each with its smallest doc_id."""

    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        shared, many = _asked(side, "names"), _asked(side, "hot")
        held = []
        for ids, _, _, raw, at in Part(texts, side).slices() if len(shared) else ():
            names, first, last, view = segments(raw, at, length, gram)
            names = _short(names, n)
            keep = _member(shared, names)
            names, first, last = names[keep], first[keep], last[keep]
            crowd = _member(many, names)
            for name, h, place, size in (
                (names[~crowd], hash_ranges(raw, first[~crowd], last[~crowd] + length - 1, view), first[~crowd], (last - first)[~crowd] + length - 1),
                (*_windows(raw, view, first[crowd], last[crowd], length, n), 0),
            ):
                if len(name):
                    size = np.broadcast_to(size, len(name)).astype(np.int32)
                    held.append(_distinct(name, h, ids[np.searchsorted(at, place, side="right") - 1], size, raw[gather(place, size)]))
        out = []
        if held:
            p = texts.column("p")[0].as_py()
            names, hashes, firsts, sizes, data = _distinct(*(np.concatenate([h[k] for h in held]) for k in range(5)))
            del held
            bounds = np.searchsorted(names, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
            begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                o = slice(bounds[b], bounds[b + 1])
                low = (names[o] & u64(0xFFFFFFFF)).astype(np.uint32)
                text = data[begin[bounds[b]] : begin[bounds[b + 1]]]
                out.append((b, p, _lows(low), hashes[o].tobytes(), squeezed(firsts[o]), squeezed(sizes[o]), squeezed(text), None))
            if len(many):
                out.append((p, p, None, None, None, None, None, squeezed(many)))  # comes back with the answers
        return pa.Table.from_batches([rows_of(_OUT, out)])

    return run


def _distinct(names: np.ndarray, hashes: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple:
    """Each (name, hash) once, ascending, with its smallest doc_id and its bytes."""
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    order = np.lexsort((firsts, hashes, names))
    ranked, hashed = names[order], hashes[order]
    order = order[np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (hashed[1:] != hashed[:-1])])]
    return names[order], hashes[order], firsts[order], sizes[order], data[gather(begin[order], sizes[order])]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of many ranges in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


# --------------------------------------------------------------------------------------------------- the transform
def suffix_order(strings: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(order, low, high, depth): suffixes of all strings by their first ``length`` bytes, and the places of those that agree in depth.

    Prefix doubling from 7 bytes in one integer, without what is settled already. A string's end comes before any byte,
    and suffixes that end within the bytes compared differ from all others. depth is that of the last round but one.
    """
    total = len(strings)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # bytes from here to the string's end
    depth = min(7, length)
    held = np.minimum(left, depth)
    key = first_bytes(eights(strings)[:total], held).byteswap() | held.astype(np.uint64)
    todo = np.argsort(key)  # what is not settled, by place
    order, rank, slots = todo.copy(), np.empty(total, np.int64), np.arange(total)
    key, low, high = key[todo], np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (left[todo[1:]] < depth), [True]]))
        width = np.diff(edge)
        rank[todo] = np.repeat(slots[edge[:-1]], width)
        order[slots] = todo
        several = width > 1
        if depth == length and len(low):  # the intervals of the round before
            return order, low, high, before
        low, high, before = slots[edge[:-1][several]], slots[edge[:-1][several]] + width[several], depth
        if depth == length or not len(low):
            return order, low, high, before
        keep = np.repeat(several, width)
        todo, slots = todo[keep], slots[keep]
        shift = min(depth, length - depth)
        key = rank[todo] * (total + 1) + np.where(left[todo] > shift, rank[np.minimum(todo + shift, total - 1)] + 1, 0)
        turn = np.argsort(key)
        todo, key, depth = todo[turn], key[turn], depth + shift


def repeated(strings: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(interval, position) of every suffix of a collection whose first ``length`` bytes start another suffix too.

    strings are the bytes of all strings in a row; positions count in that row, and intervals ascend. Nothing crosses from
    one string to the next. The order of suffixes ends at ``length`` bytes, where the expansion ends, too; its last round
    but one shows the intervals of shorter prefixes, from which the expansion starts.
    """
    order, low, high, depth = suffix_order(strings, sizes, length)
    place = np.empty(len(order), np.int32)  # of each suffix: the last-to-first mapping of a suffix is the place of the one before
    place[order] = np.arange(len(order), dtype=np.int32)
    inner = np.ones(len(order), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    interval, seen = np.empty(len(order), np.int32), np.zeros(len(order), bool)
    where, ids = order[gather(low, high - low)], np.repeat(np.arange(len(low), dtype=np.int32), high - low)
    for _ in range(length - depth):
        extends = inner[where]  # the transform holds a byte, not the beginning of a string
        target = place[where[extends] - 1]
        interval[target], seen[target] = ids[extends], True
        at = np.flatnonzero(seen)
        seen[at] = False
        where, ids = order[at], interval[at]
        # after one backward step, suffixes of one interval that share the new first byte are again side by side
        head = strings[where]
        edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (head[1:] != head[:-1]), [True]])) if len(at) else np.zeros(1, np.int64)
        width = np.diff(edge)
        keep = np.repeat(width > 1, width)
        where, width = where[keep], width[width > 1]
        ids = np.repeat(np.arange(len(width), dtype=np.int32), width)
        if not len(where):
            break
    return ids.astype(np.int64), where


_ANSWER = pa.schema([("p", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("values", pa.binary()), ("hot", pa.binary())])


def _key(names: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One integer for a segment: both its name and its hash."""
    return mix(names * u64(0x9E3779B97F4A7C15)) ^ hashes


def _expand(length: int):
    """For each segment sent, the smallest doc_id of each of its windows; one for all if they agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, p, names, *row, hot in zip(*(batch.column(c).to_pylist() for c in _OUT.names)):
                if hot is not None:
                    yield rows_of(_ANSWER, [(p, None, None, None, hot)])
                    continue
                firsts, sizes, data = (unsqueezed(x, t) for x, t in zip(row[1:], (np.int64, np.int32, np.uint8)))
                held.setdefault(b, []).append((p, _names(names, b), np.frombuffer(row[0], np.uint64), firsts, sizes, data))
        for b in list(held):
            rows = held.pop(b)
            p = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
            names, hashes, firsts, sizes, data = (np.concatenate([r[k] for r in rows]) for k in range(1, 6))
            del rows
            sizes = sizes.astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            order = np.lexsort((firsts, hashes, names))
            new = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])
            kind = np.empty(len(order), np.int64)
            kind[order] = np.cumsum(new) - 1
            lead = order[new]  # one of each distinct segment, with its smallest doc_id
            for k in range(0, len(order), 1 << 16):  # the bytes of segments with equal hashes
                o = order[k : k + (1 << 16)]
                one = lead[kind[o]]
                if (sizes[o] != sizes[one]).any() or not np.array_equal(data[gather(begin[o], sizes[o])], data[gather(begin[one], sizes[one])]):
                    raise ValueError("two segments have one name and one hash")
            least = firsts[lead]
            group_new = np.concatenate([[True], names[lead][1:] != names[lead][:-1]])
            group = np.cumsum(group_new) - 1
            several = np.flatnonzero((np.bincount(group)[group] > 1) & (sizes[lead] > 0))
            counts = np.ones(len(lead), np.int64)
            windows: dict[int, np.ndarray] = {}
            at = 0
            while at < len(several):  # whole names at a time
                weight = np.cumsum(sizes[lead[several[at:]]])
                stop = at + max(1, int(np.searchsorted(weight, _SPAN)))
                while stop < len(several) and group[several[stop]] == group[several[stop - 1]]:
                    stop += 1
                part = several[at:stop]
                at = stop
                own = sizes[lead[part]]
                starts = np.cumsum(own) - own
                value = np.repeat(least[part], own)
                interval, where = repeated(data[gather(begin[lead[part]], own)], own, length)
                if len(where):
                    edge = np.flatnonzero(np.diff(interval, prepend=-1))
                    smallest = np.repeat(np.minimum.reduceat(value[where], edge), np.diff(edge, append=len(where)))
                    where, smallest = where[smallest < value[where]], smallest[smallest < value[where]]
                    value[where] = smallest
                    for k in np.unique(np.searchsorted(starts, where, side="right") - 1).tolist():
                        one = value[starts[k] : starts[k] + own[k] - length + 1]
                        windows[int(part[k])], counts[part[k]] = one, len(one)
            size = counts[kind]
            flat = np.empty(int(counts.sum()), np.int64)
            base = np.cumsum(counts) - counts
            flat[base] = least
            for k, one in windows.items():
                flat[base[k] : base[k] + len(one)] = one
            for one in np.unique(p):
                mine = np.flatnonzero(p == one)
                values = flat[gather(base[kind[mine]], size[mine])]
                yield rows_of(_ANSWER, [(int(one), _key(names[mine], hashes[mine]).tobytes(), squeezed(size[mine].astype(np.int32)), squeezed(values), None)])

    return run


# ------------------------------------------------------------------------------------------------------- removal
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("digest", pa.binary())])


class Answers:
    """The smallest doc_id of each window of a p's segments and hot windows."""

    def __init__(self, side: pa.Table):
        rows = side.filter(pc.is_valid(side.column("keys")))
        columns = list(zip(*(rows.column(c).to_pylist() for c in ("keys", "counts", "values"))))
        keys = np.concatenate([np.frombuffer(r[0], np.uint64) for r in columns] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([unsqueezed(r[1], np.int32) for r in columns] or [np.zeros(0, np.int32)]).astype(np.int64)
        self.values = np.concatenate([unsqueezed(r[2], np.int64) for r in columns] or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        self.keys, self.counts, self.begin = keys[order], counts[order], (np.cumsum(counts) - counts)[order]
        rows = side.filter(pc.is_valid(side.column("hot")))
        self.hot = np.concatenate([unsqueezed(x, np.uint64) for x in rows.column("hot").to_pylist()] or [np.zeros(0, np.uint64)])

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, row) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        row = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[row] == keys, row


def _gone(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, answers: Answers, length: int, gram: int, n: int) -> np.ndarray:
    """Which bytes are covered by a window that starts in a document with a smaller doc_id, too."""
    names, first, last, view = segments(raw, at, length, gram)
    names = _short(names, n)
    starts, least = [], []
    crowd = _member(answers.hot, names)
    if crowd.any():
        name, h, place = _windows(raw, view, first[crowd], last[crowd], length, n)
        known, row = answers.look(_key(name, h))
        starts.append(place[known])
        least.append(answers.values[answers.begin[row[known]]])
        names, first, last = names[~crowd], first[~crowd], last[~crowd]
    known, row = answers.look(_key(names, hash_ranges(raw, first, last + length - 1, view)))
    first, width, row = first[known], (last - first)[known], row[known]
    index = np.where(np.repeat(answers.counts[row] == 1, width), np.repeat(answers.begin[row], width), gather(answers.begin[row], width))
    starts.append(gather(first, width))
    least.append(answers.values[index])
    starts, least = np.concatenate(starts), np.concatenate(least)
    hit = starts[least < ids[np.searchsorted(at, starts, side="right") - 1]]
    edges = np.zeros(len(raw) + 1, np.int32)  # no two of hit are equal, nor are their ends
    edges[hit] += 1
    edges[hit + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _remove(length: int, gram: int, n: int, digest: bool):
    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        answers, out = Answers(side), []
        for ids, digests, copy, raw, at in Part(texts, side).slices(copies=True):
            gone = _gone(raw, at, ids, answers, length, gram, n) if len(answers.keys) else np.zeros(len(raw), bool)
            rows = []
            for i, (doc, sha, a, b) in enumerate(zip(ids.tolist(), digests, at[:-1].tolist(), at[1:].tolist())):
                own = gone[a:b] if not copy[i] else np.full(b - a, b - a >= length)
                removed = int(np.count_nonzero(own))
                if not removed:
                    rows.append((doc, b - a, 0, 0, None, sha))
                    continue
                kept = raw[a:b][~own].tobytes()
                spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[0])
                rows.append((doc, b - a, removed, spans, None if digest else kept, hashlib.sha256(kept).digest()))
            out.append(rows_of(_RESULT, rows))
        return pa.Table.from_batches(out, _RESULT)

    return run


def _removed(docs: DataFrame, length: int, gram: int, hot: int, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(safe_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    name = f"fluorite_texts_{uuid.uuid4().hex}"
    packed = mapped(rows, _pack(n), "p int, ids binary, sizes binary, digests binary, data binary")
    packed.repartition(n, "p").write.bucketBy(n, "p").option("path", new_path(spark, "texts")).option("compression", "none").saveAsTable(name)
    texts = spark.table(name)

    narrow = mapped(texts.select("p", "ids", "digests"), _digests, "p int, digest binary, doc_id long")
    local = narrow.groupBy("digest", "p").agg(F.min("doc_id").alias("m"), F.count("*").alias("k"))
    least = local.groupBy("digest").agg(F.min("m").alias("least"), F.sum("k").alias("k")).where("k > 1").select("digest", "least")
    copies = stored(local.select("p", "digest").join(least, "digest").select("p", "digest", "least"), "copies")

    def cogrouped(side: DataFrame, run, schema: str) -> DataFrame:
        whole = copies.unionByName(side, allowMissingColumns=True) if side is not None else copies
        missing = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _SIDE_SQL.split(", ")) if c not in whole.columns]
        return texts.groupBy("p").cogroup(whole.select("*", *missing).groupBy("p")).applyInArrow(run, schema)

    asked = cogrouped(None, _ask(length, gram, n), "bucket int, p int, names binary, counts binary")
    names = mapped(by_number(asked, "bucket", n), _shared_names(hot), "p int, bucket int, names binary, hot binary")
    sent = cogrouped(names, _send(length, gram, n), "bucket int, p int, names binary, hashes binary, firsts binary, sizes binary, data binary, hot binary")
    answers = mapped(by_number(sent, "bucket", n), _expand(length), "p int, keys binary, counts binary, values binary, hot binary")
    return cogrouped(answers, _remove(length, gram, n, digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, digest binary")


def without_repeats(docs: DataFrame, length: int = 50, gram: int = 24, hot: int = 8192) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; null where nothing was removed) and their SHA-256 per document."""
    return _removed(docs, length, gram, hot, False).select(real_id(), "n_bytes", "n_removed", "n_spans", "kept", "digest")


def repeat_digest(docs: DataFrame, length: int = 50, gram: int = 24, hot: int = 8192) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = _removed(docs, length, gram, hot, True)
    return out.select(real_id(), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("digest")).alias("kept_sha256"))


__all__ = ["repeat_digest", "repeated", "without_repeats"]
