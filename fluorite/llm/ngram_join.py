"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct 5-word shingles (64-bit hashes). Shingles are hashed into groups; a document's
counts per group are a point, and the overlap of two documents is at most the sum over groups of the smaller count. An
R-tree over such points bounds the overlap of whole boxes the same way (summed minima of the boxes' upper corners), so
box pairs that can't reach the threshold are left without looking inside. Surviving pairs are verified on the sets.

One tree over a corpus would compare everything with everything, so points are first dealt to trees:

* Copies are one point: documents with equal sets form a class (null or wordless texts stay alone). A class is named by
  64 bits of its set; a second hash of 64 bits tells whether two sets share a name, and such are renamed.
* Of two sets of similarity t, their first common shingle in any fixed order is among the first n - ceil(2t/(1+t) n) + 1
  of the smaller one (its core) and the first n - ceil(t n) + 1 of the larger one (its prefix). The order puts shingles
  last that a count sketch over all documents finds frequent, so that common passages deal nothing. The classes with a
  shingle in their prefixes form a tree, without those that no other one fits by size and core; trees with the same
  members are built once.
* Pass 1 of a tree compares each box's members with one of them, and those with one another's: as many pairs as
  members. After verification and one components run, pass 2 walks the tree in full but leaves boxes, and box pairs,
  that lie in one component: what links within a component can't change the result. So a group of near copies costs
  about its size, and no link between components is lost.
* A tree of more than ``BLOCK`` members is cut into blocks by hash: in pass 1 each block is a tree; in pass 2 the blocks
  of its largest component meet those of all others, and these one another, each pair of blocks in a tree of its own.

Shuffled: 14 bytes for each prefix shingle (packed), then points and sets of what shares one. Broadcast: the sketch, of
fixed size, and ids up to ``PICKED``. Shingles are 64-bit hashes.

Defined cases: null, empty or wordless text: n_shingles 0, its own component; fewer than five words: one shingle, the
whole sequence; a null id is treated as the smallest id; equal ids share a component; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import NULL_ID, Words, buckets_of, by_number, components, ints, mapped, mix, partitions, pieces, released, rows_of, safe_id, split_by, squeezed, stored, u64, unsqueezed

SKETCH = 1 << 20  # counters of the frequency sketch
_LEAF, _FAN = 32, 16
FIRST_TREES = 16  # of each class, told to its other trees so that they leave out the pairs found there
BLOCK = 512  # members of a tree that is not cut


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, ascending."""
    shingles, at = Words(texts).shingles(size)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = np.sort(shingles[a:b])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own


def _class_of(s: np.ndarray, renamed: dict[tuple[int, int], int], bits: int) -> int:
    """The class of a set, by its name and, if another set has that name, its twin."""
    if not len(s):
        return 0
    name = _name_of(s, bits)
    return renamed.get((name, _twin_of(s)), name) if renamed else name


def _name_of(s: np.ndarray, bits: int) -> int:
    return int((mix(s.copy()).sum() + np.uint64(len(s)) >> np.uint64(64 - bits)).astype(np.int64)) if len(s) else 0


def _twin_of(s: np.ndarray) -> int:
    return int(mix(s * u64(0xD1342543DE82EF95) + u64(0x632BE59BD9B4E019)).sum().astype(np.int64)) if len(s) else 0


# ---------------------------------------------------------------------------------------- sizes, classes, sketch
_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("twin", pa.int64()), ("point", pa.binary()), ("bucket", pa.int32()), ("counts", pa.binary())])


def _survey(size: int, n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.int64), False
        for batch in batches:
            for piece in pieces(batch):
                out, held = [], []
                for doc, s in zip(piece.column("doc_id").to_pylist(), _sets(piece.column("text"), size)):
                    out.append((doc, len(s), _name_of(s, bits), _twin_of(s), _pack(point_of(s)), None, None))
                    held.append(s)
                sketch += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                seen = True
                yield rows_of(_FIRST, out)
        if seen:  # the sketch, cut into n slices
            for b, part in enumerate(np.array_split(sketch, n)):
                yield rows_of(_FIRST, [(None, None, None, None, None, b, squeezed(part.astype(np.int32)))])

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, counts in zip(batch.column("bucket").to_pylist(), batch.column("counts").to_pylist()):
            sums[b] = sums.get(b, 0) + unsqueezed(counts, np.int32).astype(np.int64)
    yield rows_of(pa.schema([("bucket", pa.int32()), ("counts", pa.binary())]), [(b, x.tobytes()) for b, x in sums.items()])


# --------------------------------------------------------------------------------------------- dealing to trees
_ENTRIES = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary())])


def _prefixes(shared, size: int, percent: int, n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, renamed = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            keys, classes, sizes = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((classes, keys))
            keys, classes, sizes = keys[order], classes[order], sizes[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])])
            keys, classes, sizes = keys[new], classes[new], sizes[new]
            order, bounds = split_by(buckets_of(keys, n), n)
            keys = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # the bucket has the rest; a clash only adds candidates
            return rows_of(_ENTRIES, [(b, keys[o].tobytes(), classes[o].tobytes(), squeezed(sizes[o])) for b in range(n) if len(o := order[bounds[b] : bounds[b + 1]])])

        for batch in batches:
            for piece in pieces(batch):
                for s in _sets(piece.column("text"), size):
                    if not len(s):
                        continue
                    count = len(s) - -(-percent * len(s) // 100) + 1
                    core = len(s) - -(-2 * percent * len(s) // (100 + percent)) + 1
                    often = frequency[(s % np.uint64(SKETCH)).astype(np.int64)]
                    prefix = s[np.lexsort((s, often))[:count]]
                    # a set's size, and whether the shingle is in its core
                    held.append((mix(prefix.copy()), np.full(count, _class_of(s, renamed, bits), np.int64), (2 * len(s) + (np.arange(count) < core)).astype(np.uint32)))
                    total += count
                if total > 1 << 20:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return run


def _partnered(keys: np.ndarray, sizes: np.ndarray, core: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, in order of key and size, have another one of their key that fits: the smaller one by its core, and no larger than the threshold allows."""
    n = len(keys)
    at = np.arange(n)
    fits = np.zeros(n, bool)
    fits[:-1] = core[:-1] & (keys[1:] == keys[:-1]) & (sizes[1:] * percent <= 100 * sizes[:-1])  # with the next larger one
    before = np.maximum.accumulate(np.where(core, at, -1))  # the last core entry up to each one
    before = np.concatenate([[-1], before[:-1]])
    back = np.maximum(before, 0)
    return fits | ((before >= 0) & (keys[back] == keys) & (sizes * percent <= 100 * sizes[back]))


_TREES = pa.schema([("tree", pa.int64()), ("members", pa.binary())])


def _gather(percent: int):
    """The sets of two or more classes that share a prefix shingle and fit, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for b, k, c, z in zip(*(batch.column(x).to_pylist() for x in _ENTRIES.names)):
                held.setdefault(b, []).append((np.frombuffer(k, np.uint32), np.frombuffer(c, np.int64), unsqueezed(z, np.uint32)))
        for b in list(held):
            keys, classes, sizes = (np.concatenate(x) for x in zip(*held.pop(b)))
            order = np.lexsort((classes, sizes >> 1, keys))
            keys, classes, sizes = keys[order], classes[order], sizes[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])])  # a class has one size
            keys, classes, sizes = keys[new], classes[new], sizes[new]
            keep = _partnered(keys, (sizes >> 1).astype(np.int64), (sizes & 1).astype(bool), percent)
            keys, classes = keys[keep], classes[keep]
            order = np.lexsort((classes, keys))
            keys, classes = keys[order], classes[order]
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            hashes = mix(classes.astype(np.uint64))
            sums = np.concatenate([[0], np.cumsum(hashes, dtype=np.uint64)]).astype(np.uint64)
            names, first = np.unique(mix(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64)), return_index=True)
            rows = [(int(name), classes[starts[i] : starts[i] + sizes[i]].tobytes()) for name, i in zip(names.astype(np.int64), first)]
            for k in range(0, len(rows), 10000):
                yield rows_of(_TREES, rows[k : k + 10000])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.frombuffer(m.as_py(), np.int64) for m in batch.column("members")]
        if parts:
            sizes = [len(p) for p in parts]
            tree = np.repeat(batch.column("tree").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(np.concatenate(parts)), pa.array(np.repeat(sizes, sizes).astype(np.int64))], names=["tree", "class", "size"])


# ------------------------------------------------------------------------------------------------ points, trees
_SETS = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])
#: Ids of at most this number of classes are broadcast to the scan that picks their texts (8 MB); beyond, a join shuffles.
PICKED = 1_000_000


def point_of(s: np.ndarray) -> np.ndarray:
    """Counts of shingles per group; more groups (a power of two) for larger sets, one or two shingles in each."""
    groups = min(2048, max(32, 1 << (len(s) // 2).bit_length()))
    return np.bincount((s >> np.uint64(40)).astype(np.int64) % groups, minlength=groups).astype(np.int32)


def _pack(point: np.ndarray) -> bytes:
    """Half a byte a count where that is enough, else one, else four; the first byte says which."""
    most = point.max(initial=0)
    if most < 16:
        return b"\0" + (point[::2] | point[1::2] << 4).astype(np.uint8).tobytes()
    return (b"\1" if most < 256 else b"\4") + point.astype(np.uint8 if most < 256 else np.int32).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    if packed[0] == 0:
        both = np.frombuffer(packed, np.uint8, offset=1)
        return np.stack([both & 15, both >> 4], axis=1).ravel().astype(np.int32)
    return np.frombuffer(packed, np.uint8 if packed[0] == 1 else np.int32, offset=1).astype(np.int32)


def _whole_sets(size: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renamed = shared.value[1]
        for batch in batches:
            for piece in pieces(batch):
                yield rows_of(_SETS, [(_class_of(s, renamed, bits), s.tobytes()) for s in _sets(piece.column("text"), size)])

    return run


def _texts_of(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each wanted class (a column ``class``, distinct); repeated rows count once."""
    ids = stored(wanted.join(classes, "class").select(F.col("first").alias("doc_id")), "picked")
    if ids.count() <= PICKED:
        ids = F.broadcast(ids)
    picked = texts.join(ids, "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
    once = picked.select("doc_id", "h").groupBy("doc_id", "h").count().where("count > 1").select("doc_id").limit(1)
    return picked.dropDuplicates(["doc_id", "h"]) if once.head() else picked


class CountTree:
    """An R-tree over points of counts, packed by component and size; walks give pairs whose bounds reach the threshold.

    earlier: per member, some trees that come before this one and hold it, too; what two members share there is theirs.
    sides: 0 or 1 per member if only pairs across matter.
    """

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray], component: np.ndarray, percent: int, earlier: list[np.ndarray] | None = None, sides: np.ndarray | None = None):
        self.percent, self.earlier = percent, None
        if earlier is not None and (width := max(len(x) for x in earlier)):
            self.earlier, self.known = np.zeros((len(earlier), width), np.int64), np.zeros((len(earlier), width), bool)
            for k, x in enumerate(earlier):
                self.earlier[k, : len(x)], self.known[k, : len(x)] = x, True
        self.order = np.lexsort((sizes, component) if sides is None else (sizes, component, sides))
        groups = min(len(p) for p in points)
        self.points = np.array([points[i].reshape(-1, groups).sum(axis=0) for i in self.order])  # folded to the fewest groups
        self.sizes, self.component = sizes[self.order], component[self.order]
        self.sides = np.full(len(sizes), -1) if sides is None else sides[self.order]  # -1: any pair
        at = np.arange(len(self.sizes))
        #: levels from the leaves up: first and last+1 child, upper corner, smallest and largest size, component or None, side or None
        self.levels: list[list[tuple]] = []
        spans = [(i, min(i + _LEAF, len(at))) for i in range(0, len(at), _LEAF)]
        while True:
            level = []
            for a, b in spans:
                if self.levels:
                    below = self.levels[-1][a:b]
                    whole, side = {x[5] for x in below}, {x[6] for x in below}
                    level.append((a, b, np.max([x[2] for x in below], axis=0), min(x[3] for x in below), max(x[4] for x in below), whole.pop() if len(whole) == 1 else None, side.pop() if len(side) == 1 else None))
                else:
                    own, side = self.component[a:b], self.sides[a:b]
                    level.append((a, b, self.points[a:b].max(axis=0), self.sizes[a:b].min(), self.sizes[a:b].max(), int(own[0]) if (own == own[0]).all() else None, int(side[0]) if side[0] >= 0 and (side == side[0]).all() else None))
            self.levels.append(level)
            if len(level) == 1:
                return
            spans = [(i, min(i + _FAN, len(level))) for i in range(0, len(level), _FAN)]

    def _reaches(self, overlap, low, high):
        """Whether an overlap between sets of these least sizes can reach the threshold (overlap >= t/(1+t) of both sizes)."""
        return overlap * (100 + self.percent) >= self.percent * (low + high)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of left and right members whose own bounds reach the threshold."""
        n, m = self.sizes[left][:, None], self.sizes[right][None, :]
        good = (np.minimum(n, m) * 100 >= self.percent * np.maximum(n, m)) & self._reaches(np.minimum(self.points[left][:, None, :], self.points[right][None, :, :]).sum(axis=2), n, m)
        i, j = np.nonzero(good)
        return self.order[left[i]], self.order[right[j]]

    def _first_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of members have no earlier tree in common, as far as their lists tell."""
        if self.earlier is None:
            return np.ones(len(i), bool)
        met = (self.earlier[i][:, :, None] == self.earlier[j][:, None, :]) & self.known[i][:, :, None] & self.known[j][:, None, :]
        return ~met.any(axis=(1, 2))

    def pivots(self) -> tuple[np.ndarray, np.ndarray]:
        """Each leaf's members against its first, the leaves' firsts against the first of all, and neighbours in the order of points."""
        parts = [self._pairs(np.array([a]), np.arange(a + 1, b)) for a, b, *_ in self.levels[0]]
        heads = np.array([x[0] for x in self.levels[0]][1:], np.int64)
        parts.append(self._pairs(np.array([0]), heads))
        if len(self.levels[0]) > 1:
            near = np.lexsort(self.points.T[:16])
            parts += [self._pairs(near[k : k + 1], near[k + 1 : k + 3]) for k in range(len(near) - 1)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def across(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of different components whose bounds reach the threshold and that no earlier tree gives."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        while todo:
            level, x, y = todo.pop()
            a, b = self.levels[level][x], self.levels[level][y]
            if a[5] is not None and a[5] == b[5] or a[6] is not None and a[6] == b[6]:
                continue
            if x != y and (a[4] * 100 < self.percent * b[3] or b[4] * 100 < self.percent * a[3] or not self._reaches(np.minimum(a[2], b[2]).sum(), a[3], b[3])):
                continue
            if level:
                todo += [(level - 1, i, j) for i in range(a[0], a[1]) for j in range(max(b[0], i) if x == y else b[0], b[1])]
                continue
            i, j = self._pairs(np.arange(a[0], a[1]), np.arange(b[0], b[1]))
            place = np.empty(len(self.order), np.int64)
            place[self.order] = np.arange(len(self.order))
            one, two = self.sides[place[i]], self.sides[place[j]]
            keep = (self.component[place[i]] != self.component[place[j]]) & ((one != two) | (one < 0)) & ((place[i] < place[j]) if x == y else True)
            i, j = i[keep], j[keep]
            first = self._first_here(i, j)
            out.append((i[first], j[first]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def _walk(percent: int, full: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, total = None, [], [], 0

        def unique() -> pa.RecordBatch:
            """The pairs found since last time, each once: trees with common members find the same."""
            nonlocal found, total
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            order = np.lexsort((b, a))
            a, b, found, total = a[order], b[order], [], 0
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], schema=schema)

        def pairs() -> None:
            nonlocal total
            classes = np.array([h[0] for h in held], np.int64)
            sides = np.array([h[5] for h in held]) if now[1] != now[2] else None
            earlier = [np.array([t for t in h[4] if t < now[0]], np.int64) for h in held] if full else None
            tree = CountTree(np.array([h[1] for h in held], np.int64), [_unpack(h[2]) for h in held], np.array([h[3] for h in held], np.int64), percent, earlier, sides)
            i, j = tree.across() if full else tree.pivots()
            a, b = classes[i], classes[j]
            found.append((np.minimum(a, b), np.maximum(a, b)))
            total += len(a)

        for batch in batches:
            for *key, cls, n, point, component, trees, side in zip(*(batch.column(c).to_pylist() for c in _DEALT)):
                if key != now:
                    if len(held) > 1:
                        pairs()
                    if total > 1 << 20:
                        yield unique()
                    now, held = key, []
                held.append((cls, n, point, component, trees, side))
        if len(held) > 1:
            pairs()
        yield unique()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[place] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, sets_of, percent: int, name: str) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    sets = stored(mapped(_texts_of(texts, classes, wanted), sets_of, "class long, shingles binary"), "sets")
    with_x = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    with_both = with_x.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    links = stored(mapped(with_both.select("a", "b", "x", "y"), _verify(percent), "a long, b long"), name)
    released(sets)
    return links


_DEALT = ["tree", "i", "j", "class", "n", "point", "component", "trees", "side"]


def _blocks(labelled: DataFrame) -> DataFrame:
    """(tree, i, j, class, component, side): members of several components, dealt to trees or, of large trees, pairs of blocks.

    Blocks of a large tree's largest component are numbered -1, -2 and so on, those of all others 0, 1 and so on.
    """
    by_component = labelled.groupBy("tree", "component").count()
    whole = by_component.groupBy("tree").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("size"), F.count("*").alias("kinds"))
    many = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = whole.where("kinds > 1 and size > 2").select("tree", F.col("top.component").alias("main"), many(F.col("top.count")).alias("mains"), many(F.col("size") - F.col("top.count")).alias("others"), (F.col("size") > BLOCK).alias("large"))
    rows = labelled.join(mixed, "tree")
    zero, h = F.lit(0), F.abs(F.xxhash64("class") % (1 << 30)).cast("int")
    small = rows.where("not large").select("tree", zero.alias("i"), zero.alias("j"), "class", "component", zero.alias("side"))
    large = rows.where("large")
    steps = lambda n: F.explode(F.sequence(zero, n - 1))
    main = large.where("component = main").select("tree", (-1 - h % F.col("mains")).alias("i"), steps(F.col("others")).alias("j"), "class", "component", zero.alias("side"))
    rest = large.where("component != main").withColumn("own", h % F.col("others"))
    beside = rest.withColumn("k", steps(F.col("mains"))).select("tree", (-1 - F.col("k")).alias("i"), F.col("own").alias("j"), "class", "component", F.lit(1).alias("side"))
    among = rest.withColumn("k", steps(F.col("others"))).select("tree", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "class", "component", (F.col("own") > F.col("k")).cast("int").alias("side"))
    return small.union(main).union(beside).union(among)


def _tree_pairs(dealt: DataFrame, points: DataFrame, percent: int, full: bool) -> DataFrame:
    rows = dealt.join(points, "class").select(*_DEALT)
    rows = rows.repartition(partitions(dealt.sparkSession), "tree", "i", "j").sortWithinPartitions("tree", "i", "j")
    return mapped(rows, _walk(percent, full), "a long, b long").distinct()


def _renamed(first: DataFrame, bits: int) -> dict[tuple[int, int], int]:
    """New names for sets that share one with another set: about one in so many as there are names, so hardly ever any."""
    clash = first.where("n > 0").groupBy("class").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where("low < high").select("class")
    rows = first.join(clash, "class", "left_semi").select("class", "twin").distinct().collect()
    return {(r[0], r[1]): int(mix(np.array([r[0] ^ r[1]], np.int64).astype(np.uint64) + u64(bits))[0].astype(np.int64)) for r in rows}


def _linked(docs: DataFrame, size: int, percent: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame, Broadcast]:
    """(doc_id, n, class) of each row, (class, first) with the smallest id of each class, (node, component) of the classes that are linked, and the broadcast sketch and renamed classes."""
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select(safe_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(mapped(texts, _survey(size, n, bits), "doc_id long, n long, class long, twin long, point binary, bucket int, counts binary"), "survey")
    slices = mapped(by_number(first.where("counts is not null").select("bucket", "counts"), "bucket", n), _add_slices, "bucket int, counts binary")
    cut = {r.bucket: np.frombuffer(r.counts, np.int64) for r in slices.collect()}  # SKETCH counters in all
    found = first.where("counts is null")
    renamed = _renamed(found, bits)
    if renamed:
        names = spark.createDataFrame([(a, b, c) for (a, b), c in renamed.items()], "class long, twin long, new long")
        found = found.join(F.broadcast(names), ["class", "twin"], "left").withColumn("class", F.coalesce("new", "class"))
    shared = spark.sparkContext.broadcast((np.concatenate([cut[b] for b in sorted(cut)]) if cut else np.zeros(SKETCH, np.int64), renamed))

    narrow = found.select("doc_id", "n", "class")
    whole = stored(found.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.min(F.struct("n", "point")).alias("k")).select("class", "first", "k.n", "k.point"), "classes")
    classes = whole.select("class", "first")
    entries = mapped(texts, _prefixes(shared, size, percent, n, bits), "bucket int, keys binary, classes binary, sizes binary")
    trees = mapped(by_number(entries, "bucket", n), _gather(percent), "tree long, members binary")
    trees = trees.groupBy("tree").agg(F.min("members").alias("members"))
    members = stored(mapped(trees, _members, "tree long, class long, size long"), "members")
    wanted = members.select("class").distinct()
    points = stored(whole.select("class", "n", "point").join(wanted, "class", "left_semi"), "points")
    sets_of = _whole_sets(size, bits, shared)

    block = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / BLOCK))).otherwise(0).cast("int")
    each = members.select("tree", block.alias("i"), block.alias("j"), "class", F.col("class").alias("component"), F.lit(None).cast("array<long>").alias("trees"), F.lit(0).alias("side"))
    pairs = stored(_tree_pairs(each, points, percent, False), "pairs-1")
    links = _verified(pairs, texts, classes, sets_of, percent, "links-1")
    near = stored(components(links, "join-1"), "components-1")
    labelled = members.join(near.withColumnRenamed("node", "class"), "class", "left").select("tree", "class", F.coalesce("component", "class").alias("component"))
    # each class's first trees: a pair is left to the first tree that both lists hold (a list grows with its own text only)
    lists = members.groupBy("class").agg(F.slice(F.array_sort(F.collect_set("tree")), 1, FIRST_TREES).alias("trees"))
    rest = stored(_tree_pairs(_blocks(labelled), points.join(lists, "class"), percent, True).join(pairs, ["a", "b"], "left_anti"), "pairs-2")
    more = _verified(rest, texts, classes, sets_of, percent, "links-2")
    released(members, points, pairs, rest)
    joined = near.select(F.col("node").alias("a"), F.col("component").alias("b"))  # a component as a star
    return narrow, classes, components(joined.union(more), "join-2"), shared


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 75, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of similarity percent/100 or more."""
    narrow, classes, linked, _ = _linked(docs, size, percent, bits)
    named = linked.withColumnRenamed("node", "class").join(classes, "class")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    of_class = stored(classes.join(named.join(least, "component").select("class", "least"), "class", "left").select("class", F.coalesce("least", "first").alias("least")), "class-components")
    out = narrow.join(of_class, "class", "left")
    smallest = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    null = lambda c: F.when(c != NULL_ID, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(smallest).alias("component_id"))


def _with_class(size: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renamed = shared.value[1]
        for batch in batches:
            for piece in pieces(batch):
                sets = list(_sets(piece.column("text"), size))
                keys = pa.array([_class_of(s, renamed, bits) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*piece.columns, *keys], names=[*piece.schema.names, "__class", "__n"])

    return run


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 75, bits: int = 64) -> DataFrame:
    """One row of docs of each component, unchanged: one with the smallest id. Rows are told apart by id and class, so equal or null ids don't matter.

    Rows without words are components of their own, and all stay.
    """
    _, classes, linked, shared = _linked(docs, size, percent, bits)
    whole = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = whole.groupBy("component").agg(F.min(F.struct("first", "class")).alias("k"))
    kept = least.select(F.col("k.first").alias("__id"), F.col("k.class").alias("__class"), F.lit(True).alias("__kept"))
    keyed = mapped(docs, _with_class(size, bits, shared), StructType([*docs.schema, StructField("__class", LongType()), StructField("__n", LongType())]))
    keyed = keyed.withColumn("__id", safe_id()).withColumn("__class", F.when(F.col("__n") > 0, F.col("__class")).otherwise(F.monotonically_increasing_id()))
    rows = keyed.join(kept, ["__id", "__class"], "left").where((F.col("__n") == 0) | F.col("__kept"))
    return rows.dropDuplicates(["__id", "__class", "__n"]).select(*docs.columns)


__all__ = ["CountTree", "ints", "ngram_components", "one_of_each", "point_of"]
