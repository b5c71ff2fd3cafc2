"""Fingerprints against fingerprints, tile by tile: parts of both sides meet in one task each, as matrices of their bits.

A tile holds the rows of one part of the left and one of the right side (or of two parts of the same table) and is one
partition of one shuffle. No pair that misses the cutoff, or is not among the best, leaves its task. Products of bit
matrices count shared bits; whatever passes them is counted anew from the packed words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part of a table that is joined, of queries and of a training set.
JOIN_ROWS, QUERY_ROWS, TRAIN_ROWS = 40_000, 20_000, 100_000
#: Bits that the first product of a join looks at; rows and columns of a product; pairs counted from words at once.
_BITS, _ROWS, _COLUMNS, _PAIRS = 192, 256, 4096, 1 << 15


class Side:
    """Rows in the order of their numbers of bits."""

    def __init__(self, batches: list[pa.RecordBatch], words: int):
        table = pa.Table.from_batches(batches)
        n = table.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        flat = table.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.n, self.words = n[order].astype(np.int64), flat.astype(np.int64).view(np.uint64).reshape(-1, words)[order]
        self.ids = table.column("id").combine_chunks().take(pa.array(order))
        self.keys = self.ids.to_numpy(zero_copy_only=False)

    def bits(self, start: int, stop: int) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(self.words[start:stop]).view(np.uint8), axis=1, bitorder="little")


def _shared(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), _PAIRS):
        o = slice(k, k + _PAIRS)
        out[o] = np.bitwise_count(a.words[i[o]] & b.words[j[o]]).sum(axis=1, dtype=np.int64)
    return out


def _scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    common = _shared(a, b, i, j)
    total = a.n[i] + b.n[j] - common
    return np.where(total == 0, 0.0, common / np.maximum(total, 1))


def near_pairs(a: Side, b: Side, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of all pairs at cutoff; of a side with itself, each pair once.

    Sizes bound j to a range. Of the bits that vary most, the shared ones are counted; with all other bits of row i they
    must be enough, or the pair is not looked at again.
    """
    same, share = a is b, cutoff / (1 + cutoff)
    often = np.zeros(64 * a.words.shape[1])
    for side in (a, b):
        step = max(1, len(side.n) // 2000)
        often += np.unpackbits(np.ascontiguousarray(side.words[::step]).view(np.uint8), axis=1, bitorder="little").mean(axis=0)
    chosen = np.sort(np.argsort(np.abs(often - 1), kind="stable")[:_BITS])
    right = np.empty((len(b.n), len(chosen) + 2), np.float32)
    for k in range(0, len(b.n), _COLUMNS):
        right[k : k + _COLUMNS, :-2] = b.bits(k, k + _COLUMNS)[:, chosen]
    right[:, -2], right[:, -1] = 1, -share * b.n
    for start in range(0, len(a.n), _ROWS):
        stop = min(start + _ROWS, len(a.n))
        bits = a.bits(start, stop)[:, chosen].astype(np.float32)
        rest = a.n[start:stop] - bits.sum(axis=1)
        left = np.column_stack([bits, (rest - share * a.n[start:stop]).astype(np.float32), np.ones(stop - start, np.float32)])
        low = int(np.searchsorted(b.n, cutoff * a.n[start] - 1e-6))
        high = int(np.searchsorted(b.n, a.n[stop - 1] / cutoff + 1e-6, side="right"))
        for at in range(max(low, start) if same else low, high, _COLUMNS):
            enough = left @ right[at : min(at + _COLUMNS, high)].T >= -0.05  # never too strict
            i, j = np.nonzero(enough)
            i, j = i + start, j + at
            keep = (a.n[i] >= cutoff * b.n[j]) & (b.n[j] >= cutoff * a.n[i])
            if same:
                keep &= j > i
            i, j = i[keep], j[keep]
            score = _scores(a, b, i, j)
            keep = (score >= cutoff) & (a.keys[i] != b.keys[j])
            if keep.any():
                yield i[keep], j[keep], score[keep]


def best_scores(a: Side, b: Side, k: int, compat: bool) -> list[np.ndarray]:
    """The k best scores of each row of a, descending; rows of equal ids don't meet unless compat.

    Columns nearest in size come first; a range of columns is left out when sizes alone keep it below all of the k best.
    """
    out = []
    columns = _COLUMNS // 2
    for start in range(0, len(a.n), _ROWS * 2):
        stop = min(start + _ROWS * 2, len(a.n))
        n, bits = a.n[start:stop], a.bits(start, stop).astype(np.float32)
        best = np.full((stop - start, k), -1.0)
        middle = int(np.searchsorted(b.n, np.median(n)))
        ranges = [(at, min(at + columns, len(b.n))) for at in range(0, len(b.n), columns)]
        for low, high in sorted(ranges, key=lambda r: max(r[0] - middle, middle - r[1])):
            worst = best[:, -1]
            most = np.minimum(n, b.n[high - 1]) / np.maximum(np.maximum(n, b.n[low]), 1)  # a bound of every score in the range
            if (most < worst).all():
                continue
            # shared * (1 + worst) >= worst * (n + n'), as one product
            left = np.column_stack([bits * (1 + worst)[:, None], -worst * n, -worst]).astype(np.float32)
            right = np.column_stack([b.bits(low, high), np.ones(high - low), b.n[low:high]]).astype(np.float32)
            product = left @ right.T
            if (worst < 0).any():  # not yet k: the best of this range alone
                common = bits @ right[:, :-2].T
                total = n[:, None] + b.n[None, low:high] - common
                score = np.where(total == 0, 0.0, common / np.maximum(total, 1))
                if not compat:
                    score[a.keys[start:stop, None] == b.keys[None, low:high]] = -1.0
                best = -np.sort(-np.concatenate([best, -np.partition(-score, min(k, high - low) - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
                continue
            i, j = np.nonzero(product >= -0.05)
            if len(i):
                score = _scores(a, b, i + start, j + low)
                keep = score > worst[i]
                if not compat:
                    keep &= a.keys[i + start] != b.keys[j + low]
                i, score = i[keep], score[keep]
            if len(i):
                rows = np.unique(i)
                i, score = np.concatenate([i, np.repeat(rows, k)]), np.concatenate([score, best[rows].ravel()])
                order = np.lexsort((-score, i))
                i, score = i[order], score[order]
                first = np.searchsorted(i, rows)
                best[rows] = score[first[:, None] + np.arange(k)]
        out += [row[row >= 0] for row in best]
    return out


# ------------------------------------------------------------------------------------------------------- on tables
def _rows(df: DataFrame, words: int) -> DataFrame:
    return df.select("id", F.col("n").cast("int").alias("n"), F.array(*(F.coalesce(F.get("words", F.lit(k)), F.lit(0).cast("long")) for k in range(words))).alias("words"))


def _dealt(rows: DataFrame, tiles: int, f: Callable[[list, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f of each tile's rows (columns tile and part, false for the first side); a tile is a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = [], []
        for batch in batches:
            part = batch.column("part")
            for k, mask in enumerate((pc.invert(part), part)):
                if pc.any(mask).as_py():
                    sides[k].append(batch.filter(mask))
        yield from f(*sides)

    return rows.repartitionById(tiles, F.col("tile")).mapInArrow(run, schema)


def _part(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def join(left: DataFrame, right: DataFrame, cutoff: float, words: int) -> DataFrame:
    """a, b, score: ids of all pairs of different ids at cutoff, in both directions if both sides are one table."""
    kind, same = dict(left.dtypes)["id"], left is right
    a, b = (_rows(x.where("id is not null"), words) for x in (left, right))

    def pairs(first: list, second: list) -> Iterator[pa.RecordBatch]:
        if not first or not (second or same):
            return
        one = Side(first, words)
        other = Side(second, words) if second else one
        for i, j, score in near_pairs(one, other, cutoff):
            i, j, score = one.ids.take(pa.array(i)), other.ids.take(pa.array(j)), pa.array(score)
            yield pa.RecordBatch.from_arrays([i, j, score], ["a", "b", "score"])
            if same:
                yield pa.RecordBatch.from_arrays([j, i, score], ["a", "b", "score"])

    if same:  # parts meet once: tile y (y + 1) / 2 + x is of the parts x <= y
        n = max(4, -(-left.count() // JOIN_ROWS))
        tile = (F.expr("(greatest(p, q) * (greatest(p, q) + 1)) div 2 + least(p, q)")).cast("int")
        rows = a.withColumn("p", _part(n)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = rows.select("id", "n", "words", tile.alias("tile"), (F.col("p") != F.least("p", "q")).alias("part"))
        return _dealt(rows, n * (n + 1) // 2, pairs, f"a {kind}, b {kind}, score double")
    m, n = max(4, -(-left.count() // JOIN_ROWS)), max(3, -(-right.count() // JOIN_ROWS))
    return _dealt(_crossed(a, b, m, n), m * n, pairs, f"a {kind}, b {kind}, score double")


def _crossed(a: DataFrame, b: DataFrame, m: int, n: int) -> DataFrame:
    """Every part of a (of m) with every one of b (of n)."""
    a = a.withColumn("p", _part(m)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("part", F.lit(False))
    b = b.withColumn("q", _part(n)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("part", F.lit(True))
    return a.unionByName(b).select("id", "n", "words", (F.col("p") * n + F.col("q")).cast("int").alias("tile"), "part")


def best(queries: DataFrame, train: DataFrame, k: int, compat: bool, words: int = 16) -> DataFrame:
    """id and scores, the k best of a query's scores in one part of the training set; a query has a row for each part."""
    kind = dict(queries.dtypes)["id"]
    a, b = (_rows(x if compat else x.where("id is not null"), words) for x in (queries, train))
    m, n = max(12, -(-queries.count() // QUERY_ROWS)), max(1, -(-train.count() // TRAIN_ROWS))

    def run(first: list, second: list) -> Iterator[pa.RecordBatch]:
        if first and second:
            one = Side(first, words)
            scores = best_scores(one, Side(second, words), k, compat)
            yield pa.RecordBatch.from_arrays([one.ids, pa.array([s.tolist() for s in scores], pa.list_(pa.float64()))], ["id", "scores"])

    return _dealt(_crossed(a, b, m, n), m * n, run, f"id {kind}, scores array<double>")
