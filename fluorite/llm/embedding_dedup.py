"""Embedding near-duplicates by collision-counting projections.

Vectors of one label are projected on many random unit directions. Two vectors collide in a projection if one lies in a
window around the other. For a pair at the threshold, the difference of its projections is nearly normal with a known
deviation, so the count of collisions is nearly binomial; the count asked for is the largest that such a pair misses
with a probability of ``miss`` at most. Pairs with that count are verified by cosine in double precision.

Equal vectors are one point with a multiplicity. The first two projections cut a label into cells of one window's width
(four deviations), so a point meets only its own and the eight adjacent cells; cells are split into blocks of bounded
size, and each task handles pairs of blocks, whatever the size of a label or cell. A pair of blocks gives no list of its
links, but for each vector the number of vectors it links with, and a spanning forest of the links: at most two rows for a
vector, however dense a group is, and no link is lost to the counts or to the components.

Defined cases: a vector that is null, zero, or holds null or non-finite components, and one without a label, has no links
and is its own component; vectors of different lengths don't link; a null vec_id counts as the smallest id; an empty
table gives no rows; rows with equal ids are separate vectors; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mapped, partitions, real_id, released, safe_id, stored

BLOCK = 1024  # vectors compared with as many at once


class Counting:
    """The projections, windows and collision count for vectors of one length."""

    def __init__(self, dimensions: int, cosine: float, projections: int, miss: float, deviations: float = 1.5, seed: int = 11):
        directions = np.random.default_rng(seed).standard_normal((dimensions, projections))
        self.directions = directions / np.linalg.norm(directions, axis=0)
        deviation = math.sqrt(2 - 2 * cosine) / math.sqrt(dimensions)  # of a projected difference at the threshold
        self.cell, self.window = 4 * deviation, deviations * deviation
        hit, counted = math.erf(deviations / math.sqrt(2)), projections - 2
        below, self.least = 0.0, 0
        for k in range(counted + 1):
            below += math.comb(counted, k) * hit**k * (1 - hit) ** (counted - k)
            if below > miss:
                self.least = k
                break


def _points(cosine: float, projections: int, miss: float):
    schema = pa.schema([("vector", pa.binary()), ("id", pa.int64()), ("many", pa.int64()), ("label", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("projected", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Counting] = {}
        for batch in batches:
            xs, ys, out = [], [], []
            for v in batch.column("vector"):
                vector = np.frombuffer(v.as_py(), np.float64)
                how = known.setdefault(len(vector), Counting(len(vector), cosine, projections, miss))
                p = (vector / np.linalg.norm(vector)) @ how.directions
                xs.append(math.floor(p[0] / how.cell))
                ys.append(math.floor(p[1] / how.cell))
                out.append(p[2:].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("id"), batch.column("many"), batch.column("label"), pa.array(xs, pa.int32()), pa.array(ys, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    return run


def collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """How many projections put a right point into the window around a left one, for each pair."""
    counts = np.zeros((len(left), len(right)), np.uint8 if left.shape[1] < 256 else np.uint16)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        ranked = right[order, k]
        low, high = np.searchsorted(ranked, left[:, k] - window, "left"), np.searchsorted(ranked, left[:, k] + window, "right")
        for q, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            counts[q, order[a:b]] += 1
    return counts


def _cosines(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows."""
    out, lengths = np.empty(len(i)), [np.linalg.norm(x, axis=1) for x in (left, right)]
    for k in range(0, len(i), 1 << 15):  # bounds the temporary arrays
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        out[k : k + (1 << 15)] = np.einsum("ij,ij->i", left[a], right[b]) / (lengths[0][a] * lengths[1][b])
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    while (label != (up := label[label])).any():
        label = up
    return label


def _link(cosine: float, projections: int, miss: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Counting] = {}
        now, held = None, []

        def links() -> pa.RecordBatch:
            by: dict[tuple[int, int], list] = {}
            for side, node, many, vector, projected in held:
                by.setdefault((len(vector) // 8, side), []).append((node, many, np.frombuffer(vector, np.float64), np.frombuffer(projected, np.float32)))
            rows: list[tuple[np.ndarray, ...]] = []
            for (d, side), left in by.items():
                right = by.get((d, 1)) if side == 0 and now[-1] else left if side == 0 else None
                if not right:
                    continue
                how = known.setdefault(d, Counting(d, cosine, projections, miss))
                (ids, counts, vs, ps), (jds, others, ws, qs) = ([np.array(x) for x in zip(*side)] for side in (left, right))
                i, j = np.nonzero(collisions(ps, qs, how.window) >= how.least)
                if right is left:
                    i, j = i[i < j], j[i < j]
                good = _cosines(vs, ws, i, j) >= cosine
                i, j = i[good], j[good]
                shift = 0 if right is left else len(ids)
                nodes, weights = (ids, counts) if right is left else (np.concatenate([ids, jds]), np.concatenate([counts, others]))
                j = j + shift
                linked = (np.bincount(i, weights[j], len(nodes)) + np.bincount(j, weights[i], len(nodes))).astype(np.int64)
                some = np.flatnonzero(linked)
                root = forest(len(nodes), i, j)
                child = np.flatnonzero(root != np.arange(len(nodes)))
                rows.append((nodes[some], np.full(len(some), -1), linked[some]))
                rows.append((nodes[root[child]], nodes[child], np.zeros(len(child), np.int64)))
            a, b, linked = (np.concatenate(x).astype(np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(linked)], schema=schema)

        names = ("label", "x", "y", "sub", "dx", "dy", "other", "two")
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*names, "side", "id", "many", "vector", "projected")]
            for row in zip(*columns):
                if row[:8] != now:
                    if held:
                        yield links()
                    now, held = row[:8], []
                held.append(row[8:])
        if held:
            yield links()

    return run


def near_vectors(embeddings: DataFrame, cosine: float = 0.98, projections: int = 42, miss: float = 1e-4) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings."""
    spark = embeddings.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = embeddings.select(safe_id("vec_id").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("good", good)
    rows = stored(mapped(rows, _packed, "vec_id long, label long, vector binary"), "vectors")
    # a class is all rows of one label and vector; its number, not a vec_id (which may repeat), is its name
    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    points = stored(mapped(classes.select("vector", "id", "many", "label"), _points(cosine, projections, miss), "vector binary, id long, many long, label long, x int, y int, projected binary"), "points")

    cells = points.groupBy("label", "x", "y").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    home = points.join(cells, ["label", "x", "y"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a group is a block (x, y, sub) and one of: itself, a later block of its cell, any block of four adjacent cells
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)]
    body = ["id", "many", "vector", "projected"]
    key = lambda *c: [x.cast("int").alias(n) for x, n in zip(c, ("x", "y", "sub", "dx", "dy", "other"))]
    zero, sub = F.lit(0), F.col("sub")
    same = home.select("label", *key(F.col("x"), F.col("y"), sub, zero, zero, sub), F.lit(False).alias("two"), zero.alias("side"), *body)
    others = home.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), k -> k != sub)")))
    within = others.select("label", *key(F.col("x"), F.col("y"), F.least("sub", "other"), zero, zero, F.greatest("sub", "other")), F.lit(True).alias("two"), F.when(F.col("sub") < F.col("other"), 0).otherwise(1).alias("side"), *body)
    groups = same.unionByName(within)
    for dx, dy in steps:
        beside = cells.select("label", (F.col("x") - dx).cast("int").alias("x"), (F.col("y") - dy).cast("int").alias("y"), F.col("blocks").alias("there"))
        ahead = home.join(beside, ["label", "x", "y"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("there") - 1)))
        groups = groups.unionByName(ahead.select("label", *key(F.col("x"), F.col("y"), sub, F.lit(dx), F.lit(dy), F.col("other")), F.lit(True).alias("two"), zero.alias("side"), *body))
        before = cells.select("label", (F.col("x") + dx).cast("int").alias("x"), (F.col("y") + dy).cast("int").alias("y"), F.col("blocks").alias("there"))
        behind = home.join(before, ["label", "x", "y"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("there") - 1)))
        groups = groups.unionByName(behind.select("label", *key(F.col("x") - dx, F.col("y") - dy, F.col("other"), F.lit(dx), F.lit(dy), sub), F.lit(True).alias("two"), F.lit(1).alias("side"), *body))
    names = ["label", "x", "y", "sub", "dx", "dy", "other", "two"]
    dealt = groups.repartition(partitions(spark), *names).sortWithinPartitions(*names)
    links = stored(mapped(dealt, _link(cosine, projections, miss), "a long, b long, linked long"), "vector-links")

    degree = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("linked").alias("linked"))
    joined = components(links.where("b is not null").select("a", "b"), "vectors").withColumnRenamed("node", "id")
    named = classes.select("id", "first").join(joined, "id")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    reached = named.join(least, "component").select("id", "least")
    of_class = classes.join(degree, "id", "left").join(reached, "id", "left")
    of_class = stored(of_class.select("label", "vector", (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component")), "class-links")
    released(points, links)
    out = rows.join(of_class, ["label", "vector"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).select(real_id("vec_id"), "n_links", real_id("component_id"), "kept")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as the bytes of their doubles; null for the others."""
    for batch in batches:
        vectors = [(np.array(v.as_py(), np.float64) + 0.0).tobytes() if g else None for v, g in zip(batch.column("embedding"), batch.column("good").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vectors, pa.binary())], names=["vec_id", "label", "vector"])
