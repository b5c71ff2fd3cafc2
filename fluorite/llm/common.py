"""Shared pieces of the training-data operators: scratch tables, routing, and vectorised text parsing.

Two ideas carry most operators here:

* *Routing.* ``routed`` gives each document a partition number from its id alone. Facts gathered over the corpus travel
  back to exactly the partitions that asked for them, so no table of corpus size is ever broadcast or collected.
* *Packed rows.* A task sends its (key, value) pairs as one binary row per target bucket. Keys are hashed, so buckets
  are even whatever the data; the shuffle moves a few large rows instead of many small ones.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id while rows travel; turned back into null in results.
NULL_ID = -(2**63)
#: Bytes of text parsed at once in a Python worker; bounds its temporary arrays (a longer document is one piece).
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------------------------------------- scratch tables
def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (local runs only)."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="fluorite-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is not None and not jsc.sc().isStopped():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()  # lets the context cleaner drop the shuffle files of what is now stored
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def released(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table.scratch)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------------------------------------------ routing
def safe_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def real_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def routed(docs: DataFrame, *extra: Column, n: int | None = None) -> DataFrame:
    """doc_id, text, p (0 to n-1, from the id alone), and any extra columns; other columns of docs are dropped."""
    n = n or partitions(docs.sparkSession)
    return docs.select(safe_id().alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).withColumn(
        "p", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    )


def by_number(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose column is k go to partition k."""
    return df.repartitionById(n, F.col(column))


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("p", pa.int32()), ("payload", pa.binary())])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for piece in pieces(batch, 64 << 20):
            order, bounds = split_by(ints(piece, "p"), int(ints(piece, "p").max()) + 1)
            out = []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                rows = piece.take(pa.array(order[bounds[p] : bounds[p + 1]]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(rows)
                out.append((p, sink.getvalue().to_pybytes()))
            yield rows_of(schema, out)


def packed_rows(docs: DataFrame) -> DataFrame:
    """(p, payload): the rows of each p that one task has in a batch, as a compressed Arrow stream; halves what a text shuffle moves."""
    return mapped(docs, _pack_rows, "p int, payload binary")


def unpacked(payload: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(payload)


def with_side(docs: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """docs and side rows (both with p) in partition p, side rows first within each p; kind is 0 for side rows."""
    both = side.withColumn("kind", F.lit(0)).unionByName(docs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return by_number(both, "p", n).sortWithinPartitions("p", "kind")


# --------------------------------------------------------------------------------------------- Arrow and packing
def u64(x: int) -> np.uint64:
    return np.uint64(x & (2**64 - 1))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place."""
    h ^= h >> np.uint64(30)
    h *= u64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= u64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and their len+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, limit: int = CHUNK_BYTES, column: str = "text", rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most limit bytes of text and so many rows each, or with one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + limit, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


# ------------------------------------------------------------------------------------------------------- words
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that are no part of a word when punctuation is left out: ASCII that is neither letter nor digit.
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Ranges longer than this are hashed one by one, so a loop over eights of bytes stays short.
_LONG = 256


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one little-endian integer (zeros beyond the end); a view of a padded copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def first_bytes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values with all but their first ``sizes`` bytes (of 8 at most) set to zero."""
    spare = np.clip(8 - sizes, 0, 8).astype(np.uint64) * np.uint64(8)
    half = spare >> np.uint64(1)
    return values << half << (spare - half) >> half >> (spare - half)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes [start, end) of data for arrays of both.

    Eight bytes at a time are added to a state that is mixed in between, so it is no polynomial with a structure that some
    texts would cancel out; long ranges are digested by BLAKE2b.
    """
    view = eights(data) if view is None else view
    sizes = ends - starts
    state = mix(sizes.astype(np.uint64) + u64(_BASE))
    live, at = np.flatnonzero((sizes > 0) & (sizes <= _LONG)), 0
    while len(live):
        part = first_bytes(view[starts[live] + at], sizes[live] - at)
        state[live] = mix((state[live] ^ part) * u64(_BASE) + u64(0xD6E8FEB86659FD93))
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return state


def hash_grams(view: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes (a multiple of 8) from each position on, for all positions with as many."""
    n = max(0, len(view) - k)
    mixed = mix(view.copy())
    out = np.zeros(n, np.uint64)
    for j in range(k // 8):
        out += mixed[8 * j : 8 * j + n] * u64(pow(_BASE, j + 1, 2**64))
    return out


class Words:
    """The words of a list of texts: lower-cased (A-Z), runs of bytes other than space and 0x09 to 0x0D.

    With ``plain``, words are runs of letters, digits and non-ASCII bytes, and two-byte capitals (U+00C0 to U+00DE) are
    lower-cased too, so that punctuation and case don't matter.
    """

    def __init__(self, texts: pa.Array, plain: bool = False):
        raw, at = bytes_of(texts)
        self.n = len(at) - 1
        self.data = _LOWER[np.insert(raw, at[1:], 32)]  # a space ends every text
        self.at = at + np.arange(self.n + 1)  # each text with its space
        if plain:
            second = np.flatnonzero(self.data[:-1] == 0xC3) + 1
            self.data[second[(self.data[second] >= 0x80) & (self.data[second] <= 0x9E)]] += 0x20
        inside = ~(_PUNCTUATION if plain else _SPACE)[self.data]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.at)  # the words of text i: first[i] to first[i+1]
        self.hashes = hash_ranges(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the size words from each word on, and len n+1 offsets of each text's shingles.

        A text with fewer words has one shingle, its whole sequence; a text without words has none.
        """
        counts = np.diff(self.first)
        number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(number)])
        out = np.empty(offsets[-1], np.uint64)
        h = self.hashes
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled += h[k : k + len(rolled)] * u64(pow(_BASE, k + 2, 2**64))
        rolled = mix(rolled)
        long = counts >= size
        take = np.repeat(long, number)
        inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], number)
        out[take] = rolled[(np.repeat(self.first[:-1], number) + inner)[take]]
        for i in np.flatnonzero((counts > 0) & ~long):
            one = h[self.first[i] : self.first[i + 1]]
            out[offsets[i]] = mix(np.array([sum(int(x) * pow(_BASE, k + 2, 2**64) for k, x in enumerate(one)) + len(one) & (2**64 - 1)], np.uint64))[0]
        return out, offsets


def squeezed(x: np.ndarray) -> bytes:
    """x as compressed planes of its bytes: sorted keys and small counts take a fraction of their 8 bytes."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes | pa.Buffer, kind: type) -> np.ndarray:
    n, size = int.from_bytes(bytes(data[:8]), "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd"), np.uint8)
    return planes if size == 1 else np.ascontiguousarray(planes.reshape(size, n).T).view(kind)[:, 0]


# --------------------------------------------------------------------------------------- corpus-wide merging
class Tally:
    """Sums by 64-bit key, compacted as it grows."""

    def __init__(self, limit: int = 1 << 20):
        self.keys, self.values, self.size, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        if values is None:
            keys, values = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.values.append(values.astype(np.int64))
        self.size += len(keys)
        if self.size > self.limit:
            k, v = self.get()
            self.keys, self.values, self.size = [k], [v], len(k)
            self.limit = max(self.limit, 2 * len(k))

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate(self.values), minlength=len(keys)).astype(np.int64)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by bucket, and the n+1 bounds of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _give_back() -> None:
    """Return what a worker has freed to the system: workers live on, and two tasks' peaks need not add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


# ------------------------------------------------------------------------------------------------- components
def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that can be reached, itself included.

    Alternates large-star and small-star steps (each one aggregation with map-side partial minima and one join, which
    adaptive execution may split at a hub) until nothing changes; every step is a table in the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    step = 0
    while True:
        step += 1
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        star = star.union(low.where("a != m").select("a", F.col("m").alias("b"))).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(small.union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), f"{name}-{step}")
        summary = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        settled = summary(new) == summary(edges)
        released(edges)
        if settled:
            break
        edges = new
    roots = new.select(F.col("b").alias("a")).distinct().join(new.select("a"), "a", "left_anti")
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
