"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Words are runs of letters and digits, lower-cased, so punctuation and case hide nothing. A benchmark item of m words is
compared with windows of m words of every document, and with the whole of a document that has fewer:

* A window without any 5-word shingle of any item has similarity 0 with all, so only windows around such shingles are
  looked at; that leaves nothing out.
* A window's 64-bit SimHash sums its shingles' bits. Fingerprints are cut into 8 blocks of 8 bits; two within ``radius``
  bits differ in at most radius // 8 bits in some block, so tables of all block values within that many bits find every
  item within the radius.
* Candidates are verified by exact weighted-shingle similarity: sum of smaller counts over sum of larger counts.

Documents are read once and not shuffled. The items are broadcast in blocks of at most ``block_items`` items and
``block_bytes`` bytes each, one pass over the documents for each block, however many there are.

Defined cases: an item or document without words matches nothing; one with fewer than five words is a single shingle, so
such an item matches only a document that consists of it; null ids stay null (an item's counts as -2^63 in pairs); empty
tables give no rows; repeated rows give repeated results; columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mapped, mix, pieces, real_id, rows_of, safe_id

_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())])


def simhashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """The 64-bit SimHash of each run of count shingles."""
    bits = np.unpackbits(mix(shingles.copy()).view(np.uint8)).reshape(-1, 64)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(2 * (sums[count:] - sums[:-count]) > count, axis=1).view(np.uint64)[:, 0]


def weighted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending shingles, counts)."""
    place = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = np.minimum(a[1], b[1][place])[b[0][place] == a[0]].sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


class Index:
    """Items by number of shingles, with the Hamming tables of each."""

    def __init__(self, ids: list[int], texts: list[str], size: int, radius: int):
        words = Words(pa.array(texts, pa.string()), plain=True)
        shingles, at = words.shingles(size)
        self.size, self.radius, self.ids = size, radius, np.array(ids, np.int64)
        number = np.diff(words.first)
        self.bags = [np.unique(shingles[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
        some = np.flatnonzero(number > 0)
        owners = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.lexsort((number[owners], shingles))
        #: shingles of any item, and the item sizes (in words) in which each occurs
        pairs = np.unique(np.stack([shingles[order], number[owners][order].astype(np.uint64)]), axis=1) if len(shingles) else np.zeros((2, 0), np.uint64)
        self.known, self.first = np.unique(pairs[0], return_index=True)
        self.sizes, self.first = pairs[1].astype(np.int64), np.append(self.first, pairs.shape[1])
        flips = [sum(1 << b for b in c) for k in range(radius // 8 + 1) for c in itertools.combinations(range(8), k)]
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in np.unique(number[some]):
            items = some[number[some] == m]
            prints = np.array([simhashes(shingles[at[i] : at[i + 1]], at[i + 1] - at[i])[0] for i in items], np.uint64)
            tables = np.zeros((8, 256, len(items)), bool)
            for block, byte in enumerate(prints.view(np.uint8).reshape(-1, 8).T):
                for flip in flips:
                    tables[block, byte ^ flip, np.arange(len(items))] = True
            self.groups[int(m)] = (items, prints, tables)

    def search(self, shingles: np.ndarray, n_words: int, least: float) -> Iterator[tuple[int, float, int]]:
        """(item, similarity, first word) of each item's best window in one document."""
        place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hits = np.flatnonzero(self.known[place] == shingles)
        best: dict[int, tuple[float, int]] = {}
        near: dict[int, list[int]] = {}
        for p in hits.tolist():
            for m in self.sizes[self.first[place[p]] : self.first[place[p] + 1]].tolist():
                near.setdefault(m, []).append(p)
        for m, positions in near.items():
            count = max(1, m - self.size + 1)
            if (m < self.size and n_words != m) or len(shingles) / count < least:  # too short to be that similar
                continue
            count = min(count, len(shingles))
            low, high = np.maximum(np.array(positions) - count + 1, 0), np.minimum(np.array(positions), len(shingles) - count)
            edges = np.zeros(len(shingles) + 1, np.int64)
            ok = low <= high
            np.add.at(edges, low[ok], 1)
            np.add.at(edges, high[ok] + 1, -1)
            starts = np.flatnonzero(np.cumsum(edges) > 0)
            items, prints, tables = self.groups[m]
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                if not len(run):
                    continue
                windows = simhashes(shingles[run[0] : run[-1] + count], count)
                bytes_ = windows.view(np.uint8).reshape(-1, 8)
                found = reduce(np.logical_or, (tables[b][bytes_[:, b]] for b in range(8)))
                w, k = np.nonzero(found)
                close = np.bitwise_count(windows[w] ^ prints[k]) <= self.radius
                for start, item in zip(run[w[close]].tolist(), items[k[close]].tolist()):
                    similarity = weighted(np.unique(shingles[start : start + count], return_counts=True), self.bags[item])
                    if similarity >= least and similarity > best.get(item, (0.0, 0))[0]:
                        best[item] = (similarity, start)
        for item, (similarity, start) in sorted(best.items()):
            yield item, similarity, start


def _search(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column("text"), plain=True)
                shingles, at = words.shingles(index.size)
                if not len(index.known):
                    continue
                ids = piece.column("doc_id").to_pylist()
                place = np.minimum(np.searchsorted(index.known, shingles), len(index.known) - 1)
                hit = index.known[place] == shingles
                out = []
                for i in np.unique(np.searchsorted(at, np.flatnonzero(hit), side="right") - 1).tolist():
                    for item, similarity, start in index.search(shingles[at[i] : at[i + 1]], int(words.first[i + 1] - words.first[i]), least):
                        out.append((ids[i], int(index.ids[item]), similarity, start))
                yield rows_of(_PAIRS, out)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.75, radius: int = 23, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, similarity, first_word: each document and item with a window of similarity ``least`` or more."""
    texts = docs.select(safe_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long"
    parts = [mapped(texts, _search(shared, least), schema) for shared in _indexes(benchmark, size, radius, block_items, block_bytes)]
    out = reduce(DataFrame.union, parts)
    return out.select(real_id(), real_id("item_id"), "similarity", "first_word")


def _indexes(benchmark: DataFrame, size: int, radius: int, block_items: int, block_bytes: int) -> list:
    """A broadcast index of each block of items; one empty index if there are none."""
    spark = benchmark.sparkSession
    items = benchmark.select(safe_id("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    count, total = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-total // block_bytes))
    out = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # one block
        out.append(spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], size, radius)))
    return out


def _keep(shared, least: float):
    search = _search(shared, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = pa.RecordBatch.from_arrays([pa.array(range(piece.num_rows), pa.int64()), piece.column("text")], names=["doc_id", "text"])
                good = np.ones(piece.num_rows, bool)
                for found in search(iter([rows])):
                    good[found.column("doc_id").to_numpy()] = False
                yield piece.filter(pa.array(good))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.75, radius: int = 23, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, unchanged, that are contaminated by no item."""
    for shared in _indexes(benchmark, size, radius, block_items, block_bytes):
        docs = mapped(docs, _keep(shared, least), docs.schema)
    return docs
