"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Only the numbers of pieces of each length matter to a packing, so the plan is made from a table of at most ``capacity``
rows whatever the corpus. The reduction fixes {j, i} (i the largest length that fits beside j) where it dominates every
other set with j: when it fills the sequence, when nothing smaller allows a third piece, or when i is no smaller than
any two pieces that fit beside j; a piece beside which nothing fits is fixed alone. It repeats on what is left, until
nothing is fixed; the rest is packed best-fit by decreasing length, many equal sequences at a time.

Pieces then find their place by their rank among the pieces of the same length: per-partition counts give offsets, a
window inside each (partition, length) the rest, so a common length is never gathered in one task.

Defined cases: a null or empty text is the end id alone; a text without a null id keeps it null; an empty table gives no
rows; repeated rows are packed each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, pieces, real_id, safe_id, stored
from .tokenise import encoder, vocabulary


class Plan:
    """places[length]: (first rank, sequences, pieces of this length in each, first sequence, offset) in order of rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.places: dict[int, list[tuple[int, int, int, int, int]]] = {s: [] for s in counts}
        self.left = {s: n for s, n in counts.items() if n}
        self.used = dict.fromkeys(counts, 0)
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _place(self, size: int, bins: int, each: int, first: int, offset: int) -> None:
        self.places[size].append((self.used[size], bins, each, first, offset))
        self.used[size] += bins * each
        self.left[size] -= bins * each
        if not self.left[size]:
            del self.left[size]

    def _fix(self, sizes: tuple[int, ...], bins: int) -> None:
        offset = 0
        if len(sizes) == 2 and sizes[0] == sizes[1]:
            self._place(sizes[0], bins, 2, self.sequences, 0)
        else:
            for s in sizes:
                self._place(s, bins, 1, self.sequences, offset)
                offset += s
        self.sequences += bins

    def _reduce(self) -> None:
        changed = True
        while changed and self.left:
            changed = False
            for j in sorted(self.left, reverse=True):
                while self.left.get(j) and (bins := self._dominant(j)):
                    changed = True
                    self._fix((j,) if bins < 0 else (j, self._beside), abs(bins))

    def _dominant(self, j: int) -> int:
        """How many sequences of j and the largest length that fits beside it (``_beside``) may be fixed at once; less than 0: of j alone; 0: none.

        The condition looks at which lengths have one, two or three pieces and more. While more than four of j and of the
        other are left, fixing one pair changes none of that, so all but four go at once and the last ones one by one: a
        few steps for a length, however many pieces it has.
        """
        sizes = sorted(self.left)
        room = self.capacity - j
        many = lambda s: self.left[s] - (s == j)  # noqa: E731  of length s besides one j
        small = [s for s in sizes for _ in range(min(3, many(s)))][:3]
        if not small or small[0] > room:
            return -self.left[j]
        k = bisect_right(sizes, room) - 1
        while not many(sizes[k]):
            k -= 1
        self._beside = i = sizes[k]
        most = self.left[j] // 2 if i == j else min(self.left[j], self.left[i])
        if i + j == self.capacity:  # a full sequence dominates whatever else there is
            return most
        alone = len(small) < 2 or small[0] + small[1] > room
        if alone or ((len(small) < 3 or sum(small) > room) and self._largest_pair(sizes, many, room) <= i):
            return max(1, most - 4)
        return 0

    @staticmethod
    def _largest_pair(sizes: list[int], many, room: int) -> int:
        best, low, high = 0, 0, len(sizes) - 1
        while low <= high:
            total = sizes[low] + sizes[high]
            usable = many(sizes[low]) >= 1 and many(sizes[high]) >= 1 and (low < high or many(sizes[low]) >= 2)
            if total <= room:
                best = max(best, total) if usable else best
                if low < high and many(sizes[low]) >= 2 and 2 * sizes[low] <= room:
                    best = max(best, 2 * sizes[low])
                low += 1
            else:
                high -= 1
        return best

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)
        rooms: list[int] = []
        for size in sorted(self.left, reverse=True):
            while self.left.get(size):
                k = bisect_right(rooms, size - 1)
                if k < len(rooms):
                    room = rooms[k]
                    first, bins = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[k]
                else:
                    room, first = self.capacity, self.sequences
                    bins = -(-self.left[size] // (room // size))
                    self.sequences += bins
                each = room // size
                n = min(bins, self.left[size] // each)
                if n:
                    self._place(size, n, each, first, self.capacity - room)
                    self._open(open_, rooms, room - each * size, first, n)
                rest = self.left.get(size, 0)
                if n < bins and rest and rest < each:
                    self._place(size, 1, rest, first + n, self.capacity - room)
                    self._open(open_, rooms, room - rest * size, first + n, 1)
                    n += 1
                if n < bins:
                    self._open(open_, rooms, room, first + n, bins - n)

    @staticmethod
    def _open(open_: dict, rooms: list[int], room: int, first: int, bins: int) -> None:
        if room:
            if room not in open_:
                open_[room] = []
                rooms.insert(bisect_right(rooms, room), room)
            open_[room].append((first, bins))

    def arrays(self) -> dict[int, np.ndarray]:
        return {s: np.array(rows, np.int64).reshape(-1, 5) for s, rows in self.places.items()}


def _cut(path: str, end: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for part in pieces(batch):
                ids, at = encode(part.column("text"), end)
                out: list[tuple] = []
                for doc, first, last in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    for k, start in enumerate(range(first, last, capacity)):
                        stop = min(start + capacity, last)
                        out.append((doc, k, start - first, stop - start, zlib.crc32(ids[start:stop].astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _assign(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                table = places[int(size)]
                row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                inner = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 3] + inner // row[:, 2]
                offset[mine] = row[:, 4] + inner % row[:, 2] * size
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    rows = docs.select(safe_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = mapped(rows, _cut(tokenizer or vocabulary("word_bpe_49k.json"), end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    cut = stored(cut.withColumn("part", F.spark_partition_id()), "pieces")
    counts = cut.groupBy("part", "length").count()
    plan = Plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacity)  # at most ``capacity`` rows
    shared = docs.sparkSession.sparkContext.broadcast(plan.arrays())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("inner", F.row_number().over(inside) - 1).join(offsets, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inner")).alias("rank"))
    placed = mapped(ranked, _assign(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.select(real_id(), *placed.columns[1:])
