"""Token ids as binary blocks, compressed by Re-Pair grammars.

Documents are tokenised in ascending order of id and cut into blocks of about ``block_tokens`` ids (never inside a
document). Each block is one binary record of a Parquet table in the shared folder:

    magic "RP01" | documents, rules, symbols: int32 | doc_id: int64 each | ids per document: int32 each |
    left and right side of each rule: int32 each | expansion length of each rule: int32 each | symbols: int32 each

Symbols below ``RULE`` are token ids, the others rules. Pairs are replaced from the most frequent down, until none occurs
``least_count`` times without overlapping itself: a round takes the pairs with at least an eighth (``share``) of the count of
the most frequent, and where two overlap, the more frequent one; a pair that keeps less than half of what the round asks
for waits. A pair of equal ids is replaced from the left of each run. Then only the places whose pair may have gained
(beside a replaced one) or occurs twice are counted again. A pair never holds an end id, or a rule that ends with one, on
its left, so no rule crosses a document. Expansion lengths let one document be decoded without the rest.

Defined cases: a null or empty text is the end id alone; a null id sorts first and stays null; an empty table gives no
rows; rows with equal ids are written one after the other, in order of text; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, new_path, partitions, pieces, real_id, rows_of, safe_id
from .tokenise import encoder, vocabulary

RULE = 1 << 24  # the first rule's symbol
_HEAD = struct.Struct("<4s3i")
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()), ("payload", pa.binary())])


def _every_second(at: np.ndarray) -> np.ndarray:
    """Of places of pairs of equal ids, whether each is the first, third and so on of its run from the left."""
    head = np.concatenate([np.ones(min(1, len(at)), bool), np.diff(at) > 1])
    begin = at[head][np.cumsum(head) - 1]
    return (at - begin) % 2 == 0


def _grouped(key: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, with their places, each key's from the left."""
    place = int(at[-1]).bit_length() if len(at) else 1
    if bits + place <= 64:  # one sort of integers that hold both
        both = np.sort(key << np.uint64(place) | at.astype(np.uint64))
        return both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], at[order]


def _apart(places: np.ndarray, ranks: np.ndarray, n: int, turns: int) -> np.ndarray:
    """Which of the pairs at places are taken: of two that overlap the one of better rank, in a few turns."""
    best = np.full(n + 2, 1 << 30, np.int32)  # best[i + 1]: the rank of the pair at i, if it may be taken
    best[places + 1] = ranks
    left, taken = np.arange(len(places)), []
    for _ in range(turns):
        p = places[left]
        rank = best[p + 1]
        win = (rank < best[p]) & (rank < best[p + 2])
        taken.append(left[win])
        p = p[win]
        best[p] = best[p + 1] = best[p + 2] = 1 << 30
        left = left[~win]
        left = left[best[places[left] + 1] < 1 << 30]
        if not len(left):
            break
    return np.concatenate(taken)


def repair(ids: np.ndarray, end: int, least_count: int = 2, share: int = 8, turns: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as (left, right) rows, expansion lengths)."""
    first = int(ids.max(initial=end)) + 1  # rules are numbered from here on meanwhile
    width = (first + len(ids) // 2).bit_length()
    symbols = ids.astype(np.uint32)
    closing = np.zeros(first + len(ids) // 2, bool)  # symbols that end with an end id
    closing[end] = True
    open_ = symbols != end  # places whose pair may be replaced; a pair that occurs once will never occur twice
    lefts, rights, rules = [], [], 0
    while len(symbols) > 1:
        at = np.flatnonzero(open_[:-1])
        left, right = symbols[at], symbols[at + 1]
        same = np.flatnonzero(left == right)
        if len(same) and not (second := _every_second(at[same])).all():
            keep = np.ones(len(at), bool)
            keep[same[~second]] = False
            at, left, right = at[keep], left[keep], right[keep]
        key = left.astype(np.uint64) << np.uint64(width) | right
        key, where = _grouped(key, at, 2 * width)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        counts = np.diff(edge)
        most = int(counts.max(initial=0))
        if most < least_count:
            break
        open_[where[edge[:-1][counts < 2]]] = False
        least = max(least_count, -(-most // share))
        often = np.flatnonzero(counts >= least)
        number, begin = counts[often], edge[often]
        rank = np.empty(len(often), np.int32)
        rank[np.argsort(-number, kind="stable")] = np.arange(len(often))
        pair = np.repeat(np.arange(len(often), dtype=np.int32), number)
        places = where[np.arange(len(pair)) + np.repeat(begin - (np.cumsum(number) - number), number)]
        taken = _apart(places, rank[pair], len(symbols), turns)
        good = np.bincount(pair[taken], minlength=len(often)) >= max(least_count, least // 2)
        taken = taken[good[pair[taken]]]
        hit = places[taken]
        lefts.append(key[begin[good]] >> np.uint64(width))
        rights.append(key[begin[good]] & np.uint64((1 << width) - 1))
        new = first + rules + np.arange(int(good.sum()))
        closing[new] = closing[rights[-1].astype(np.int64)]
        rules += len(new)
        symbols[hit] = new[(np.cumsum(good) - 1)[pair[taken]]]
        for place in (hit, np.maximum(hit - 1, 0)):
            open_[place] = ~closing[symbols[place]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        keep = np.flatnonzero(keep)
        symbols, open_ = symbols[keep], open_[keep]
    out = [x.astype(np.int64) for x in (symbols, np.concatenate(lefts or [symbols[:0]]), np.concatenate(rights or [symbols[:0]]))]
    symbols, left, right = (np.where(x >= first, x - first + RULE, x).astype(np.int32) for x in out)
    return symbols, np.stack([left, right], axis=1), _lengths(left, right)


def _lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of ids each rule stands for; a rule's sides come before it."""
    lengths = np.zeros(len(left), np.int32)
    todo = np.arange(len(left))
    while len(todo):
        sides = [np.where(x[todo] >= RULE, lengths[np.maximum(x[todo] - RULE, 0)], 1) for x in (left, right)]
        known = (sides[0] > 0) & (sides[1] > 0)
        lengths[todo[known]] = (sides[0] + sides[1])[known]
        todo = todo[~known]
    return lengths


def encode_block(doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray, end: int) -> bytes:
    symbols, rules, lengths = repair(ids, end)
    head = _HEAD.pack(b"RP01", len(doc_ids), len(rules), len(symbols))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), rules.T.astype("<i4").tobytes(), lengths.astype("<i4").tobytes(), symbols.astype("<i4").tobytes()])


class Block:
    """A block opened for reading."""

    def __init__(self, payload: bytes):
        magic, n, rules, symbols = _HEAD.unpack_from(payload)
        if magic != b"RP01":
            raise ValueError("not a block of token ids")
        at = _HEAD.size

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.counts = take(n, "<i8"), take(n, "<i4")
        self.left, self.right, self.lengths = take(rules, "<i4"), take(rules, "<i4"), take(rules, "<i4")
        self.symbols = take(symbols, "<i4")
        self.starts = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules in a row, and where each one's begin."""
        if not hasattr(self, "rule_ids"):
            symbols = np.arange(RULE, RULE + len(self.left), dtype=np.int32)
            while (inner := symbols >= RULE).any():
                ends = np.cumsum(np.where(inner, 2, 1))
                rule = symbols[inner] - RULE
                out = np.empty(ends[-1], np.int32)
                out[ends[inner] - 2], out[ends[inner] - 1] = self.left[rule], self.right[rule]
                out[ends[~inner] - 1] = symbols[~inner]
                symbols = out
            self.rule_ids, self.rule_starts = symbols, np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        return self.rule_ids, self.rule_starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = np.flatnonzero(symbols >= RULE)
        if not len(rule):
            return symbols
        ids, starts = self._flat()
        sizes = np.ones(len(symbols), np.int64)
        sizes[rule] = self.lengths[symbols[rule] - RULE]
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1], np.int32)
        plain = np.flatnonzero(symbols < RULE)
        out[ends[plain] - 1] = symbols[plain]
        shift = ends[rule] - sizes[rule]
        inner = np.arange(sizes[rule].sum()) - np.repeat(np.cumsum(sizes[rule]) - sizes[rule], sizes[rule])
        out[np.repeat(shift, sizes[rule]) + inner] = ids[np.repeat(starts[symbols[rule] - RULE], sizes[rule]) + inner]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its own symbols are expanded."""
        if not hasattr(self, "ends"):
            rule = np.maximum(self.symbols - RULE, 0)
            sizes = np.where(self.symbols >= RULE, self.lengths[rule] if len(self.lengths) else 1, 1)
            self.ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        first, last = np.searchsorted(self.ends, [self.starts[k], self.starts[k + 1]])
        return self.expand(self.symbols[first:last])


def _write(path: str, end: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        block, before, held, size = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held, size
            docs, ids, counts = (np.concatenate(x) for x in zip(*held))
            out = rows_of(_BLOCK, [(part, block, before, len(ids), encode_block(docs, ids, counts, end))])
            block, before, held, size = block + 1, before + len(ids), [], 0
            return out

        for batch in batches:
            for piece in pieces(batch, block_tokens):
                ids, at = encode(piece.column("text"), end)
                held.append((piece.column("doc_id").to_numpy(), ids, np.diff(at)))
                size += len(ids)
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, block_tokens: int = 1 << 18) -> None:
    """Write the ids of all documents, in ascending order of id, as blocks under path."""
    rows = docs.select(safe_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    blocks = mapped(ordered, _write(tokenizer or vocabulary("byte_bpe_50k.json"), end, block_tokens), "part int, block int, before long, tokens long, payload binary")
    blocks.write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for offset, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
            block = Block(payload.as_py())
            ids = block.expand(block.symbols).astype("<u4")
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(block.starts[:-1], block.starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids), pa.array(block.starts[:-1] + offset), pa.array(block.counts.astype(np.int64)), pa.array(sums, pa.int64())], schema=schema)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, decoded from the blocks under path."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row per partition written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = blocks.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("start"), "payload")
    out = mapped(placed, _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.select(real_id(), "start", "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    path = new_path(docs.sparkSession, "token-blocks")
    write_tokens(docs, path, tokenizer, end)
    return read_tokens(docs.sparkSession, path)
