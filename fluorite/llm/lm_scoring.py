"""Language-model scores by a probabilistic suffix tree over the bytes of tokens.

A text is its lower-cased words, one space between them, and an end byte, so a distribution over byte sequences is one
over token sequences. The tree keeps contexts of up to ``depth`` bytes:

* candidates are contexts seen ``least`` times or more, however large the corpus, so the tree grows with it;
* a context stays if its next-byte distribution diverges from that of its suffix: count times relative entropy is at
  least ``divergence`` nats; suffixes of kept contexts stay too;
* a distribution is smoothed with that of its suffix (weight: number of different next bytes), down to a uniform start;
* a byte is scored by the longest kept suffix of what precedes it.

Nothing of the tree's size is broadcast or collected. Tasks send their (context and next byte, count) pairs to buckets
hashed by the last ``STEM`` bytes of the context, so a bucket holds all longer suffixes of its contexts and can build its
part of the tree. Contexts below STEM bytes (limited by the alphabet, not by the corpus) are summed and broadcast, with
a bit for each that must stay for a longer one in any bucket. A bucket's probabilities travel back only to the partitions
that hold the pair, as the baseline's global word counts do.

Defined cases: null text counts as empty (one end token); a null id is scored and never held out, so it trains; an
empty table gives no rows; repeated rows are scored and counted each; columns other than doc_id and text are ignored;
without training texts the tree is the uniform distribution and the baseline has N = V = 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_of, by_number, ints, mapped, mix, packed_rows, partitions, pieces, real_id, routed, rows_of, split_by, squeezed, stored, Tally, unpacked, unsqueezed, with_side, Words

END = 10  # the end byte; also fills the context before a text's first byte
_END_TOKEN = np.uint64(1)  # the key of the end token among word hashes
STEM = 3  # bytes of a context that decide its bucket
_WORDS, _GRAMS = 0, 1  # kinds of packed rows
_PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("p", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def held_out_by_crc(column: str = "doc_id", modulus: int = 5, rest: int = 1) -> Column:
    return (F.crc32(F.col(column).cast("string").cast("binary")) % modulus) == rest


# ------------------------------------------------------------------------------------------------ byte contexts
def symbols(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes, each after depth end bytes; which positions are scored; the first scored position of each."""
    per_word = words.ends - words.starts + 1  # with the space after it; the last one's is the end byte
    counts = np.diff(words.first)
    length = np.concatenate([[0], np.cumsum(per_word)])
    text_bytes = length[words.first[1:]] - length[words.first[:-1]] + (counts == 0)
    starts = np.concatenate([[0], np.cumsum(text_bytes + depth)])
    out = np.full(starts[-1], END, np.uint8)
    if len(words.starts):
        shift = np.repeat(starts[:-1] + depth - length[words.first[:-1]], counts) + length[:-1]
        inner = np.arange(length[-1]) - np.repeat(length[:-1], per_word)
        source = np.repeat(words.starts, per_word) + inner
        byte = words.data[source]
        byte[length[1:] - 1] = 32
        out[np.repeat(shift, per_word) + inner] = byte
        out[starts[1:] - 1] = END
    scored = np.ones(len(out), bool)
    for k in range(depth):
        scored[starts[:-1] + k] = False
    return out, scored, starts[:-1] + depth


def packed_grams(seq: np.ndarray, scored: np.ndarray, depth: int) -> np.ndarray:
    """For each scored position, its depth bytes of context and itself in one integer, the oldest byte on top."""
    where = np.flatnonzero(scored)
    key = np.zeros(len(where), np.uint64)
    for k in range(depth, -1, -1):
        key = (key << np.uint64(8)) | seq[where - k]
    return key


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, (d+1)-grams, counts) for d from depth to 0."""
    for d in range(depth, -1, -1):
        keys = keys & np.uint64(2 ** (8 * (d + 1)) - 1)
        keys, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
        yield d, keys, counts


def _stem_hash(keys: np.ndarray, stem: int) -> np.ndarray:
    """A hash of the last stem bytes of each key's context."""
    return mix((keys >> np.uint64(8)) & np.uint64(2 ** (8 * stem) - 1))


def frequent(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The seen pairs of contexts with a sum of least or more."""
    _, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
    keep = (np.bincount(inverse, weights=counts)[inverse] >= least) & (counts > 0) if len(keys) else np.zeros(0, bool)
    return keys[keep], counts[keep]


class SuffixTree:
    """levels[d]: kept contexts of d bytes, the (context, next) pairs seen, their probabilities, and for unseen nexts the factor on the suffix's probability."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], depth: int, divergence: float, held: tuple[int, np.ndarray] | None = None):
        """held: (d, contexts of d bytes that stay whatever their gain, for longer ones that are not in tables)."""
        self.depth = depth
        full: list[tuple] = []
        kept: list[np.ndarray] = []
        for d in range(depth + 1):
            keys, counts = tables.get(d, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(contexts))
            kinds = np.bincount(inverse, minlength=len(contexts))
            parent = self._smoothed(full, keys, d - 1)
            p = (counts + kinds[inverse] * parent) / (total + kinds)[inverse]
            full.append((contexts, keys, p, kinds / (total + kinds)))
            gain = np.bincount(inverse, weights=counts * np.log(p / parent), minlength=len(contexts))
            kept.append(np.ones(len(contexts), bool) if d == 0 else gain >= divergence)
        if held is not None:
            kept[held[0]] |= np.isin(full[held[0]][0], held[1])
        for d in range(depth, 1, -1):  # suffixes of kept contexts stay
            mask = np.uint64(2 ** (8 * (d - 1)) - 1)
            kept[d - 1] |= np.isin(full[d - 1][0], full[d][0][kept[d]] & mask)
        self.full = full
        self.kept = [full[d][0][kept[d]] for d in range(depth + 1)]

    @staticmethod
    def _smoothed(full: list[tuple], keys: np.ndarray, d: int) -> np.ndarray:
        """The probability of each key's next byte after its last d bytes; every suffix of a candidate is a candidate."""
        out = np.full(len(keys), 1 / 256)
        for level in range(d + 1):
            contexts, pairs, p, rest = full[level]
            short = keys & np.uint64(2 ** (8 * (level + 1)) - 1)
            if not len(contexts):
                continue
            i = np.minimum(np.searchsorted(contexts, short >> np.uint64(8)), len(contexts) - 1)
            known = contexts[i] == short >> np.uint64(8)
            j = np.minimum(np.searchsorted(pairs, short), len(pairs) - 1)
            out = np.where(known, np.where(pairs[j] == short, p[j], rest[i] * out), out)
        return out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's next byte by its longest kept suffix."""
        state = np.zeros(len(keys), np.int64)
        for d in range(1, self.depth + 1):
            if len(self.kept[d]):
                context = (keys >> np.uint64(8)) & np.uint64(2 ** (8 * d) - 1)
                i = np.minimum(np.searchsorted(self.kept[d], context), len(self.kept[d]) - 1)
                state[self.kept[d][i] == context] = d
        out = np.empty(len(keys))
        for d in range(self.depth + 1):
            at = np.flatnonzero(state == d)
            pairs, p = self.full[d][1], self.full[d][2]
            short = keys[at] & np.uint64(2 ** (8 * (d + 1)) - 1)
            j = np.minimum(np.searchsorted(pairs, short), max(0, len(pairs) - 1))
            seen = pairs[j] == short if len(pairs) else np.zeros(len(at), bool)
            out[at[seen]] = np.log10(p[j[seen]])
            out[at[~seen]] = np.log10(self._smoothed(self.full, keys[at[~seen]], d))
        return out


# ---------------------------------------------------------------------------------------- counts of the corpus
def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    for batch in batches:
        for p, payload in zip(batch.column("p").to_pylist(), batch.column("payload")):
            yield p, unpacked(payload.as_buffer())


def _count(depth: int, stem: int, n: int):
    """Each partition's words and grams with their counts in its training texts; 0 asks for what only others may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, tuple[Tally, Tally]] = {}
        for k, rows in _opened(batches):
            for batch in rows:
                for piece in pieces(batch):
                    words, train = Words(piece.column("text")), ~ints(piece, "held_out").astype(bool)
                    mine = tallies.setdefault(k, (Tally(), Tally()))
                    seq, scored, first = symbols(words, depth)
                    seen = np.repeat(train, np.diff(np.append(first - depth, len(seq))))[scored]
                    for tally, keys, counted in zip(mine, (words.hashes, packed_grams(seq, scored, depth)), (train[words.owner()], seen)):
                        tally.add(keys[counted])
                        rest = np.unique(keys[~counted])
                        tally.add(rest, np.zeros(len(rest)))
                    mine[_WORDS].add(np.array([_END_TOKEN]), np.array([train.sum()]))
        for k, mine in tallies.items():
            for kind, tally in enumerate(mine):
                keys, counts = tally.get()
                order, bounds = split_by(buckets_of(_stem_hash(keys, stem) if kind == _GRAMS else keys, n), n)
                yield rows_of(_PACKED, [(kind, b, k, squeezed(keys[o]), squeezed(counts[o])) for b in range(n) if len(o := order[bounds[b] : bounds[b + 1]])])

    return run


_SUMS = pa.schema([*_PACKED, ("tokens", pa.int64()), ("kinds", pa.int64()), ("asked", pa.list_(pa.struct([("p", pa.int32()), ("at", pa.binary())])))])
_SUMS_SQL = "kind int, bucket int, p int, keys binary, counts binary, tokens long, kinds long, asked array<struct<p: int, at: binary>>"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words: each partition's with their global counts (a bucket's totals on its first row). Grams: one row for a bucket, and where in it each partition's are."""
    asked: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    sums: dict[tuple[int, int], Tally] = {}
    for batch in batches:
        for kind, b, p, keys, counts in zip(*(batch.column(c).to_pylist() for c in _PACKED.names)):
            keys = unsqueezed(keys, np.uint64)
            asked.setdefault((kind, b), []).append((p, keys))
            sums.setdefault((kind, b), Tally()).add(keys, unsqueezed(counts, np.int64))
    for (kind, b), tally in sums.items():
        keys, counts = tally.get()
        if kind == _GRAMS:
            where = [{"p": p, "at": np.searchsorted(keys, wanted).astype(np.int32).tobytes()} for p, wanted in asked[kind, b]]
            yield rows_of(_SUMS, [(kind, b, None, squeezed(keys), squeezed(counts), 0, 0, where)])
            continue
        for i, (p, wanted) in enumerate(asked[kind, b]):
            yield rows_of(_SUMS, [(kind, b, p, squeezed(wanted), squeezed(counts[np.searchsorted(keys, wanted)]), 0 if i else int(counts.sum()), 0 if i else int((counts > 0).sum()), None)])


def _short(stem: int, n: int):
    """The pairs whose contexts have stem - 1 bytes, with the sums of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                tally.add(*next((k, c) for _, k, c in _levels(unsqueezed(keys, np.uint64), unsqueezed(counts, np.int64), stem - 1)))
        keys, counts = tally.get()
        keys, counts = keys[counts > 0], counts[counts > 0]
        order, bounds = split_by(buckets_of(mix(keys.copy()), n), n)
        yield rows_of(_PACKED, [(_GRAMS, b, None, squeezed(keys[o]), squeezed(counts[o])) for b in range(n) if len(o := order[bounds[b] : bounds[b + 1]])])

    return run


def _sum_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            tally.add(unsqueezed(keys, np.uint64), unsqueezed(counts, np.int64))
    keys, counts = tally.get()
    yield rows_of(_PACKED, [(_GRAMS, 0, None, squeezed(keys), squeezed(counts))] if len(keys) else [])


def _part(keys: np.ndarray, counts: np.ndarray, base: dict, depth: int, stem: int, least: int, divergence: float, held: np.ndarray | None = None) -> SuffixTree:
    """A bucket's part of the tree: its contexts of stem bytes and more, and all shorter ones."""
    seen = counts > 0
    tables = {d: frequent(k, c, least) for d, k, c in _levels(keys[seen], counts[seen], depth) if d >= stem}
    return SuffixTree(base | tables, depth, divergence, None if held is None else (stem - 1, held))


_BITS = pa.schema([("bits", pa.binary())])
_LOGS = pa.schema([("p", pa.int32()), ("keys", pa.binary()), ("logs", pa.binary())])


def _held(shared, stem: int, *options):
    """A bit for each context of stem - 1 bytes: whether a kept one of the bucket ends with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(256 ** (stem - 1), bool)
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                tree = _part(unsqueezed(keys, np.uint64), unsqueezed(counts, np.int64), shared.value, options[0], stem, *options[1:])
                bits[(tree.kept[stem] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        yield rows_of(_BITS, [(np.packbits(bits).tobytes(),)])

    return run


def _answer(shared, stem: int, *options):
    """log10 of the probability of each pair, for the partitions that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = shared.value
        for batch in batches:
            for keys, counts, asked in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "asked"))):
                keys = unsqueezed(keys, np.uint64)
                logs = _part(keys, unsqueezed(counts, np.int64), base, options[0], stem, *options[1:], held).log10(keys)
                for x in asked:
                    at = np.frombuffer(x["at"], np.int32)
                    yield rows_of(_LOGS, [(x["p"], squeezed(keys[at]), squeezed(logs[at]))])

    return run


def gram_answers(grams: DataFrame, depth: int, least: int, divergence: float) -> DataFrame:
    """p, keys, logs of all grams summed by _sum. What reaches the driver: pairs of contexts below STEM bytes, and bits."""
    spark = grams.sparkSession
    n, stem = partitions(spark), min(STEM, depth)
    packed = "kind int, bucket int, p int, keys binary, counts binary"
    rows = mapped(by_number(mapped(grams.select("keys", "counts"), _short(stem, n), packed), "bucket", n), _sum_short, packed).select("keys", "counts").collect()
    tally = Tally()
    for r in rows:
        tally.add(unsqueezed(r["keys"], np.uint64), unsqueezed(r["counts"], np.int64))
    base = {d: frequent(k, c, least) for d, k, c in _levels(*tally.get(), stem - 1)}
    options = (depth, least, divergence)
    bits = np.zeros(256 ** (stem - 1), bool)
    for r in mapped(grams.select("keys", "counts"), _held(spark.sparkContext.broadcast(base), stem, *options), "bits binary").toLocalIterator():
        bits |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(bits)).astype(bool)
    shared = spark.sparkContext.broadcast((base, np.flatnonzero(bits).astype(np.uint64)))
    return mapped(grams.select("keys", "counts", "asked"), _answer(shared, stem, *options), "p int, keys binary, logs binary")


def _score(depth: int, total: int, kinds: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        below = total + 0.5 * (kinds + 1)
        now, parts, side = None, ([], []), None
        for batch in batches:
            kind = ints(batch, "kind")
            facts = batch.filter(pa.array(kind == 0))
            for p, k, c, x in zip(*(facts.column(name).to_pylist() for name in ("p", "keys", "counts", "logs"))):
                if p != now:
                    now, parts = p, ([], [])
                parts[_GRAMS if c is None else _WORDS].append((unsqueezed(k, np.uint64), unsqueezed(x, np.float64) if c is None else unsqueezed(c, np.int64)))
                side = None
            for p, rows in _opened([batch.filter(pa.array(kind == 1))]):
                if p != now:
                    raise ValueError(f"counts of partition {p} are missing")
                if side is None:
                    side = [_table(x) for x in parts]
                (keys, counts), (pairs, chances) = side
                for piece in (x for batch in rows for x in pieces(batch)):
                    words = Words(piece.column("text"))
                    c = counts[np.minimum(np.searchsorted(keys, words.hashes), max(0, len(keys) - 1))] if len(words.hashes) else np.zeros(0, np.int64)
                    end = int(counts[np.searchsorted(keys, _END_TOKEN)])
                    owner, n = words.owner(), words.n
                    base = np.bincount(owner, np.log10((c + 0.5) / below), n) + math.log10((end + 0.5) / below)
                    known = np.bincount(owner, c > 0, n).astype(np.int64) + (end > 0)
                    seq, scored, first = symbols(words, depth)
                    codes, grams = pd.factorize(packed_grams(seq, scored, depth))
                    logs = chances[np.searchsorted(pairs, np.asarray(grams, np.uint64))][codes]
                    begin = first - depth * np.arange(1, n + 1)
                    score = np.add.reduceat(logs, begin)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(words.first) + 1, pa.int64()), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(score)], schema=schema
                    )

    return run


def _table(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    return keys[order], values[order]


def score_texts(docs: DataFrame, held_out: Column | None = None, depth: int = 5, least: int = 2, divergence: float = 4.0) -> DataFrame:
    """Scores of all texts by a suffix tree and by a word unigram baseline, both learnt from those not held out."""
    spark = docs.sparkSession
    n = partitions(spark)
    flag = F.coalesce(held_out_by_crc() if held_out is None else held_out, F.lit(False)).alias("held_out")
    routed_docs = routed(docs, flag)
    texts = packed_rows(routed_docs)
    counted = mapped(by_number(texts, "p", n), _count(depth, min(STEM, depth), n), "kind int, bucket int, p int, keys binary, counts binary")
    sums = stored(mapped(by_number(counted, "bucket", n), _sum, _SUMS_SQL), "counts")
    words = sums.where(F.col("kind") == _WORDS)
    total, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    grams = gram_answers(sums.where(F.col("kind") == _GRAMS), depth, least, divergence)
    side = words.select("p", "keys", "counts").unionByName(grams, allowMissingColumns=True)
    out = mapped(with_side(texts, side, n), _score(depth, int(total), int(kinds)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(real_id(), *out.columns[1:])
