"""Language identification by hyperdimensional profiles.

Every letter (and the gap between words) has a random +1/-1 vector drawn from its code point. A letter trigram binds the
twice-permuted vector of its first letter, the once-permuted one of its second and that of its third by elementwise
product. A document bundles (adds) the vectors of all its trigrams; a language prototype bundles all its training
documents; the prediction is the prototype with the greatest cosine, and the score is that cosine, 0 if negative.

Prototypes are integer sums, so they don't depend on the order of tasks; what travels is one vector per task and
language, and what is broadcast is one vector per language, at most ``max_languages`` of them.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; training rows need a non-null lang; equal
cosines go to the smaller lang; without training rows every text gets ``und``; an empty table gives no rows; repeated
rows are predicted each; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_number, ints, mapped, mix, partitions, pieces, real_id, rows_of, safe_id, u64

UND = "und"
#: Texts predicted at once: a task holds so many vectors and rows of 2048 counts, however short the texts are.
ROWS = 512
_letters: list[np.ndarray] = []
_PROFILE = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("vector", pa.binary())])


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams of lower-cased letters and single gaps, the text each belongs to, and each text's letter count."""
    lowered = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
    points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.concatenate([np.full(len(t) + 1, i) for i, t in enumerate(lowered)]) if lowered else np.zeros(0, np.int64)
    letter = _is_letter()[points]
    number = np.bincount(owner, letter, len(lowered)).astype(np.int64)
    # one gap before the first word, between words and after the last
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    after = np.concatenate([[False], letter[:-1]]) & ~first if len(owner) else first
    gap = ~letter & after
    keep = letter | gap
    points = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    owner, opens = owner[keep], None
    if not len(owner):
        return np.zeros(0, np.uint64), owner, number
    opens = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    points, owner = np.insert(points, opens, 32), np.insert(owner, opens, owner[opens])
    key = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    same = owner[:-2] == owner[2:]
    return key[same], owner[:-2][same], number


class Space:
    """The vectors of letters and trigrams in so many dimensions (a multiple of 64)."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed, self.letters, self.cache = dimensions, seed, {}, {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            words = mix(np.arange(self.dimensions // 64, dtype=np.uint64) + u64(point * 4096 + self.seed * 0x9E3779B97F4A7C15))
            self.letters[point] = np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letters[point]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty((len(keys), self.dimensions), np.float32)
        low = np.uint64(0x1FFFFF)
        columns = []
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            points, inverse = np.unique((keys >> np.uint64(shift)) & low, return_inverse=True)
            columns.append((np.array([np.roll(self.letter(int(c)), turn) for c in points], np.int8).reshape(-1, self.dimensions), inverse))
        for start in range(0, len(keys), 4096):  # bounds the temporary arrays
            part = slice(start, start + 4096)
            (a, i), (b, j), (c, k) = columns
            out[part] = a[i[part]] * b[j[part]] * c[k[part]]
        return out


def _bundle(dimensions: int, seed: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        space, counts = Space(dimensions, seed), {}
        for batch in batches:
            for piece in pieces(batch):
                keys, owner, _ = trigrams(piece.column("text"))
                langs = np.array(piece.column("lang").to_pylist(), dtype=object)
                for lang in set(langs):
                    unique, number = np.unique(keys[(langs == lang)[owner]], return_counts=True)
                    old = counts.get(lang)
                    if old is not None:
                        unique, inverse = np.unique(np.concatenate([old[0], unique]), return_inverse=True)
                        number = np.bincount(inverse, np.concatenate([old[1], number])).astype(np.int64)
                    counts[lang] = (unique, number)
        bucket = TaskContext.get().partitionId() % n
        for lang, (keys, number) in counts.items():
            total = np.zeros(dimensions, np.int64)
            for start in range(0, len(keys), 4096):
                total += (number[start : start + 4096] @ space.vectors(keys[start : start + 4096]).astype(np.int64))
            yield rows_of(_PROFILE, [(bucket, lang, total.tobytes())])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, vector in zip(batch.column("lang").to_pylist(), batch.column("vector").to_pylist()):
            sums[lang] = sums.get(lang, 0) + np.frombuffer(vector, np.int64)
    yield rows_of(_PROFILE, [(0, lang, v.tobytes()) for lang, v in sums.items()])


def fit_profiles(train: DataFrame, dimensions: int = 1024, seed: int = 7, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """lang: prototype, over all rows of train (text, lang) with both."""
    spark = train.sparkSession
    rows = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    schema = "bucket int, lang string, vector binary"
    n = min(64, partitions(spark))
    sums = mapped(by_number(mapped(rows, _bundle(dimensions, seed, n), schema), "bucket", n), _add, schema)
    out: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        out[r.lang] = out.get(r.lang, 0) + np.frombuffer(r.vector, np.int64)
        if len(out) > max_languages:
            raise ValueError(f"more than {max_languages} languages; raise max_languages if the prototypes fit a broadcast")
    return out


def _predict(model, dimensions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = model.value
        space = Space(dimensions, seed)
        for batch in batches:
            for piece in pieces(batch, rows=ROWS):
                keys, owner, number = trigrams(piece.column("text"))
                n = piece.num_rows
                if not n:
                    continue
                best, score = np.full(n, -1), np.zeros(n)
                if len(keys) and len(langs):
                    unique, code = np.unique(keys, return_inverse=True)
                    bundled = np.zeros((n, dimensions), np.float32)
                    for start in range(0, len(unique), 2048):
                        inside = (code >= start) & (code < start + 2048)
                        width = min(2048, len(unique) - start)
                        table = np.bincount(owner[inside] * width + code[inside] - start, minlength=n * width).reshape(n, width)
                        bundled += table.astype(np.float32) @ space.vectors(unique[start : start + width])
                    norm = np.sqrt((bundled.astype(np.float64) ** 2).sum(axis=1))
                    cosine = (bundled.astype(np.float64) @ prototypes.T) / np.maximum(norm, 1e-12)[:, None]
                    best = np.where(number > 0, cosine.argmax(axis=1), -1)
                    score = np.where(number > 0, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                names = [langs[k] if k >= 0 else UND for k in best]
                kept = [f for f in piece.schema.names if f != "text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score), pa.array(number)], names=[*kept, "lang_pred", "score", "letters"])

    return run


def _units(model: dict[str, np.ndarray], dimensions: int) -> tuple[list[str], np.ndarray]:
    langs = sorted(model)
    return langs, np.array([model[k] / max(np.sqrt((model[k].astype(np.float64) ** 2).sum()), 1e-12) for k in langs], np.float64).reshape(-1, dimensions)


def identify(docs: DataFrame, held_out: Column | None = None, dimensions: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; prototypes come from the rows not held out."""
    flag = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2 if held_out is None else held_out
    rows = docs.select(safe_id().alias("doc_id"), F.coalesce(flag, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit_profiles(rows.where("not held_out"), dimensions, seed)
    shared = docs.sparkSession.sparkContext.broadcast(_units(model, dimensions))  # max_languages vectors at most
    out = mapped(rows.drop("lang"), _predict(shared, dimensions, seed), "doc_id long, held_out boolean, lang_pred string, score double, letters long")
    return out.select(real_id(), "held_out", "lang_pred", "score")


def _keep(predict, column: str, least: float, labelled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column=column, rows=ROWS):
                (said,) = predict(iter([pa.RecordBatch.from_arrays([piece.column(column)], names=["text"])]))
                good = pc.greater_equal(said.column("score"), least) if labelled else pc.greater(said.column("letters"), 0)
                yield piece.filter(pc.and_(good, pc.greater(said.column("letters"), 0)))

    return run


def keep_identified(docs: DataFrame, least: float = 0.05, dimensions: int = 1024, seed: int = 7) -> DataFrame:
    """The rows of docs, unchanged, whose text has letters and a cosine of least or more with its nearest prototype.

    Without a labelled row there is no prototype to be far from: all rows whose text has letters stay.
    """
    model = fit_profiles(docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2), dimensions, seed)
    shared = docs.sparkSession.sparkContext.broadcast(_units(model, dimensions))
    return mapped(docs, _keep(_predict(shared, dimensions, seed), "text", least, bool(model)), docs.schema)
