"""Sparse bit sets as columns: on-bits (ascending int arrays) and packed 64-bit words. No UDFs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column, strict: bool = False) -> Column:
    """``{1, 5, 9}`` to its bits. Tolerant: reading stops at the first token that is no integer. Strict: such a token raises.

    Null stays null when tolerant (not computed) and is the empty set when strict, as blank text and ``{}`` are in both.
    """
    inner = F.trim(F.regexp_replace(text, r"^\s*\{|\}\s*$", ""))
    tokens = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda t: t != "")
    if strict:
        bits = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: t.cast("int"))))
        return F.when(text.isNull(), F.array().cast("array<int>")).otherwise(bits)
    good = F.transform(tokens, lambda t: t.try_cast("int"))
    bad = F.array_position(F.transform(good, lambda b: b.isNull()), True)
    kept = F.when(bad == 0, good).otherwise(F.slice(good, 1, F.greatest(bad.cast("int") - 1, F.lit(0))))
    return F.array_sort(F.array_distinct(kept))


def render(bits: Column) -> Column:
    """Bits to ``{1, 5, 9}``, ascending."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(bits), ", "), F.lit("}"))


def from_binary_string(text: Column) -> Column:
    """``0110`` to {1, 2}."""
    marks = F.transform(F.split(text, ""), lambda c, i: F.when(c == "1", i))
    return F.filter(marks, lambda i: i.isNotNull())


def to_bytes(bits: Column, size: int) -> Column:
    """Big-endian bytes, as a hexadecimal string: bit 0 is the lowest of the last byte."""
    byte = lambda k: F.aggregate(F.filter(bits, lambda b: F.floor(b / 8) == k), F.lit(0), lambda a, b: a + F.pow(F.lit(2), b % 8).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(size // 8 - 1), F.lit(0), F.lit(-1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), "")


def from_bytes(text: Column) -> Column:
    """Big-endian bytes, as a hexadecimal string, to bits: the lowest bit of the last byte is bit 0."""
    digits = F.reverse(F.split(text, ""))
    value = lambda c: F.conv(c, 16, 10).cast("int")
    marks = F.transform(digits, lambda c, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(F.call_function("shiftright", value(c), k).bitwiseAND(F.lit(1)) == 1, i * 4 + k)), lambda b: b.isNotNull()))
    return F.flatten(marks)


def tanimoto_or_zero(a: Column, b: Column) -> Column:
    """Tanimoto of two sets as text; 0 where either can't be read."""
    read = lambda x: F.when(x.rlike(r"^\s*\{\s*([0-9]+\s*(,\s*[0-9]+\s*)*)?\}\s*$"), parse(x))
    return F.coalesce(tanimoto(read(a), read(b)), F.lit(0.0))


def pack(bits: Column, words: int = 16) -> Column:
    """On-bits to so many longs; a bit of 64 * words or more raises."""
    fits = F.coalesce(F.array_max(bits), F.lit(0)) < 64 * words
    bits = F.when(fits | bits.isNull(), bits).otherwise(F.raise_error(F.lit(f"a bit does not fit {words} words")).cast("array<int>"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda k: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == k), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int")))),
    )


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def contains(candidate: Column, query: Column) -> Column:
    """Whether every query bit is set."""
    return F.size(F.array_except(query, candidate)) == 0


def tanimoto(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over united bits; ``empty`` for two empty sets."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(empty)).otherwise(common / total)


def packed_common(a: Column, b: Column, words: int = 16) -> Column:
    """Shared bits of packed words; spelled out word by word, so that it compiles (lambdas over arrays don't)."""
    parts = [F.bit_count(F.coalesce(F.get(a, F.lit(k)).bitwiseAND(F.get(b, F.lit(k))), F.lit(0).cast("long"))) for k in range(words)]
    return sum(parts[1:], parts[0])


def packed_tanimoto(a: Column, b: Column, size_a: Column, size_b: Column, words: int = 16) -> Column:
    common = packed_common(a, b, words)
    total = size_a + size_b - common
    return F.when(total == 0, F.lit(0.0)).otherwise(common / total)


def word_tanimoto(ours: list[Column], theirs: list[Column]) -> Column:
    """Tanimoto over parallel integer columns (hash words)."""
    add = lambda parts: sum(parts[1:], parts[0])
    a, b = add([F.bit_count(x) for x in ours]), add([F.bit_count(x) for x in theirs])
    c = add([F.bit_count(x.bitwiseAND(y)) for x, y in zip(ours, theirs)])
    return F.when(a + b - c == 0, F.lit(0.0)).otherwise(c / (a + b - c))


def words_contain(columns: list[Column], query: list[int]) -> Column:
    """(column & q) = q for all words; zero words ask for nothing."""
    out = F.lit(True)
    for c, q in zip(columns, query):
        if q:
            out = out & (c.bitwiseAND(F.lit(q)) == q)
    return out


def to_vector(bits: Column, size: int) -> Column:
    """A vector of 0/1 features; spark.ml keeps it, and reads it, as one column rather than one per bit."""
    return array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.array_contains(bits, k).cast("double")))


def word_fingerprint(text: Column, size: int = 1024) -> Column:
    """Bits of the words of a text: the first three hexadecimal digits of each word's MD5, modulo size."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[ \n]+")), "")  # each word is hashed once
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 3), 16, 10).cast("int") % size)))
