"""Tanimoto joins and searches over (id, bits, words, n) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import tiles

#: Rows up to which a size-bounded nested loop over a broadcast table is cheaper than an index (16 words a row).
LOOP_ROWS = 50_000
#: Words of 64 bits that hold the 1100 extended and the 5110 Klekota-Roth bits.
WIDTHS = {"ext": 18, "kr": 80}


def prepare(df: DataFrame, key: str, bits: str, words: int = 16) -> DataFrame:
    """id, bits, words, n; rows without bits are left out."""
    return df.where(F.col(bits).isNotNull()).select(F.col(key).alias("id"), F.col(bits).alias("bits"), B.pack(F.col(bits), words).alias("words"), F.size(bits).alias("n"))


def similarity_join(left: DataFrame, right: DataFrame, cutoff: float = 0.85, plan: str = "auto", words: int = 16) -> DataFrame:
    """mol_id1, mol_id2, score for pairs of different ids with score >= cutoff, both directions.

    Plans: ``loop`` compares packed words in a size-bounded nested loop over a broadcast right side; ``prefix`` deals both
    sides to tiles, counts the shared bits of some columns there and verifies the pairs for which they can be enough. ``auto``
    counts the right side (a job at planning time) and loops only while it is small. Both give the same pairs. words is the
    width both sides were packed with.
    """
    if plan == "auto":
        plan = "loop" if right.limit(LOOP_ROWS + 1).count() <= LOOP_ROWS else "prefix"
    a, b = _spread(left, "a", words), _spread(right, "b", words)
    near = (F.col("a") != F.col("b")) & (F.col("na") >= cutoff * F.col("nb")) & (F.col("nb") >= cutoff * F.col("na"))
    score = _spread_tanimoto(words)
    if plan == "loop":
        enough = _spread_common(words) >= cutoff / (1 + cutoff) * (F.col("na") + F.col("nb")) - 1e-6  # cheap and never too strict
        pairs = a.join(F.broadcast(b), near & enough & (score >= cutoff))  # the whole condition compiles into the loop
    else:
        return tiles.join(left, right, cutoff, words).select(F.col("a").alias("mol_id1"), F.col("b").alias("mol_id2"), "score")
    return pairs.select(F.col("a").alias("mol_id1"), F.col("b").alias("mol_id2"), score.alias("score"))


def _spread(df: DataFrame, name: str, words: int = 16) -> DataFrame:
    """id, n and one long column per packed word: a nested loop reads those from the row without touching an array."""
    longs = [F.coalesce(F.get("words", F.lit(k)), F.lit(0).cast("long")).alias(f"{name}{k}") for k in range(words)]
    return df.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), *longs)


def _spread_common(words: int = 16) -> Column:
    parts = [F.bit_count(F.col(f"a{k}").bitwiseAND(F.col(f"b{k}"))) for k in range(words)]
    return sum(parts[1:], parts[0])


def _spread_tanimoto(words: int = 16) -> Column:
    common = _spread_common(words)
    total = F.col("na") + F.col("nb") - common
    return F.when(total == 0, F.lit(0.0)).otherwise(common / total)


def batch_similarity(batch: DataFrame, everything: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """The stored edge list of a batch against all: ext or kr reaches the cutoff, and ext is below 1.

    Both tables have id, ext and kr (bits); a null on either side of a pair leaves it out.
    """
    both = [t.where("ext is not null and kr is not null") for t in (batch, everything)]
    found = [similarity_join(prepare(both[0], "id", c, w), prepare(both[1], "id", c, w), cutoff, words=w).select("mol_id1", "mol_id2") for c, w in WIDTHS.items()]
    pairs = found[0].union(found[1]).distinct()
    a, b = (t.select(F.col("id").alias(i), F.col("ext").alias(f"ext{k}"), F.col("kr").alias(f"kr{k}")) for t, i, k in ((both[0], "mol_id1", 1), (both[1], "mol_id2", 2)))
    scored = pairs.join(a, "mol_id1").join(b, "mol_id2").select("mol_id1", "mol_id2", B.tanimoto(F.col("ext1"), F.col("ext2")).alias("ext"), B.tanimoto(F.col("kr1"), F.col("kr2")).alias("kr"))
    return scored.where("ext < 1").select("mol_id1", "mol_id2", F.col("ext").cast("decimal(5,4)").alias("ext"), F.col("kr").cast("decimal(5,4)").alias("kr"))


def similarity_search(fps: DataFrame, query: Column, threshold: float = 0.8, limit: int = 100) -> DataFrame:
    """mol_id and score of the best ``limit`` rows at threshold or more; ties go to the smaller id."""
    scored = fps.select(F.col("id").alias("mol_id"), B.tanimoto(F.col("bits"), query).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "mol_id").limit(max(limit, 1))


def substructure_screen(fps: DataFrame, query: Column, limit: int = 100, verify=None) -> DataFrame:
    """Ids whose bits hold all query bits; ``verify`` (a column condition) runs on those only."""
    hits = fps.where(B.contains(F.col("bits"), query))
    hits = hits.where(verify) if verify is not None else hits
    return hits.select(F.col("id").alias("mol_id")).orderBy("mol_id").limit(limit)


def certainty(queries: DataFrame, train: DataFrame, k: int = 5, compat: bool = False) -> DataFrame:
    """Mean of the k best similarities to the training set; with compat a row may match itself."""
    found = tiles.best(queries, train, k, compat).where(F.size("scores") > 0)
    scores = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k)
    merged = found.groupBy(F.col("id").alias("mol_id")).agg(scores.alias("scores"))
    return merged.select("mol_id", (F.aggregate("scores", F.lit(0.0), lambda x, y: x + y) / F.size("scores")).alias("certainty_score"))


def squared_distance(columns: list[str], query: dict[str, int]) -> Column:
    """Sum of squared differences of counters."""
    parts = [F.pow(F.col(c) - query[c], 2) for c in columns]
    return sum(parts[1:], parts[0])


def blended_search(df: DataFrame, key: str, counters: dict[str, int], hashes: dict[str, int], groups: dict[str, int], weight: float = 0.5, most: int = 5000, farthest: int = 300, hits: int = 250, least: float = 0.5) -> DataFrame:
    """Cheap distance first (best ``most``, then at most ``farthest``), then (ws Ts + wf Tf)(farthest - d)/farthest, best ``hits``."""
    near = df.withColumn("diffsum", squared_distance(list(counters), counters)).orderBy("diffsum", key).limit(most).where(F.col("diffsum") <= farthest)
    ts, tf = (B.word_tanimoto([F.col(c) for c in q], [F.lit(v) for v in q.values()]) for q in (hashes, groups))
    score = ((1 - weight) * ts + weight * tf) * (farthest - F.col("diffsum")) / farthest
    return near.select(key, "diffsum", score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(hits)
