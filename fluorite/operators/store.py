"""Writes as table-to-table functions: keys, upserts, insert-or-ignore, cascades, schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_key(df: DataFrame, key: str) -> DataFrame:
    """One row: the largest key plus one, 1 for an empty table."""
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long").alias("next_key"))


def assign_keys(records: DataFrame, order: str, first: int, key: str = "mol_id") -> DataFrame:
    """Keys first, first+1, ... by a numeric record order: counts of the parts between fixed bounds, then local numbers.

    The bounds (quantiles of the order) are literals of the plan, so both branches cut the rows alike however they run.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(records.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01))) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    cut = records.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return cut.withColumn("__n", local).join(F.broadcast(offsets), "__part").withColumn(key, F.col("__before") + F.col("__n") + (first - 1)).drop("__part", "__n", "__before")


def _one_of(new: DataFrame, keys: list[str], order: str | None, last: bool) -> DataFrame:
    """One row of each key: the first or last in order, any if none is given."""
    if order is None:
        return new.dropDuplicates(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order)))
    return new.withColumn("__r", rank).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows win, the last in order among those of one key; order must not be a column of the table."""
    fresh = _one_of(new, keys, order, True)
    return old.join(fresh, keys, "left_anti").unionByName(fresh.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows win, then the first in order."""
    return old.unionByName(_one_of(new, keys, order, False).join(old, keys, "left_anti").select(*old.columns))


def update_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns take the new value where there is one."""
    fresh = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return old.join(fresh, keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in old.columns))


def delete_batch(tables: dict[str, DataFrame], members: DataFrame, batch_id: int) -> dict[str, DataFrame]:
    """All tables without the molecules of a batch (also where another batch has them too), and membership without it."""
    gone = members.where(F.col("batch_id") == batch_id).select("mol_id").distinct()
    out = {name: df.join(gone, "mol_id", "left_anti") for name, df in tables.items()}
    return out | {"batchmols": members.where(F.col("batch_id") != batch_id)}


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A null column, unless one of that name (in any case) exists."""
    return df if name.lower() in {c.lower() for c in df.columns} else df.withColumn(name, F.lit(None).cast(kind))


def pending_pairs(left: DataFrame, right: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """All combinations that don't exist yet; right is a registry table, broadcast by Catalyst below its threshold."""
    return left.crossJoin(right).join(existing, keys, "left_anti")


def unique_names(df: DataFrame, name: str = "name", key: str = "mol_id", taken: DataFrame | None = None) -> DataFrame:
    """Later rows of a name, and all rows of one that ``taken`` holds, get _<key> appended."""
    later = F.row_number().over(Window.partitionBy(name).orderBy(key)) > 1
    if taken is not None:
        df = df.join(taken.select(F.col(name)).distinct().withColumn("__taken", F.lit(True)), name, "left").select(*df.columns, "__taken")
        later, df = later | F.coalesce("__taken", F.lit(False)), df
    return df.withColumn("__later", later).drop("__taken").withColumn(name, F.when(F.col("__later"), F.concat(name, F.lit("_"), F.col(key).cast("string"))).otherwise(F.col(name))).drop("__later")


def one_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key (null is a key like any other)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def missing_from(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows still to compute: restartable work lists."""
    return work.join(done, key, "left_anti")


def rekey(predictions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Predictions with the pred_id of mapping (old_id, pred_id) where there is one."""
    new = mapping.select(F.col("old_id").alias("pred_id"), F.col("pred_id").alias("__new"))
    return predictions.join(new, "pred_id", "left").withColumn("pred_id", F.coalesce("__new", "pred_id")).select(*predictions.columns)


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """A column of 1, 2, ... in order."""
    return assign_keys(df, order, 1, name)


def ordered_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types in order of the schema."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def check_mapping(columns: list[tuple[str, str]], mapping: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(column, fault) of a tag mapping: ``duplicate`` names (in any case), or a ``type`` other than the stored column's."""
    stored, seen, out = {n.lower(): k.lower() for n, k in columns}, set(), []
    for _, column, kind in mapping:
        name = column.lower()
        if name in seen:
            out.append((column, "duplicate"))
        seen.add(name)
        if stored.get(name, kind.lower()) != kind.lower():
            out.append((column, "type"))
    return out
