"""Training tables by data type, alignment to a model's header, saved models, and stored predictions.

One function builds all eleven data types. Fingerprints stay sparse: one array of on-bits, numbered across the fingerprints
of the data type; only bits that vary become columns.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import learning as L

#: Fingerprints and their widths, and whether descriptors belong to it, of each data type.
DATA_TYPES = {
    "CDK": ({}, True),
    "MACCS": ({"maccs": 200}, False),
    "SUB": ({"sub": 310}, False),
    "GO": ({"go": 1110}, False),
    "KR": ({"kr": 5100}, False),
    "PubChem": ({"pubchem": 1000}, False),
    "EXT": ({"ext": 1100}, False),
    "EXTGO": ({"ext": 1100, "go": 1100}, False),
    "ALL": ({"maccs": 200, "pubchem": 1000, "ext": 1100, "sub": 310}, True),
    "JUMBO": ({"maccs": 200, "pubchem": 1000, "ext": 1100, "sub": 310, "kr": 5110}, True),
    "MCAT": ({"maccs": 200, "pubchem": 1000, "estate": 100, "sub": 310, "kr": 5110}, True),
}
#: Data types whose training rows must have a weight other than 0.
_WEIGHED = {"ALL", "JUMBO", "MCAT"}


def _shifted(bits: Column, width: int, shift: int) -> Column:
    return F.transform(F.filter(bits, lambda b: b < width), lambda b: b + shift)


def featurize(members: DataFrame, data_type: str, fingerprints: DataFrame | None = None, descriptors: DataFrame | None = None, labels: DataFrame | None = None, weight: str = "mw", numeric_label: bool = False) -> DataFrame:
    """mol_id, label (in training), bits (numbered across the fingerprints), and the descriptors, of the molecules of members.

    Training (labels: mol_id, label): rows with a blank or null label go, of numeric ones also 0; descriptors must have a
    weight, in some data types other than 0. A molecule without a fingerprint goes; so does one without descriptors.
    """
    if data_type not in DATA_TYPES:
        raise ValueError(f"no data type {data_type!r}")
    widths, described = DATA_TYPES[data_type]
    out, columns = members.select("mol_id"), ["mol_id"]
    if labels is not None:
        kept = F.col("label").isNotNull() & (F.trim(F.col("label").cast("string")) != "")
        kept = kept & (F.col("label").try_cast("double") != 0) if numeric_label else kept
        out, columns = out.join(labels.where(kept).select("mol_id", F.col("label").cast("string").alias("label")), "mol_id"), [*columns, "label"]
    if widths:
        missing = fingerprints.where(" and ".join(f"{k} is not null" for k in widths)).select("mol_id", *widths)
        shift, parts = 0, []
        for kind, width in widths.items():
            parts.append(_shifted(F.col(kind), width, shift))
            shift += width
        out, columns = out.join(missing, "mol_id").withColumn("bits", F.concat(*parts)), [*columns, "bits"]
    if described:
        rows = descriptors.where(F.col(weight).isNotNull())
        rows = rows.where(F.col(weight) != 0) if labels is not None and data_type in _WEIGHED else rows
        names = [c for c in descriptors.columns if c != "mol_id"]
        out, columns = out.join(rows, "mol_id"), [*columns, *names]
    return out.select(*columns)


def width(data_type: str) -> int:
    return sum(DATA_TYPES[data_type][0].values())


def varying_bits(rows: DataFrame) -> DataFrame:
    """bit, n of the bits that some rows have and others lack; bits all rows have are constants."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), F.col("n") < F.col("total")).select("bit", "n")


def as_columns(rows: DataFrame, bits: list[int]) -> DataFrame:
    """Columns bit_<n> of 0 and 1 for the bits listed, in place of the array."""
    return rows.select(*(c for c in rows.columns if c != "bits"), *(F.array_contains("bits", b).cast("double").alias(f"bit_{b}") for b in bits))


def as_nominal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as their texts, for schemes that take classes of values."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def align(df: DataFrame, header: dict[str, str | list[str]], keep: list[str] = ("mol_id",)) -> DataFrame:
    """The columns of a header, by name: absent ones are null, and so are values no number or no label of the header."""
    out = []
    for name, kind in header.items():
        if name not in df.columns:
            out.append(F.lit(None).cast("string" if isinstance(kind, list) else kind).alias(name))
        elif isinstance(kind, list):
            out.append(F.when(F.col(name).cast("string").isin(kind), F.col(name).cast("string")).alias(name))
        else:
            out.append(F.col(name).try_cast(kind).alias(name))
    return df.select(*keep, *out)


# ---------------------------------------------------------------------------------------------------- saved models
def save_bayes(df: DataFrame, features: list[str], path: str, model_id: int, version: int = 2) -> None:
    """A naive Bayes model as its statistics, its header and class list, under version and id."""
    target = f"{path}/v{version}/model_{model_id}"
    L.bayes_statistics(df, features).write.mode("overwrite").parquet(f"{target}/statistics")
    header = json.dumps({"scheme": "NaiveBayes", "features": features, "labels": L.classes(df)})
    df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/header")


def load_bayes(spark: SparkSession, path: str, model_id: int, version: int = 2) -> tuple[L.Model, dict[str, str]]:
    """The model and its header; a model of another version is not found."""
    target = f"{path}/v{version}/model_{model_id}"
    about = json.loads(spark.read.text(f"{target}/header").first().value)
    rows = spark.read.parquet(f"{target}/statistics").collect()  # a row per class
    names, features = about["labels"], about["features"]
    score = lambda d: d.withColumn("distribution", L._softmax(L._bayes_from(rows, names, features)))
    return L.Model(names, score), dict.fromkeys(features, "double")


def predict(model: L.Model, rows: DataFrame, header: dict[str, str], certainty: DataFrame | None = None, key: str = "mol_id") -> DataFrame:
    """key, predicted, distribution, strength, log odds of the first class, and certainty where it is given by key."""
    aligned = align(rows, header, [key])
    out = model.predict(aligned, [key]).withColumn("lhood", X.log_odds(F.element_at("distribution", 1)))
    return out if certainty is None else out.join(certainty, key, "left")


def printout(predictions: DataFrame, names: list[str], key: str = "mol_id") -> DataFrame:
    """One row: the report of a job, a header and a line for each row, in order of key.

    The lines are put together in parts of 100,000, so no task holds more text than that and the driver none.
    """
    title = X.report_line(F.lit(key), F.lit("main_class"), F.lit("*"), F.lit("\t".join(names)))
    spread = X.render_distribution(F.col("distribution"))
    lines = predictions.select(F.col(key).alias("k"), X.report_line(F.col(key), F.col("predicted"), F.lit("*"), spread).alias("line"))
    part = F.floor((F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("k")) - 1) / 100_000)
    parts = lines.repartitionByRange("k").withColumn("p", F.spark_partition_id()).withColumn("b", part).groupBy("p", "b")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return parts.agg(F.min("k").alias("first"), text.alias("printout")).withColumn("printout", F.concat(title, F.lit("\n"), "printout")).select("first", "printout")
