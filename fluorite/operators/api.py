"""The service's named queries as functions over a store: a mapping of table names to DataFrames.

Tables and the columns used: batchlist (batch_id, filename, username, mol_type, info, learn), batchmols (batch_id, mol_id),
molecules (mol_id, mol_name, inchi_key, smiles, inchi, murcko_id), fingerprints (mol_id, maccs), statistics (mol_id, n_...),
hashes (mol_id, hfp...), descriptors (mol_id, ...), class_models (model_id, batch_id, class_tag, data_type, class_scheme,
username, model_data), prediction_list (pred_id, model_id, batch_id, pred_name), prediction_mols (pred_id, mol_id, main_class,
lhood). Functions return DataFrames; those that change the store return the new tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.scalars import all_of, bounds_from, log_odds, matches
from . import store as K

Store = Mapping[str, DataFrame]


class NotFound(LookupError):
    """No row of that id."""


class TooManyHits(RuntimeError):
    """A search met more rows than it may return."""


def _filters(df: DataFrame, you: str | None = None, who: str | None = None, **equal) -> DataFrame:
    """Rows that satisfy the filters given; None leaves one out."""
    owner = matches(who, you or "") if who else None
    return df.where(all_of(owner, *(F.col(c) == v for c, v in equal.items() if v is not None)))


def by_id(df: DataFrame, key: str, value: int, must: bool = False) -> DataFrame:
    out = df.where(F.col(key) == value)
    if must and not out.head(1):
        raise NotFound(f"{key} {value}")
    return out


# ------------------------------------------------------------------------------------------------------- datasets
def list_datasets(s: Store, you: str | None = None, who: str | None = None, mol_type: str | None = None) -> DataFrame:
    return _filters(s["batchlist"], you, who, mol_type=mol_type)


def dataset(s: Store, batch_id: int, must: bool = False) -> DataFrame:
    return by_id(s["batchlist"], "batch_id", batch_id, must)


def dataset_compounds(s: Store, batch_id: int) -> DataFrame:
    return by_id(s["batchmols"], "batch_id", batch_id).join(s["molecules"], "mol_id").select("mol_id", "mol_name", "inchi_key")


def newest_batches(s: Store, limit: int | None = None) -> DataFrame:
    out = s["batchlist"].orderBy(F.desc("batch_id"))
    return out if limit is None else out.limit(limit)


def dataset_reviews(s: Store) -> DataFrame:
    """Learning batches with the number of their molecules and models, newest first."""
    n = s["batchmols"].groupBy("batch_id").agg(F.count("*").alias("n_mols"))
    m = s["class_models"].groupBy("batch_id").agg(F.count("*").alias("n_models"))
    out = s["batchlist"].where("learn = 1").join(n, "batch_id", "left").join(m, "batch_id", "left")
    return out.select("batch_id", "filename", F.coalesce("n_mols", F.lit(0)).alias("n_mols"), F.coalesce("n_models", F.lit(0)).alias("n_models")).orderBy(F.desc("batch_id"))


def delete_dataset(s: Store, batch_id: int, tables: tuple[str, ...] = ("molecules", "fingerprints", "statistics", "hashes", "prediction_mols")) -> dict[str, DataFrame]:
    out = K.delete_batch({t: s[t] for t in tables if t in s}, s["batchmols"], batch_id)
    return out | {"batchlist": s["batchlist"].where(F.col("batch_id") != batch_id)}


def learn_batches(s: Store) -> DataFrame:
    """Learning batches with the tags of their info text, split at blanks."""
    words = F.filter(F.split(F.trim("info"), r"\s+"), lambda x: x != "")
    return s["batchlist"].where("learn = 1").select("batch_id", "filename", F.explode_outer(words).alias("tag"))


def batch_detail(s: Store, batch_id: int) -> DataFrame:
    jobs = s["prediction_list"].join(s["class_models"].select("model_id", "class_tag"), "model_id").select("batch_id", "pred_id", "model_id", "class_tag", "pred_name")
    return by_id(s["batchlist"], "batch_id", batch_id).select("batch_id", "filename").join(jobs, "batch_id")


# ------------------------------------------------------------------------------------------------------ compounds
def compound_detail(s: Store, mol_id: int) -> DataFrame:
    """The molecule with its batches, statistics and descriptors; a name that occurs twice is kept once."""
    out = by_id(s["molecules"], "mol_id", mol_id).join(s["batchmols"], "mol_id", "left")
    for t in ("statistics", "descriptors"):
        if t in s:
            out = out.join(s[t].select("mol_id", *(c for c in s[t].columns if c not in out.columns)), "mol_id", "left")
    return out


def structure_fingerprint(s: Store, mol_id: int) -> DataFrame:
    """The molecule's fingerprint bits, one row each; none if it has none."""
    return by_id(s["molecules"], "mol_id", mol_id).join(s["fingerprints"], "mol_id", "left").select("mol_id", F.explode("maccs").alias("bit"))


def property_fingerprint(s: Store, mol_id: int) -> DataFrame:
    """Names and values of the molecule's statistics."""
    names = [c for c in s["statistics"].columns if c != "mol_id"]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")
    return by_id(s["molecules"], "mol_id", mol_id).join(s["statistics"], "mol_id", "left").select("mol_id", pairs).select("mol_id", "x.*")


def model_scores(s: Store, mol_id: int) -> DataFrame:
    """The molecule's score by each model, of its last job; one row per model (a map's entries)."""
    rows = by_id(s["prediction_mols"], "mol_id", mol_id).join(s["prediction_list"], "pred_id")
    last = rows.groupBy("mol_id", "model_id").agg(F.max_by("lhood", "pred_id").alias("lhood"))
    return last.select("mol_id", F.concat(F.lit("model_"), F.col("model_id").cast("string")).alias("model"), "lhood")


def compound_predictions(s: Store, mol_id: int) -> DataFrame:
    """One prediction per model: of its first job."""
    rows = by_id(s["prediction_mols"], "mol_id", mol_id).join(s["prediction_list"], "pred_id").join(s["class_models"].select("model_id", "class_tag"), "model_id", "left")
    first = Window.partitionBy("mol_id", "model_id").orderBy("pred_id")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("mol_id", "model_id", "class_tag", "pred_id", "main_class", "lhood")


def text_search(s: Store, query: str, limit: int = 50) -> DataFrame:
    """Molecules whose name, key, SMILES, InChI or a batch's file name holds the text, in any case; % and _ stay wildcards."""
    rows = s["molecules"].join(s["batchmols"], "mol_id", "left").join(s["batchlist"].select("batch_id", "filename"), "batch_id", "left")
    any_of = F.lit(False)
    for c in ("mol_name", "inchi_key", "smiles", "inchi", "filename"):
        any_of = any_of | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return rows.where(any_of).select("mol_id", "mol_name", "filename").distinct().orderBy("mol_id", "filename").limit(limit)


def same_scaffold(s: Store, mol_id: int) -> DataFrame:
    """All molecules of the molecule's scaffold, itself included."""
    own = by_id(s["molecules"], "mol_id", mol_id).select("murcko_id")
    return s["molecules"].join(F.broadcast(own), "murcko_id").select("mol_id", "mol_name", "murcko_id")


def hit_list(s: Store, ids: list[int] | DataFrame) -> DataFrame:
    """Molecules of a set of ids (or of the mol_id2 of similarity edges), one row per key: the smallest id."""
    rows = s["molecules"].where(F.col("mol_id").isin(ids)) if isinstance(ids, list) else s["molecules"].join(ids.select(F.col("mol_id2").alias("mol_id")).distinct(), "mol_id", "left_semi")
    return K.one_per_key(rows, "inchi_key", "mol_id").select("mol_id", "mol_name", "inchi_key")


def molecule_detail(s: Store, mol_id: int, models: list[int] | None = None) -> DataFrame:
    """All predictions of a molecule, of some models if given, with job and batch; a right-deep join."""
    jobs = s["prediction_list"].join(s["class_models"].select("model_id", "class_tag"), "model_id")
    jobs = jobs if models is None else jobs.where(F.col("model_id").isin(models))
    right = s["prediction_mols"].join(jobs, "pred_id")
    return by_id(s["molecules"], "mol_id", mol_id).join(right, "mol_id").select("mol_id", "mol_name", "pred_id", "model_id", "class_tag", F.ceil("batch_id").alias("batch_id"), "main_class", "lhood")


# --------------------------------------------------------------------------------------------------------- models
def list_models(s: Store, you: str | None = None, who: str | None = None, class_scheme: str | None = None, data_type: str | None = None) -> DataFrame:
    rows = s["class_models"].join(s["batchlist"].select("batch_id", "filename"), "batch_id", "left")
    return _filters(rows, you, who, class_scheme=class_scheme, data_type=data_type).select("model_id", "batch_id", "filename", "class_tag", "data_type", "class_scheme", "username")


def model(s: Store, model_id: int, must: bool = False) -> DataFrame:
    return by_id(s["class_models"], "model_id", model_id, must)


def newest_models(s: Store, limit: int = 100) -> DataFrame:
    built = F.when(F.col("model_data").isNull(), 0).otherwise(1).alias("is_built")
    return s["class_models"].orderBy(F.desc("model_id")).limit(limit).select("model_id", "class_tag", built)


def model_exists(s: Store, batch_id: int, class_tag: str, data_type: str, class_scheme: str) -> DataFrame:
    return _filters(s["class_models"], batch_id=batch_id, class_tag=class_tag, data_type=data_type, class_scheme=class_scheme).select("model_id")


def create_model(s: Store, batch_id: int, class_tag: str, data_type: str, class_scheme: str, username: str) -> DataFrame:
    """class_models with a pending row of the next key, or unchanged if a model of these four exists."""
    table = s["class_models"]
    spec = {"batch_id": batch_id, "class_tag": class_tag, "data_type": data_type, "class_scheme": class_scheme}
    known = model_exists(s, **spec).limit(1)
    row = K.next_key(table, "model_id").select(F.col("next_key").alias("model_id"), *(F.lit(v).alias(k) for k, v in spec.items()), F.lit(username).alias("username"), F.lit(None).cast("string").alias("model_data"))
    return table.select(*row.columns).unionByName(row.join(known.select(F.lit(1).alias("known")), F.lit(True), "left_anti"))


def queue_model(s: Store) -> DataFrame:
    """The queue: models without data, oldest first."""
    return s["class_models"].where("model_data is null").orderBy("model_id").select("model_id", "batch_id", "class_tag")


def validate_tag(df: DataFrame, tag: str) -> str:
    """The tag, if it is a plain column name of the table; otherwise ValueError."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9_]+", tag) or tag not in df.columns:
        raise ValueError(f"no class tag {tag!r}")
    return tag


def model_detail(s: Store, model_id: int) -> DataFrame:
    """The model with its learning batch, and its jobs."""
    rows = by_id(s["class_models"], "model_id", model_id).join(s["batchlist"].select("batch_id", "filename"), "batch_id")
    jobs = s["prediction_list"].select("model_id", "pred_id", F.col("batch_id").alias("pred_batch"))
    return rows.join(jobs, "model_id").select("model_id", "class_tag", "filename", "pred_id", "pred_batch")


# ---------------------------------------------------------------------------------------------------- predictions
def dataset_predictions(s: Store, batch_id: int) -> DataFrame:
    return by_id(s["prediction_list"], "batch_id", batch_id).join(s["class_models"].select("model_id", "class_tag"), "model_id").select("pred_id", "model_id", "class_tag", "pred_name")


def model_batches(s: Store, model_id: int) -> DataFrame:
    return by_id(s["prediction_list"], "model_id", model_id).join(s["batchlist"].select("batch_id", "filename"), "batch_id").select("pred_id", "batch_id", "filename")


def job(s: Store, pred_id: int, must: bool = False) -> DataFrame:
    rows = by_id(s["prediction_list"], "pred_id", pred_id, must).join(s["batchlist"].select("batch_id", "filename"), "batch_id")
    return rows.join(s["class_models"].select("model_id", "class_tag"), "model_id").select("pred_id", "batch_id", "filename", "model_id", "class_tag")


def results(s: Store, pred_id: int) -> DataFrame:
    """Results per compound: four tables joined by their keys."""
    rows = by_id(s["prediction_mols"], "pred_id", pred_id).join(s["prediction_list"], "pred_id").join(s["class_models"].select("model_id", "class_tag"), "model_id")
    return rows.join(s["molecules"], "mol_id").select("pred_id", "mol_id", "mol_name", "class_tag", "main_class", "lhood")


def latest_results(s: Store, model_id: int) -> DataFrame:
    """The results of a model's last job, likeliest first."""
    last = by_id(s["prediction_list"], "model_id", model_id).orderBy(F.desc("pred_id")).limit(1).select("pred_id")
    return s["prediction_mols"].join(F.broadcast(last), "pred_id").orderBy(F.desc("lhood"), "mol_id").select("pred_id", "mol_id", "main_class", "lhood")


def jobs_for_all_models(s: Store, batch_id: int) -> DataFrame:
    """A job of the batch for each built model: the one there is, or one with the next keys."""
    models = s["class_models"].where("model_data is not null").select("model_id", F.lit(batch_id).cast("long").alias("batch_id"))
    known = by_id(s["prediction_list"], "batch_id", batch_id).groupBy("model_id", "batch_id").agg(F.min("pred_id").alias("pred_id"))
    rows = models.join(known, ["model_id", "batch_id"], "left")
    first = s["prediction_list"].agg(F.coalesce(F.max("pred_id"), F.lit(0)).alias("top"))
    number = F.row_number().over(Window.partitionBy(F.col("pred_id").isNull()).orderBy("model_id"))  # a registry's rows
    rows = rows.withColumn("n", number).crossJoin(F.broadcast(first))
    return rows.select("model_id", "batch_id", F.coalesce("pred_id", F.col("top") + F.col("n")).alias("pred_id"), F.col("pred_id").isNull().alias("is_new"))


def export_batch(s: Store, batch_id: int) -> DataFrame:
    """All predictions of a batch's jobs, flat, for a spreadsheet."""
    jobs = by_id(s["prediction_list"], "batch_id", batch_id).join(s["class_models"].select("model_id", "class_tag"), "model_id")
    return s["prediction_mols"].join(jobs, "pred_id").join(s["molecules"], "mol_id").select("mol_id", "mol_name", "inchi_key", "pred_id", "class_tag", "main_class", F.round("lhood", 6).alias("lhood"))


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def likelihoods(s: Store, model_id: int, offset: float = 0.001) -> DataFrame:
    """main_class and log odds of each likelihood of a model that is known."""
    rows = by_id(s["prediction_list"], "model_id", model_id).select("pred_id").distinct()
    return s["prediction_mols"].join(rows, "pred_id", "left_semi").where("lhood is not null").select("mol_id", "main_class", log_odds(F.col("lhood"), offset).alias("logit"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 50, by: str | None = None) -> DataFrame:
    """Counts per bin of equal width from low to high (the last one closed), per group if asked for."""
    bin_ = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int").alias("bin")
    return df.where(F.col(value).between(low, high)).groupBy(*([by] if by else []), bin_).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, at: list[float], width: float, by: str) -> DataFrame:
    """Gaussian kernel density of each group at some points: one aggregation, each row adds to all points."""
    points = F.explode(F.array(*map(F.lit, at))).alias("x")
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), points)
    kernel = F.exp(-F.pow((F.col("x") - F.col("v")) / width, 2) / 2) / (width * 2.5066282746310002)
    return rows.groupBy(by, "x").agg(F.avg(kernel).alias("density"))


# --------------------------------------------------------------------------------------------------------- search
def screen(s: Store, bounds: str, words: Mapping[str, int], exact: set[str] = frozenset(), most: int | None = None) -> DataFrame:
    """Candidates of a substructure search: statistics no smaller than the query's, and all its hash bits; TooManyHits beyond ``most``."""
    held = B.words_contain([F.col(c) for c in words], list(words.values()))
    out = s["statistics"].join(s["hashes"], "mol_id").where(bounds_from(bounds, exact) & held).select("mol_id")
    if most is not None and out.limit(most + 1).count() > most:
        raise TooManyHits(f"more than {most} candidates")
    return out


def dictionary_hits(s: Store, entry: Mapping[str, int], exact: bool = False, strict: bool = False) -> DataFrame | None:
    """The answer of a query that is an entry of the dictionary: the molecules with its bit; None if it must be verified."""
    if exact or strict or not entry:
        return None
    return s["hashes"].where(B.words_contain([F.col(c) for c in entry], list(entry.values()))).select("mol_id")


def enough_atoms(n_atoms: int, least: int = 3) -> bool:
    """Whether a query structure is large enough to be searched for."""
    return n_atoms >= least


def find_duplicates(statistics: DataFrame, hashes: DataFrame, query: DataFrame) -> DataFrame:
    """(query_id, mol_id) of molecules equal to a query molecule in all statistics and all hash words; nulls are equal."""
    whole = statistics.join(hashes, "mol_id")
    names = [c for c in whole.columns if c != "mol_id"]
    same: Column = F.lit(True)
    for c in names:
        same = same & whole[c].eqNullSafe(F.col(f"q_{c}"))
    asked = query.select(F.col("mol_id").alias("query_id"), *(F.col(c).alias(f"q_{c}") for c in names))
    return whole.join(asked, same & (F.col("mol_id") != F.col("query_id"))).select("query_id", "mol_id")


def access_allowed(df: DataFrame, user: str) -> DataFrame:
    """One row: how many entries give the user access."""
    return df.where((F.col("username") == user) & (F.col("access") > 0)).agg(F.count("*").alias("n"))
