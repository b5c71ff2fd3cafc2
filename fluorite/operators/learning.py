"""Learning on DataFrames: attribute filters, class balancing, classifiers, cross-validation and reports.

A data set has a key column ``id``, a string column ``label`` and double feature columns. Everything kept on the driver is
a model: its size depends on features, classes and trees, never on rows. Classes are in ascending order of their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import Index

#: Training rows the ReliefF search broadcasts at once; a larger training set is searched block by block.
NEIGHBOUR_BLOCK = 20_000
#: Values of training rows that an index of neighbours holds.
INDEX_VALUES = 1_000_000


# ------------------------------------------------------------------------------------------------ attribute filters
def remove_useless(df: DataFrame, numeric: list[str], nominal: list[str] = (), most: float = 99.0) -> list[str]:
    """Columns that are not constant; nominal ones also go if more than ``most`` per cent of their values are distinct."""
    if not [*numeric, *nominal]:
        return []
    ends = [f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate([*numeric, *nominal]) for k, f in (("a", F.min), ("b", F.max))]
    counts = [x for i, c in enumerate(nominal) for x in (F.count_distinct(c).alias(f"d{i}"), F.count(c).alias(f"n{i}"))]
    r = df.agg(*ends, *counts).first()
    varied = [c for i, c in enumerate([*numeric, *nominal]) if r[f"a{i}"] != r[f"b{i}"]]
    unique = {c for i, c in enumerate(nominal) if r[f"n{i}"] and 100.0 * r[f"d{i}"] / r[f"n{i}"] > most}
    return [c for c in varied if c not in unique]


def classes(df: DataFrame, label: str = "label") -> list[str]:
    return [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def select_by_correlation(df: DataFrame, features: list[str], label: str = "label") -> list[str]:
    """Correlation-based subset by greedy forward steps: features tied to the class and not to each other.

    One pass gives all correlations (a matrix of features and class indicators); the search runs on that matrix.
    """
    names = classes(df, label)
    shown = df.select(*(F.col(c).cast("double") for c in features), *((F.col(label) == v).cast("double").alias(f"__c{i}") for i, v in enumerate(names)))
    columns = [*features, *(f"__c{i}" for i in range(len(names)))]
    m = np.nan_to_num(np.abs(Correlation.corr(VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(shown), "v").first()[0].toArray()))
    share = [r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()]
    d = len(features)
    to_class = m[:d, d:] @ (np.array(share) / max(sum(share), 1))

    def merit(s: list[int]) -> float:
        inner = m[np.ix_(s, s)].sum() - sum(m[i, i] for i in s)
        return float(to_class[s].sum() / math.sqrt(len(s) + inner))

    chosen: list[int] = []
    best = 0.0
    while len(chosen) < d:
        score, i = max((merit([*chosen, i]), -i) for i in range(d) if i not in chosen)
        if score <= best + 1e-12:
            break
        best = score
        chosen.append(-i)
    return [features[i] for i in sorted(chosen)]


def _nearest_by_label(x: DataFrame, features: list[str], k: int, power: int) -> DataFrame:
    """i, own (label), v, t, away, mine, other: for each row i of x and each label v, the k nearest other rows t (distance, then i).

    x has a number ``__i`` of each row, ``label`` and features without nulls. All rows meet all rows, NEIGHBOUR_BLOCK at
    a time; each block's k best are kept before blocks meet.
    """
    blocks = max(1, -(-x.count() // NEIGHBOUR_BLOCK))

    def against(block: pd.DataFrame):
        values, keys = block[features].to_numpy(float), block["__i"].to_numpy()
        groups = {v: np.flatnonzero((block["label"] == v).to_numpy()) for v in sorted(block["label"].unique())}

        def best(row: np.ndarray, i: int, own: str) -> list[tuple]:
            away = (np.abs(values - row) ** power).sum(axis=1)
            out = []
            for v, at in groups.items():
                at = at[keys[at] != i]
                if len(at) > 4 * k:
                    at = at[away[at] <= np.partition(away[at], k - 1)[k - 1]]
                out += [(i, own, v, keys[j], away[j], row, values[j]) for j in at[np.lexsort((keys[at], away[at]))[:k]]]
            return out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for start in range(0, len(whole), 500):
                    b = whole.iloc[start : start + 500]
                    rows = [r for row, i, own in zip(b[features].to_numpy(float), b["__i"], b["label"]) for r in best(row, i, own)]
                    yield pd.DataFrame(rows, columns=["i", "own", "v", "t", "away", "mine", "other"])

        return run

    part = lambda n: x.where(F.pmod(F.xxhash64("__i"), F.lit(blocks)) == n).toPandas()
    found = reduce(DataFrame.unionByName, (x.mapInPandas(against(part(n)), "i long, own string, v string, t long, away double, mine array<double>, other array<double>") for n in range(blocks)))
    rank = F.row_number().over(Window.partitionBy("i", "v").orderBy("away", "t"))
    return found if blocks == 1 else found.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def relief_weights(df: DataFrame, features: list[str], label: str = "label", key: str = "id", k: int = 10) -> dict[str, float]:
    """ReliefF weights: how much further the nearest rows of other classes lie in a feature than those of the own class.

    Every labelled row is an instance and is compared with all rows.
    """
    r = df.agg(*(f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max)))).first()
    scaled = [((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - (r[f"a{i}"] or 0.0)) / ((r[f"b{i}"] or 0.0) - (r[f"a{i}"] or 0.0) or 1.0)).alias(c) for i, c in enumerate(features)]
    clean = df.where(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("__i"), F.col(label).alias("label"), *scaled).persist()  # numbered once: keys may be null
    share = {x["label"]: x["n"] for x in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    gaps = F.zip_with("mine", "other", lambda a, b: F.abs(a - b))
    near = _nearest_by_label(clean, features, k, 1).withColumn("gaps", gaps)
    means = near.groupBy("i", "own", "v").agg(*(F.avg(F.get("gaps", F.lit(j))).alias(f"g{j}") for j in range(len(features))))
    weights = np.zeros(len(features))
    for x in means.groupBy("own", "v").agg(*(F.sum(f"g{j}").alias(f"g{j}") for j in range(len(features)))).collect():  # at most classes * classes
        factor = -1.0 if x["v"] == x["own"] else share[x["v"]] / max(total - share[x["own"]], 1)
        weights += factor * np.array([x[f"g{j}"] for j in range(len(features))]) / max(total, 1)
    clean.unpersist()
    return dict(zip(features, map(float, weights)))


# -------------------------------------------------------------------------------------------------- class balancing
def spread_subsample(df: DataFrame, key: str = "id", label: str = "label", most: float = 5.0, seed: int = 1) -> DataFrame:
    """At most ``most`` times the smallest class's rows of each class, exactly, chosen by a hash of the key.

    Counts of 4096 hash ranges tell where a class's limit falls; only rows of that one range are ranked.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__g", F.shiftright("__h", 52))
    counts = hashed.groupBy(F.col(label), "__g").agg(F.count("*").alias("__n"))
    sizes = counts.groupBy(label).agg(F.sum("__n").alias("n"))
    least = sizes.where(F.col(label).isNotNull()).agg(F.min("n").alias("least"))
    run = F.sum("__n").over(Window.partitionBy(label).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1))
    room = counts.withColumn("__before", F.coalesce(run, F.lit(0))).crossJoin(least).select(F.col(label).alias("__l"), F.col("__g").alias("__gg"), "__n", (F.floor(F.col("least") * most) - F.col("__before")).alias("__room"))
    joined = hashed.join(F.broadcast(room.where("__room > 0")), (F.col(label) == F.col("__l")) & (F.col("__g") == F.col("__gg")))  # 4096 rows a class
    edge = joined.where("__n > __room").withColumn("__r", F.row_number().over(Window.partitionBy(label, "__g").orderBy("__h", key))).where("__r <= __room").drop("__r")
    return joined.where("__n <= __room").unionByName(edge).select(*df.columns)


def smote(df: DataFrame, features: list[str], key: str = "id", label: str = "label", k: int = 5, percent: int = 100, seed: int = 1) -> DataFrame:
    """df and ``percent`` per cent more rows of the smallest class, each between a row and one of its k nearest of that class.

    New rows have a null key. Neighbours come from the whole class, and new rows depend on the rows' keys and values only.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy("n", label).first()
    if sizes is None:
        return df
    small = df.where(F.col(label) == sizes[label]).select(key, F.col(label).alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    r = small.agg(*(f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max)))).first()
    low, span = (np.array([r[f"a{i}"] for i in range(len(features))], float), np.array([r[f"b{i}"] - r[f"a{i}"] or 1.0 for i in range(len(features))], float))
    scaled = [((F.col(c) - float(low[i])) / float(span[i])).alias(c) for i, c in enumerate(features)]
    # rows of equal key and values are numbered one after the other, so that none counts as its own neighbour
    same = F.row_number().over(Window.partitionBy("__h").orderBy("__h")) - 1
    numbered = small.withColumn("__h", F.xxhash64(key, *features)).withColumn("__i", F.col("__h") + same).select("__i", "label", *scaled).persist()

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for i, row, near in zip(b["i"], b["mine"], b["near"]):
                rng = np.random.default_rng([seed, i & (2**64 - 1)])
                for _ in range(percent // 100 + (rng.random() * 100 < percent % 100)):
                    made.append(low + span * (row + rng.random(len(features)) * (np.asarray(near[rng.integers(len(near))], float) - row)))
            yield pd.DataFrame(np.array(made).reshape(-1, len(features)), columns=features).assign(**{label: sizes[label]})[[label, *features]]

    schema = f"`{label}` string, " + ", ".join(f"`{c}` double" for c in features)
    found = _nearest_by_label(numbered, features, k, 2).groupBy("i").agg(F.first("mine").alias("mine"), F.sort_array(F.collect_list(F.struct("away", "t", "other"))).alias("near"))
    new = found.select("i", "mine", F.transform("near", lambda x: x["other"]).alias("near")).mapInPandas(grow, schema)
    return df.unionByName(new, allowMissingColumns=True)


# ------------------------------------------------------------------------------------------------------ classifiers
@dataclass
class Model:
    """``score`` adds a column ``distribution`` (array of class probabilities in the order of ``names``)."""

    names: list[str]
    score: Callable[[DataFrame], DataFrame]

    def predict(self, df: DataFrame, keep: list[str] = ("id",)) -> DataFrame:
        """keep, predicted class, distribution and strength (the predicted class's probability); ties go to the first class."""
        strength = F.array_max("distribution")
        chosen = F.get(F.array(*map(F.lit, self.names)), (F.array_position("distribution", strength) - 1).cast("int"))
        return self.score(df).select(*keep, chosen.alias("predicted"), "distribution", strength.alias("strength"))


def _normalised(parts: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, parts)
    return F.array(*(F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(parts))) for p in parts))


def _assembled(df: DataFrame, features: list[str], out: str = "__v") -> DataFrame:
    filled = df.withColumns({f"__f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol=out).transform(filled).drop(*(f"__f{i}" for i in range(len(features))))


def _spark_model(kind: type, **options) -> Callable:
    """A fit function of a spark.ml classifier that handles several classes; it is made when there is a session."""

    def fit(df: DataFrame, features: list[str]) -> Model:
        clean = df.where(F.col("label").isNotNull())
        m = Pipeline(stages=[StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc"), kind(featuresCol="__v", labelCol="__y", **options)]).fit(_assembled(clean, features))
        names, tree = list(m.stages[0].labels), m.stages[1]
        return Model(names, lambda d: tree.transform(_assembled(d, features)).withColumn("distribution", vector_to_array("probability")).drop("__v", "rawPrediction", "probability", "prediction"))

    return fit


def _one_against_rest(binary: Callable[[DataFrame, list[str]], Callable[[DataFrame, str], DataFrame]]) -> Callable:
    """A fit function of a two-class method: one model per class, probabilities normalised; two classes need only one."""

    def fit(df: DataFrame, features: list[str]) -> Model:
        names, clean = classes(df), df.where(F.col("label").isNotNull())
        asked = names[1:] if len(names) == 2 else names
        if len(names) < 2:
            return Model(names, lambda d: d.withColumn("distribution", F.array(*(F.lit(1.0) for _ in names))))
        models = [binary(clean.withColumn("__y", (F.col("label") == v).cast("double")), features) for v in asked]

        def score(d: DataFrame) -> DataFrame:
            for i, m in enumerate(models):
                d = m(d, f"__p{i}")
            parts = [F.col(f"__p{i}") for i in range(len(models))]
            parts = [1 - parts[0], parts[0]] if len(names) == 2 else parts
            return d.withColumn("distribution", _normalised(parts)).drop(*(f"__p{i}" for i in range(len(models))))

        return Model(names, score)

    return fit


def _binary_ml(kind: type, **options):
    def fit(df: DataFrame, features: list[str]):
        m = kind(featuresCol="__v", labelCol="__y", **options).fit(_assembled(df, features))
        return lambda d, out: m.transform(_assembled(d, features)).withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop("__v", "rawPrediction", "probability", "prediction")

    return fit


def _support_vectors(cost: float | None, kernel: int = 0, costs: tuple = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0)):
    """Linear separation of scaled features, or of ``kernel`` random Fourier features of them, with logistic calibration.

    Without a cost, the one with the best accuracy on a third of the rows (by hash) is taken.
    """

    def fit(df: DataFrame, features: list[str]):
        scaler = MinMaxScaler(inputCol="__v", outputCol="__s").fit(_assembled(df, features))
        rng = np.random.default_rng(1)
        w, b = rng.normal(0, math.sqrt(2.0 / len(features)), (len(features), kernel)), rng.uniform(0, 2 * math.pi, kernel)

        def shown(d: DataFrame) -> DataFrame:
            d = scaler.transform(_assembled(d, features)).drop("__v")
            if not kernel:
                return d.withColumnRenamed("__s", "__v")
            rows = F.array(*(F.struct(F.array(*map(F.lit, w[:, j].tolist())).alias("w"), F.lit(float(b[j])).alias("b")) for j in range(kernel)))
            dot = lambda r: F.aggregate(F.zip_with("__x", r["w"], lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
            d = d.withColumn("__x", vector_to_array("__s"))
            return d.withColumn("__v", array_to_vector(F.transform(rows, lambda r: F.cos(dot(r) + r["b"])))).drop("__s", "__x")

        size = df.count()
        train = lambda d, c: LinearSVC(featuresCol="__v", labelCol="__y", rawPredictionCol="__m", predictionCol="__q", regParam=1.0 / (c * max(size, 1)), maxIter=20).fit(d)
        best = cost
        if best is None:
            part = F.pmod(F.xxhash64(*features), F.lit(3)) == 0
            right = lambda c: train(shown(df.where(~part)), c).transform(shown(df.where(part))).agg(F.avg((F.col("__q") == F.col("__y")).cast("double"))).first()[0] or 0.0
            best = max((right(c), -c) for c in costs)[1] * -1
        m = train(shown(df), best)
        margin = lambda d: VectorAssembler(inputCols=["__d"], outputCol="__w").transform(m.transform(shown(d)).withColumn("__d", F.get(vector_to_array("__m"), F.lit(1))))
        platt = LogisticRegression(featuresCol="__w", labelCol="__y", probabilityCol="__r", rawPredictionCol="__rr", predictionCol="__rp", regParam=1e-3, maxIter=20).fit(margin(df))
        return lambda d, out: platt.transform(margin(d)).withColumn(out, F.get(vector_to_array("__r"), F.lit(1))).drop("__v", "__m", "__q", "__d", "__w", "__r", "__rr", "__rp")

    return fit


def _real_boosting(rounds: int = 10):
    """Real AdaBoost on stumps: each adds half the log-odds of its leaf, and rows are weighted by what is still wrong."""

    def fit(df: DataFrame, features: list[str]):
        models = []

        def add(d: DataFrame, m) -> DataFrame:
            p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.get(vector_to_array("probability"), F.lit(1))))
            return m.transform(d).withColumn("__f", F.col("__f") + 0.5 * F.log(p / (1 - p))).drop("rawPrediction", "probability", "prediction")

        d = _assembled(df, features).withColumn("__f", F.lit(0.0))
        for _ in range(rounds):
            weighted = d.withColumn("__w", F.exp(-(2 * F.col("__y") - 1) * F.col("__f")))
            models.append(DecisionTreeClassifier(featuresCol="__v", labelCol="__y", weightCol="__w", maxDepth=1).fit(weighted))
            d = add(d, models[-1])
        return lambda x, out: reduce(add, models, _assembled(x, features).withColumn("__f", F.lit(0.0))).withColumn(out, 1 / (1 + F.exp(-2 * F.col("__f")))).drop("__v", "__f")

    return fit


def _committee(chunks: int = 4):
    """Boosted committees of disjoint chunks of rows (by hash); their mean counts."""

    def fit(df: DataFrame, features: list[str]):
        part = lambda i: df.where(F.pmod(F.xxhash64(*features), F.lit(chunks)) == i)
        usable = [i for i in range(chunks) if part(i).select("__y").distinct().count() == 2] or [None]
        models = [_binary_ml(GBTClassifier, maxDepth=1, maxIter=10, seed=1)(df if i is None else part(i), features) for i in usable]

        def score(d: DataFrame, out: str) -> DataFrame:
            for i, m in enumerate(models):
                d = m(d, f"__k{i}")
            return d.withColumn(out, reduce(lambda a, b: a + b, (F.col(f"__k{i}") for i in range(len(models)))) / len(models)).drop(*(f"__k{i}" for i in range(len(models))))

        return score

    return fit


def bayes_statistics(df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """n, and mean and deviation of each feature, by label (and ``by``): at most classes (times groups) rows."""
    stats = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    return df.where(F.col("label").isNotNull()).groupBy(*by, "label").agg(F.count("*").alias("n"), *stats)


def _bayes_from(rows, names: list[str], features: list[str], least: float = 1e-3) -> list[Column]:
    """Unnormalised log-probabilities of all classes from collected statistics; absent features say nothing."""
    total = sum(r["n"] for r in rows)
    found = {r["label"]: r for r in rows}
    out = []
    for v in names:
        r = found.get(v)
        part = F.lit(math.log(((r["n"] if r else 0) + 1) / (total + len(names))))
        for i, c in enumerate(features if r else []):
            if r[f"m{i}"] is not None:
                s = max(r[f"s{i}"] or 0.0, least)
                part = part + F.coalesce(-F.pow((F.col(c).cast("double") - r[f"m{i}"]) / s, 2) / 2 - math.log(s), F.lit(0.0))
        out.append(part)
    return out


def _softmax(logs: list[Column]) -> Column:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return _normalised([F.exp(x - top) for x in logs])


def naive_bayes(df: DataFrame, features: list[str]) -> Model:
    """Normal densities per class and feature, priors with one added; one aggregation, scoring by built-in functions."""
    names, rows = classes(df), bayes_statistics(df, features).collect()
    return Model(names, lambda d: d.withColumn("distribution", _softmax(_bayes_from(rows, names, features))))


#: Numbers a model of pairs of values may hold; more must be reduced by attribute selection first.
PAIR_CELLS = 10_000_000


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def decile_cuts(df: DataFrame, features: list[str], bins: int = 10) -> list[list[float]]:
    """The distinct inner quantiles of each feature over all rows, below its maximum; a value's bin is the number of cuts below it."""
    at = [i / bins for i in range(1, bins)]
    r = df.agg(*(F.percentile_approx(_value(c), at, 1_000_000).alias(f"c{i}") for i, c in enumerate(features)), *(F.max(_value(c)).alias(f"m{i}") for i, c in enumerate(features))).first()
    return [sorted({x for x in r[f"c{i}"] or [] if x < r[f"m{i}"]}) for i in range(len(features))]


def _bins(features: list[str], cuts: list[list[float]]) -> list[Column]:
    return [reduce(lambda a, b: a + b, ((_value(c) > x).cast("int") for x in own), F.lit(0)) for c, own in zip(features, cuts)]


def _place(names: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1).cast("int")


def hidden_bayes(df: DataFrame, features: list[str]) -> Model:
    """Naive Bayes with a hidden parent per attribute: the other attributes' mixture, weighted by conditional mutual information.

    One pass counts pairs of binned values by class, as products of indicator matrices per task; cells, not rows, are shuffled.
    Smoothing adds one row, spread evenly. A single attribute has no parents and is used as in naive Bayes.
    """
    names, clean = classes(df), df.where(F.col("label").isNotNull())
    cuts = decile_cuts(clean, features)
    sizes = np.array([len(c) + 1 for c in cuts])
    first, width, k = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), int(sizes.sum()), len(names)
    if k * width * width > PAIR_CELLS:
        raise ValueError(f"{k} classes and {width} values make more than {PAIR_CELLS} cells: select attributes first")
    at = F.array(*(b + int(o) for b, o in zip(_bins(features, cuts), first)))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros((k, width, width), np.int64)
        for batch in batches:
            if len(batch):
                places, y = np.stack(batch["at"]), batch["y"].to_numpy()
                shown = np.zeros((len(batch), width))
                np.put_along_axis(shown, places, 1, axis=1)
                for c in range(k):
                    cells[c] += np.rint(shown[y == c].T @ shown[y == c]).astype(np.int64)
        y, u, v = np.nonzero(cells)
        yield pd.DataFrame({"y": y, "u": u, "v": v, "n": cells[y, u, v]})

    found = clean.select(at.alias("at"), _place(names).alias("y")).mapInPandas(counted, "y int, u int, v int, n long").groupBy("y", "u", "v").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros((k, width, width))
    cells[found["y"], found["u"], found["v"]] = found["n"]
    of = np.repeat(np.arange(len(features)), sizes)
    alone = np.stack([np.diag(c) for c in cells])
    rows = alone[:, of == 0].sum(axis=1)
    total = rows.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(cells > 0, cells / total * np.log(cells * rows[:, None, None] / (alone[:, :, None] * alone[:, None, :])), 0.0).sum(axis=0)
    weight = np.add.reduceat(np.add.reduceat(gain, first, axis=0), first, axis=1)
    np.fill_diagonal(weight, 0.0)
    weight = np.maximum(weight, 0.0)
    others = np.ones_like(weight) - np.eye(len(features))
    weight = np.where(weight.sum(axis=1, keepdims=True) > 1e-12, weight, others)
    weight = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-300)
    mixed = weight[of][:, of] * (cells + 1 / sizes[of][:, None]) / (alone[:, None, :] + 1)
    if len(features) == 1:
        mixed = np.stack([np.diag((a + 1 / width) / (n + 1)) for a, n in zip(alone, rows)])
    prior = np.log((rows + 1 / max(k, 1)) / (total + 1))

    @F.pandas_udf("array<double>")
    def distribution(places: pd.Series) -> pd.Series:
        x = np.stack(places) if len(places) else np.zeros((0, len(features)), int)
        logs = np.tile(prior, (len(x), 1))
        for i in range(len(features)):
            logs += np.log(mixed[:, x[:, [i]], x].sum(axis=2)).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return pd.Series(list(p / p.sum(axis=1, keepdims=True)))

    return Model(names, lambda d: d.withColumn("distribution", distribution(at)))


def decision_table_bayes(df: DataFrame, features: list[str]) -> Model:
    """A decision table over some attributes times naive Bayes over others, on binned values.

    All attributes start in the table. Each step moves one to naive Bayes or drops it, whichever gives the most correct
    rows with each row left out of its own counts, as long as that is no worse; one job rates all choices of a step. Smoothing
    adds one row to each class. The table stays a DataFrame; scoring joins it by its values, and rows without an entry get
    equal shares from it.
    """
    names, clean = classes(df), df.where(F.col("label").isNotNull())
    cuts, k = decile_cuts(clean, features), len(names)
    bins = _bins(features, cuts)
    grouped = clean.select(F.array(*bins).alias("b"), _place(names).alias("y")).groupBy("b", "y").agg(F.count("*").alias("n")).persist()
    counts = [np.zeros((len(c) + 1, k)) for c in cuts]
    for r in grouped.select("y", "n", F.posexplode("b").alias("i", "v")).groupBy("i", "v", "y").agg(F.sum("n").alias("n")).collect():  # bins * classes rows
        counts[r["i"]][r["v"], r["y"]] = r["n"]
    rows = counts[0].sum(axis=0)

    def chance(i: int, v: Column, c: int, out: Column | int) -> Column:
        """log of the share of value v of attribute i in class c, without ``out`` rows."""
        return F.log((F.get(F.array(*map(F.lit, counts[i][:, c].tolist())), v) - out + 1.0) / (float(rows[c]) - out + float(len(counts[i]))))

    sums = [F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"t{c}") for c in range(k)]
    own = [(F.col("y") == c).cast("int") for c in range(k)]
    shown = grouped.select("b", "y", "n", F.array(*(F.array(*(chance(i, F.get("b", F.lit(i)), c, own[c]) for c in range(k))) for i in range(len(features)))).alias("l"))

    def right(choices: list[tuple[tuple, tuple]]) -> list[int]:
        def one(j: int, table: tuple, rest: tuple) -> Column:
            logs = [reduce(lambda a, b: a + b, (F.get(F.get("l", F.lit(i)), F.lit(c)) for i in rest), F.lit(0.0)) for c in range(k)]
            return F.struct(F.lit(j).alias("j"), F.array(*(F.get("b", F.lit(i)) for i in table)).cast("array<int>").alias("key"), F.array(*logs).alias("logs"))

        each = shown.select("y", "n", F.inline(F.array(*(one(j, *x) for j, x in enumerate(choices)))))
        table = each.groupBy("j", "key").agg(*sums)
        scores = [F.log(F.col(f"t{c}") - own[c] + 1.0) + F.get("logs", F.lit(c)) for c in range(k)]
        guess = F.array_position(F.array(*scores), F.array_max(F.array(*scores))) - 1
        found = each.join(table, ["j", "key"]).groupBy("j").agg(F.sum(F.when(guess == F.col("y"), F.col("n")).otherwise(0)).alias("n"))
        return [n for _, n in sorted((r["j"], r["n"]) for r in found.collect())]

    table, rest = tuple(range(len(features))), ()
    best = right([(table, rest)])[0] if k > 1 else 0
    while table and k > 1:
        choices = [(tuple(x for x in table if x != i), more) for i in table for more in (rest, (*rest, i))]
        found = right(choices)
        if max(found) < best:
            break
        best, (table, rest) = max(found), choices[found.index(max(found))]
    grouped.unpersist()
    key = F.array(*(bins[i] for i in table)).cast("array<int>")
    entries = clean.select(key.alias("__key"), _place(names).alias("y"), F.lit(1).alias("n")).groupBy("__key").agg(*(x.alias(f"__t{c}") for c, x in enumerate(sums)))

    def score(d: DataFrame) -> DataFrame:
        joined = d.withColumn("__key", key).join(entries, "__key", "left")
        logs = [F.log(F.coalesce(F.col(f"__t{c}"), F.lit(0)) + 1.0) + reduce(lambda a, b: a + b, (chance(i, bins[i], c, 0) for i in rest), F.lit(0.0)) for c in range(k)]
        return joined.withColumn("distribution", _softmax(logs)).drop("__key", *(f"__t{c}" for c in range(k)))

    return Model(names, score)


# ------------------------------------------------------------------------------------------------------ pruned tree
def _outline(tree) -> tuple:
    """The shape of a fitted tree: a leaf's number (as in its leaf column), or a pair of subtrees."""
    lines = iter(x.strip() for x in tree.toDebugString.splitlines()[1:] if x.strip())
    number = iter(range(2**31))

    def part():
        if next(lines).startswith("Predict"):
            return next(number)
        left = part()
        next(lines)  # the other branch's condition
        return left, part()

    return part()


def pruned_shares(shape, counts: dict[int, np.ndarray], classes_: int, confidence: float) -> dict[int, np.ndarray]:
    """Class shares by leaf, one row added to each class, after replacing subtrees that promise no fewer errors than a leaf would.

    A leaf's errors are the upper end of the confidence interval of its error rate (normal approximation to the binomial).
    """
    z = NormalDist().inv_cdf(1 - confidence)

    def errors(c: np.ndarray) -> float:
        n = c.sum()
        if not n:
            return 0.0
        f = 1 - c.max() / n
        return n * (f + z * z / (2 * n) + z * math.sqrt(f / n - f * f / n + z * z / (4 * n * n))) / (1 + z * z / n)

    def part(node) -> tuple[np.ndarray, float, dict]:
        if isinstance(node, int):
            c = counts.get(node, np.zeros(classes_))
            return c, errors(c), {node: c}
        (a, x, left), (b, y, right) = part(node[0]), part(node[1])
        if errors(a + b) <= x + y + 0.1:
            return a + b, errors(a + b), dict.fromkeys(left | right, a + b)
        return a + b, x + y, left | right

    return {leaf: (c + 1) / (c.sum() + classes_) for leaf, c in part(shape)[2].items()}


def _pruned_tree(depth: int = 16, folds: int = 10, confidences: tuple = tuple(round(0.05 * i, 2) for i in range(1, 9))) -> Callable:
    """A tree pruned at the confidence with the fewest errors in cross-validation (the smallest of equal ones).

    Each fold's tree is grown once and pruned at every confidence; only counts by leaf and class leave the executors.
    """

    def fit(df: DataFrame, features: list[str]) -> Model:
        clean = _assembled(df.where(F.col("label").isNotNull()), features).withColumn("__fold", F.pmod(F.xxhash64("id", *features), F.lit(folds)))
        index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(clean)
        names, rows = list(index.labels), index.transform(clean).select("__v", "__y", "__fold").persist()
        k = len(names)
        if k < 2:
            rows.unpersist()
            return Model(names, lambda d: d.withColumn("distribution", F.array(*(F.lit(1.0) for _ in names))))

        def by_leaf(tree, d: DataFrame) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            for r in tree.transform(d).groupBy("__leaf", "__y").agg(F.count("*").alias("n")).collect():  # leaves * classes rows
                out.setdefault(int(r["__leaf"]), np.zeros(k))[int(r["__y"])] = r["n"]
            return out

        grow = DecisionTreeClassifier(featuresCol="__v", labelCol="__y", leafCol="__leaf", maxDepth=depth, minInstancesPerNode=2, impurity="entropy").fit
        right = np.zeros(len(confidences))
        sizes = {r["__fold"]: r["n"] for r in rows.groupBy("__fold").agg(F.count("*").alias("n")).collect()}
        for f in sizes if len(sizes) > 1 else ():
            train = rows.where(F.col("__fold") != f)
            tree = grow(train)
            shape, seen, held = _outline(tree), by_leaf(tree, train), by_leaf(tree, rows.where(F.col("__fold") == f))
            for j, c in enumerate(confidences):
                shares = pruned_shares(shape, seen, k, c)
                right[j] += sum(n[shares[leaf].argmax()] for leaf, n in held.items())
        tree = grow(rows)
        shares = pruned_shares(_outline(tree), by_leaf(tree, rows), k, confidences[int(right.argmax())])
        rows.unpersist()
        table = df.sparkSession.createDataFrame([(float(leaf), p.tolist()) for leaf, p in shares.items()], "__leaf double, distribution array<double>")

        def score(d: DataFrame) -> DataFrame:
            return tree.transform(_assembled(d, features)).join(F.broadcast(table), "__leaf").drop("__leaf", "__v", "rawPrediction", "probability", "prediction")  # at most 2^depth leaves

        return Model(names, score)

    return fit


def _leaf_models(depth: int, least: int, local: Callable) -> Callable:
    """A shallow tree whose leaves hold models of their own: local(rows of all leaves, features, names) -> {leaf: distribution}."""

    def fit(df: DataFrame, features: list[str]) -> Model:
        names, clean = classes(df), _assembled(df.where(F.col("label").isNotNull()), features)
        m = Pipeline(stages=[StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc"), DecisionTreeClassifier(featuresCol="__v", labelCol="__y", leafCol="__leaf", maxDepth=depth, minInstancesPerNode=least, impurity="entropy")]).fit(clean)
        tree = m.stages[1]
        finish = local(m.transform(clean), features, names)
        return Model(names, lambda d: finish(tree.transform(_assembled(d, features))).drop("__v", "rawPrediction", "probability", "prediction", "__leaf"))

    return fit


def _bayes_leaves(rows: DataFrame, features: list[str], names: list[str]):
    by_leaf: dict = {}
    for r in bayes_statistics(rows, features, ["__leaf"]).collect():  # leaves * classes rows
        by_leaf.setdefault(r["__leaf"], []).append(r)

    def finish(d: DataFrame) -> DataFrame:
        out = F.array(*(F.lit(1.0 / len(names)) for _ in names))
        for leaf, stats in by_leaf.items():
            out = F.when(F.col("__leaf") == leaf, _softmax(_bayes_from(stats, names, features))).otherwise(out)
        return d.withColumn("distribution", out)

    return finish


def _logistic_leaves(rows: DataFrame, features: list[str], names: list[str]):
    counts: dict = {}
    for r in rows.groupBy("__leaf", "__y").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["__leaf"], {})[int(r["__y"])] = r["n"]
    models = {leaf: LogisticRegression(featuresCol="__v", labelCol="__y", regParam=0.01, maxIter=30, family="multinomial").fit(rows.where(F.col("__leaf") == leaf).drop("rawPrediction", "probability", "prediction")) for leaf, c in counts.items() if len(c) > 1}

    def finish(d: DataFrame) -> DataFrame:
        out = F.array(*(F.lit(1.0 / len(names)) for _ in names))
        x = vector_to_array("__v")
        for leaf, c in counts.items():
            if leaf in models:
                w, b = models[leaf].coefficientMatrix.toArray(), models[leaf].interceptVector.toArray()
                logs = [reduce(lambda p, q: p + q, (F.get(x, F.lit(i)) * float(w[j, i]) for i in range(len(features)))) + float(b[j]) if j < len(b) and j in c else F.lit(-1e30) for j in range(len(names))]
                leaf_out = _softmax(logs)
            else:
                leaf_out = F.array(*(F.lit(1.0 if j in c else 0.0) for j in range(len(names))))
            out = F.when(F.col("__leaf") == leaf, leaf_out).otherwise(out)
        return d.withColumn("distribution", out)

    return finish


def neighbours(queries: DataFrame, train: DataFrame, features: list[str], k: int) -> DataFrame:
    """id, rank, label of the k nearest training rows (squared distance, then key) with another key.

    The driver collects training rows with INDEX_VALUES values at a time; queries search a block where they are, and each
    block's k best are kept before blocks meet.
    """
    blocks = -(-train.count() * max(1, len(features)) // INDEX_VALUES) or 1
    numbers = lambda p: [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{p}{i}") for i, c in enumerate(features)]
    q = queries.select(F.col("id"), *(numbers("q") or [F.lit(0.0).alias("q0")]))
    x = train.where(F.col("label").isNotNull()).select(F.col("id").alias("t"), "label", *(numbers("t") or [F.lit(0.0).alias("t0")]))
    kinds, width = dict(q.dtypes) | dict(x.dtypes), max(1, len(features))
    matrix = lambda table, p: np.column_stack([table.column(f"{p}{i}").to_numpy(zero_copy_only=False) for i in range(width)])

    def against(block: pa.Table):
        known = pc.unique(block.column("t").combine_chunks())
        known = known.take(pc.sort_indices(known, null_placement="at_start"))
        index = Index(matrix(block, "t"), pc.index_in(block.column("t"), value_set=known).to_numpy(), k)
        rows = block.select(["t", "label"]).combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = pc.fill_null(pc.index_in(batch.column("id"), value_set=known), -1).to_numpy(zero_copy_only=False)
                i, j, away = index.search(matrix(batch, "q"), keys)
                near = rows.take(pa.array(j)).combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column("id").take(pa.array(i)), *near.columns, pa.array(away))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "t", "label", "away"])

        return run

    part = lambda n: (x if blocks == 1 else x.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == n)).toArrow()
    found = [q.mapInArrow(against(part(n)), f"id {kinds['id']}, t {kinds['t']}, label {kinds['label']}, away double") for n in range(blocks)]
    rank = F.row_number().over(Window.partitionBy("id").orderBy("away", "t"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "label")


def _nearest(k: int | None = None, tried: tuple = (25, 20, 18)) -> Callable:
    """Votes of the k nearest training rows on scaled features; without k, the best of ``tried`` by leaving one out."""

    def fit(df: DataFrame, features: list[str]) -> Model:
        names, clean = classes(df), df.where(F.col("label").isNotNull())
        r = clean.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max)))).first()
        scaled = lambda d: d.withColumns({c: (F.col(c).cast("double") - (r[f"a{i}"] or 0.0)) / (((r[f"b{i}"] or 0.0) - (r[f"a{i}"] or 0.0)) or 1.0) for i, c in enumerate(features)})
        best = k
        if best is None:
            near = neighbours(scaled(clean), scaled(clean), features, max(tried))
            votes = near.groupBy("id").agg(*(F.count_if((F.col("label") == v) & (F.col("rank") <= c)).alias(f"v{j}_{c}") for j, v in enumerate(names) for c in tried))
            guess = lambda c: F.get(F.array(*map(F.lit, names)), (F.array_position(F.array(*(F.col(f"v{j}_{c}") for j in range(len(names)))), F.greatest(*(F.col(f"v{j}_{c}") for j in range(len(names))), F.lit(0))) - 1).cast("int"))
            right = votes.join(clean.select("id", "label"), "id").agg(*(F.count_if(guess(c) == F.col("label")).alias(f"r{c}") for c in tried)).first()
            best = max(tried, key=lambda c: (right[f"r{c}"] or 0, c))

        def score(d: DataFrame) -> DataFrame:
            near = neighbours(scaled(d), scaled(clean), features, best)
            votes = near.groupBy("id").agg(*(F.count_if(F.col("label") == v).cast("double").alias(f"__p{j}") for j, v in enumerate(names)))
            parts = [F.coalesce(F.col(f"__p{j}"), F.lit(0.0)) for j in range(len(names))]
            return d.join(votes, "id", "left").withColumn("distribution", _normalised(parts)).drop(*(f"__p{j}" for j in range(len(names))))

        return Model(names, score)

    return fit


def fold(seed: int = 1, folds: int = 10, key: str = "id") -> Column:
    """A row's fold, decided by its key alone."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


def _stacked(folds: int = 3) -> Callable:
    """Tree and 25 nearest neighbours; a tree learns from their out-of-fold distributions."""

    def fit(df: DataFrame, features: list[str]) -> Model:
        base, names = [_PLAIN_TREE, CLASSIFIERS["KNN25"]], classes(df)
        clean = df.where(F.col("label").isNotNull())

        def shown(models: list[Model], d: DataFrame) -> DataFrame:
            for i, m in enumerate(models):
                at = {v: j for j, v in enumerate(m.names)}
                d = m.score(d).withColumns({f"__b{i}_{j}": F.get("distribution", F.lit(at[v])) if v in at else F.lit(0.0) for j, v in enumerate(names)}).drop("distribution")
            return d

        meta = [f"__b{i}_{j}" for i in range(len(base)) for j in range(len(names))]
        parts = []
        for f in range(folds):
            models = [b(clean.where(fold(1, folds) != f), features) for b in base]
            parts.append(shown(models, clean.where(fold(1, folds) == f)).select("id", "label", *meta))
        shares = reduce(DataFrame.unionByName, parts).persist()  # a tree passes over them many times
        top = _PLAIN_TREE(shares, meta)
        shares.unpersist()
        models = [b(clean, features) for b in base]
        return Model(top.names, lambda d: top.score(shown(models, d)).drop(*meta))

    return fit


_PLAIN_TREE = _spark_model(DecisionTreeClassifier, impurity="entropy", minInstancesPerNode=2, maxDepth=8)

#: Names a model may be queued with. BayesNet, NeuralNet and Ensemble2 are refused, as are unknown names.
CLASSIFIERS: dict[str, Callable[[DataFrame, list[str]], Model]] = {
    "RandomForest": _spark_model(RandomForestClassifier, numTrees=100, featureSubsetStrategy="log2", maxDepth=10, seed=2),
    "LMT": _leaf_models(3, 15, _logistic_leaves),
    "LibSVM": _one_against_rest(_support_vectors(2.0, 64)),
    "LibSVM2": _one_against_rest(_support_vectors(1.0, 64)),
    "SMO": _one_against_rest(_support_vectors(None)),
    "KNN": _nearest(),
    "KNN25": _nearest(25),
    "J48": _pruned_tree(),
    "realAdaBoost": _one_against_rest(_real_boosting()),
    "LogitBoost": _one_against_rest(_binary_ml(GBTClassifier, maxDepth=1, maxIter=10, seed=1)),
    "RacedIncrementalLogitBoost": _one_against_rest(_committee()),
    "Ensemble": _stacked(),
    "NaiveBayes": naive_bayes,
    "NBTree": _leaf_models(2, 30, _bayes_leaves),
    "HiddenNaiveBayes": hidden_bayes,
    "DecisionTreeNaiveBayes": decision_table_bayes,
}


def build(df: DataFrame, features: list[str], scheme: str, selection: str = "cfs", balance: bool = True) -> Model:
    """Balancing, attribute selection and classifier as one unit, so that nothing leaks between folds."""
    if scheme not in CLASSIFIERS:
        raise ValueError(f"no classifier {scheme!r}")
    useful = remove_useless(df, features)
    if balance:
        df = smote(spread_subsample(df), useful)
    df = df.persist()  # selection and fitting pass over it many times
    if selection == "cfs":
        useful = select_by_correlation(df, useful) or useful
    elif selection == "relief":
        useful = [c for c, w in relief_weights(df, useful).items() if w > 0] or useful
    model = CLASSIFIERS[scheme](df, useful)
    df.unpersist()  # schemes that keep rows read them anew
    return model


def cross_validate(df: DataFrame, features: list[str], scheme: str, folds: int = 10, seed: int = 1, **options) -> DataFrame:
    """id, label, predicted, distribution and strength of every row, from the model of the other folds."""
    parts = [build(df.where(fold(seed, folds) != f), features, scheme, **options).predict(df.where(fold(seed, folds) == f), ["id", "label"]) for f in range(folds)]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------------------------------------------------- reports
def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Per class: rows, precision, recall and F-measure; from the confusion matrix, so one aggregation of the rows."""
    m = confusion(predictions)
    side = lambda c, own, out: m.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(out), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias(own))
    r = side("label", "hit", "n_rows").join(side("predicted", "__hit", "n_predicted"), "class", "full").na.fill(0, ["n_rows", "hit", "n_predicted"])
    precision, recall = F.when(F.col("n_predicted") > 0, F.col("hit") / F.col("n_predicted")), F.when(F.col("n_rows") > 0, F.col("hit") / F.col("n_rows"))
    return r.select("class", "n_rows", "n_predicted", precision.alias("precision"), recall.alias("recall"), F.when(F.col("n_rows") + F.col("n_predicted") > 0, 2 * F.col("hit") / (F.col("n_rows") + F.col("n_predicted"))).alias("f_measure"))


def summary(predictions: DataFrame) -> DataFrame:
    """Rows, correct rows, accuracy and kappa."""
    m = confusion(predictions)
    total = m.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("correct"))
    rows, cols = (m.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(o)) for c, o in (("label", "r"), ("predicted", "c")))
    chance = rows.join(cols, "class").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("c")), F.lit(0.0)).alias("x"))
    p, e = F.col("correct") / F.col("n"), F.col("x") / (F.col("n").cast("double") * F.col("n"))
    return total.crossJoin(chance).select("n", "correct", p.alias("accuracy"), F.when(e < 1, (p - e) / (1 - e)).alias("kappa"))
