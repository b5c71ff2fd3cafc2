import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorite import catalogue
from fluorite.operators import learning as L

DATA = "/root/testdata/sf0.001"
TOY = [(i, "0", 1.0 + i, 2.0 - i) for i in range(6)] + [(10 + i, "1", 0.5 - i, 0.8 + i) for i in range(6)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "id long, label string, x double, y double").coalesce(1).cache()


@pytest.mark.parametrize("scheme", sorted(L.CLASSIFIERS))
def test_classifiers_on_the_toy_set(spark, toy, scheme):
    rows = L.CLASSIFIERS[scheme](toy, ["x", "y"]).predict(toy, ["id", "label"]).collect()
    assert len(rows) == 12 and all(abs(sum(r.distribution) - 1) < 1e-6 and r.strength == max(r.distribution) for r in rows)
    least = 6 if scheme in ("KNN", "KNN25", "Ensemble", "RacedIncrementalLogitBoost") else 10  # neighbours beyond the set size vote evenly
    assert sum(r.label == r.predicted for r in rows) >= least or scheme in ("KNN", "KNN25", "Ensemble")


@pytest.fixture(scope="module")
def table(spark):
    """120 rows of four small whole numbers, two of them with the class in common, in some rows null."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (120, 4))
    y = np.where(rng.random(120) < 0.15, rng.integers(0, 3, 120), (x[:, 0] + x[:, 1]) % 3)
    rows = [(i, "abc"[c], *(None if i % 17 == 0 and j == 3 else float(v) for j, v in enumerate(r))) for i, (c, r) in enumerate(zip(y, x))]
    x[::17, 3] = 0  # nulls count as 0
    return spark.createDataFrame(rows, "id long, label string, a double, b double, c double, d double").repartition(3), x, y


def test_hidden_bayes_against_brute_force(table):
    df, x, y = table
    got = {r.id: r.distribution for r in L.hidden_bayes(df, list("abcd")).predict(df, ["id"]).collect()}
    rate = lambda *conditions: np.mean(np.logical_and.reduce(conditions))
    w = np.zeros((4, 4))
    for i in range(4):
        for j in range(4):
            for c in range(3):
                for u in range(4):
                    for v in range(4):
                        p = rate(x[:, i] == u, x[:, j] == v, y == c)
                        w[i, j] += p * np.log(p * rate(y == c) / rate(x[:, i] == u, y == c) / rate(x[:, j] == v, y == c)) if p and i != j else 0
    w /= w.sum(axis=1, keepdims=True)
    for k in range(120):
        p = []
        for c in range(3):
            n = np.sum(y == c)
            q = (n + 1 / 3) / 121
            for i in range(4):
                own = lambda j: np.sum((x[:, i] == x[k, i]) & (x[:, j] == x[k, j]) & (y == c))  # noqa: B023, E731
                q *= sum(w[i, j] * (own(j) + 1 / 4) / (np.sum((x[:, j] == x[k, j]) & (y == c)) + 1) for j in range(4) if j != i)
            p.append(q)
        assert np.allclose(got[k], np.array(p) / sum(p))


def test_decision_table_bayes_against_brute_force(table):
    df, x, y = table
    got = {r.id: r.distribution for r in L.decision_table_bayes(df, list("abcd")).predict(df, ["id"]).collect()}

    def logs(k, table, rest, out):
        same = np.all(x[:, list(table)] == x[k, list(table)], axis=1) & (np.arange(120) != (k if out else -1))
        return [np.log(np.sum(same & (y == c)) + 1) + sum(np.log((np.sum((x[:, i] == x[k, i]) & (y == c)) - (out and y[k] == c) + 1) / (np.sum(y == c) - (out and y[k] == c) + 4)) for i in rest) for c in range(3)]

    right = lambda t, r: sum(int(np.argmax(np.round(logs(k, t, r, True), 9)) == y[k]) for k in range(120))
    table_, rest = (0, 1, 2, 3), ()
    best = right(table_, rest)
    while table_:
        choices = [(tuple(t for t in table_ if t != i), r) for i in table_ for r in (rest, (*rest, i))]
        scores = [right(*c) for c in choices]
        if max(scores) < best:
            break
        best, (table_, rest) = max(scores), choices[int(np.argmax(scores))]
    for k in range(120):
        p = np.exp(logs(k, table_, rest, False))
        assert np.allclose(got[k], p / p.sum())
    assert set(table_) == {0, 1} and best > 90


def test_schemes_of_binned_values_on_odd_tables(spark, table, monkeypatch):
    """One class, one attribute, no rows to score, an unseen value; too many cells are refused."""
    df = table[0]
    for scheme in (L.hidden_bayes, L.decision_table_bayes, L.CLASSIFIERS["J48"]):
        one = scheme(df.where("label = 'a'"), ["a", "b"]).predict(df, ["id"])
        assert {(r.predicted, r.strength) for r in one.collect()} == {("a", 1.0)}
        model = scheme(df, ["a"])
        assert model.predict(df.limit(0), ["id"]).count() == 0
        odd = model.predict(spark.createDataFrame([(1, 99.0), (2, None)], "id long, a double"), ["id"]).collect()
        assert len(odd) == 2 and all(abs(sum(r.distribution) - 1) < 1e-9 for r in odd)
    monkeypatch.setattr(L, "PAIR_CELLS", 10)
    with pytest.raises(ValueError):
        L.hidden_bayes(df, ["a", "b"])


def test_pruning():
    """Leaves that split noise become one; a lower confidence prunes no less; useful splits stay."""
    shape, counts = ((0, 1), (2, 3)), {0: np.array([20.0, 0]), 1: np.array([19.0, 1]), 2: np.array([0.0, 30]), 3: np.array([2.0, 1])}
    p = L.pruned_shares(shape, counts, 2, 0.25)
    assert np.allclose(p[0], [40 / 42, 2 / 42]) and np.allclose(p[0], p[1]) and p[2].argmax() == 1
    kinds = [len({tuple(v) for v in L.pruned_shares(shape, counts, 2, c).values()}) for c in (0.05, 0.25, 0.4, 0.5)]
    assert kinds == sorted(kinds) and kinds[0] >= 2
    assert np.allclose(L.pruned_shares(0, {0: np.array([3.0, 0])}, 2, 0.25)[0], [0.8, 0.2])


def test_pruned_tree_outline_matches_leaf_numbers(table):
    df, x, y = table
    rows = {r.id: r for r in L.CLASSIFIERS["J48"](df, list("abcd")).predict(df, ["id", "label"]).collect()}
    assert sum(r.label == r.predicted for r in rows.values()) > 95


def test_refused_classifiers(toy):
    for name in ("BayesNet", "NeuralNet", "Ensemble2", "x"):
        with pytest.raises(ValueError):
            L.build(toy, ["x", "y"], name)


def test_filters(spark, toy):
    df = toy.withColumn("z", F.lit(3.0)).withColumn("u", F.col("id").cast("string"))
    assert L.remove_useless(df, ["x", "y", "z"], ["u"]) == ["x", "y"]
    noisy = toy.withColumn("noise", F.pmod(F.col("id") * 7, F.lit(5)).cast("double"))
    weights = L.relief_weights(noisy, ["x", "y", "noise"], k=3)
    assert min(weights["x"], weights["y"]) > weights["noise"]
    assert set(L.select_by_correlation(noisy, ["x", "y", "noise"])) & {"x", "y"}


def test_balancing(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 70, "a").otherwise("b").alias("label"), F.rand(1).alias("x"))
    kept = {r.label: r.n for r in L.spread_subsample(df).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert kept == {"a": 70, "b": 350}
    grown = L.smote(df, ["x"])
    assert grown.where("label = 'a'").count() == 140 and grown.where("id is null and label = 'a'").count() == 70
    low, high = df.where("label = 'a'").agg(F.min("x"), F.max("x")).first()
    assert grown.where("id is null").where(~F.col("x").between(low, high)).count() == 0


def test_relief_rates_every_row_against_all(spark, monkeypatch):
    """Weights equal brute force over all rows, also where a class is rare and rows come in blocks."""
    rng = np.random.default_rng(3)
    x = rng.random((260, 3))
    label = np.array(["rare" if i % 65 == 0 else "ab"[i % 2] for i in range(260)])
    df = spark.createDataFrame([(None if i % 50 == 0 else i, str(label[i]), *map(float, x[i])) for i in range(260)], "id long, label string, f0 double, f1 double, f2 double").repartition(3)
    scaled, want = (x - x.min(0)) / np.ptp(x, axis=0), np.zeros(3)
    for i in range(260):
        gaps = np.abs(scaled - scaled[i])
        for v in ("a", "b", "rare"):
            at = np.flatnonzero((label == v) & (np.arange(260) != i))
            mean = gaps[at[np.argsort(gaps[at].sum(axis=1))[:10]]].mean(axis=0)
            want += mean / 260 * (-1 if v == label[i] else (label == v).sum() / (label != label[i]).sum())
    for block in (20_000, 60):
        monkeypatch.setattr(L, "NEIGHBOUR_BLOCK", block)
        assert np.allclose(list(L.relief_weights(df, ["f0", "f1", "f2"]).values()), want)


def test_smote_is_the_same_at_every_size(spark, monkeypatch):
    """A class beyond a block gives the rows it gives in one block, each between a row and one of its 5 nearest of all."""
    x = np.random.default_rng(4).random((120, 2))
    df = spark.createDataFrame([(i, "a", *map(float, r)) for i, r in enumerate(x)] + [(200 + i, "b", 0.0, 0.0) for i in range(130)], "id long, label string, x double, y double").repartition(3)
    made = []
    for block in (20_000, 25):
        monkeypatch.setattr(L, "NEIGHBOUR_BLOCK", block)
        made.append(sorted((r.x, r.y) for r in L.smote(df, ["x", "y"]).where("id is null").collect()))
    assert len(made[0]) == 120 and np.allclose(made[0], made[1])
    away = (((x[:, None] - x[None]) / np.ptp(x, axis=0)) ** 2).sum(axis=2)
    boxes = [(np.minimum(x[i], x[j]) - 1e-9, np.maximum(x[i], x[j]) + 1e-9) for i in range(120) for j in np.argsort(away[i])[1:6]]
    assert all(any((low <= p).all() and (p <= high).all() for low, high in boxes) for p in made[1])


def test_neighbours_by_index(spark, monkeypatch):
    """The nearest rows of all, ties by key, with null keys, equal rows and blocks; distances of few of all pairs are computed."""
    from fluorite.operators import nearest

    rng = np.random.default_rng(5)
    x, counted = rng.integers(0, 60, (900, 2)).astype(float), []
    ids = [None, *range(1, 900)]
    df = spark.createDataFrame([(k, "ab"[i % 2], *map(float, x[i])) for i, k in enumerate(ids)], "id long, label string, x double, y double").repartition(3)
    for values in (1_000_000, 500):
        monkeypatch.setattr(L, "INDEX_VALUES", values)
        got = {}
        for r in L.neighbours(df, df, ["x", "y"], 7).orderBy("rank").collect():
            got.setdefault(r.id, []).append(r.label)
        for i, k in enumerate(ids):
            away = ((x - x[i]) ** 2).sum(axis=1)
            assert got[k] == ["ab"[j % 2] for j in sorted(set(range(900)) - {i}, key=lambda j: (away[j], j))[:7]]
    index = nearest.Index(x, np.arange(900), 7)
    plain = index._away
    index._away = lambda v, k, at: counted.append(len(v) * len(at)) or plain(v, k, at)
    index.search(x, np.arange(900))
    assert sum(counted) < 900 * 900


def test_cross_validation_covers_all_rows(toy):
    rows = L.cross_validate(toy, ["x", "y"], "NaiveBayes", folds=3, balance=False).collect()
    assert sorted(r.id for r in rows) == sorted(t[0] for t in TOY)


@pytest.mark.parametrize("name", sorted(n for n in catalogue.queries() if n.startswith(("m6_", "m9_"))))
def test_queries_without_sql_return_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
