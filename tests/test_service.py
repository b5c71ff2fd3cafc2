"""Chemistry, features, saved models, jobs, SD files and the repaired operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorite.chemistry import molecule as M
from fluorite.functions import bits as B
from fluorite.functions import scalars as X
from fluorite.operators import api, chemistry, features, jobs, learning, similarity, store
from fluorite.sources import sdf
from fluorite.streaming import queue

SMILES = ["CCO", "CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "[Na+].[Cl-]", "C[C@H](N)C(=O)O", "c1ccc(cc1)-c1ccccc1", "[O-][N+](=O)c1ccc2[nH]ccc2c1", "C1CC2CCC1C2", "FC(F)(F)c1ccc(Cl)cc1Br", "OC%12CCCCC%12", "C/C=C/C", "N#Cc1ccncc1"]


@pytest.mark.parametrize("text", SMILES)
def test_smiles_do_not_depend_on_the_order_of_atoms(text):
    rng, m = random.Random(1), M.parse_smiles(text)
    names = set()
    for _ in range(15):
        order = list(range(len(m.atoms)))
        rng.shuffle(order)
        place = {x: i for i, x in enumerate(order)}
        bonds = [(place[i], place[j], o) for i, j, o in m.bonds]
        rng.shuffle(bonds)
        names.add(M.write_smiles(M.Molecule([m.atoms[x] for x in order], bonds)))
    (name,) = names
    assert M.write_smiles(M.parse_smiles(name)) == name and M.statistics(M.parse_smiles(name)) == M.statistics(m)
    again = M.parse_molfile(M.write_molfile(m, "x"))
    assert (len(again.atoms), len(again.bonds)) == (len(m.atoms), len(m.bonds)) and [a.charge for a in again.atoms] == [a.charge for a in m.atoms]


def test_measures():
    aspirin = M.statistics(M.parse_smiles("CC(=O)Oc1ccccc1C(=O)O"))
    assert (aspirin["n_atoms"], aspirin["n_rings"], aspirin["mw"], aspirin["n_donors"], aspirin["n_acceptors"], aspirin["n_hydrogens"]) == (13, 1, 180.159, 1, 4, 8)
    assert M.write_smiles(M.strip_salt(M.parse_smiles("[Na+].CCO.CCO.[Cl-]"))) == "CCO"
    assert M.write_smiles(M.murcko(M.parse_smiles("CCc1ccc(CCC2CC2)cc1O"))) == M.write_smiles(M.parse_smiles("c1ccc(CCC2CC2)cc1"))
    assert not M.murcko(M.parse_smiles("CCCC")).atoms


@pytest.mark.parametrize("text", ["C(", "C)", "C1CC", "[Xy", "C=", "c1ccccc", "C11", "?"])
def test_what_is_no_smiles(text):
    with pytest.raises(ValueError):
        M.parse_smiles(text)


def test_matching_against_all_placements():
    import itertools

    rng = random.Random(3)
    for _ in range(150):
        target = M.Molecule([M.Atom(rng.choice("CNO")) for _ in range(6)], [(i, rng.randrange(i), rng.choice([1, 2])) for i in range(1, 6)])
        query = M.Molecule([M.Atom(rng.choice("CNO")) for _ in range(3)], [(1, 0, 1), (2, rng.randrange(2), rng.choice([1, 2]))])
        want = any(
            all(query.atoms[i].symbol == target.atoms[p[i]].symbol for i in range(3)) and all(target.near[p[i]].get(p[j]) == o for i, j, o in query.bonds)
            for p in itertools.permutations(range(6), 3)
        )
        assert M.matches(query, target) == want
        if want:
            assert all(set(M.fingerprint(query, k)) <= set(M.fingerprint(target, k)) for k in M.WIDTHS if k not in ("estate",))


def test_unreadable_structures_stop_nothing(spark):
    rows = spark.createDataFrame([(1, "CCO"), (2, "C("), (3, None), (4, "x\n\n\n  9  9")], "mol_id long, structure string")
    got = {r.mol_id: r for r in chemistry.describe(rows).collect()}
    assert got[1].n_atoms == 3 and got[1].fault is None and got[3].fault is None and got[3].n_atoms is None
    assert all(got[k].fault and got[k].n_atoms is None for k in (2, 4))
    assert {r.fault for r in chemistry.describe(rows.limit(1), budget=-1.0).collect()} == {"timeout"}
    with pytest.raises(ValueError):
        chemistry.substructure_search(rows, "CC")


def test_wide_bits_are_neither_lost_nor_cut(spark):
    bits = lambda a, b: list(range(a, b))
    rows = spark.createDataFrame([(1, [1], bits(1100, 1200)), (2, [2], bits(1100, 1195)), (3, [3], bits(4000, 4100)), (4, [4], None)], "id long, ext array<int>, kr array<int>")
    got = {(r.mol_id1, r.mol_id2): float(r.kr) for r in similarity.batch_similarity(rows, rows).collect()}
    assert got == {(1, 2): 0.95, (2, 1): 0.95}
    with pytest.raises(Exception, match="does not fit"):
        spark.range(1).select(B.pack(F.array(F.lit(1024)))).collect()


def test_decimal_texts(spark):
    cases = {0.87: "0.87", 0.13: "0.13", 1.0: "1", 0.0: "0", 0.123456789: "0.12345679", 100.0: "100", -2.5: "-2.5"}
    rows = spark.createDataFrame([(k,) for k in cases], "v double").select("v", X.decimal_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases
    assert spark.range(1).select(X.render_distribution(F.array(F.lit(0.87), F.lit(0.13))).alias("x")).first().x == "0.87\t0.13\t"


def test_duplicate_keys_are_settled_in_order(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (2, "e", 2)], "k int, v string, o int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], "o").collect())) == [(1, "c"), (2, "e")]
    assert sorted(map(tuple, store.insert_or_ignore(old, new, ["k"], "o").collect())) == [(1, "a"), (2, "d")]


def test_keys_are_gapless_however_parts_run(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n")).repartition(7)
    assert sorted(r.k - r.n for r in store.assign_keys(rows, "n", 5, "k").collect()) == [5] * 1000


def _bit_rows(spark, n=300):
    rng = np.random.default_rng(7)
    base = [set(rng.choice(1024, rng.integers(0, 90)).tolist()) for _ in range(n // 3)]
    sets = base + [b | set(rng.choice(1024, 5).tolist()) for b in base] + [set(list(b)[3:]) for b in base]
    df = spark.createDataFrame([(i, [int(b) for b in sorted(s)]) for i, s in enumerate(sets)], "id long, bits array<int>")
    score = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    return similarity.prepare(df, "id", "bits"), sets, score


def test_similarity_tiles_against_brute_force(spark, monkeypatch):
    """Pairs of one table and of two, from several tiles, without a shuffle of pairs."""
    fp, sets, score = _bit_rows(spark)
    monkeypatch.setattr(similarity.tiles, "JOIN_ROWS", 50)
    for left in (fp, fp.where("id < 100")):
        joined = similarity.similarity_join(left, fp, 0.85, "prefix")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Join") == 0
        want = {(a, b): score(sets[a], sets[b]) for a in range(300 if left is fp else 100) for b in range(300) if a != b}
        assert {(r[0], r[1]): r[2] for r in joined.collect()} == {k: v for k, v in want.items() if v >= 0.85}


@pytest.mark.parametrize("compat", [False, True])
def test_certainty_tiles_against_brute_force(spark, monkeypatch, compat):
    """The mean of the five best, in several tiles and ranges of columns, without a sort of all pairs."""
    fp, sets, score = _bit_rows(spark)
    monkeypatch.setattr(similarity.tiles, "TRAIN_ROWS", 120)
    found = similarity.certainty(fp, fp, compat=compat)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    want = {a: np.mean(sorted((score(sets[a], sets[b]) for b in range(300) if compat or a != b), reverse=True)[:5]) for a in range(300)}
    assert {r[0]: r[1] for r in found.collect()} == pytest.approx(want)
    one, k = similarity.tiles, 5
    rows = one.pa.Table.from_batches(one._rows(fp, 16).toArrow().to_batches()).to_batches()
    monkeypatch.setattr(one, "_COLUMNS", 32)
    side = one.Side(rows, 16)
    assert {i: np.mean(s) for i, s in zip(side.keys.tolist(), one.best_scores(side, side, k, compat))} == pytest.approx(want)


def test_certainty_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    fp = similarity.prepare(spark.createDataFrame([(i, sorted(rng.sample(range(40), 12))) for i in range(60)], "id long, bits array<int>"), "id", "bits").cache()
    whole = {r[0]: r[1] for r in similarity.certainty(fp, fp).collect()}
    monkeypatch.setattr(similarity, "LOOP_ROWS", 17)
    assert {r[0]: r[1] for r in similarity.certainty(fp, fp).collect()} == pytest.approx(whole)


def test_sd_files_of_many_kinds(spark, tmp_path):
    text = "one\r\n\r\n> <A>\r\n1\r\n$$$$\r\ntwo\n> <A>\n2\nmore\n\n  $$$$  \nthree\n> <B>\nx\n$$$$\n\n$$$$\nlast > <A>\n"
    (tmp_path / "a.sdf").write_bytes(text.encode())
    rows = sdf.read_sdf(spark, str(tmp_path / "a.sdf")).orderBy("record_no").collect()
    assert [r.record.split("\n")[0] for r in rows] == ["one", "two", "three", "last > <A>"] and len({r.record_no for r in rows}) == 4
    tagged = sdf.read_sdf(spark, str(tmp_path / "a.sdf")).select(sdf.tags(F.col("record")).alias("m")).collect()
    assert [r.m for r in tagged[:3]] == [{"A": "1"}, {"A": "2\nmore"}, {"B": "x"}]


def test_definition_files_and_arff(spark, tmp_path):
    config, mapping = sdf.parse_definition("# c\nkey = v\nName:name:VARCHAR(20)\nName2:NAME:INT\nBad:1x:INT\nLogP:logp:DOUBLE\n")
    assert config == {"key": "v"} and mapping == [("Name", "name", "VARCHAR(20)"), ("LogP", "logp", "DOUBLE")]
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@attribute x numeric\n@attribute 'y' {a,b}\n@data\n1,a\n2,b\n")
    assert sorted(map(tuple, sdf.read_arff(spark, str(tmp_path / "a.arff")).collect())) == [("1", "a"), ("2", "b")]


def test_saved_models_predict_alike(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 2) + i / 100, 1.0 + i % 3) for i in range(40)], "id long, label string, x double, y double")
    features.save_bayes(rows, ["x", "y"], str(tmp_path), 7)
    model, header = features.load_bayes(spark, str(tmp_path), 7)
    want = sorted(map(tuple, learning.naive_bayes(rows, ["x", "y"]).predict(rows).collect()))
    got = features.predict(model, rows.drop("label"), header, key="id").select("id", "predicted", "distribution", "strength")
    assert sorted(map(tuple, got.collect())) == want
    report = features.printout(features.predict(model, rows, header, key="id"), model.names, key="id").orderBy("first").collect()
    assert report[0].printout.startswith("id") and sum(r.printout.count("\n") for r in report) == 40
    with pytest.raises(Exception):
        features.load_bayes(spark, str(tmp_path), 7, version=1)


def test_jobs(spark):
    control = jobs.Jobs()
    control.run("good", [1, 2, 3], lambda x: x * 2)
    control.run("bad", [1, 0, 3], lambda x: 1 // x)
    got = {r.name: r for r in control.table(spark).collect()}
    assert (got["good"].state, got["good"].processed, got["good"].fault) == ("completed", 3, None)
    assert (got["bad"].state, got["bad"].processed) == ("failed", 1) and "zero" in got["bad"].fault and control.rows["bad"]["results"] == [1]
    seen = []
    assert jobs.after_import({"similarity": lambda s: seen.append("s"), "fingerprints": lambda s: seen.append("f")}, {}) == ["fingerprints", "similarity"] and seen == ["f", "s"]


def test_queue_is_handled_once(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "model_id int, class_tag string").write.json(str(tmp_path / "queue"))
    seen = []
    for _ in range(2):
        queue.watch_queue(spark, str(tmp_path / "queue"), "model_id int, class_tag string", lambda df, n: seen.extend(r.model_id for r in df.collect()), str(tmp_path / "at")).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_temporary_batch(spark):
    s = {"molecules": spark.createDataFrame([(1, "a")], "mol_id long, mol_name string"), "batchmols": spark.createDataFrame([(1, 1)], "batch_id long, mol_id long")}
    one = spark.createDataFrame([(9, "new")], "mol_id long, mol_name string")
    assert [tuple(r) for r in jobs.temporary_batch(s, one, 5, lambda t: api.dataset_compounds({**t, "molecules": t["molecules"].withColumn("inchi_key", F.lit("k"))}, 5)).collect()] == [(9, "new", "k")]
    assert s["batchmols"].count() == 1


def test_searches_refuse(spark):
    s = {"statistics": spark.createDataFrame([(i, 5) for i in range(9)], "mol_id long, n_atoms int"), "hashes": spark.createDataFrame([(i, 7) for i in range(9)], "mol_id long, hfp01 long"), "class_models": spark.createDataFrame([(1,)], "model_id long")}
    with pytest.raises(api.TooManyHits):
        api.screen(s, "n_atoms:5", {"hfp01": 1}, most=5)
    with pytest.raises(api.NotFound):
        api.model(s, 5, must=True)
    with pytest.raises(ValueError):
        api.validate_tag(s["statistics"], "n_atoms; drop")
    assert api.dictionary_hits(s, {"hfp01": 1}, exact=True) is None and api.dictionary_hits(s, {"hfp01": 1}).count() == 9
    assert not api.enough_atoms(2) and api.enough_atoms(3)
