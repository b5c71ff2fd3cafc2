"""The named queries, over tables of the driver in the roles of the service's: parts are molecules, nations batches,
suppliers models, orders jobs and line items their results. SQL twins share the same roles as common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import api as A
from .registry import Tables, query

ROLES = {
    "batchlist": ("nation", ["n_nationkey::bigint batch_id", "n_name filename", "concat('u', n_regionkey) username", "concat('type', n_regionkey % 2) mol_type", "concat('tag', n_nationkey, ' tag', n_regionkey) info", "(n_nationkey % 2)::int learn"]),
    "batchmols": ("part", ["(p_partkey % 25)::bigint batch_id", "p_partkey::bigint mol_id"]),
    "molecules": ("part", ["p_partkey::bigint mol_id", "p_name mol_name", "concat(p_type, p_size) inchi_key", "p_type smiles", "p_brand inchi", "p_brand murcko_id"]),
    "statistics": ("part", ["p_partkey::bigint mol_id", "p_size::int n_atoms", "length(p_name)::int n_bonds", "(p_size % 7)::int n_rings"]),
    "hashes": ("part", ["p_partkey::bigint mol_id", "(p_partkey % 4 * 35)::bigint hfp01", "(p_partkey % 3)::bigint hfp02"]),
    "class_models": ("supplier", ["s_suppkey::bigint model_id", "s_nationkey::bigint batch_id", "concat('tag', s_nationkey) class_tag", "case when s_suppkey % 2 = 0 then 'MACCS' else 'EXT' end data_type", "case when s_suppkey % 3 = 0 then 'RandomForest' else 'J48' end class_scheme", "concat('u', s_nationkey % 5) username", "case when s_acctbal > 3000 then s_name end model_data"]),
    "prediction_list": ("orders", ["o_orderkey::bigint pred_id", "(o_custkey % 10)::bigint model_id", "(o_custkey % 25)::bigint batch_id", "o_orderpriority pred_name"]),
    "prediction_mols": ("lineitem", ["l_orderkey::bigint pred_id", "l_partkey::bigint mol_id", "l_returnflag main_class", "l_discount::double lhood", "l_linenumber::int line"]),
}
CTE = "with " + ", ".join(f"{name} as (select {', '.join(columns)} from {table})" for name, (table, columns) in ROLES.items()) + "\n"


class Roles(dict):
    """The store of a directory; a table is read when asked for."""

    def __init__(self, spark, path):
        super().__init__()
        self.tables = Tables(spark, path)

    def __contains__(self, name) -> bool:
        return name in ROLES

    def __missing__(self, name):
        table, columns = ROLES[name]
        return getattr(self.tables, table).selectExpr(*columns)


def named(name: str, sql: str):
    """A query over the roles; its twin starts with them."""

    def register(f):
        query(name, CTE + sql)(lambda spark, path: f(Roles(spark, path)))
        return f

    return register


LAST = "qualify row_number() over (partition by {0} order by {1}) = 1"


@named("q01_list_datasets", "select * from batchlist where mol_type='type1' and username<>'u1'")
def _(s):
    return A.list_datasets(s, you="u1", who="other", mol_type="type1")


@named("q02_dataset", "select * from batchlist where batch_id=7")
def _(s):
    return A.dataset(s, 7)


@named("q03_dataset_compounds", "select mol_id, mol_name, inchi_key from batchmols join molecules using (mol_id) where batch_id=7")
def _(s):
    return A.dataset_compounds(s, 7)


@named("q05_compound_detail", "select mol_id, mol_name, inchi_key, smiles, inchi, murcko_id, batch_id, n_atoms, n_bonds, n_rings from molecules left join batchmols using (mol_id) left join statistics using (mol_id) where mol_id=42")
def _(s):
    return A.compound_detail({k: s[k] for k in ("molecules", "batchmols", "statistics")}, 42)


@named("q07_property_fingerprint", "select mol_id, property, value::double as value from (select mol_id, n_atoms, n_bonds, n_rings from statistics where mol_id=42) unpivot (value for property in (n_atoms, n_bonds, n_rings))")
def _(s):
    return A.property_fingerprint(s, 42)


@named("q08_model_fingerprint", "select mol_id, concat('model_', model_id) model, lhood from (select mol_id, model_id, first(lhood order by pred_id desc) lhood from prediction_mols join prediction_list using (pred_id) where mol_id=42 group by all)")
def _(s):
    return A.model_scores(s, 42)


@named("q09_compound_predictions", "select mol_id, model_id, class_tag, pred_id, main_class, lhood from prediction_mols join prediction_list using (pred_id) left join (select model_id, class_tag from class_models) using (model_id) where mol_id=42 " + LAST.format("mol_id, model_id", "pred_id"))
def _(s):
    return A.compound_predictions(s, 42)


@named("q10_list_models", "select model_id, m.batch_id, filename, class_tag, data_type, class_scheme, m.username from class_models m left join batchlist b on m.batch_id=b.batch_id where m.username='u2' and class_scheme='J48'")
def _(s):
    return A.list_models(s, you="u2", who="you", class_scheme="J48")


@named("q11_model", "select * from class_models where model_id=3")
def _(s):
    return A.model(s, 3)


@named("q12_text_search", "select distinct mol_id, mol_name, filename from molecules left join batchmols using (mol_id) left join (select batch_id, filename from batchlist) using (batch_id) where mol_name ilike '%ring%' or inchi_key ilike '%ring%' or smiles ilike '%ring%' or inchi ilike '%ring%' or filename ilike '%ring%' order by mol_id, filename limit 50")
def _(s):
    return A.text_search(s, "RING")


@named("q14_same_scaffold", "select mol_id, mol_name, murcko_id from molecules where murcko_id=(select murcko_id from molecules where mol_id=42)")
def _(s):
    return A.same_scaffold(s, 42)


@named("q15_create_model", "select * from class_models union all select (select max(model_id)+1 from class_models), 7, 'newtag', 'EXT', 'J48', 'u9', null")
def _(s):
    return A.create_model(s, 7, "newtag", "EXT", "J48", "u9")


@named("q15_create_known_model", "select * from class_models")
def _(s):
    known = s["class_models"].where("model_id = 3").first()
    return A.create_model(s, known.batch_id, known.class_tag, known.data_type, known.class_scheme, "u9")


@named("q16_delete_dataset", "select mol_id from molecules where mol_id not in (select mol_id from batchmols where batch_id=7)")
def _(s):
    return A.delete_dataset({k: s[k] for k in ROLES}, 7)["molecules"].select("mol_id")


@named("q17_dataset_predictions", "select pred_id, p.model_id, class_tag, pred_name from prediction_list p join class_models m on p.model_id=m.model_id where p.batch_id=7")
def _(s):
    return A.dataset_predictions(s, 7)


@named("q18_model_batches", "select pred_id, p.batch_id, filename from prediction_list p join batchlist b on p.batch_id=b.batch_id where model_id=3")
def _(s):
    return A.model_batches(s, 3)


@named("q19_job", "select pred_id, p.batch_id, filename, p.model_id, class_tag from prediction_list p join batchlist b on p.batch_id=b.batch_id join class_models m on m.model_id=p.model_id where pred_id=100")
def _(s):
    return A.job(s, 100)


@named("q20_results", "select r.pred_id, r.mol_id, mol_name, class_tag, main_class, lhood from prediction_mols r join prediction_list p on p.pred_id=r.pred_id join class_models m on m.model_id=p.model_id join molecules x on x.mol_id=r.mol_id where r.pred_id=100")
def _(s):
    return A.results(s, 100)


@named("q23_newest_batches", "select * from batchlist order by batch_id desc limit 10")
def _(s):
    return A.newest_batches(s, 10)


@named("q24_newest_models", "select model_id, class_tag, case when model_data is null then 0 else 1 end is_built from class_models order by model_id desc limit 100")
def _(s):
    return A.newest_models(s)


@named("q25_reviews", "select b.batch_id, filename, (select count(*) from batchmols x where x.batch_id=b.batch_id) n_mols, (select count(*) from class_models x where x.batch_id=b.batch_id) n_models from batchlist b where learn=1")
def _(s):
    return A.dataset_reviews(s)


@named("q26_queue", "select model_id, batch_id, class_tag from class_models where model_data is null")
def _(s):
    return A.queue_model(s)


@named("q27_latest_results", "select pred_id, mol_id, main_class, lhood from prediction_mols where pred_id=(select max(pred_id) from prediction_list where model_id=3)")
def _(s):
    return A.latest_results(s, 3)


@named("q28_jobs_for_all_models", "select model_id, 7::bigint batch_id, coalesce(p.pred_id, (select max(pred_id) from prediction_list) + row_number() over (partition by p.pred_id is null order by model_id)) pred_id, p.pred_id is null is_new from (select model_id from class_models where model_data is not null) m left join (select model_id, min(pred_id) pred_id from prediction_list where batch_id=7 group by 1) p using (model_id)")
def _(s):
    return A.jobs_for_all_models(s, 7)


@named("q29_hit_list", "select mol_id, mol_name, inchi_key from molecules where mol_id between 1 and 300 " + LAST.format("inchi_key", "mol_id"))
def _(s):
    return A.hit_list(s, list(range(1, 301)))


@named("q29_scaffold_hits", "select mol_id, mol_name, inchi_key from molecules where murcko_id=(select murcko_id from molecules where mol_id=42) " + LAST.format("inchi_key", "mol_id"))
def _(s):
    return A.hit_list(s, A.same_scaffold(s, 42).select(F.col("mol_id").alias("mol_id2")))


@named("q30_molecule_detail", "select x.mol_id, mol_name, r.pred_id, p.model_id, class_tag, p.batch_id, main_class, lhood from molecules x join (prediction_mols r join (prediction_list p join class_models m on m.model_id=p.model_id) on r.pred_id=p.pred_id) on x.mol_id=r.mol_id where x.mol_id=42 and p.model_id in (1,3,5)")
def _(s):
    return A.molecule_detail(s, 42, [1, 3, 5])


@named("q31_learn_batches", "select batch_id, filename, unnest(string_split(info, ' ')) tag from batchlist where learn=1")
def _(s):
    return A.learn_batches(s)


@named("q32_model_detail", "select m.model_id, class_tag, filename, pred_id, p.batch_id pred_batch from class_models m join batchlist b on m.batch_id=b.batch_id join prediction_list p on p.model_id=m.model_id where m.model_id=3")
def _(s):
    return A.model_detail(s, 3)


@named("q33_batch_detail", "select b.batch_id, filename, pred_id, p.model_id, class_tag, pred_name from batchlist b join prediction_list p on p.batch_id=b.batch_id join class_models m on m.model_id=p.model_id where b.batch_id=7")
def _(s):
    return A.batch_detail(s, 7)


@named("q34_export_batch", "select r.mol_id, mol_name, inchi_key, r.pred_id, class_tag, main_class, round(lhood,6) lhood from prediction_mols r join prediction_list p on p.pred_id=r.pred_id join class_models m on m.model_id=p.model_id join molecules x on x.mol_id=r.mol_id where p.batch_id=7")
def _(s):
    return A.export_batch(s, 7)


@named("q35_exact_screen", "select s.mol_id from statistics s join hashes h on s.mol_id=h.mol_id where n_atoms=20 and n_bonds>=8 and (hfp01 & 3)=3")
def _(s):
    return A.screen(s, "n_atoms:20;n_bonds:8;", {"hfp01": 3, "hfp02": 0}, {"n_atoms"}, most=10**6)


@named("b11_dictionary_hits", "select mol_id from hashes where (hfp01 & 96)=96")
def _(s):
    return A.dictionary_hits(s, {"hfp01": 96})


@named("q37_duplicates", "select q.p query_id, mol_id from (select p_size a, length(p_name) b, p_size % 7 c, p_partkey % 4 * 35 d, p_partkey % 3 e, p_partkey p from part where p_partkey < 200) q join statistics s on s.n_atoms=q.a and s.n_bonds=q.b and s.n_rings=q.c join hashes h using (mol_id) where hfp01=q.d and hfp02=q.e and mol_id<>q.p")
def _(s):
    asked = s["statistics"].where("mol_id < 200").join(s["hashes"], "mol_id")
    return A.find_duplicates(s["statistics"], s["hashes"], asked)


@named("q38_likelihoods", "select main_class, count(*) n, round(avg(ln((lhood+0.001)/(1.001-lhood))),6) mean from prediction_mols where pred_id in (select pred_id from prediction_list where model_id=3) and lhood is not null group by 1")
def _(s):
    return A.likelihoods(s, 3).groupBy("main_class").agg(F.count("*").alias("n"), F.round(F.avg("logit"), 6).alias("mean"))


@named("q38_histogram", "select main_class, least(floor((v+7.0)/((0.0+7.0)/50)),49)::int bin, count(*) n from (select main_class, ln((lhood+0.001)/(1.001-lhood)) v from prediction_mols where pred_id in (select pred_id from prediction_list where model_id=3) and lhood is not null) where v between -7.0 and 0.0 group by all")
def _(s):
    return A.histogram(A.likelihoods(s, 3), "logit", -7.0, 0.0, 50, "main_class")


@named("a12_density", "select main_class, x, round(avg(exp(-(((x-v)/0.5)**2)/2)/(0.5*2.5066282746310002)),6) density from (select main_class, ln((lhood+0.001)/(1.001-lhood)) v from prediction_mols where pred_id in (select pred_id from prediction_list where model_id=3) and lhood is not null), (select unnest([-6.0,-4.0,-2.0])::double x) group by all")
def _(s):
    return A.density(A.likelihoods(s, 3), "logit", [-6.0, -4.0, -2.0], 0.5, "main_class").withColumn("density", F.round("density", 6))


@named("m15_duplicate_model", "select model_id from class_models where batch_id=(select batch_id from class_models where model_id=3) and data_type='EXT' and class_scheme='RandomForest'")
def _(s):
    known = s["class_models"].where("model_id = 3").first()
    return A.model_exists(s, known.batch_id, known.class_tag, "EXT", "RandomForest")
