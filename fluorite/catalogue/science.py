"""Queries of learning: the labelled documents stand for a training batch, counts of characters for descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from .registry import Tables, query

FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def labelled(spark, path):
    """id, label (quality as text) and five character counts of every labelled document."""
    x = Tables(spark, path)
    text = F.coalesce("text", F.lit(""))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    counts = [F.length(text).cast("double"), without(" "), without("[0-9]"), without("\n"), without("e")]
    rows = x.labels.where("quality is not null").select("doc_id", F.col("quality").cast("string").alias("label"))
    return x.documents.join(rows, "doc_id").select(F.col("doc_id").alias("id"), "label", *(c.alias(f) for c, f in zip(counts, FEATURES)))


def every(f, sep=", "):
    return sep.join(f(c) for c in FEATURES)


FT = """raw as (select d.doc_id id, quality::varchar as label, coalesce(text,'') tx from documents d join labels l on d.doc_id=l.doc_id where quality is not null),
 ft as (select id, label, length(tx)::double f0, (length(tx)-length(replace(tx,' ','')))::double f1, (length(tx)-length(regexp_replace(tx,'[0-9]','','g')))::double f2,
  (length(tx)-length(replace(tx,chr(10),'')))::double f3, (length(tx)-length(replace(tx,'e','')))::double f4 from raw)"""
NB = f"""{FT}, st as (select label, count(*) n, {every(lambda c: f'avg({c}) m{c}, greatest(stddev_pop({c}),0.001) s{c}')} from ft group by label),
 tot as (select sum(n) t, count(*) k from st),
 lp as (select ft.id, ft.label, st.label c, ln((n+1)/(t+k)) + {every(lambda c: f'(-((({c}-m{c})/s{c})**2)/2 - ln(s{c}))', ' + ')} v from ft, st, tot),
 top as (select id, label, c, v, max(v) over (partition by id) mx, row_number() over (partition by id order by v desc, c) r, sum(exp(v)) over (partition by id) from lp),
 pred as (select id, label, max(case when r=1 then c end) predicted, 1/sum(exp(v-mx)) strength from top group by id, label)"""


@query("m4_remove_useless", f"with {FT} select c as column_name from (" + " union all ".join(f"select '{c}' c, min({c})<max({c}) varied from ft" for c in FEATURES) + ") where varied")
def _(s, d):
    kept = L.remove_useless(labelled(s, d).withColumn("fixed", F.lit(1.0)), [*FEATURES, "fixed"])
    return s.createDataFrame([(c,) for c in kept], "column_name string")


@query("m6_correlation_subset")
def _(s, d):
    return s.createDataFrame([(c,) for c in L.select_by_correlation(labelled(s, d), FEATURES)], "column_name string")


@query("m6_relief_weights")
def _(s, d):
    return s.createDataFrame(list(L.relief_weights(labelled(s, d), FEATURES).items()), "column_name string, weight double")


@query("m7_spread_subsample", f"with {FT}, n as (select label, count(*) n from ft group by label) select label, least(n, floor(1.5*(select min(n) from n)))::bigint n_kept from n")
def _(s, d):
    return L.spread_subsample(labelled(s, d), most=1.5).groupBy("label").agg(F.count("*").alias("n_kept"))


@query("m7_smote", f"with {FT}, n as (select label, count(*) n from ft group by label) select label, (case when label=(select label from n order by n, label limit 1) then 2*n else n end)::bigint n_rows from n")
def _(s, d):
    return L.smote(labelled(s, d), FEATURES).groupBy("label").agg(F.count("*").alias("n_rows"))


@query("m9_cross_validation")
def _(s, d):
    return L.cross_validate(labelled(s, d).persist(), FEATURES, "NaiveBayes").select("id", "label", "predicted", "strength")


@query("m10_confusion", f"with {NB} select label, predicted, count(*) n from pred group by label, predicted")
def _(s, d):
    x = labelled(s, d)
    return L.confusion(L.naive_bayes(x, FEATURES).predict(x, ["label"]))


@query("m10_class_report", f"with {NB}, k as (select distinct label c from pred union select distinct predicted from pred), z as (select c, count(*) filter (label=c) a, count(*) filter (predicted=c) b, count(*) filter (label=c and predicted=c) h from k, pred group by c) select c as class, a n_rows, b n_predicted, round(case when b>0 then h/b end,6) as precision, round(case when a>0 then h/a end,6) recall, round(2*h/(a+b),6) f_measure from z")
def _(s, d):
    x = labelled(s, d)
    report = L.class_report(L.naive_bayes(x, FEATURES).predict(x, ["label"]))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f_measure")})


@query("m10_summary", f"with {NB}, z as (select count(*) n, count(*) filter (label=predicted) h from pred), e as (select sum(a*1.0*b) x from (select label c, count(*) a from pred group by 1) join (select predicted c, count(*) b from pred group by 1) using (c)) select n, h correct, round(h/n,6) accuracy, round((h/n-x::double/(n::double*n))/(1-x::double/(n::double*n)),6) kappa from z, e")
def _(s, d):
    x = labelled(s, d)
    return L.summary(L.naive_bayes(x, FEATURES).predict(x, ["label"])).withColumns({c: F.round(c, 6) for c in ("accuracy", "kappa")})


KNN = f"""{FT}, r as (select {every(lambda c: f'min({c}) a{c}, case when max({c})>min({c}) then max({c})-min({c}) else 1.0 end b{c}')} from ft),
 sc as (select id, label, {every(lambda c: f'({c}-a{c})/b{c} {c}')} from ft, r),
 w as (select q.id, q.label, x.label v, x.id t, {every(lambda c: f'(q.{c}-x.{c})*(q.{c}-x.{c})', ' + ')} away from sc q join sc x on q.id<>x.id),
 nn as (select *, row_number() over (partition by id order by away, t) k from w),
 vt as (select id, label, v, count(*) n from nn where k<=25 group by all),
 pk as (select *, row_number() over (partition by id order by n desc, v) k, sum(n) over (partition by id) al from vt)
 select id, label, v predicted, round(n/al,6) strength from pk where k=1"""


@query("m12_strength", f"with {NB} select id, label, predicted, round(strength,4) strength from pred")
def _(s, d):
    x = labelled(s, d)
    return L.naive_bayes(x, FEATURES).predict(x, ["id", "label"]).select("id", "label", "predicted", F.round("strength", 4).alias("strength"))


@query("m25_knn_25", "with " + KNN)
def _(s, d):
    x = labelled(s, d)
    return L.CLASSIFIERS["KNN25"](x, FEATURES).predict(x, ["id", "label"]).select("id", "label", "predicted", F.round("strength", 6).alias("strength"))


HNB = f"""{FT}, u as (select id, label, unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) f, unnest([{every(str)}]) x from ft),
 qs as (select f, max(x) mx, unnest(quantile_disc(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) c from u group by f),
 cuts as (select distinct f, c from qs where c < mx),
 b as (select u.id, u.label, u.f, count(*) filter (cuts.c < u.x) b from u join cuts using (f) group by all),
 sz as (select f, count(*)+1 s from cuts group by f), nc as (select label, count(*) n from ft group by label),
 c1 as (select f, b, label, count(*) n from b group by all),
 c2 as (select p.f f, p.b b, q.f g, q.b d, p.label label, count(*) n from b p join b q on p.id=q.id and p.f<>q.f group by all),
 mi as (select c2.f, c2.g, greatest(sum(c2.n/(select count(*) from ft)*ln(c2.n*nc.n/(x.n*y.n))),0) w from c2 join nc on nc.label=c2.label join c1 x on x.f=c2.f and x.b=c2.b and x.label=c2.label join c1 y on y.f=c2.g and y.b=c2.d and y.label=c2.label group by all),
 w as (select f, g, w/sum(w) over (partition by f) w from mi),
 pr as (select p.id, p.label truth, p.f, nc.label, sum(w.w*(coalesce(c2.n,0)+1.0/sz.s)/(coalesce(y.n,0)+1)) v from b p join b q on p.id=q.id and p.f<>q.f cross join nc join w on w.f=p.f and w.g=q.f join sz on sz.f=p.f
  left join c2 on c2.f=p.f and c2.b=p.b and c2.g=q.f and c2.d=q.b and c2.label=nc.label left join c1 y on y.f=q.f and y.b=q.b and y.label=nc.label group by all),
 lp as (select id, truth, pr.label, sum(ln(v)) + ln((any_value(nc.n)+1.0/(select count(*) from nc))/((select count(*) from ft)+1)) v from pr join nc on nc.label=pr.label group by id, truth, pr.label),
 pk as (select *, row_number() over (partition by id order by v desc, label) r, max(v) over (partition by id) mx from lp)
 select id, truth as label, max(case when r=1 then label end) predicted, round(1/sum(exp(v-mx)),4) strength from pk group by id, truth"""


@query("m33_hidden_bayes", "with " + HNB)
def _(s, d):
    x = labelled(s, d)
    return L.hidden_bayes(x, FEATURES).predict(x, ["id", "label"]).select("id", "label", "predicted", F.round("strength", 4).alias("strength"))


def _register(name, scheme):
    @query(name)
    def _(s, d):
        x = labelled(s, d).persist()  # fitting passes over it many times
        return L.build(x, FEATURES, scheme, selection="none", balance=False).predict(x, ["id", "label"]).select("id", "label", "predicted", "strength")


for _name, _scheme in {
    "m20_random_forest": "RandomForest", "m21_lmt": "LMT", "m25_knn": "KNN", "m26_j48": "J48", "m28_logitboost": "LogitBoost", "m32_nbtree": "NBTree",
    "m22_libsvm": "LibSVM", "m23_libsvm2": "LibSVM2", "m24_smo": "SMO", "m27_real_adaboost": "realAdaBoost", "m29_raced_logitboost": "RacedIncrementalLogitBoost", "m30_ensemble": "Ensemble",
    "m34_decision_table_bayes": "DecisionTreeNaiveBayes",
}.items():
    _register(_name, _scheme)
