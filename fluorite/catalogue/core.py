"""Queries of projections, joins, aggregates, windows, top-k, sets, scalars, writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import scalars as X
from ..operators import similarity as S
from ..operators import store as K
from .registry import FP, PAIRS, Tables, fingerprints, query

R = lambda c, n=6: F.round(c, n)


def t(spark, d):
    return Tables(spark, d)


# ------------------------------------------------------------------------------------------- projections, filters
@query("p1_optional_filters", "select p_partkey, p_name from part where p_brand='Brand#1' and p_size>=10 union all select p_partkey, p_name from part where 1=0")
def _(s, d):
    conditions = {"p_brand": "Brand#1", "p_type": None}
    return t(s, d).part.where(X.all_of(*(F.col(k) == v if v is not None else None for k, v in conditions.items()), F.col("p_size") >= 10)).select("p_partkey", "p_name")


@query("p2_ownership", "select c_custkey, c_mktsegment username from customer where c_mktsegment <> 'BUILDING'")
def _(s, d):
    return t(s, d).customer.select("c_custkey", F.col("c_mktsegment").alias("username")).where(X.matches("other", "BUILDING"))


@query("p3_text_search", "select c_custkey, c_name, o_orderkey from customer left join orders on c_custkey=o_custkey where c_name ilike '%00_1%' or c_mktsegment ilike '%mach%' or o_orderpriority ilike '%urg%'")
def _(s, d):
    x = t(s, d)
    like = F.col("c_name").ilike("%00_1%") | F.col("c_mktsegment").ilike("%mach%") | F.col("o_orderpriority").ilike("%urg%")
    return x.customer.join(x.orders, F.col("c_custkey") == F.col("o_custkey"), "left").where(like).select("c_custkey", "c_name", "o_orderkey")


@query("p4_key_match", "select p_partkey, lpad(p_partkey::varchar,8,'0') shown from part where lpad(p_partkey::varchar,8,'0') ilike '0000012%'")
def _(s, d):
    shown = X.zero_filled(F.col("p_partkey"))
    return t(s, d).part.where(shown.ilike("0000012%")).select("p_partkey", shown.alias("shown"))


@query("p5_work_pending", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus='F')")
def _(s, d):
    x = t(s, d)
    return K.missing_from(x.customer.select("c_custkey"), x.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("p6_training_rows", "select event_id, props from events where props is not null and props <> ''")
def _(s, d):
    return t(s, d).events.where(F.col("props").isNotNull() & (F.col("props") != "")).select("event_id", "props")


@query("p7_descriptor_present", "select l_orderkey, l_linenumber from lineitem where l_tax is not null and l_tax <> 0")
def _(s, d):
    return t(s, d).lineitem.where("l_tax is not null and l_tax <> 0").select("l_orderkey", "l_linenumber")


@query("p8_id_list", "select p_partkey, p_name from part where p_partkey in (1,5,9,77)")
def _(s, d):
    return t(s, d).part.where(F.col("p_partkey").isin(1, 5, 9, 77)).select("p_partkey", "p_name")


@query("p9_semi_join", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment='BUILDING')")
def _(s, d):
    x = t(s, d)
    return x.orders.join(x.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("p10_key_range", "select o_orderkey, o_totalprice from orders where o_orderkey between 100 and 400")
def _(s, d):
    return t(s, d).orders.where(F.col("o_orderkey").between(100, 400)).select("o_orderkey", "o_totalprice")


@query("p11_bit_containment", "select l_orderkey, l_linenumber from lineitem where (l_orderkey & 5)=5 and (l_partkey & 3)=3")
def _(s, d):
    return t(s, d).lineitem.where(B.words_contain([F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")], [5, 0, 3])).select("l_orderkey", "l_linenumber")


@query("p12_count_dominance", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 30 and l_linenumber >= 3 and l_suppkey = 7")
def _(s, d):
    return t(s, d).lineitem.where(X.bounds_from("l_quantity:30;l_linenumber:3;l_suppkey:7;", {"l_suppkey"})).select("l_orderkey", "l_linenumber")


@query("p13_exact_duplicates", "select a.p_partkey a, b.p_partkey b from part a join part b on a.p_brand=b.p_brand and a.p_type=b.p_type and a.p_size=b.p_size and a.p_partkey<b.p_partkey")
def _(s, d):
    p = t(s, d).part
    a, b = (p.select(F.col("p_partkey").alias(k), "p_brand", "p_type", "p_size") for k in "ab")
    return a.join(b, ["p_brand", "p_type", "p_size"]).where("a < b").select("a", "b")


@query("p16_text_pattern_count", r"select page_id, len(list_filter(string_split(html, chr(10)), lambda x: contains(x, '<p>'))) n from pages")
def _(s, d):
    return t(s, d).pages.select("page_id", F.size(F.filter(F.split("html", "\n"), lambda x: x.contains("<p>"))).cast("long").alias("n"))


@query("p19_link_columns", "select o_orderkey, concat('order=', o_orderkey) link from orders")
def _(s, d):
    return t(s, d).orders.select("o_orderkey", F.concat(F.lit("order="), F.col("o_orderkey").cast("string")).alias("link"))


@query("p20_is_built", "select d.doc_id, case when l.quality is null then 0 else 1 end is_built from documents d left join labels l using (doc_id)")
def _(s, d):
    x = t(s, d)
    return x.documents.select("doc_id").join(x.labels, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), 0).otherwise(1).alias("is_built"))


# --------------------------------------------------------------------------------------------------------- joins
@query("j1_three_way", "select c_custkey, o_orderkey, l_linenumber from customer, orders, lineitem where c_custkey=o_custkey and o_orderkey=l_orderkey and l_quantity>45")
def _(s, d):
    x = t(s, d)
    return x.lineitem.where("l_quantity > 45").join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(x.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "l_linenumber")


@query("j2_batch_results", "select n_name, count(*) n, round(sum(l_extendedprice),2) total from nation join customer on n_nationkey=c_nationkey join orders on c_custkey=o_custkey join lineitem on o_orderkey=l_orderkey group by n_name")
def _(s, d):
    x = t(s, d)
    j = x.lineitem.join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(x.customer, F.col("o_custkey") == F.col("c_custkey")).join(x.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("j3_left_chain", "select c_custkey, o_orderkey, l_linenumber from customer left join orders on c_custkey=o_custkey left join lineitem on o_orderkey=l_orderkey and l_returnflag='R'")
def _(s, d):
    x = t(s, d)
    right = x.lineitem.where("l_returnflag = 'R'")
    return x.customer.join(x.orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(right, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("c_custkey", "o_orderkey", "l_linenumber")


@query("j4_right_deep", "select s_suppkey, n_name, r_name from supplier join (nation join region on n_regionkey=r_regionkey) on s_nationkey=n_nationkey")
def _(s, d):
    x = t(s, d)
    inner = x.nation.join(x.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.supplier.join(inner, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j6_similarity_join", f"with {PAIRS} select a mol_id1, b mol_id2, round(c/(na+nb-c),6) score from pairs where c/(na+nb-c) >= 0.85")
def _(s, d):
    fp = fingerprints(t(s, d))
    return S.similarity_join(fp, fp, 0.85).withColumn("score", R(F.col("score")))


@query("j6_similarity_join_prefix", f"with {PAIRS} select a mol_id1, b mol_id2, round(c/(na+nb-c),6) score from pairs where c/(na+nb-c) >= 0.9")
def _(s, d):
    fp = fingerprints(t(s, d))
    return S.similarity_join(fp, fp, 0.9, "prefix").withColumn("score", R(F.col("score")))


@query("j8_substructure_screen", f"with {FP}, q as (select list_slice(bits,1,12) bits from fp where id=3) select id mol_id from fp, q where list_has_all(fp.bits, q.bits) order by id limit 100")
def _(s, d):
    fp = fingerprints(t(s, d))
    q = fp.where("id = 3").select(F.slice("bits", 1, 12).alias("q"))
    return S.substructure_screen(fp.crossJoin(F.broadcast(q)), F.col("q"))


@query("j9_pending_pairs", "select n_nationkey, s_suppkey from nation, supplier anti join (select distinct c_nationkey, c_custkey from customer) x on n_nationkey=c_nationkey and s_suppkey=c_custkey")
def _(s, d):
    x = t(s, d)
    done = x.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("s_suppkey")).distinct()
    return K.pending_pairs(x.nation.select("n_nationkey"), x.supplier.select("s_suppkey"), done, ["n_nationkey", "s_suppkey"])


@query("j10_all_models_new_batch", "select r_regionkey, n_nationkey from region, nation")
def _(s, d):
    x = t(s, d)
    return x.region.select("r_regionkey").crossJoin(x.nation.select("n_nationkey"))


@query("j13_same_scaffold", "select a.p_partkey, b.p_partkey member from part a join part b using (p_brand) where a.p_partkey=7")
def _(s, d):
    p = t(s, d).part
    own = p.where("p_partkey = 7").select("p_partkey", "p_brand")
    return p.select(F.col("p_partkey").alias("member"), "p_brand").join(F.broadcast(own), "p_brand").select("p_partkey", "member")


@query("j15_certainty", f"with {FP}, tr as (select fp.* from fp join labels on id=doc_id where quality=1), p as (select q.id mol_id, x.id tid, len(list_intersect(q.bits,x.bits)) c, len(q.bits) na, len(x.bits) nb from fp q, tr x where q.id<>x.id), s as (select mol_id, c/(na+nb-c) v, row_number() over (partition by mol_id order by c/(na+nb-c) desc, tid) r from p) select mol_id, round(avg(v),6) certainty_score from s where r<=5 group by mol_id")
def _(s, d):
    x = t(s, d)
    fp = fingerprints(x)
    train = fp.join(x.labels.where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "words", "n")
    return S.certainty(fp, train).withColumn("certainty_score", R(F.col("certainty_score")))


# ---------------------------------------------------------------------------------------------------- aggregates
@query("a1_counts", "select count(*) n, count(distinct l_orderkey) orders from lineitem")
def _(s, d):
    return t(s, d).lineitem.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query("a2_next_key", "select coalesce(max(o_orderkey),0)+1 next_key from orders")
def _(s, d):
    return K.next_key(t(s, d).orders, "o_orderkey")


@query("a3_distinct", "select distinct l_returnflag from lineitem")
def _(s, d):
    return t(s, d).lineitem.select("l_returnflag").distinct()


@query("a4_any_row_fixed", "select o_custkey, o_orderstatus, min(o_orderkey) o_orderkey, arg_min(o_totalprice, o_orderkey) o_totalprice from orders group by all")
def _(s, d):
    return t(s, d).orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("a5_one_per_structure", "select p_partkey, p_type from (select *, row_number() over (partition by p_type order by p_partkey) r from part) where r=1")
def _(s, d):
    return K.one_per_key(t(s, d).part, "p_type", "p_partkey").select("p_partkey", "p_type")


@query("a6_popcount_sum", "select p_brand, sum(bit_count(p_partkey & 255))::bigint n from part group by 1")
def _(s, d):
    return t(s, d).part.groupBy("p_brand").agg(F.sum(F.bit_count(F.col("p_partkey").bitwiseAND(F.lit(255)))).alias("n"))


@query("a7_squared_differences", "select l_orderkey, l_linenumber, (l_linenumber-3)**2 + (l_suppkey-5)**2 diffsum from lineitem order by 3,1,2 limit 100")
def _(s, d):
    x = t(s, d).lineitem
    return x.select("l_orderkey", "l_linenumber", S.squared_distance(["l_linenumber", "l_suppkey"], {"l_linenumber": 3, "l_suppkey": 5}).alias("diffsum")).orderBy("diffsum", "l_orderkey", "l_linenumber").limit(100)


@query("a9_class_labels", "select string_agg(v, chr(9) order by v) || chr(9) class_labels from (select distinct l_returnflag v from lineitem)")
def _(s, d):
    labels = F.array_sort(F.collect_set("l_returnflag"))  # the labels of one class attribute
    return t(s, d).lineitem.agg(F.concat(F.array_join(labels, "\t"), F.lit("\t")).alias("class_labels"))


@query("a10_widest_value", "select event_type, max(length(props)) width, count(*) n from events group by 1")
def _(s, d):
    return t(s, d).events.groupBy("event_type").agg(F.max(F.length("props")).cast("long").alias("width"), F.count("*").alias("n"))


@query("a11_score_pivot", "select l_orderkey, max(case when l_linenumber=1 then l_discount end) model_1, max(case when l_linenumber=2 then l_discount end) model_2, max(case when l_linenumber=3 then l_discount end) model_3 from lineitem group by 1")
def _(s, d):
    p = t(s, d).lineitem.groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_discount"))
    return p.select("l_orderkey", *(F.col(str(k)).alias(f"model_{k}") for k in (1, 2, 3)))


@query("a12_histogram", "select l_returnflag, least(floor(l_discount*500/10.0)::int, 49) bin, count(*) n from lineitem group by all")
def _(s, d):
    return t(s, d).lineitem.groupBy("l_returnflag", F.least(F.floor(F.col("l_discount") * 500 / 10.0).cast("int"), F.lit(49)).alias("bin")).agg(F.count("*").alias("n"))


@query("a13_class_likelihoods", "select l_returnflag main_class, round(avg(ln((l_discount+0.001)/(1.001-l_discount))),6) mean_llh, count(*) n from lineitem where l_discount is not null group by 1")
def _(s, d):
    return t(s, d).lineitem.where("l_discount is not null").groupBy(F.col("l_returnflag").alias("main_class")).agg(R(F.avg(X.log_odds(F.col("l_discount")))).alias("mean_llh"), F.count("*").alias("n"))


@query("a14_confusion", "select quality actual, toxic predicted, count(*) n from labels group by all")
def _(s, d):
    return t(s, d).labels.groupBy(F.col("quality").alias("actual"), F.col("toxic").alias("predicted")).agg(F.count("*").alias("n"))


@query("a15_largest_component", "select l_orderkey, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) r from lineitem) where r=1")
def _(s, d):
    return t(s, d).lineitem.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct(F.col("l_quantity"), -F.col("l_linenumber"), -F.col("l_partkey"))).alias("l_partkey"))


# -------------------------------------------------------------------------------------------------------- windows
@query("w1_surrogate_keys", "select p_partkey, row_number() over (order by p_partkey) + 1000 mol_id from part where p_size > 5")
def _(s, d):
    return K.assign_keys(t(s, d).part.where("p_size > 5").select("p_partkey"), "p_partkey", 1001)


@query("w2_top5", "select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) r from lineitem) where r<=5")
def _(s, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t(s, d).lineitem.withColumn("r", F.row_number().over(w)).where("r <= 5").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("w3_latest_prediction", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) r from orders) where r=1")
def _(s, d):
    return K.latest(t(s, d).orders, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("w6_unique_names", "select p_partkey, case when row_number() over (partition by p_name order by p_partkey)>1 then p_name||'_'||p_partkey else p_name end p_name from part")
def _(s, d):
    return K.unique_names(t(s, d).part.select("p_partkey", "p_name"), "p_name", "p_partkey")


# ---------------------------------------------------------------------------------------------------------- top-k
@query("q13_similar", f"with {FP}, q as (select bits from fp where id=0) select fp.id mol_id, round(len(list_intersect(fp.bits,q.bits))/(len(fp.bits)+len(q.bits)-len(list_intersect(fp.bits,q.bits))),6) score from fp, q where fp.id<>0 order by len(list_intersect(fp.bits,q.bits))/(len(fp.bits)+len(q.bits)-len(list_intersect(fp.bits,q.bits))) desc, fp.id limit 20")
def _(s, d):
    fp = fingerprints(t(s, d))
    q = F.broadcast(fp.where("id = 0").select(F.col("bits").alias("q")))  # one row
    return S.similarity_search(fp.where("id <> 0").crossJoin(q), F.col("q"), 0.0, 20).withColumn("score", R(F.col("score")))


@query("q22_similarity_threshold", f"with {FP}, q as (select bits from fp where id=5) select fp.id mol_id, round(len(list_intersect(fp.bits,q.bits))/(len(fp.bits)+len(q.bits)-len(list_intersect(fp.bits,q.bits))),6) score from fp, q where len(list_intersect(fp.bits,q.bits))/(len(fp.bits)+len(q.bits)-len(list_intersect(fp.bits,q.bits))) >= 0.3 order by 2 desc, 1 limit 100")
def _(s, d):
    fp = fingerprints(t(s, d))
    q = F.broadcast(fp.where("id = 5").select(F.col("bits").alias("q")))
    return S.similarity_search(fp.crossJoin(q), F.col("q"), 0.3, 100).withColumn("score", R(F.col("score")))


@query("q36_blended", "with n as (select l_orderkey*10+l_linenumber k, (l_linenumber-3)**2+(l_suppkey-5)**2 diffsum, * from lineitem order by 2,1 limit 5000), f as (select k, diffsum, l_partkey&255 h, l_orderkey&63 g from n where diffsum<=300), s as (select k, diffsum, (0.5*bit_count(h&173)::double/(bit_count(h)+bit_count(173)-bit_count(h&173)) + 0.5*bit_count(g&37)::double/(bit_count(g)+bit_count(37)-bit_count(g&37)))*(300-diffsum)/300 score from f) select k, diffsum, round(score,6) score from s where score>=0.5 order by s.score desc, k limit 250")
def _(s, d):
    x = t(s, d).lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_linenumber", "l_suppkey", F.col("l_partkey").bitwiseAND(F.lit(255)).alias("h"), F.col("l_orderkey").bitwiseAND(F.lit(63)).alias("g"))
    return S.blended_search(x, "k", {"l_linenumber": 3, "l_suppkey": 5}, {"h": 173}, {"g": 37}).withColumn("score", R(F.col("score")))


@query("t6_paging", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def _(s, d):
    return t(s, d).orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("t8_newest_first", "select o_orderkey, o_orderstatus from orders order by o_orderkey desc limit 100")
def _(s, d):
    return t(s, d).orders.select("o_orderkey", "o_orderstatus").orderBy(F.desc("o_orderkey")).limit(100)


# ----------------------------------------------------------------------------------------------- sets, resolution
@query("u1_resolve_identifier", "select mol_id from (select 1 p, min(p_partkey) mol_id from part where p_partkey::varchar='17' union all select 2, min(p_partkey) from part where p_name='17' union all select 3, min(p_partkey) from part where p_type='17') where mol_id is not null order by p limit 1")
def _(s, d):
    from ..operators.search import resolve_compound

    return resolve_compound(t(s, d).part, "17", "p_partkey", ["p_name", "p_type"])


@query("u2_bit_algebra", f"with {FP}, q as (select bits from fp where id=1) select fp.id, len(list_intersect(fp.bits,q.bits)) shared, len(list_distinct(list_concat(fp.bits,q.bits))) united, len(fp.bits)-len(list_intersect(fp.bits,q.bits)) rest from fp, q")
def _(s, d):
    fp = fingerprints(t(s, d))
    q = F.broadcast(fp.where("id = 1").select(F.col("bits").alias("q")))
    n = lambda c: F.size(c).cast("long")
    b, q_ = F.col("bits"), F.col("q")
    return fp.crossJoin(q).select("id", n(B.intersection(b, q_)).alias("shared"), n(B.union(b, q_)).alias("united"), n(B.difference(b, q_)).alias("rest"))


# --------------------------------------------------------------------------------------------------- bits, scalars
@query("b3_render_bits", f"with {FP} select id, '{{' || array_to_string(bits, ', ') || '}}' shown from fp")
def _(s, d):
    return fingerprints(t(s, d)).select("id", B.render(F.col("bits")).alias("shown"))


@query("b1_parse_bits", f"with {FP} select id, len(bits) n, bits[1]::int low from fp")
def _(s, d):
    parsed = B.parse(B.render(F.col("bits")))
    return fingerprints(t(s, d)).select("id", F.size(parsed).cast("long").alias("n"), F.try_element_at(parsed, F.lit(1)).alias("low"))


@query("b8_word_tanimoto", "select p_partkey, round(bit_count(p_partkey&1365)::double/(bit_count(p_partkey)+bit_count(1365)-bit_count(p_partkey&1365)),6) score from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", R(B.word_tanimoto([F.col("p_partkey")], [F.lit(1365)])).alias("score"))


@query("f8_log_odds", "select l_orderkey, l_linenumber, round(ln((l_discount+0.001)/(1.001-l_discount)),6) lhood from lineitem")
def _(s, d):
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", R(X.log_odds(F.col("l_discount"))).alias("lhood"))


@query("f9_likelihood_bar", "select l_orderkey, l_linenumber, round(30+v*60/14,6) pixels, case when 30+v*60/14>=30 then 'green' else 'red' end colour from (select *, ln((l_discount+0.001)/(1.001-l_discount)) v from lineitem)")
def _(s, d):
    pixels, colour = X.likelihood_bar(X.log_odds(F.col("l_discount")))
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", R(pixels).alias("pixels"), colour.alias("colour"))


@query("f10_certainty_bucket", "select l_orderkey, l_linenumber, case when l_tax*10>=0.7 then 'High' when l_tax*10>=0.4 then 'Medium' else 'Low' end bucket from lineitem")
def _(s, d):
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", X.certainty_bucket(F.col("l_tax") * 10).alias("bucket"))


@query("f13_four_decimals", "select p_partkey, printf('%.4f', p_size/8.0) shown from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", F.format_string("%.4f", F.col("p_size") / 8.0).alias("shown"))


@query("f14_normalise", "select p_partkey, replace(replace(replace(p_type,' ','_'),'-','_'),'.','_') v from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", F.translate("p_type", " -.", "___").alias("v"))


@query("f17_split_distribution", "select l_orderkey, l_linenumber, round(l_discount,6) p0, round(1-l_discount,6) p1 from lineitem")
def _(s, d):
    text = F.concat(F.col("l_discount").cast("string"), F.lit("\t"), F.round(1 - F.col("l_discount"), 8).cast("string"), F.lit("\t"))
    p = X.distribution(text)
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", R(p[0]).alias("p0"), R(p[1]).alias("p1"))


@query("f18_pad_right", "select p_partkey, rpad(p_brand,15,' ') v from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", X.pad_right(F.col("p_brand"), 15).alias("v"))


@query("f23_infer_type", "select p_partkey, case when regexp_full_match(v,'[+-]?[0-9]+') then 'int' when regexp_full_match(v,'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then 'float' else 'string' end kind from (select p_partkey, case p_partkey%3 when 0 then p_size::varchar when 1 then p_size::varchar||'.5' else p_name end v from part)")
def _(s, d):
    v = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_name"))
    return t(s, d).part.select("p_partkey", X.infer_type(v).alias("kind"))


@query("f24_width_bucket", "select doc_id, case when n<5 then 'VARCHAR(10)' when n<10 then 'VARCHAR(20)' when n<25 then 'VARCHAR(50)' when n<50 then 'VARCHAR(100)' when n<100 then 'VARCHAR(200)' when n<200 then 'VARCHAR(255)' else 'TEXT' end declared from (select doc_id, length(text) n from documents)")
def _(s, d):
    return t(s, d).documents.select("doc_id", X.varchar_bucket(F.length("text")).alias("declared"))


@query("f26_first_name", "select o_orderkey, coalesce(nullif(trim(case when o_orderkey%2=0 then '' else o_orderpriority end),''), 'Mol_'||o_orderkey) name from orders")
def _(s, d):
    tag = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority"))
    return t(s, d).orders.select("o_orderkey", X.first_named(tag, F.concat(F.lit("Mol_"), F.col("o_orderkey").cast("string"))).alias("name"))


# --------------------------------------------------------------------------------------------------------- writes
@query("k4_upsert", "select c_custkey, c_acctbal from customer where c_custkey%10<>0 union all select c_custkey, 0.0 from customer where c_custkey%10=0")
def _(s, d):
    old = t(s, d).customer.select("c_custkey", "c_acctbal")
    return K.upsert(old, old.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("k5_insert_or_ignore", "select c_custkey, c_nationkey from customer union all select s_suppkey+1400, s_nationkey from supplier where s_suppkey+1400 not in (select c_custkey from customer)")
def _(s, d):
    x = t(s, d)
    new = x.supplier.select((F.col("s_suppkey") + 1400).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return K.insert_or_ignore(x.customer.select("c_custkey", "c_nationkey"), new, ["c_custkey"])


@query("k7_update_columns", "select p_partkey, case when p_partkey<50 then p_size+1 else p_size end p_size from part")
def _(s, d):
    old = t(s, d).part.select("p_partkey", "p_size")
    return K.update_columns(old, old.where("p_partkey < 50").withColumn("p_size", F.col("p_size") + 1), ["p_partkey"], ["p_size"])


@query("k9_delete_batch", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey=3)")
def _(s, d):
    x = t(s, d)
    members = x.customer.select(F.col("c_custkey").alias("mol_id"), F.col("c_nationkey").alias("batch_id"))
    return K.delete_batch({"o": x.orders.withColumnRenamed("o_custkey", "mol_id")}, members, 3)["o"].select("o_orderkey")


@query("k11_add_column", "select p_partkey, null::double logp from part")
def _(s, d):
    return K.add_column(t(s, d).part.select("p_partkey"), "logp", "double")


@query("k14_json_hits", "select '[' || string_agg('{\"id\":' || p_partkey || '}', ',' order by p_partkey) || ']' hits from part where p_partkey<=10")
def _(s, d):
    hits = t(s, d).part.where("p_partkey <= 10").agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("id")))).alias("h"))  # a bounded hit list
    return hits.select(F.to_json("h").alias("hits"))
