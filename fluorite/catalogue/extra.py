"""Operators that the other modules don't register: scalars, bit sets, reports, SD files and job tables, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import scalars as X
from ..operators import jobs as R
from ..operators import similarity as S
from ..operators import store as K
from ..sources import sdf
from .registry import FP, Tables, fingerprints, query

t = Tables
RECORD = """'mol ' || p_partkey || chr(10) || '  x' || chr(10) || chr(10) || '  1  0  0' || chr(10) || '    0.0000    0.0000    0.0000 C' || chr(10) || 'M  END' || chr(10)
 || '> <NAME>' || chr(10) || p_name || chr(10) || chr(10) || '>  <SIZE> (1)' || chr(10) || p_size || chr(10) || 'second' || chr(10) || chr(10)"""


def records(s, d):
    """SD records made of the rows of part."""
    text = "concat('mol ', p_partkey, '\\n  x\\n\\n  1  0  0\\n    0.0000    0.0000    0.0000 C\\nM  END\\n> <NAME>\\n', p_name, '\\n\\n>  <SIZE> (1)\\n', p_size, '\\nsecond\\n\\n')"
    return t(s, d).part.select("p_partkey", F.expr(text).alias("record"))


# ------------------------------------------------------------------------------------------------------- scalars
@query("f2_number_text", "select p_partkey, round(p_retailprice, 6) rounded, format('{:,.3f}', p_retailprice) as text from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", F.round("p_retailprice", 6).alias("rounded"), X.number_text(F.col("p_retailprice")).alias("text"))


@query("f3_ceil", "select l_orderkey, l_linenumber, ceil(l_quantity / 7)::bigint c from lineitem")
def _(s, d):
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", F.ceil(F.col("l_quantity") / 7).alias("c"))


@query("f6_shift_and", "select o_orderkey, (o_orderkey >> 3) & 5 v from orders")
def _(s, d):
    return t(s, d).orders.select("o_orderkey", F.shiftright("o_orderkey", 3).bitwiseAND(F.lit(5)).alias("v"))


@query("f11_percent", "select l_orderkey, l_linenumber, format('{:.1f}', l_discount * 100) p from lineitem")
def _(s, d):
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", X.percent_text(F.col("l_discount")).alias("p"))


@query("f12_decimal_text", r"select l_orderkey, l_linenumber, regexp_replace(format('{:.8f}', l_quantity / 64), '\.?0+$', '') v from lineitem")
def _(s, d):
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", X.decimal_text(F.col("l_quantity") / 64).alias("v"))


@query("f14_descriptor_name", "select p_partkey, case when p_partkey % 2 = 0 then 'TopoPSA_' || replace(p_type,'-','_') else 'x_TPSA' end v from part")
def _(s, d):
    name = F.expr("case when p_partkey % 2 = 0 then concat('TPSA.', p_type) else 'x-TPSA' end")
    return t(s, d).part.select("p_partkey", X.descriptor_name(name).alias("v"))


@query("f19_sanitise", "select page_id, left(regexp_replace(replace(replace(translate(url,'''\"','``'),'--','~~'),';','~~'),'select|insert|update|delete|drop|union','','gi'),40) v from pages")
def _(s, d):
    return t(s, d).pages.select("page_id", X.sanitise(F.col("url")).alias("v"))


@query("f20_breaks", "select doc_id, replace(left(text,200), chr(10), '<br />' || chr(10)) v from documents where text not like '%' || chr(13) || '%'")
def _(s, d):
    return t(s, d).documents.where("text not like '%\r%'").select("doc_id", X.with_breaks(F.substring("text", 1, 200)).alias("v"))


@query("f21_md5", "select c_custkey, md5(c_name) v from customer")
def _(s, d):
    return t(s, d).customer.select("c_custkey", F.md5("c_name").alias("v"))


@query("f22_job_stamp", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') v from orders")
def _(s, d):
    return t(s, d).orders.select("o_orderkey", X.job_stamp(F.col("o_orderdate")).alias("v"))


@query("f27_json_decode", "select event_id, (props::json->>'$.k')::bigint k from events")
def _(s, d):
    return t(s, d).events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("p16_zero_lines", r"select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: len(list_filter(regexp_split_to_array(trim(x), ' +')[1:3], lambda w: contains(w, 'a')))>=3)) > 1 bad from documents where text is not null")
def _(s, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.size(F.filter(F.slice(F.split(F.trim(x), " +"), 1, 3), lambda w: w.contains("a"))) >= 3)
    return t(s, d).documents.where("text is not null").select("doc_id", (F.size(lines) > 1).alias("bad"))


@query("p17_input_forms", r"select c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_.@-]+') username, regexp_full_match(c_mktsegment, '[A-Za-z0-9_]+') class_tag from customer")
def _(s, d):
    return t(s, d).customer.select("c_custkey", X.valid_input("username", F.col("c_name")).alias("username"), X.valid_input("class_tag", F.col("c_mktsegment")).alias("class_tag"))


@query("p21_access", "select count(*) n from customer where c_name='Customer#000000007' and c_acctbal > 0")
def _(s, d):
    from ..operators.api import access_allowed

    return access_allowed(t(s, d).customer.select(F.col("c_name").alias("username"), F.col("c_acctbal").alias("access")), "Customer#000000007")


@query("j5_using_and_on", "select c.c_custkey, o_orderkey, n_name from customer c join orders o on c.c_custkey=o.o_custkey join nation on c_nationkey=n_nationkey and n_regionkey=1")
def _(s, d):
    x = t(s, d)
    left = x.customer.withColumnRenamed("c_custkey", "key").join(x.orders.withColumnRenamed("o_custkey", "key"), "key")
    return left.join(x.nation, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("n_regionkey") == 1)).select(F.col("key").alias("c_custkey"), "o_orderkey", "n_name")


@query("a9_label_list", "select string_agg(p_brand, chr(9) order by f) || chr(9) labels from (select p_brand, min(p_partkey) f from part group by 1)")
def _(s, d):
    first = t(s, d).part.groupBy("p_brand").agg(F.min("p_partkey").alias("f"))  # in the order of their first row
    whole = first.agg(F.array_sort(F.collect_list(F.struct("f", "p_brand"))).alias("x"))  # one entry per label
    return whole.select(F.concat(F.array_join(F.transform("x", lambda r: r["p_brand"]), "\t"), F.lit("\t")).alias("labels"))


@query("a16_progress", "select count(quality) processed, count(*) total from documents left join labels using (doc_id)")
def _(s, d):
    x = t(s, d)
    return R.progress(x.documents.join(x.labels, "doc_id", "left"), "quality")


@query("w5_tag_numbers", "select c_custkey, row_number() over (order by c_custkey) n from customer")
def _(s, d):
    return K.number_rows(t(s, d).customer.select("c_custkey"), "c_custkey", "n").select("c_custkey", "n")


@query("w6_names_against_stored", "select p_partkey, case when row_number() over (partition by p_name order by p_partkey) > 1 or p_name in (select p_name from part where p_partkey < 50) then p_name || '_' || p_partkey else p_name end p_name from part where p_partkey >= 50")
def _(s, d):
    part = t(s, d).part.select("p_partkey", "p_name")
    return K.unique_names(part.where("p_partkey >= 50"), "p_name", "p_partkey", part.where("p_partkey < 50")).select("p_partkey", "p_name")


# ------------------------------------------------------------------------------------------------------ bit sets
@query("b1_tolerant_parse", "select p_partkey, [p_partkey, p_partkey + p_size + 1]::int[] b from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", B.parse(F.expr("concat('{', p_partkey, ', ', p_partkey + p_size + 1, ', oops, 7}')")).alias("b"))


@query("b2_strict_parse", "select p_partkey, case when p_partkey % 3 = 0 then []::int[] else [p_partkey]::int[] end b from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", B.parse(F.expr("case when p_partkey % 3 = 0 then null else concat('{', p_partkey, '}') end"), strict=True).alias("b"))


@query("b5_tanimoto_or_zero", "select p_partkey, case when p_partkey % 2 = 0 then 0.0 when p_size = 5 then 1.0 else 1.0/3 end s from part")
def _(s, d):
    text = F.expr("case when p_partkey % 2 = 0 then 'none' else concat('{1, ', if(p_size = 5, 2, 3), '}') end")
    return t(s, d).part.select("p_partkey", B.tanimoto_or_zero(text, F.lit("{1, 2}")).alias("s"))


@query("b6_jaccard_of_empty", f"with {FP} select id doc_id, case when len(bits)=0 then 1.0 else len(list_filter(bits, lambda b: b%2=0))::double/len(bits) end s from fp")
def _(s, d):
    return fingerprints(t(s, d)).select(F.col("id").alias("doc_id"), B.tanimoto(F.filter("bits", lambda b: b % 2 == 0), F.col("bits"), 1.0).alias("s"))


WORDS16 = ", ".join(f"(l_orderkey * {2 * k + 3} % 4096)::bigint h{k}" for k in range(16))


@query("b8_sixteen_words", f"select l_orderkey, l_linenumber, c::double/(a+16-c) s from (select l_orderkey, l_linenumber, {' + '.join(f'bit_count(h{k})::int' for k in range(16))} a, {' + '.join(f'bit_count(h{k} & 1)::int' for k in range(16))} c from (select l_orderkey, l_linenumber, {WORDS16} from lineitem))")
def _(s, d):
    rows = t(s, d).lineitem.selectExpr("l_orderkey", "l_linenumber", *(f"l_orderkey * {2 * k + 3} % 4096 h{k}" for k in range(16)))
    return rows.select("l_orderkey", "l_linenumber", B.word_tanimoto([F.col(f"h{k}") for k in range(16)], [F.lit(1).cast("long")] * 16).alias("s"))


@query("b12_bit_vector", f"with {FP} select id doc_id, list_transform(range(1100), lambda k: case when list_contains(bits, k::int) then 1.0 else 0.0 end)::double[] v from fp where id < 100")
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    return fingerprints(t(s, d)).where("id < 100").select(F.col("id").alias("doc_id"), vector_to_array(B.to_vector(F.col("bits"), 1100)).alias("v"))


@query("b13_bytes", "select p_partkey, list_filter(range(16), lambda k: ((p_partkey * 31 % 65536) >> k) & 1 = 1)::int[] b, lower(lpad(hex(p_partkey * 31 % 65536), 4, '0')) h from part")
def _(s, d):
    bits = B.from_bytes(F.expr("lpad(hex(p_partkey * 31 % 65536), 4, '0')"))
    rows = t(s, d).part.select("p_partkey", bits.alias("b"))
    return rows.select("p_partkey", "b", F.lower(B.to_bytes(F.col("b"), 16)).alias("h"))


@query("b14_binary_string", "select p_partkey, list_filter(range(12), lambda k: substr(lpad(bin(p_partkey), 12, '0'), k::int + 1, 1) = '1')::int[] b from part")
def _(s, d):
    return t(s, d).part.select("p_partkey", B.from_binary_string(F.expr("lpad(bin(p_partkey), 12, '0')")).alias("b"))


@query("p14_batch_similarity", f"""with {FP}, x as (select id, bits ext, list_transform(bits, lambda b: b * 4 + 1000) kr from fp),
 p as (select a.id mol_id1, b.id mol_id2, len(list_intersect(a.ext, b.ext)) c, len(a.ext) m, len(b.ext) n from x a join x b on a.id<>b.id and a.id < 60 and len(a.ext)*100 >= 85*len(b.ext) and len(b.ext)*100 >= 85*len(a.ext))
 select mol_id1, mol_id2, round(c/(m+n-c)::double, 4) ext, round(c/(m+n-c)::double, 4) kr from p where c/(m+n-c)::double >= 0.85 and c < m+n-c""")
def _(s, d):
    rows = fingerprints(t(s, d)).select("id", F.col("bits").alias("ext"), F.transform("bits", lambda b: b * 4 + 1000).alias("kr"))
    return S.batch_similarity(rows.where("id < 60"), rows).select("mol_id1", "mol_id2", F.col("ext").cast("double").alias("ext"), F.col("kr").cast("double").alias("kr"))


# --------------------------------------------------------------------------------------------- SD files, reports
@query("s2_tags", "select p_partkey, p_name as name, p_size || chr(10) || 'second' size from part")
def _(s, d):
    tags = records(s, d).select("p_partkey", sdf.tags(F.col("record")).alias("m"))
    return tags.select("p_partkey", F.try_element_at("m", F.lit("NAME")).alias("name"), F.try_element_at("m", F.lit("SIZE")).alias("size"))


@query("s3_molfile", "select p_partkey, 'mol ' || p_partkey || chr(10) || '  x' || chr(10) || chr(10) || '  1  0  0' || chr(10) || '    0.0000    0.0000    0.0000 C' || chr(10) || 'M  END' block from part")
def _(s, d):
    return records(s, d).select("p_partkey", sdf.molfile(F.col("record")).alias("block"))


@query("s5_tag_schema", "select 'NAME' tag, count(*) n, max(length(p_name)) width, 'string' as type from part union all select 'SIZE', count(*), max(length(p_size::varchar)) + 7, 'string' from part")
def _(s, d):
    return sdf.infer_tags(records(s, d).withColumnRenamed("p_partkey", "record_no")).select("tag", "n", F.col("width").cast("long").alias("width"), "type")


@query("s15_printout", "select o_orderkey pred_id, o_custkey mol_id, o_orderstatus main_class, '0.25' || chr(9) || '0.75' distribution from orders where o_orderkey < 500")
def _(s, d):
    text = "concat('report\\nmol_id  class\\n', rpad(o_custkey, 15, ' '), '*', o_orderstatus, '   0.25 0.75\\n')"
    rows = t(s, d).orders.where("o_orderkey < 500").select(F.col("o_orderkey").alias("pred_id"), F.expr(text).alias("printout"))
    return sdf.parse_printout(rows)


@query("k3_next_key", "select max(o_orderkey) + 1 next_key from orders")
def _(s, d):
    return K.next_key(t(s, d).orders, "o_orderkey")


@query("k8_rekey", "select case when l_orderkey < 50 then l_orderkey + 100000 else l_orderkey end pred_id, l_linenumber from lineitem")
def _(s, d):
    rows = t(s, d).lineitem.select(F.col("l_orderkey").alias("pred_id"), "l_linenumber")
    mapping = t(s, d).orders.where("o_orderkey < 50").select(F.col("o_orderkey").alias("old_id"), (F.col("o_orderkey") + 100000).alias("pred_id"))
    return K.rekey(rows, mapping)


@query("k10_truncate", "select * from region where false")
def _(s, d):
    return K.truncate(t(s, d).region)


@query("k12_tag_table", "select p_partkey, p_name as name, p_size || ';second' size, 'parts' db from part")
def _(s, d):
    tags = records(s, d).select("p_partkey", sdf.tags(F.col("record")).alias("m"))
    joined = lambda c: F.regexp_replace(F.try_element_at("m", F.lit(c)), "\n", ";")
    return tags.select("p_partkey", joined("NAME").alias("name"), joined("SIZE").alias("size"), F.lit("parts").alias("db"))


@query("k15_appended_tag", "select p_partkey, 'id' || p_partkey as value from part")
def _(s, d):
    more = sdf.append_tag(F.col("record"), "ID", F.concat(F.lit("id"), F.col("p_partkey").cast("string")))
    return records(s, d).select("p_partkey", F.try_element_at(sdf.tags(more), F.lit("ID")).alias("value"))


@query("k18_report_line", r"select l_orderkey, l_linenumber, rpad(l_partkey::varchar, 15, ' ') || rpad(l_shipdate::date::varchar, 27, ' ') || l_returnflag || chr(9) || regexp_replace(format('{:.8f}', l_discount), '\.?0+$', '') || chr(9) || regexp_replace(format('{:.8f}', 1 - l_discount), '\.?0+$', '') || chr(9) line from lineitem")
def _(s, d):
    spread = X.render_distribution(F.array(F.col("l_discount"), 1 - F.col("l_discount")))
    line = X.report_line(F.col("l_partkey"), F.col("l_shipdate").cast("date").cast("string"), F.col("l_returnflag"), spread)
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", line.alias("line"))


@query("s10_schema", "select column_name from (describe customer)")
def _(s, d):
    return s.createDataFrame([(n,) for n, _ in K.ordered_columns(t(s, d).customer)], "column_name string")


@query("q39_mapping_checks", "select * from (values ('c_name','duplicate'),('c_acctbal','type')) x(col, fault)")
def _(s, d):
    mapping = [("A", "c_name", "string"), ("B", "C_NAME", "string"), ("C", "c_acctbal", "int"), ("D", "fresh", "int")]
    return s.createDataFrame([(c.lower(), f) for c, f in K.check_mapping(K.ordered_columns(t(s, d).customer), mapping)], "col string, fault string")


@query("m13_log_odds_of_first", "select l_orderkey, l_linenumber, ln((l_discount + 0.001)/(1.001 - l_discount)) lhood from lineitem")
def _(s, d):
    return t(s, d).lineitem.select("l_orderkey", "l_linenumber", X.log_odds(F.element_at(F.array("l_discount", 1 - F.col("l_discount")), 1)).alias("lhood"))
