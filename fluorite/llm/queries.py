"""The queries of the ten operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, language, lm_scoring, ngram_join, packing, pseudonyms, sharding, suffix_dedup, token_output

#: Key of the pseudonyms in queries and pipeline; a deployment passes its own secret.
KEY = "fluorite-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir))


def op2_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(_table(spark, sf_dir).select("doc_id", "text"), KEY)
    return out.select("doc_id", "text", F.size("pseudonyms").alias("n_pseudonyms"), F.to_json("pseudonyms").alias("pseudonyms"))


def op4_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir))


def op5_repair_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(_table(spark, sf_dir))


def op6_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(_table(spark, sf_dir))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir))


def op9_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir))


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: DuckDB: (a, b) by which each a reaches b over link (a, b) in both directions, and itself.
REACH = "reach as (select id a, id b from node union select reach.a, link.b from reach join link on reach.b = link.a)"

SQL = {
    "op4_byte_prefix_shards": """with t as (select list_transform(range(256), lambda n: list_reduce([n,0,0,0,0,0,0,0,0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) t),
 d as (select doc_id, octet_length(encode(coalesce(text, ''))) + 1 size, hex(encode(coalesce(text, ''))) h from documents),
 c as (select doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) text_crc32 from d, t),
 p as (select *, coalesce(sum(size) over (order by doc_id, text_crc32, size rows between unbounded preceding and 1 preceding), 0) b, sum(size) over () total from c),
 q as (select *, least(7, floor(b * 8 / total))::int shard from p)
 select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'bytes' law, shard, (row_number() over (partition by shard order by doc_id, text_crc32, size) - 1)::bigint slot, null::int grown_shard from q""",
    "op6_interval_expansion": """with d as (select doc_id, octet_length(encode(coalesce(text, ''))) n, hex(encode(coalesce(text, ''))) h from documents),
 w as (select doc_id, unnest(range(n - 49)) i, h from d where n >= 50),
 x as (select doc_id, i, substr(h, 2 * i + 1, 100) x from w), m as (select x, min(doc_id) f from x group by x having min(doc_id) < max(doc_id)),
 g as (select doc_id, i, f from x join m using (x)),
 z as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) step from g where f < doc_id),
 r as (select *, sum(case when step is null or step > 50 then 1 else 0 end) over (partition by doc_id order by i) k from z),
 s as (select doc_id, k, min(i) a, max(i) + 50 b from r group by all),
 o as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) before from s),
 kept as (select doc_id, sum(b - a)::bigint removed, count(*) spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) kept from o join d using (doc_id) group by doc_id)
 select doc_id, n::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from d left join kept using (doc_id)""",
    "op7_collision_counting": f"""with recursive v as (select vec_id id, label, embedding::double[] e from embeddings),
 g as (select *, sqrt(list_inner_product(e, e)) m from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_inner_product(e, e) > 0),
 one as (select a.id a, b.id b from g a join g b on a.label = b.label and a.id < b.id where len(a.e) = len(b.e) and list_inner_product(a.e, b.e) / (a.m * b.m) >= 0.98),
 link as (select a, b from one union all select b, a from one), node as (select id from v), {REACH}, c as (select a id, min(b) c from reach group by a)
 select id vec_id, (select count(*) from link where link.a = id) n_links, c component_id, id = c kept from c""",
    "op9_count_vector_join": f"""with recursive w as (select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end s from w),
 e as (select doc_id, len(s) n, unnest(s) x from s),
 one as (select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 link as (select a, b from one union all select b, a from one), node as (select doc_id id from s), {REACH}, c as (select a id, min(b) c from reach group by a)
 select doc_id, len(s) n_shingles, c component_id from s join c on c.id = s.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """Four contracts in SQL; tokenizers, models and Hamming search are tested against brute force in tests/llm."""
    return dict(SQL)
