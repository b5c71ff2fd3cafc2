import duckdb
import pytest
from pyspark.sql import functions as F

from fluorite import catalogue
from fluorite.functions import bits as B
from fluorite.functions import scalars as X
from fluorite.operators import similarity as S
from fluorite.sources import sdf

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,bits", [(None, None), ("{}", []), ("{0}", [0]), ("{63, 64}", [63, 64]), ("{9, 5, 1}", [1, 5, 9]), ("{1, x, 3}", [1])])
def test_parse_bits(spark, text, bits):
    assert one(spark, B.parse(F.lit(text).cast("string"))) == bits


def test_bits_round_trip_and_packing(spark):
    bits = F.array(*map(F.lit, (0, 63, 64, 1023)))
    assert one(spark, B.render(bits)) == "{0, 63, 64, 1023}"
    words = one(spark, B.pack(bits))
    assert [b for k, w in enumerate(words) for b in range(k * 64, k * 64 + 64) if w % 2**64 >> (b % 64) & 1] == [0, 63, 64, 1023]


def test_tanimoto_edges(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    assert one(spark, B.tanimoto(a(), a())) == 0 and one(spark, B.tanimoto(a(), a(), 1.0)) == 1
    assert one(spark, B.tanimoto(a(1, 2), a(3))) == 0 and one(spark, B.tanimoto(a(1, 2), a(1, 2))) == 1


def test_similarity_join_plans_agree(spark):
    fp = S.prepare(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", B.word_fingerprint(F.col("text")).alias("bits")), "doc_id", "bits").cache()
    rows = lambda plan: sorted(map(tuple, S.similarity_join(fp, fp, 0.7, plan).collect()))
    assert rows("loop") == rows("prefix") != []


def test_scalars(spark):
    assert one(spark, X.infer_type(F.lit("-1e3"))) == "float" and one(spark, X.infer_type(F.lit("12"))) == "int" and one(spark, X.infer_type(F.lit("a1"))) == "string"
    assert one(spark, X.pad_right(F.lit("abcdef"), 3)) == "abcdef"
    assert one(spark, X.distribution(F.lit("0.25\t0.75\t"))) == [0.25, 0.75]


def test_sdf_records(spark, tmp_path):
    atoms = "    0.0000    0.0000    0.0000 C   0  0\n"
    good = "mol\n  x\n\n  2  0  0  0\n" + atoms + "    1.0000    0.0000    0.0000 O   0  0\nM  END\n> <NAME>\nabc\ndef\n\n> <N>\n7\n\n$$$$\n"
    bad = "mol2\n  x\n\n  2  0  0  0\n" + atoms + atoms + "> <NAME>\nlast\n"
    (tmp_path / "a.sdf").write_text(good + bad)
    r = sdf.read_sdf(spark, str(tmp_path / "a.sdf")).select("record_no", sdf.tags(F.col("record")).alias("t"), sdf.molfile(F.col("record")).alias("m")).withColumn("ok", sdf.coordinates_valid(F.col("m"))).orderBy("record_no").collect()
    assert [x.t for x in r] == [{"NAME": "abc\ndef", "N": "7"}, {"NAME": "last"}]
    assert [x.ok for x in r] == [True, False] and all("M  END" in x.m for x in r)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours = catalogue.queries()[name](spark, DATA)
    theirs = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)

    def norm(v):
        return "~" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)

    assert sorted(tuple(map(norm, r)) for r in theirs.fetchall()) == sorted(tuple(map(norm, r)) for r in ours.select(*columns).collect())
