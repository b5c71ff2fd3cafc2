"""Chemistry and training tables over structures made of the rows of part: a carbon chain of p_size atoms that ends in a
benzene ring, an oxygen, or has a sodium ion beside it. What a chemist would count of them is the SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chemistry as C
from ..operators import features as T
from ..operators import learning as L
from .registry import Tables, query


def structures(s, d):
    text = "concat(repeat('C', p_size), case p_partkey % 3 when 0 then 'c1ccccc1' when 1 then 'O' else '.[Na+]' end)"
    rows = Tables(s, d).part.select(F.col("p_partkey").cast("long").alias("mol_id"), F.expr(text).alias("structure"))
    return rows.repartition(s.sparkContext.defaultParallelism)


X = "x as (select p_partkey::bigint mol_id, p_size k, p_partkey % 3 e, p_brand, p_retailprice from part)"
TAIL = "case e when 0 then 'c1ccccc1' when 1 then 'O' else '' end"


@query("c2_describe", f"""with {X} select mol_id, (k + case e when 0 then 6 when 1 then 1 else 0 end)::double n_atoms, (case e when 0 then 1 else 0 end)::double n_rings, (case e when 0 then 6 else 0 end)::double n_aromatic,
 (case e when 0 then 2*k+6 else 2*k+2 end)::double n_hydrogens, round(12.011*(k+case e when 0 then 6 else 0 end) + case e when 1 then 15.999 else 0 end + 1.008*(case e when 0 then 2*k+6 else 2*k+2 end), 3)::double mw, (case e when 1 then 1 else 0 end)::double n_donors from x""")
def _(s, d):
    return C.describe(structures(s, d)).select("mol_id", "n_atoms", "n_rings", "n_aromatic", "n_hydrogens", "mw", "n_donors")


@query("c3_salt_stripping", f"with {X} select mol_id, (e = 2 and k > 0) salt, case e when 0 then 6 + k when 1 then k + 1 else k end heavy from x")
def _(s, d):
    whole = C.describe(structures(s, d)).select("mol_id", F.col("n_atoms").cast("int").alias("heavy"))
    salt = structures(s, d).select("mol_id", F.col("structure").contains(".").alias("salt"))
    return salt.join(whole, "mol_id")


@query("c4_canonical_smiles", f"with {X} select mol_id, repeat('C', k) parent from x where e = 2")
def _(s, d):
    return C.identify(structures(s, d).where("mol_id % 3 = 2")).select("mol_id", "parent")


@query("c5_structures_read", f"with {X} select mol_id, (k + case e when 0 then 6 else 1 end)::int atoms from x")
def _(s, d):
    blocks = C.to_molfile(structures(s, d))
    return blocks.select("mol_id", F.trim(F.substring(F.element_at(F.split("molfile", "\n"), 4), 1, 3)).cast("int").alias("atoms"))


@query("c6_substructure_search", f"with {X} select mol_id from x where e = 1 and k >= 2")
def _(s, d):
    return C.substructure_search(structures(s, d), "OCC", limit=None)


@query("j8_verified_ring_search", f"with {X} select mol_id from x where e = 0 and k >= 2 order by mol_id limit 100")
def _(s, d):
    return C.substructure_search(structures(s, d), "CCc1ccccc1")


@query("c7_murcko_scaffold", f"with {X} select mol_id, case e when 0 then 'c1ccccc1' else '' end scaffold from x")
def _(s, d):
    return C.identify(structures(s, d)).select("mol_id", "scaffold")


@query("c1_screen_is_safe", f"with {X} select mol_id, true held from x where e = 0 and k >= 2")
def _(s, d):
    """The bits of a part are bits of the whole, in every kind but estate."""
    from ..chemistry import molecule as M
    from ..functions import bits as B

    kinds = [k for k in M.WIDTHS if k != "estate"]
    part = M.parse_smiles("CCc1ccccc1")
    held = [B.contains(F.col(k), F.array(*map(F.lit, M.fingerprint(part, k)))) for k in kinds]
    rows = C.fingerprints(structures(s, d).where("mol_id % 3 = 0 and length(structure) >= 10"), tuple(kinds))
    return rows.select("mol_id", F.least(*(h.cast("int") for h in held)).cast("boolean").alias("held"))


@query("c8_statistics", f"with {X} select mol_id, (k + case e when 0 then 6 else 0 end)::double n_c, (case e when 1 then 1 else 0 end)::double n_o, 0.0::double charge from x where e < 2")
def _(s, d):
    rows = C.describe(structures(s, d).where("mol_id % 3 < 2"))
    return rows.select("mol_id", F.col("n_C").alias("n_c"), F.col("n_O").alias("n_o"), "charge")


# ------------------------------------------------------------------------------------------------ training tables
KINDS = ["maccs", "sub", "go", "kr", "pubchem", "ext", "estate"]
SHIFTS = {k: 3 + 2 * i for i, k in enumerate(KINDS)}


def tables(s, d):
    """Members, fingerprints, descriptors and labels in the roles of a training batch."""
    part = Tables(s, d).part
    members = part.select(F.col("p_partkey").cast("long").alias("mol_id"))
    bits = [F.when(F.col("p_partkey") % 11 != i, F.array(F.col("p_size") * m % 160, (F.col("p_partkey") % 7).cast("int") + 170)).alias(k) for i, (k, m) in enumerate(SHIFTS.items())]
    fingerprints = part.select(F.col("p_partkey").cast("long").alias("mol_id"), *bits)
    descriptors = part.select(F.col("p_partkey").cast("long").alias("mol_id"), F.expr("case when p_partkey % 13 = 0 then null when p_partkey % 13 = 1 then 0.0 else p_retailprice end").alias("mw"), F.col("p_size").cast("double").alias("n_atoms"))
    labels = part.select(F.col("p_partkey").cast("long").alias("mol_id"), F.expr("case when p_partkey % 5 = 0 then '' else p_type end").alias("label"))
    return members, fingerprints, descriptors, labels


def _featurized(data_type: str):
    widths, described = T.DATA_TYPES[data_type]
    shift, parts, held = 0, [], ["p_partkey % 5 <> 0"]
    for k, w in widths.items():
        parts.append(f"list_transform(list_filter([p_size * {SHIFTS[k]} % 160, p_partkey % 7 + 170], lambda b: b < {w}), lambda b: b + {shift})")
        held.append(f"p_partkey % 11 <> {KINDS.index(k)}")
        shift += w
    if described:
        held.append("p_partkey % 13 <> 0" + (" and p_partkey % 13 <> 1 and p_retailprice <> 0" if data_type in ("ALL", "JUMBO", "MCAT") else ""))
    columns = ["p_partkey::bigint mol_id", "p_type as label"]
    if parts:
        columns.append(f"({' || '.join(parts)})::int[] bits")
    if described:
        columns += ["(case when p_partkey % 13 = 1 then 0.0 else p_retailprice end)::double mw", "p_size::double n_atoms"]

    @query(f"m1_{data_type.lower()}", f"select {', '.join(columns)} from part where {' and '.join(held)}")
    def _(s, d):
        members, fingerprints, descriptors, labels = tables(s, d)
        return T.featurize(members, data_type, fingerprints, descriptors, labels)


for _kind in T.DATA_TYPES:
    _featurized(_kind)


@query("m1_predicted_rows_all", "select p_partkey::bigint mol_id from part where p_partkey % 11 <> 0 and p_partkey % 11 <> 1 and p_partkey % 11 <> 4 and p_partkey % 11 <> 5 and p_partkey % 13 <> 0")
def _(s, d):
    members, fingerprints, descriptors, _ = tables(s, d)
    return T.featurize(members, "ALL", fingerprints, descriptors).select("mol_id")


@query("m3_varying_bits", "with b as (select p_size * 3 % 160 bit from part where p_partkey % 11 <> 0 and p_partkey % 5 <> 0 union all select p_partkey % 7 + 170 from part where p_partkey % 11 <> 0 and p_partkey % 5 <> 0) select bit::int bit, count(*) n from b group by 1")
def _(s, d):
    members, fingerprints, _, labels = tables(s, d)
    return T.varying_bits(T.featurize(members, "MACCS", fingerprints, None, labels))


@query("m2_nominal", "select p_partkey::bigint mol_id, p_size::varchar n from part")
def _(s, d):
    return T.as_nominal(Tables(s, d).part.select(F.col("p_partkey").cast("long").alias("mol_id"), F.col("p_size").alias("n")), ["n"])


@query("j14_aligned", "select p_partkey::bigint mol_id, p_size::double p_size, null::double absent, case when p_type in ('ECONOMY','PROMO') then p_type end p_type from part")
def _(s, d):
    rows = Tables(s, d).part.select(F.col("p_partkey").cast("long").alias("mol_id"), "p_type", "p_size", "p_name")
    return T.align(rows, {"p_size": "double", "absent": "double", "p_type": ["ECONOMY", "PROMO"]})


@query("m16_class_tag", "select 'p_type' tag")
def _(s, d):
    from ..operators.api import validate_tag

    return s.createDataFrame([(validate_tag(Tables(s, d).part, "p_type"),)], "tag string")


@query("k16_saved_model", "select p_type as label, count(*) n, round(avg(p_size), 6) m0, round(avg(p_retailprice), 6) m1 from part group by 1")
def _(s, d):
    rows = Tables(s, d).part.select(F.col("p_type").alias("label"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return L.bayes_statistics(rows, ["p_size", "p_retailprice"]).select("label", "n", F.round("m0", 6).alias("m0"), F.round("m1", 6).alias("m1"))
