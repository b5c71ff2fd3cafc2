"""Molecular kernels over Arrow batches: statistics, names, scaffolds, fingerprints, and verified substructure search.

A structure is SMILES or a mol block. One that can't be read, or takes longer than ``budget`` seconds, gets nulls and a
fault, so a work list can leave it out; no structure stops a job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..chemistry import molecule as M
from . import similarity as S

_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def each_structure(df: DataFrame, key: str, column: str, columns: dict[str, str], f: Callable[[M.Molecule], tuple], budget: float = 600.0) -> DataFrame:
    """key, the columns that f gives for each structure, and fault."""
    schema = pa.schema([(key, pa.int64()), *((c, _ARROW[t]) for c, t in columns.items()), ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (None,) * len(columns)
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                began = time.monotonic()
                try:
                    got = f(M.read(text)) if text is not None else nothing
                    late = time.monotonic() - began > budget
                    rows.append((k, *(nothing if late else got), "timeout" if late else None))
                except (ValueError, IndexError, KeyError) as fault:
                    rows.append((k, *nothing, str(fault)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    spark_schema = ", ".join([f"{key} long", *(f"{c} {t}" for c, t in columns.items()), "fault string"])
    return df.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, spark_schema)


def describe(df: DataFrame, key: str = "mol_id", column: str = "structure", **options) -> DataFrame:
    """All statistics of each structure's largest component."""
    return each_structure(df, key, column, dict.fromkeys(M.STATISTICS, "double"), lambda m: tuple(map(float, M.statistics(M.strip_salt(m)).values())), **options)


def identify(df: DataFrame, key: str = "mol_id", column: str = "structure", **options) -> DataFrame:
    """Canonical SMILES, of the whole, of its largest component, and of that one's scaffold."""

    def names(m: M.Molecule) -> tuple[str, str, str]:
        main = M.strip_salt(m)
        return M.write_smiles(m), M.write_smiles(main), M.write_smiles(M.murcko(main))

    return each_structure(df, key, column, {"smiles": "string", "parent": "string", "scaffold": "string"}, names, **options)


def fingerprints(df: DataFrame, kinds: tuple[str, ...] = tuple(M.WIDTHS), key: str = "mol_id", column: str = "structure", **options) -> DataFrame:
    """The bits of each kind asked for."""
    return each_structure(df, key, column, dict.fromkeys(kinds, "array<int>"), lambda m: tuple(M.fingerprint(m, k) for k in kinds), **options)


def to_molfile(df: DataFrame, key: str = "mol_id", column: str = "structure", **options) -> DataFrame:
    return each_structure(df, key, column, {"molfile": "string"}, lambda m: (M.write_molfile(m),), **options)


def substructure_search(structures: DataFrame, query: str, fps: DataFrame | None = None, kind: str = "maccs", key: str = "mol_id", column: str = "structure", limit: int | None = 100) -> DataFrame:
    """Ids of structures that hold the query: its bits are asked for first, then the graphs of the candidates are matched.

    fps has key and kind (bits); without it fingerprints are computed. limit None gives all hits.
    """
    asked = M.read(query)
    if len(asked.atoms) < 3:
        raise ValueError("a query needs three atoms")
    bits = F.array(*map(F.lit, M.fingerprint(asked, kind))).cast("array<int>")
    fps = fingerprints(structures, (kind,), key, column) if fps is None else fps
    held = S.substructure_screen(fps.where(F.col(kind).isNotNull()).select(F.col(key).alias("id"), F.col(kind).alias("bits")), bits, limit=(1 << 31) - 1)
    candidates = structures.join(held.withColumnRenamed("mol_id", key), key, "left_semi")
    hits = each_structure(candidates, key, column, {"hit": "boolean"}, lambda m: (M.matches(asked, m),)).where("hit").select(key)
    return hits if limit is None else hits.orderBy(key).limit(limit)
