"""Job control: a job table with states and progress, time budgets, and the order of an import."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states of a job, in order.
STATES = ("pending", "running", "completed", "failed")
#: What follows an import, in order.
AFTER_IMPORT = ("fingerprints", "descriptors", "identifiers", "uploaded", "predictions", "scaffolds", "similarity")


class Jobs:
    """Jobs of one driver: each has a state, a count of parts done, its partial results, and its fault if it failed."""

    def __init__(self):
        self.rows: dict[str, dict] = {}

    def run(self, name: str, parts: list, work: Callable) -> dict:
        """Do the parts one by one; a part's fault ends the job as failed, keeping what was done."""
        row = self.rows[name] = {"state": "pending", "processed": 0, "total": len(parts), "results": [], "fault": None}
        row["state"] = "running"
        try:
            for part in parts:
                row["results"].append(work(part))
                row["processed"] += 1
            row["state"] = "completed"
        except Exception as fault:  # the job's fault is its result
            row["state"], row["fault"] = "failed", str(fault)
        return row

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, r["state"], r["processed"], r["total"], r["fault"]) for n, r in self.rows.items()]
        return spark.createDataFrame(rows, "name string, state string, processed int, total int, fault string")


def progress(rows: DataFrame, done: str) -> DataFrame:
    """processed and total of a table in which ``done`` is null where work is pending."""
    return rows.agg(F.count(done).alias("processed"), F.count("*").alias("total"))


def after_import(steps: dict[str, Callable[[dict], None]], store: dict) -> list[str]:
    """Run the steps given in the order of an import; returns their names."""
    unknown = set(steps) - set(AFTER_IMPORT)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    done = [name for name in AFTER_IMPORT if name in steps]
    for name in done:
        steps[name](store)
    return done


def temporary_batch(store: dict[str, DataFrame], molecules: DataFrame, batch_id: int, work: Callable[[dict], DataFrame]) -> DataFrame:
    """What work says of a store with the molecules as one more batch; nothing of it is stored."""
    members = molecules.select(F.lit(batch_id).cast("long").alias("batch_id"), "mol_id")
    extra = {"molecules": store["molecules"].unionByName(molecules, allowMissingColumns=True), "batchmols": store["batchmols"].unionByName(members)}
    return work({**store, **extra})


def within(budget: float, f: Callable[[str], object], key: str, text: str, out: str, kind: str):
    """For mapInArrow: (key, out, fault) of each row; a row that raises, or takes longer than budget seconds, gives its fault.

    The budget holds between the steps of a generator function; a plain function is judged when it ends.
    """
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(key, pa.int64()), (out, types[kind]), ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, x in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
                began, value, fault = time.monotonic(), None, None
                try:
                    got = f(x)
                    if isinstance(got, Iterator):
                        for value in got:
                            if time.monotonic() - began > budget:
                                raise TimeoutError("timeout")
                    else:
                        value = got
                    if time.monotonic() - began > budget:
                        raise TimeoutError("timeout")
                except Exception as x:  # noqa: BLE001  a row's fault is its result
                    value, fault = None, str(x) or type(x).__name__
                rows.append((k, value, fault))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_arrays([pa.array([], t.type) for t in schema], schema=schema)

    return run
