"""Run registered queries against their SQL: ``python -m verification.check SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from terradelta.session import local
from verification.oracle import ORACLE
from verification.queries import QUERIES

TABLES = ("customer", "orders", "events")

# Plan nodes that would not scale: all-pairs joins, rows through Python, one-task sorts.
UNWANTED = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "EvalPython",
    "InPandas",
    "Exchange SinglePartition",
)


def unwanted_nodes(df: DataFrame) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [node for node in UNWANTED if node in plan]


def _normal(rows: list[tuple]) -> list[str]:
    return sorted(repr(tuple(float(v) if isinstance(v, float) else v for v in row)) for row in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """'ok', or what differs."""
    df = QUERIES[name](spark, sf_dir)
    unwanted = unwanted_nodes(df)
    if unwanted:
        return f"plan has {unwanted}"
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLE:
        return f"rows only: {len(got)}"
    rel = con.sql(ORACLE[name])
    if sorted(rel.columns) != columns:
        return f"columns {columns} != {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    for c, t in df.dtypes:
        if spark_kinds.get(t) != kinds[c]:
            return f"type of {c}: {t} != {kinds[c]}"
    want = rel.select(*columns).fetchall()
    a, b = _normal(got), _normal(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"values: {x} != {y}"
    return "ok"


def main(sf_dir: str, names: list[str]) -> int:
    spark = local()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on to the next query
            verdict = f"error {str(e)[:600]}"
        bad += verdict != "ok"
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
