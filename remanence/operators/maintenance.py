"""Maintenance as planned writes.

A task reads the tables of one snapshot and returns the tables it would change,
as a plan. The run reports what every plan would do and stops there, unless it
is told to apply; then the plans that succeeded are committed once, together
with a record of the run. A task that fails leaves the others alone, and the run
is marked as failed. Tasks are planned in order, each on the tables as those
before it would leave them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled, workspace
from ..sources.snapshots import Store
from . import graph, lifecycle

Tables = Mapping[str, DataFrame]
Task = Callable[[Tables, Column], dict[str, DataFrame]]


def trash(tables: Tables, now: Column) -> dict[str, DataFrame]:
    """Trash that is older than a week goes for good."""
    return {"trash": lifecycle.purged(tables["trash"], "deleted_at", now, 7)}


def events(tables: Tables, now: Column) -> dict[str, DataFrame]:
    """Log rows of records that no longer exist go; rows of no record stay."""
    log, known = tables["events"], tables["memories"].select("memory_id")
    return {"events": log.where("memory_id IS NULL").unionByName(log.where("memory_id IS NOT NULL").join(known, "memory_id", "left_semi").select(*log.columns))}


def edges(tables: Tables, now: Column) -> dict[str, DataFrame]:
    """Edges fade; those that are too weak go."""
    return {"edges": graph.decayed_edges(tables["edges"])}


def tier(tables: Tables, now: Column) -> dict[str, DataFrame]:
    """Tiers that are none become the default one."""
    return {"memories": lifecycle.tiers_repaired(tables["memories"])}


TASKS: dict[str, Task] = {"trash": trash, "events": events, "edges": edges, "tier": tier}


def run(store: Store, now: Column, only: list[str] | None = None, apply: bool = False, tasks: Mapping[str, Task] = TASKS) -> DataFrame:
    """``task, table, before, after, changed, error`` of every planned write (a
    row without a table for a task that failed). With ``apply`` the plans are
    committed as one version, with the run appended to table ``runs``. An unknown
    task is an error before anything is read. ``changed`` counts rows that only
    one side has."""
    names = list(tasks) if only is None else only
    if unknown := [n for n in names if n not in tasks]:
        raise ValueError(f"unknown tasks: {unknown}")
    spark, base = store.spark, store.snapshot()
    report: list[tuple] = []
    with workspace(spark) as settle:
        tables = {name: store.read(name, base.version) for name in base.tables}
        planned: dict[str, DataFrame] = {}
        for name in names:
            try:
                changed = {table: settle(df) for table, df in tasks[name](tables, now).items()}
                for table, df in changed.items():
                    moved = _moved(tables[table], df.select(*tables[table].columns))
                    report.append((name, table, tables[table].count(), df.count(), moved, None))
            except Exception as problem:  # noqa: BLE001  a task may fail in any way; the others go on
                report.append((name, None, None, None, None, f"{type(problem).__name__}: {str(problem).splitlines()[0][:300]}" if str(problem) else type(problem).__name__))
                continue
            planned |= changed
            tables = tables | changed
        if apply:
            failed = [r[0] for r in report if r[5] is not None]
            row = spark.range(1).select(F.lit("maintenance").alias("job"), now.cast("string").alias("at"), F.lit("failed" if failed else "success").alias("status"), F.lit(",".join(names)).alias("tasks"), F.lit(",".join(failed)).alias("failed"))
            runs = tables["runs"].select(*row.columns).unionByName(row) if "runs" in tables else row
            store.commit({**planned, "runs": runs}, base=base)
        return settled(spark.createDataFrame(report, "task string, table string, before long, after long, changed long, error string"))


def _moved(before: DataFrame, after: DataFrame) -> int:
    """Rows that only one side has, repeats counted: both are gone through once."""
    balance = before.withColumn("_side", F.lit(1)).union(after.withColumn("_side", F.lit(-1))).groupBy(*before.columns).agg(F.abs(F.sum("_side")).alias("_only"))
    return balance.agg(F.coalesce(F.sum("_only"), F.lit(0))).first()[0]


def succeeded(report: DataFrame) -> bool:
    return report.where("error IS NOT NULL").limit(1).count() == 0


def compacted(spark: SparkSession, root: str, rows_per_file: int = 1_000_000, keep: int = 2) -> int:
    """Rewrites every table in fewer files and removes what no kept version
    names; returns the folders removed."""
    store = Store(spark, root)
    base = store.snapshot()
    if base.version:
        tables = {name: store.read(name, base.version) for name in base.tables}
        large = {name: df.coalesce(max(1, -(-df.count() // rows_per_file))) for name, df in tables.items()}
        store.commit(large, base=base)
    return store.vacuum(keep)
