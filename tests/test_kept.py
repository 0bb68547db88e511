"""Pairs that are kept and grow, and maintenance as planned writes."""

import random

import pytest
from pyspark.sql import functions as F

from remanence.operators import kept_pairs, maintenance, proposals
from remanence.sources.snapshots import Store


def vectors(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "memory_id string, embedding array<double>")


def listed(df):
    return sorted(tuple(r) for r in df.select("a", "b", "similarity").collect())


def test_increments_equal_one_whole_join(spark, tmp_path):
    rng = random.Random(3)
    draw = lambda: [rng.gauss(0, 1) for _ in range(5)]
    known = {f"m{i:02d}": draw() for i in range(30)}
    kept = kept_pairs.KeptPairs(spark, f"file://{tmp_path}/pairs", least=0.5)
    first = kept.update(vectors(spark, known))
    assert (first.version, first.fresh, first.compared) == (1, 30, 30 * 29 // 2)
    known |= {f"n{i}": draw() for i in range(8)} | {"m03": draw()}
    del known["m07"]
    second = kept.update(vectors(spark, known))
    assert (second.fresh, second.gone, second.compared) == (9, 2, 9 * 37)
    assert listed(kept.pairs()) == listed(proposals.alike_pairs(vectors(spark, known), "memory_id", 0.5))
    same = kept.update(vectors(spark, known))
    assert (same.version, same.compared) == (2, 0)
    del known["n0"]
    third = kept.update(vectors(spark, known))
    assert (third.fresh, third.gone, third.compared) == (0, 1, 0)
    assert listed(kept.pairs()) == listed(proposals.alike_pairs(vectors(spark, known), "memory_id", 0.5))


def test_updates_write_new_pairs_alone(spark, tmp_path):
    """Old pairs stay in the folder they are in; keys that change, go and come
    again count as they are now, also after a merge."""
    rng = random.Random(5)
    draw = lambda: [rng.gauss(0, 1) for _ in range(3)]
    known = {f"m{i:02d}": draw() for i in range(25)}
    kept = kept_pairs.KeptPairs(spark, f"file://{tmp_path}/pairs", least=0.4)
    kept.update(vectors(spark, known))
    first = kept.store.snapshot().tables["pairs/1"]
    was = known.copy()
    known |= {"a0": draw(), "m03": draw(), "m11": [0.5, 0.25, 1.0]}
    del known["m20"]
    kept.update(vectors(spark, known))
    tables = kept.store.snapshot().tables
    assert tables["pairs/1"] == first
    assert all({r["a"], r["b"]} & {"a0", "m03", "m11"} for r in kept.store.read("pairs/2").collect())
    assert listed(kept.pairs()) == listed(proposals.alike_pairs(vectors(spark, known), "memory_id", 0.4))
    known |= {"m03": was["m03"], "m20": was["m20"]}
    del known["a0"]
    kept.update(vectors(spark, known))
    wanted = listed(proposals.alike_pairs(vectors(spark, known), "memory_id", 0.4))
    assert listed(kept.pairs()) == wanted
    merged = kept.merge()
    assert [name for name in merged.tables if name.startswith("pairs/")] == ["pairs/4"] and listed(kept.pairs()) == wanted
    assert kept.store.read("pairs/4").count() == len(wanted)
    del known["m05"]
    kept.update(vectors(spark, known))
    kept.store.vacuum()
    assert listed(kept.pairs()) == listed(proposals.alike_pairs(vectors(spark, known), "memory_id", 0.4))


def test_floats_are_sent_as_floats(spark):
    rows = [("a", [1.0, 0.25]), ("b", [2.0, 0.5]), ("c", [0.1, 1.0])]
    v = vectors(spark, dict(rows))
    kept = kept_pairs.KeptPairs(spark, "file:///tmp/none")
    kind = lambda df: kept._narrowed(df)(df).schema["embedding"].dataType.simpleString()
    assert (kind(v.where("memory_id <> 'c'")), kind(v)) == ("array<float>", "array<double>")
    f = v.select("memory_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert listed(proposals.alike_pairs(f, "memory_id", 0.0)) == listed(proposals.alike_pairs(f.select("memory_id", F.col("embedding").cast("array<double>").alias("embedding")), "memory_id", 0.0))


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    memories = spark.createDataFrame([("a", "core"), ("b", "odd"), ("c", "short")], "memory_id string, tier string")
    events = spark.createDataFrame([(1, "a"), (2, "gone"), (3, None)], "event_id int, memory_id string")
    trash = spark.createDataFrame([("x", "2024-01-01"), ("y", "2024-02-01")], "memory_id string, at string").select("memory_id", F.col("at").cast("timestamp_ntz").alias("deleted_at"))
    edges = spark.createDataFrame([("a", "b", 1.0, "auto"), ("a", "c", 0.05, "auto")], "source_id string, target_id string, weight double, provenance string").withColumn("last_fired", F.lit(None).cast("timestamp_ntz"))
    store.commit({"memories": memories, "events": events, "trash": trash, "edges": edges})
    return store


@pytest.fixture
def now(spark):
    return F.expr("timestamp_ntz'2024-02-03 00:00:00'")


def test_a_dry_run_reports_and_changes_nothing(store, now):
    report = maintenance.run(store, now)
    got = {(r.task, r.table): (r.before, r.after, r.changed) for r in report.collect()}
    assert got == {("trash", "trash"): (2, 1, 1), ("events", "events"): (3, 2, 1), ("edges", "edges"): (2, 1, 3), ("tier", "memories"): (3, 3, 2)}
    assert maintenance.succeeded(report) and store.versions() == [1]


def test_applied_plans_are_one_version(store, now):
    maintenance.run(store, now, only=["trash", "tier"], apply=True)
    assert store.versions() == [1, 2]
    assert {r.tier for r in store.read("memories").collect()} == {"core", "long", "short"}
    assert store.read("trash").count() == 1 and store.read("events").count() == 3
    assert [(r.status, r.tasks, r.failed) for r in store.read("runs").collect()] == [("success", "trash,tier", "")]


def test_a_failed_task_leaves_the_others(store, now):
    def broken(tables, when):
        raise KeyError("no such table")

    report = maintenance.run(store, now, apply=True, tasks={"broken": broken, "tier": maintenance.tier})
    assert not maintenance.succeeded(report)
    assert {r.task: r.error is None for r in report.collect()} == {"broken": False, "tier": True}
    assert [(r.status, r.failed) for r in store.read("runs").collect()] == [("failed", "broken")]
    assert "odd" not in {r.tier for r in store.read("memories").collect()}
    empty = Store(store.spark, store.root + "-empty")
    assert not maintenance.succeeded(maintenance.run(empty, now, only=["trash"]))


def test_unknown_tasks_are_refused(store, now):
    with pytest.raises(ValueError):
        maintenance.run(store, now, only=["trash", "nonsense"])


def test_space_is_reclaimed(spark, store, now):
    for _ in range(3):
        maintenance.run(store, now, only=["tier"], apply=True)
    assert maintenance.compacted(spark, store.root, keep=1) > 3
    assert len(store.versions()) == 1 and store.read("memories").count() == 3 and store.read("runs").count() == 3
