"""Commits of several tables: whole or not at all, whatever step a writer dies at."""

import pytest

from remanence.sources import snapshots


class Died(RuntimeError):
    pass


@pytest.fixture
def store(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    store.commit({"records": spark.range(3), "edges": spark.range(5)})
    return store


def state(store):
    return store.snapshot().version, store.read("records").count(), store.read("edges").count()


class Dying:
    """A file system that dies at its n-th write, leaving what was done before."""

    def __init__(self, fs, step):
        self.fs, self.step = fs, step

    def __getattr__(self, name):
        if name in ("create", "rename"):
            self.step -= 1
            if self.step < 0:
                raise Died(name)
        return getattr(self.fs, name)


@pytest.mark.parametrize("step", [0, 1])
def test_a_writer_that_dies_at_the_commit_leaves_the_old_state(spark, store, step):
    before = state(store)
    writer = snapshots.Store(spark, store.root)
    writer._fs = Dying(writer._fs, step)
    with pytest.raises(Died):
        writer.commit({"records": spark.range(30), "edges": spark.range(50)})
    assert state(store) == before
    assert store.vacuum() == 2 and state(store) == before
    store.commit({"edges": spark.range(7)})
    assert state(store) == (2, 3, 7)


def test_a_writer_that_dies_between_tables_leaves_the_old_state(spark, store, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    real, calls = DataFrameWriter.save, []

    def save(self, *args, **kwargs):
        calls.append(args)
        if len(calls) == 2:
            raise Died("save")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", save)
    with pytest.raises(Died):
        store.commit({"records": spark.range(30), "edges": spark.range(50)})
    assert state(store) == (1, 3, 5)
    assert store.vacuum() == 1


def test_two_writers_cannot_make_one_version(spark, store):
    base = store.snapshot()
    store.commit({"records": spark.range(4)}, base=base)
    with pytest.raises(snapshots.Conflict):
        store.commit({"records": spark.range(9)}, base=base)
    assert state(store) == (2, 4, 5)


def test_old_versions_are_read_until_they_are_removed(spark, store):
    store.commit({"records": spark.range(8)}, dropped=("edges",))
    assert store.read("edges", 1).count() == 5 and "edges" not in store.snapshot().tables
    store.compact("records", 1)
    assert store.snapshot().version == 3 and len(store.read("records").inputFiles()) == 1 and store.read("records").count() == 8
    assert store.vacuum() == 3 and store.versions() == [3]


def test_publish_again_and_again(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    for n in (1, 2, 3):
        snapshots.publish(spark.range(n), path)
        assert snapshots.published(spark, path).count() == n
    assert len(snapshots.Store(spark, path).versions()) == 2
