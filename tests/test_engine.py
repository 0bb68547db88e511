"""Hand-computed values of the kernels, and the engine's read-only contract."""

import datetime

import pytest
from pyspark.sql import functions as F

from remanence.api import Engine
from remanence.functions import hashing, signals, text, vector
from remanence.operators import beliefs, chunks, graph, lifecycle, proposals, ranking, records, search
from remanence.sources import files, tables
from remanence.streaming import ingest

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_heat_follows_the_edge_and_stops(spark):
    m = frame(spark, [("a", 0.0), ("b", 0.0), ("c", 0.0)], "memory_id string, activation double")
    e = frame(spark, [("a", "b", 0.8, 0.5), ("b", "a", 0.8, 0.5)], "source_id string, target_id string, weight double, conductance double")
    roots = frame(spark, [("a", 1), ("a", 2), ("x", 3)], "memory_id string, place int")
    got = {r["memory_id"]: r["activation"] for r in graph.heat_spread(m, e, roots, 0.4).collect()}
    assert got == pytest.approx({"a": 0.4, "b": 0.4 * 0.5 * (0.8 / 1.5) * 0.5})


def test_heat_is_idempotent(spark):
    e = Engine.over(spark, SF)
    roots = frame(spark, [("d1", 1)], "memory_id string, place int")
    known = frame(spark, [("x",)], "event_id string")
    same = e.heated(roots, 0.4, "x", known).memories.select("memory_id", "activation")
    assert same.exceptAll(e.memories.select("memory_id", "activation")).count() == 0
    hot = e.heated(roots, 0.4, "y", known).get("d1").first()["activation"]
    assert hot == pytest.approx(0.1 + 0.4)


def test_rank_fusion_values(spark):
    v = frame(spark, [(1, "x", 1), (1, "y", 2)], "query_id int, memory_id string, rank int")
    t = frame(spark, [(1, "y", 1), (1, "z", 2)], "query_id int, memory_id string, rank int")
    got = {r["memory_id"]: r for r in search.fused(v, t, "memory_id").collect()}
    assert got["x"]["rrf"] == pytest.approx(1 / 61, abs=1e-8)
    assert got["y"]["rrf"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)
    assert got["z"]["rrf"] == pytest.approx(1.5 / 62, abs=1e-8)
    assert got["y"]["similarity"] == 1.0 and got["x"]["similarity"] == 0.0


def test_best_edge_survives_pruning(spark):
    e = frame(spark, [("a", "b", 0.05, None, "auto_x"), ("a", "c", 0.09, None, "auto_x")], "source_id string, target_id string, weight double, last_fired timestamp_ntz, provenance string")
    assert [r["target_id"] for r in graph.decayed_edges(e, 0.1, 1.0).collect()] == ["c"]


def test_one_old_case_is_little_confidence(spark):
    b = frame(spark, [("b1", "active", False)], "belief_id string, status string, pinned boolean")
    c = frame(spark, [("c1", "b1", "support", "m", datetime.datetime(2024, 1, 1))], "case_id string, belief_id string, case_kind string, memory_id string, occurred_at timestamp_ntz")
    m = frame(spark, [("m", 0.8)], "memory_id string, emotion double")
    now = F.lit(datetime.datetime(2024, 3, 31)).cast("timestamp_ntz")
    got = beliefs.confidence(b, beliefs.case_weights(c, m, now)).first()["confidence"]
    assert got == pytest.approx(0.4 / 2.4)


@pytest.mark.parametrize("hops, resolved", [(5, True), (6, False)])
def test_update_chains(spark, hops, resolved):
    rows = [(f"n{i + 1}", f"n{i}", "updates", "approved", datetime.datetime(2024, 1, i + 1)) for i in range(hops)]
    s = frame(spark, rows, "source_id string, target_id string, role string, review_state string, created timestamp_ntz")
    got = {r["memory_id"]: r for r in graph.resolved_updates(s).collect()}
    assert got["n0"]["resolved"] == resolved
    assert got["n0"]["newest"] == (f"n{hops}" if resolved else None)


def test_update_cycle_is_unresolved(spark):
    rows = [("a", "b", "updates", "approved", datetime.datetime(2024, 1, 1)), ("b", "a", "updates", "approved", datetime.datetime(2024, 1, 2))]
    s = frame(spark, rows, "source_id string, target_id string, role string, review_state string, created timestamp_ntz")
    assert {r["resolved"] for r in graph.resolved_updates(s).collect()} == {False}
    assert sorted(r["memory_id"] for r in graph.on_cycle(s).collect()) == ["a", "b"]


def events(spark, minutes):
    return frame(spark, [(i, "t", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), 1.0) for i, m in enumerate(minutes)], "event_id long, event_type string, ts timestamp, value double")


def test_time_gaps_count_from_the_last_accepted(spark):
    got = records.first_accepted(events(spark, [0, 2, 6, 10, 11, 12]), "event_type", "ts", 5).collect()
    assert sorted(r["event_id"] for r in got) == [0, 2, 4]


def test_streams_agree_with_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(spark, [0, 2, 6, 10, 11, 12, 30])
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    kept: list = []
    ingest.run_available(ingest.gap_filtered(stream, "event_type", 300), lambda df, n: kept.extend(df.collect()), f"{tmp_path}/c1")
    assert sorted(r["event_id"] for r in kept) == [0, 2, 4, 6]
    shown: list = []
    ingest.run_available(ingest.recently_shown(stream, "event_type", 301), lambda df, n: shown.extend(df.collect()), f"{tmp_path}/c2")
    assert [r["cooled"] for r in sorted(shown, key=lambda r: r["event_id"])] == [False, True, True, True, True, True, False]


def test_change_feed_stream(spark, tmp_path):
    schema = "k long, v string, op string, revision long"
    frame(spark, [(1, "a", "upsert", 1), (2, "b", "upsert", 2), (1, "c", "upsert", 3), (2, "b", "delete", 4)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    kind = spark.read.parquet(f"{tmp_path}/in").schema
    ingest.apply_changes(spark, f"{tmp_path}/in", kind, f"{tmp_path}/state", f"{tmp_path}/c", "k")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/state/version=0").collect()] == [(1, "c")]


def test_chunks_must_tile_their_text(spark):
    p = frame(spark, [("a", "one two"), ("b", "one two")], "parent_id string, text string")
    row = lambda parent, no, t: (parent, no, t, "l", "narrative", "root", None, True, "index", "h")
    c = frame(spark, [row("a", 1, "one "), row("a", 2, "two"), row("b", 1, "one "), row("b", 2, "tw")],
              "parent_id string, chunk_no int, text string, index_label string, chunk_role string, relationship string, echo_of int, adds_new_insight boolean, index_policy string, source_hash string")
    assert sorted({(r["parent_id"], r["rule"]) for r in chunks.violations(p, c).collect()}) == [("b", "length")]


def test_named_uuid(spark):
    import uuid

    got = spark.range(1).select(hashing.named_uuid(F.lit("a\x1fb"))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "a\x1fb"))


def test_spans_and_sentences(spark):
    t, n = F.lit("One. Two here. Three! Four?"), F.lit(" here ")
    row = spark.range(1).select(text.span(t, F.lit("Two")).alias("s"), text.span(t, n).alias("trimmed"), text.span(t, F.lit("zzz")).alias("none"), text.sentence_span(t, F.lit(9), F.lit(13), 0).alias("w")).first()
    assert tuple(row["s"]) == (5, 8) and tuple(row["trimmed"]) == (9, 13) and row["none"] is None
    assert "One. Two here. Three! Four?"[row["w"]["start"] : row["w"]["end"]].strip() == "Two here."


def test_vectors_survive_packing(spark):
    v = frame(spark, [([1.0, -2.5, 3.25],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(files.unpacked(files.packed("v"))).collect()] == [[1.0, -2.5, 3.25], None]


def test_hash_vector_is_unit(spark):
    v = spark.range(1).select(vector.hash_vector(F.lit("hello"))).first()[0]
    assert len(v) == 32 and sum(x * x for x in v) == pytest.approx(1)


def test_second_slot_must_say_something_else(spark):
    rows = [(1, "a", "the cat sat on the mat", 0.9, 0.9), (1, "b", "the cat sat on the mat!", 0.89, 0.89), (1, "c", "quite another story", 0.8, 0.8), (1, "d", "weak", 0.1, 0.1)]
    c = frame(spark, rows, "query_id int, memory_id string, body string, rerank double, final double")
    got = {r["memory_id"]: (r["slot"], r["reason"]) for r in ranking.slots(c).collect()}
    assert got == {"a": (1, None), "b": (None, "second gate"), "c": (2, None), "d": (None, "gate")}


def test_queue_round_trip_and_states(spark, tmp_path):
    q = tables.conform(frame(spark, [("p1", "pending"), ("p2", "approved")], "id string, status string"), tables.PROPOSAL)
    files.write_queue(q, f"{tmp_path}/queue")
    back = files.read_queue(spark, f"{tmp_path}/queue")
    decided = lifecycle.transitioned(back, frame(spark, [("p1", "approve"), ("p2", "reject")], "id string, decision string"))
    assert {r["id"]: r["status"] for r in decided.collect()} == {"p1": "approved", "p2": "approved"}
    assert proposals.enqueued(back, q).count() == 2


def test_recall_reads_only_and_ranks(spark):
    e = Engine.over(spark, SF)
    q = tables.search_queries(spark, SF).where("query_id < 3")
    asked = e.vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = e.recall(q, asked, "1998-06-01 00:00:00").collect()
    assert rows and max(r["rank"] for r in rows) <= 5
    assert e.chat_history(q).count() > 0 and e.briefing().count() > 0 and e.health().count() == 1


def test_writes_return_next_snapshots(spark):
    e = Engine.over(spark, SF)
    after = e.threaded("essay", "new1", "Title", "Body")
    assert after.memories.count() == e.memories.count() + 1 and after.unfurl("new1").count() == 1
    gone, trash = after.removed(frame(spark, [("new1",)], "memory_id string"), F.current_timestamp(), "test")
    assert gone.memories.count() == e.memories.count() and trash.count() == 1
    with pytest.raises(ValueError):
        e.threaded("nowhere", "x", "t", "b")
    assert e.slept().memories.agg(F.sum("activation")).first()[0] < e.memories.agg(F.sum("activation")).first()[0]


def test_signals(spark):
    row = spark.range(1).select(signals.human_bytes(F.lit(1536)).alias("b"), signals.percent(F.lit(1), F.lit(0)).alias("p"), signals.low_signal(F.lit("...")).alias("l"), text.redacted(F.lit("at 10.0.0.1 Bearer abc")).alias("r")).first()
    assert (row["b"], row["p"], row["l"], row["r"]) == ("1.5 KB", 0.0, "symbols", "at [ip] [bearer]")
