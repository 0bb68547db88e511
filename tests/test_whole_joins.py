"""Similarity joins against brute force over all vectors, whatever their label."""

import numpy as np
import pytest

from remanence.operators import proposals
from remanence.plans import catalog
from remanence.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute(spark):
    """Ids and the rounded cosine of every two vectors."""
    rows = T.vectors(spark, SF).select("memory_id", "embedding").collect()
    v = np.array([r["embedding"] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [r["memory_id"] for r in rows], (v @ v.T).round(6)


def pairs(brute, least):
    names, score = brute
    return {(a, names[j]): score[i, j] for i, a in enumerate(names) for j in np.flatnonzero(score[i] >= least) if a != names[j]}


def test_pairs_cross_labels(spark, brute):
    got = {(r["a"], r["b"]): r["similarity"] for r in catalog.queries()["c10_semantic_pairs"](spark, SF).collect()}
    assert got == pytest.approx({k: s for k, s in pairs(brute, 0.3).items() if k[0] < k[1]})


@pytest.mark.parametrize("block", [64, 4096])
def test_blocks_lose_no_pair(spark, brute, monkeypatch, block):
    monkeypatch.setattr(proposals, "BLOCK", block)
    v, wanted = T.vectors(spark, SF), pairs(brute, 0.2)
    got = [(r["a"], r["b"]) for r in proposals.alike_pairs(v, "memory_id", 0.2).collect()]
    assert sorted(got) == sorted(k for k in wanted if k[0] < k[1])
    asked = v.where("vec_id % 3 = 0")
    names = {r["memory_id"] for r in asked.collect()}
    got = [(r["a"], r["b"]) for r in proposals.alike_to(asked, v, "memory_id", 0.2).collect()]
    assert sorted(got) == sorted(k for k in wanted if k[0] in names)


def test_unusable_vectors_have_no_pairs(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [None, 1.0]), ("f", [1.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    assert [tuple(r) for r in proposals.alike_pairs(v, "id", 0.3).collect()] == [("a", "b", 1.0)]
    assert proposals.alike_pairs(v.where("false"), "id", 0.3).collect() == []


def test_update_candidates_cross_labels(spark, brute):
    m = {r["memory_id"]: r for r in T.memories(spark, SF).collect()}
    direct = {(r["source_id"], r["target_id"]) for r in T.flow_edges(spark, SF).collect()}
    around: dict = {}
    for a, b in direct:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    found: dict = {}
    for (old, new), s in pairs(brute, 0.2).items():
        if old in m and new in m and m[old]["ts"] < m[new]["ts"] and m[old]["source"] == m[new]["source"]:
            edge, shared = new in around.get(old, ()), len(around.get(old, set()) & around.get(new, set()))
            if edge or shared or s >= 0.3:
                found.setdefault(new, []).append((not edge, -s, old))
    best = sorted((d, s, new, old) for new, some in found.items() for d, s, old in sorted(some)[:2])[:80]
    got = [(not r["direct"], -r["similarity"], r["new"], r["old"]) for r in catalog.queries()["c08_update_candidates"](spark, SF).collect()]
    assert sorted(got) == best


def test_clusters_and_links_cross_labels(spark, brute):
    label = {r["memory_id"]: r["label"] for r in T.vectors(spark, SF).collect()}
    clusters = catalog.queries()["j17_bounded_clusters"](spark, SF).collect()
    assert any(label[r["cluster"]] != label[r["member"]] for r in clusters)
    assert len({r["member"] for r in clusters}) == len(clusters)
    links = catalog.queries()["j20_link_proposals"](spark, SF).collect()
    known = pairs(brute, 0.1)
    assert all(known[r["a"], r["b"]] == pytest.approx(r["similarity"]) for r in links)
    assert any(label[r["a"]] != label[r["b"]] for r in links)


def test_evokes_asks_library_texts_of_any_id(spark, brute):
    m = {r["memory_id"]: r["collection"] for r in T.memories(spark, SF).collect()}
    known = {(r["source_id"], r["target_id"]) for r in T.semantic_edges(spark, SF).collect()}
    found: dict = {}
    for (a, b), s in pairs(brute, 0.2).items():
        if m.get(a, "library") != "library" and m.get(b) == "library" and (a, b) not in known:
            found.setdefault(a, []).append((-s, b))
    best = sorted((s, a, b) for a, some in found.items() for s, b in sorted(some)[:2])[:40]
    got = sorted((-r["similarity"], r["a"], r["b"]) for r in catalog.queries()["c07_evokes_proposals"](spark, SF).collect())
    assert got == best and any(b < a for _, a, b in got)


def test_pools_have_members_of_any_id(spark, brute):
    lanes: dict = {}
    for a, b in pairs(brute, 0.3):
        lanes.setdefault(a, {}).setdefault(b, set()).add("semantic")
    for r in T.flow_edges(spark, SF).where("weight >= 0.4").collect():
        lanes.setdefault(r["source_id"], {}).setdefault(r["target_id"], set()).add("flow")
    wanted = {(a, b, "+".join(sorted(some[b]))) for a, some in lanes.items() for b in sorted(some, key=lambda b: (-len(some[b]), b))[:24]}
    assert {tuple(r) for r in catalog.queries()["j18_candidate_pools"](spark, SF).collect()} == wanted
    assert any(b < a and "semantic" in lane for a, b, lane in wanted)


@pytest.mark.parametrize("block", [20, 4096])
def test_first_alike_are_the_smallest_ids(spark, brute, monkeypatch, block):
    monkeypatch.setattr(proposals, "BLOCK", block)
    v, wanted = T.vectors(spark, SF), {}
    for a, b in pairs(brute, 0.2):
        wanted.setdefault(a, []).append(b)
    got: dict = {}
    for r in proposals.first_alike_to(v, v, "memory_id", 0.2, 3).collect():
        got.setdefault(r["a"], []).append(r["b"])
    assert {a: sorted(some) for a, some in got.items()} == {a: sorted(some)[:3] for a, some in wanted.items()}


def test_edges_keep_their_likeness(spark, brute):
    known = pairs(brute, 0.2)
    edges = T.flow_edges(spark, SF).toDF("a", "b", *T.flow_edges(spark, SF).columns[2:])
    got = {(r["a"], r["b"]): r["similarity"] for r in proposals.alike_ends(edges, T.vectors(spark, SF), 0.2).collect()}
    assert got == pytest.approx({k: known[k] for k in {(r["a"], r["b"]) for r in edges.collect()} if k in known})


def test_blocks_grow_before_they_become_many(spark):
    """A vector is sent once for each block."""
    assert [proposals._block_count(spark.range(n)) for n in (0, 5000, 60_000, 200_000, 400_000)] == [1, 2, 15, 16, 25]


def test_blocks_of_large_tables_are_sent_together(spark):
    """A vector is sent once for each of them."""
    assert [proposals._sent_count(spark.range(n)) for n in (0, 60_000, 200_000, 400_000, 615_384, 1_200_000)] == [1, 15, 16, 16, 16, 19]
