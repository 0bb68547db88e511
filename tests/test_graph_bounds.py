"""Bounded spread against a queue-based walk over random graphs."""

import datetime
import random

import pytest

from remanence.operators import graph, search

NOW = "2024-06-01 00:00:00"


def random_graph(seed, n=30, m=160):
    rng = random.Random(seed)
    edges = {}
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        edges[f"n{a:02d}", f"n{b:02d}"] = (round(rng.uniform(0.1, 3), 3), rng.choice([0.25, 0.5, 1.0]), datetime.datetime(2024, 5, 1) + datetime.timedelta(days=rng.randint(-120, 29)))
    return [f"n{i:02d}" for i in range(n)], edges


def walk_diffusion(seeds, edges, depth, budget):
    now = datetime.datetime(2024, 6, 1)

    def eff(e):
        w, c, t = e
        age = (now - t).total_seconds() / 86400
        return w * c * (1.0 if age <= 7 else 0.8 if age <= 30 else 0.6 if age <= 90 else 0.4)

    seen = dict(sorted(seeds.items(), key=lambda s: (-s[1], s[0]))[:budget])
    frontier = list(seen)
    depths = dict.fromkeys(seen, 0)
    for level in range(1, depth + 1):
        reached, offers = [], []
        for node in frontier:
            out = {b: eff(e) for (a, b), e in edges.items() if a == node}
            whole = sum(out.values())
            offers += [(b, seen[node] * 0.85 * x / whole) for b, x in sorted(out.items(), key=lambda p: (-round(p[1], 9), p[0]))]
        for b, mass in offers:
            if b not in seen and len(seen) < budget:
                seen[b], depths[b] = mass, level
                reached.append(b)
        frontier = reached
    return {n: (pytest.approx(m, rel=1e-9), depths[n]) for n, m in seen.items()}


@pytest.mark.parametrize("seed", range(4))
def test_diffusion(spark, seed):
    nodes, edges = random_graph(seed)
    frame = spark.createDataFrame([(a, b, *e) for (a, b), e in edges.items()], "source_id string, target_id string, weight double, conductance double, last_fired timestamp_ntz")
    seeds = {nodes[k]: s for k, s in ((0, 1.0), (1, 0.7), (2, 0.7))}
    rows = search.diffused(spark.createDataFrame([(1, n, s) for n, s in seeds.items()], "query_id int, memory_id string, similarity double"), frame, NOW, 3, 18).collect()
    assert {r["memory_id"]: (r["mass"], r["depth"]) for r in rows} == walk_diffusion(seeds, edges, 3, 18)


def walk_heat(roots, edges, nodes, boost, fan, budget):
    queue = [(n, boost, 0) for n in roots]
    seen, out = set(roots), {}
    while queue:
        node, amount, level = queue.pop(0)
        out[node] = (pytest.approx(amount, abs=1e-8), level)
        if level < 3:
            best = sorted(((b, e) for (a, b), e in edges.items() if a == node), key=lambda x: (-round(x[1][0] * x[1][1], 9), x[0]))[:fan]
            for b, (w, c, _) in best:
                if b not in seen and len(seen) < budget:
                    seen.add(b)
                    queue.append((b, amount * 0.5 * min(w / 1.5, 1) * c, level + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_heat(spark, seed):
    nodes, edges = random_graph(seed)
    frame = spark.createDataFrame([(a, b, *e) for (a, b), e in edges.items()], "source_id string, target_id string, weight double, conductance double, last_fired timestamp_ntz")
    m = spark.createDataFrame([(n, 0.0) for n in nodes], "memory_id string, activation double")
    roots = spark.createDataFrame([(nodes[3], 1), (nodes[4], 2)], "memory_id string, place int")
    rows = graph.heat_spread(m, frame, roots, 0.4, fan=3, nodes=20).collect()
    assert {r["memory_id"]: (r["amount"], r["depth"]) for r in rows} == walk_heat([nodes[3], nodes[4]], edges, nodes, 0.4, 3, 20)
