"""Components, chain ends and structure proposals against plain versions."""

import random

import pytest

from remanence.operators import structure


def plain_components(nodes, ahead):
    """Tarjan's algorithm with a stack of its own."""
    index, low, stack, on, out = {}, {}, [], set(), []
    for root in sorted(nodes):
        if root in index:
            continue
        work = [(root, iter(sorted(ahead.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(sorted(ahead.get(n, ())))))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    component = set()
                    while node not in component:
                        item = stack.pop()
                        on.discard(item)
                        component.add(item)
                    out.append(component)
    return out


def random_edges(seed, nodes=120, edges=150):
    rng = random.Random(seed)
    name = lambda i: f"n{i:03d}"
    rows = {(name(rng.randrange(nodes)), name(rng.randrange(nodes))) for _ in range(edges)}
    ring = [f"r{seed}{i:02d}" for i in range(50)]
    rng.shuffle(ring)
    rows |= set(zip(ring, ring[1:] + ring[:1]))
    line = [f"c{seed}{i:02d}" for i in range(60)]
    rows |= set(zip(line, line[1:])) | {(line[-1], ring[7]), (ring[20], name(3))}
    return sorted(rows)


def frame(spark, rows):
    return spark.createDataFrame([(s, t, "x") for s, t in rows], "source_id string, target_id string, component string").repartition(2)


@pytest.mark.parametrize("seed, edges", [(2, 150), (3, 400)])
def test_components_are_tarjans(spark, seed, edges):
    rows = random_edges(seed, edges=edges)
    ahead = {}
    for s, t in rows:
        ahead.setdefault(s, set()).add(t)
    nodes = {n for e in rows for n in e}
    wanted = {n: (min(c), len(c) > 1 or n in ahead.get(n, ())) for c in plain_components(nodes, ahead) for n in c}
    got = {r.memory_id: (r.component, r.cyclic) for r in structure.strong_components(frame(spark, rows + rows[:5])).collect()}
    assert got == wanted and sum(c for _, c in wanted.values()) >= 50


def test_no_edges_and_null_ends(spark):
    rows = spark.createDataFrame([(None, "a"), ("b", None), ("c", "c")], "source_id string, target_id string")
    assert [tuple(r) for r in structure.strong_components(rows).collect()] == [("c", "c", True)]
    assert structure.strong_components(rows.limit(0)).count() == 0


def test_chain_ends_double(spark):
    rows = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(200)] + [("b", "a100"), ("x", "y")]
    got = {r.memory_id: (r.last, r.hops) for r in structure.chain_ends(spark.createDataFrame(rows, "memory_id string, next string")).collect()}
    assert got == {f"a{i:03d}": ("a200", 200 - i) for i in range(200)} | {"b": ("a200", 101), "x": ("y", 1)}


def plain_proposals(rows, ts, most=5):
    """``rows``: (source, target, created); edges lead from the updated record on."""
    ahead = {}
    for s, t, _ in rows:
        ahead.setdefault(t, set()).add(s)
    ordered = {k: sorted(v, key=lambda m: (m not in ts, [-ord(c) for c in ts.get(m, "")], m)) for k, v in ahead.items()}
    nodes, out, cyclic = {n for s, t, _ in rows for n in (s, t)}, set(), set()
    for c in plain_components(nodes, ahead):
        if len(c) > 1 or next(iter(c)) in ahead.get(next(iter(c)), ()):
            cyclic |= c
            created, s, t = max((created or "", s, t) for s, t, created in rows if s in c and t in c)
            out.add(("structure_cycle", s, t, len(c), min(c)))
    for start in sorted(nodes - cyclic):
        path = [start]
        while ordered.get(path[-1]) and ordered[path[-1]][0] not in path:
            path.append(ordered[path[-1]][0])
        if len(path) - 1 > most and (path[-1], start) not in {(s, t) for s, t, _ in rows}:
            out.add(("structure_overlong", path[-1], start, len(path) - 1, None))
    return out


@pytest.mark.parametrize("seed", [4])
def test_proposals(spark, seed):
    rng = random.Random(seed)
    rows = [(t, s, rng.choice([None, f"2024-01-{rng.randint(10, 28)}"])) for s, t in random_edges(seed, nodes=150, edges=130)]
    nodes = sorted({n for s, t, _ in rows for n in (s, t)})
    ts = {n: f"2024-02-{rng.randint(10, 28)}" for n in nodes if rng.random() < 0.9}
    memories = spark.createDataFrame(list(ts.items()), "memory_id string, ts string")
    updates = spark.createDataFrame(rows, "source_id string, target_id string, created string").repartition(2)
    got = structure.structure_proposals(updates, memories).collect()
    assert {(r.kind, r.source_id, r.target_id, r.size, r.component) for r in got} == plain_proposals(rows, ts)
    assert len({r.proposal_id for r in got}) == len(got)
    assert {r.kind for r in got} == {"structure_cycle", "structure_overlong"}


def test_no_join_passes_a_table_through_the_driver(spark, monkeypatch):
    """A broadcast is gathered by the driver, and every round would make some."""
    from contextlib import contextmanager

    plans = []
    real, last = structure.workspace, structure.settled
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df

    @contextmanager
    def watched(session):
        with real(session) as settle:
            yield lambda df: settle(noted(df))

    monkeypatch.setattr(structure, "workspace", watched)
    monkeypatch.setattr(structure, "settled", lambda df: last(noted(df)))
    rows = [("a", "b", "2020"), ("b", "c", "2021"), ("c", "a", "2022"), ("c", "d", "2022")]
    memories = spark.createDataFrame([(m, 1) for m in "abcd"], "memory_id string, ts int")
    got = structure.structure_proposals(spark.createDataFrame(rows, "source_id string, target_id string, created string"), memories).collect()
    assert [(r["kind"], r["source_id"], r["target_id"], r["size"]) for r in got] == [("structure_cycle", "c", "a", 3)]
    assert len(plans) > 10 and not any("Broadcast" in plan for plan in plans)
