"""Events accepted a window apart against a plain fold."""

import datetime
import random

import pytest

from remanence.operators import records

BASE = datetime.datetime(2024, 1, 1)


def plain(rows, minutes):
    last, out = {}, []
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= datetime.timedelta(minutes=minutes):
            last[k] = t
            out.append((i, k, t))
    return sorted(out, key=str)


@pytest.mark.parametrize("folded", [4096, 3])
def test_accepted_is_the_fold(spark, folded):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        key = rng.choice(["busy", "busy", "busy", "a", "b", None])
        t = BASE + datetime.timedelta(seconds=rng.randint(0, 4 * 86_400) if key != "busy" else rng.randint(0, 90_000))
        rows.append((i, key, t))
    rows += [(2000 + i, "even", BASE + datetime.timedelta(minutes=5 * i)) for i in range(700)] + [(3000, "a", None)]
    rows += [(4000 + i, "same", BASE) for i in range(5)] + [(4100, "edge", BASE + datetime.timedelta(days=1)), (4101, "edge", BASE + datetime.timedelta(hours=23, minutes=55))]
    events = spark.createDataFrame(rows, "event_id int, kind string, ts timestamp_ntz").repartition(3)
    got = records.first_accepted(events, "kind", "ts", 5, folded)
    assert got.columns == ["event_id", "kind", "ts"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 5)
    assert records.first_accepted(events.limit(0), "kind", "ts", 5).count() == 0
