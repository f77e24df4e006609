import random

import pytest

from frostgrid.functions import count, mean, total
from frostgrid.operators import sessionize
from tests.frames import at, frame, ordered, rows_of

SCHEMA = "key string, ts timestamp_ntz, value double"


def sessions_of(rows, gap):
    out = []
    for key in {r[0] for r in rows if r[1] is not None}:
        run = []
        for event in sorted((r[1], r[2]) for r in rows if r[0] == key and r[1] is not None) + [None]:
            if run and (event is None or event[0] - run[-1][0] > gap):
                values = [v for _, v in run]
                out.append((key, run[0][0], run[-1][0] + gap, len(run), sum(values), sum(values) / len(values)))
                run = []
            run.append(event)
    return out


@pytest.mark.parametrize("chunk_cells", [1, 2, 10, 65_536])
def test_sessionize(spark, chunk_cells):
    rng = random.Random(chunk_cells)
    # Whole seconds, so that silences of exactly the gap are common.
    rows = [
        (rng.choice(["a", "b", None]), at(rng.randrange(-300, 600)), float(rng.randrange(5))) for _ in range(120)
    ] + [("a", None, 1.0), ("c", at(5), 2.0)]
    got = sessionize(
        frame(spark, SCHEMA, rows), "ts", ["key"], "10 seconds",
        {"n": count(), "s": total("value"), "m": mean("value")}, chunk_cells,
    )
    assert rows_of(got) == ordered(sessions_of(rows, at(10) - at(0)))


def test_events_exactly_the_gap_apart_stay_together(spark):
    rows = [("a", at(0), 1.0), ("a", at(10), 1.0), ("a", at(20.000001), 1.0)]
    got = sessionize(frame(spark, SCHEMA, rows), "ts", ["key"], "10 seconds", {"n": count()})
    assert rows_of(got) == ordered([
        ("a", at(0), at(20), 2), ("a", at(20.000001), at(30.000001), 1),
    ])


def test_no_events(spark):
    assert sessionize(frame(spark, SCHEMA, []), "ts", ["key"], "10 seconds", {"n": count()}).count() == 0
