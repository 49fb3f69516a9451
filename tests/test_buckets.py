"""Buckets cut into slots against one walk over all events."""

import random

import pytest
from gristmill.operators import buckets


def walk(rows, burst, rate, unit=10**10):
    out, state = [], {}
    for k, t, tie, w, bf, rf in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        level, last = state.get(k, (0.0, t))
        left = max(0.0, level - (t - last) * rate * max(1, int((rf if rf is not None else 1.0) * 10_000)) / 10_000)
        limit = burst * max(1, int((bf if bf is not None else 1.0) * 10_000)) / 10_000
        refused = left + (w or 0) > limit + 1e-9
        level = left if refused else left + (w or 0)
        state[k] = (level, t)
        out.append((k, tie, round(level, 6), refused))
    return sorted(out)


@pytest.mark.parametrize(("pieces", "slot"), [(buckets.PIECES, 50), (3, 7), (buckets.PIECES, 10**6)])
def test_one_user_with_most_events(spark, monkeypatch, pieces, slot):
    monkeypatch.setattr(buckets, "PIECES", pieces)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randrange(1000) if rng.random() < 0.99 else None, i, rng.choice([1.0, 2.0, 3.0, None]), rng.choice([None, 1.0, 0.5, 2.0]), rng.choice([None, 1.0, 0.5, 4.0])) for i in range(1500)]
    df = spark.createDataFrame(rows, "user string, s long, id long, w double, bf double, rf double").selectExpr("user", "timestamp_seconds(s) AS ts", "id", "w", "bf", "rf")
    got = buckets.limits(df, "user", "ts", "id", 6, 0.5, "w", "bf", "rf", slot)
    assert sorted((r.user, r.id, round(r.level, 6), r.limited) for r in got.collect()) == walk(rows, 6, 0.5)
    assert got.columns == ["user", "id", "level", "limited"] and {r[3] for r in walk(rows, 6, 0.5)} == {True, False}


def test_pieces_are_the_walk():
    rng = random.Random(4)
    for _ in range(200):
        events = [(rng.randrange(4), rng.randrange(1, 4), rng.randrange(2, 9), rng.randrange(1, 3)) for _ in range(rng.randrange(1, 30))]
        f = buckets.Pieces()
        for e in events:
            f.then(*e)
        for start in range(14):
            level = start
            for e in events:
                level, _ = buckets.after(level, *e)
            assert f.at(level=start) == level


def test_empty(spark):
    df = spark.createDataFrame([], "user string, ts timestamp, id long")
    assert buckets.limits(df, "user", "ts", "id", 5, 0.1).count() == 0
