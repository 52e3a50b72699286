import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import runs

SCHEMA = "session_id string, fish_id bigint, frame bigint, provisional_grade string, provisional_score double, detection_confidence double, observed_at timestamp, received_at timestamp, code string, stretch int"
T0 = datetime(2031, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(s, f, n, g, None, 0.5, T0 + timedelta(seconds=n or 0), None if r is None else T0 + timedelta(seconds=r), "clash", 1) for s, f, n, g, r in rows], SCHEMA)


def found(spark, rows):
    return sorted(tuple(r) for r in runs.found(table(spark, rows)).collect())


def brute(codes, weights, how):
    """The least cost over all segmentations."""
    n = len(codes)
    best = [0.0] + [None] * n
    for t in range(1, n + 1):
        best[t] = min(best[s] + how.penalty + min(sum(weights[i] * how.distance[codes[i]][k] for i in range(s, t)) for k in range(4)) for s in range(t))
    return best[n]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), min_size=1, max_size=14), st.sampled_from([0.25, 0.7, 1.5, 3.0]), st.booleans())
def test_segmentation_is_optimal(blocks, penalty, steps):
    how = runs.Segmentation(penalty, runs._STEPS if steps else runs._UNIT)
    codes, weights = [b[0] for b in blocks], [b[1] for b in blocks]
    got = runs.segment(codes, weights, how)
    cost, at = 0.0, 0
    for end, grade in got:
        cost += how.penalty + sum(weights[i] * how.distance[codes[i]][grade] for i in range(at, end))
        at = end
    assert at == len(codes) and cost == pytest.approx(brute(codes, weights, how))


def test_rules(spark):
    a = [("s", 1, n, "Class A", n) for n in (1, 2, 31, 62)]
    assert found(spark, a) == [("s", 1, 1, 31)]
    assert found(spark, [*a[:3], ("s", 1, 15, None, 15)]) == [("s", 1, 1, 2)]
    assert found(spark, [*a[:3], ("s", 1, 15, "b", 15), ("s", 1, 15, " GRADE_A", 16)]) == [("s", 1, 1, 31)]
    assert found(spark, [*a[:3], ("s", 1, 15, "Ungraded", 16), ("s", 1, 15, "A", 15)]) == [("s", 1, 1, 2)]
    assert found(spark, [("s", 1, 5, "A", 1), ("s", 1, 5, "A", 1)]) == []


def test_ties_nulls_and_clashes(spark):
    rows = [("s", 1, 1, "A", None), ("s", 1, 1, "Rejected", 0), ("s", 1, 2, "Reject", 3), ("s", 1, 2, None, 3), (None, 1, 3, "A", 1), ("s", None, 3, "A", 1), ("s", 1, None, "A", 1), ("t", 1, 2, "A", 1), ("t", 2, 3, "A", 1)]
    assert found(spark, rows) == [("s", 1, 1, 2)]
    assert found(spark, []) == []


def test_joined_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(runs, "STRETCH", 64)
    rows = [("s", 1, n, "A", n) for n in range(-100, 300, 7)] + [("s", 2, n, "B" if n < 128 else "C", n) for n in range(100, 160, 3)]
    assert found(spark, rows) == [("s", 1, -100, 299 - (299 + 100) % 7), ("s", 2, 100, 127), ("s", 2, 130, 157)]
    broken = [("s", 1, 60, "A", 1), ("s", 1, 62, "A", 1), ("s", 1, 63, None, 1), ("s", 1, 64, "A", 1), ("s", 1, 66, "A", 1)]
    assert found(spark, broken) == [("s", 1, 60, 62), ("s", 1, 64, 66)]


def test_near_runs_step_over_flickers(spark):
    rows = [("s", 1, n, "B" if n == 5 else "A", n) for n in range(10)]
    got = runs.runs(table(spark, rows), runs.NEAR, 1).collect()
    assert [(r.grade, r.start_frame, r.end_frame, r.n_frames, r.foreign_frames, r.duration_s) for r in got] == [("Class A", 0, 9, 10, 1, 9.0)]
    assert runs.runs(table(spark, rows), runs.EXACT, 1).count() == 3


def test_near_runs_do_not_see_borders(spark, monkeypatch):
    """Grades 0x10, 1x5, 0x10 and random ones give the same runs whole and cut into stretches."""
    rng = random.Random(3)
    names = "ABC"
    rows = [("s", 1, n, "B" if 10 <= n < 15 else "A", n) for n in range(25)]
    for fish in range(2, 12):
        n = rng.randrange(-40, 0)
        for _ in range(150):
            n += rng.choice([1, 1, 1, 2, 5, 29, 30, 31, 40])
            rows.append(("s", fish, n, None if rng.random() < 0.03 else rng.choice(names) if rng.random() < 0.5 else "A", n + 100))
    whole = sorted(map(tuple, runs.runs(table(spark, rows), runs.NEAR, 1).collect()))
    for stretch in (40, 64, 100):  # longer than the largest gap, as STRETCH is
        monkeypatch.setattr(runs, "STRETCH", stretch)
        assert sorted(map(tuple, runs.runs(table(spark, rows), runs.NEAR, 1).collect())) == whole


def test_long_run(spark):
    rows = [("s", 1, n, "A", 0) for n in range(20_000)]
    assert found(spark, rows) == [("s", 1, 0, 19_999)]
