"""Components, pair groups and splits."""

import itertools
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import flow, pairs, seedtree, splits


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {(x, find(x)) for x in parent}


def components(spark, edges):
    rows = seedtree.components(spark.createDataFrame(edges, "v bigint, m bigint"), "v", "m").collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-30, 30)), st.integers(-30, 30)), max_size=50))
def test_random_graphs(spark, edges):
    assert components(spark, edges) == union_find(edges)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(70)], [(500, i) for i in range(1, 120)], [(i, j) for i, j in itertools.combinations(range(12), 2)]], ids=["empty", "loop", "path", "star", "clique"])
def test_shapes(spark, edges):
    assert components(spark, edges) == union_find(edges)


MATCH = "pair_id bigint, token string, left_record_id bigint, right_record_id bigint, verdict string, score double, recorded_at timestamp, vertex string, a int"


def groups(spark, rows, ids=range(1, 20)):
    from datetime import datetime

    matches = [(p, t, l, r, v, None, None if d is None else datetime(2031, 1, d), "x", 1) for p, t, l, r, v, d in rows]
    records = spark.createDataFrame([(i,) for i in ids], "record_id bigint")
    return {tuple(r) for r in pairs.groups(spark.createDataFrame(matches, MATCH), records).collect()}


def test_pair_rules(spark):
    rows = [
        (1, "sha:a", 2, 1, "match", 1), (1, "sha:a", 2, 1, "match", 1), (2, "sha:b", 1, 2, "MATCH ", 3), (3, "x:y", 2, 3, "match", 1), (4, "x:y", 3, 2, "No_Match", 2),
        (5, "x: Unknown", 4, 5, "match", 1), (6, None, 4, 5, "match", 1), (7, "x:y", 6, 6, "match", 1), (8, "x:y", 7, None, "match", 1), (9, "x:y", 8, 99, "match", 1), (10, "x:y:z", 9, 10, "match", None),
        (11, "x:y", 11, 12, "match", 1), (12, "x:y", 12, 11, "no_match", 1), (13, "x:y", 13, 14, None, 5),
    ]
    assert groups(spark, rows) == {(1, 1), (2, 1), (9, 9), (10, 9)}


def test_no_pairs(spark):
    assert groups(spark, []) == set()
    assert groups(spark, [(1, "a:b", 1, 2, "match", 1)], ids=[]) == set()


def brute_cost(supplies, quotas, costs):
    best = None
    for choice in itertools.product(range(len(quotas)), repeat=len(supplies)):
        got = Counter()
        for s, c in zip(supplies, choice):
            got[c] += s
        over = sum(max(0, got[i] - q) for i, q in enumerate(quotas))
        cost = over * 10 + sum(s * costs[i][c] for i, (s, c) in enumerate(zip(supplies, choice)))
        best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=3, max_size=3), min_size=1, max_size=5), st.lists(st.integers(0, 3), min_size=3, max_size=3))
def test_flow_is_cheapest(costs, quotas):
    n = len(costs)
    net = flow.Network(2 + n + 3)
    for j, q in enumerate(quotas):
        net.arc(2 + n + j, 1, q)
        net.arc(2 + n + j, 1, n, 10)
    arcs = {}
    for i in range(n):
        net.arc(0, 2 + i, 1)
        for j in range(3):
            arcs[i, j] = net.arc(2 + i, 2 + n + j, 1, costs[i][j])
    assert net.send(0, 1) == n
    over = sum(max(0, sum(net.flow(arcs[i, j]) for i in range(n)) - quotas[j]) for j in range(3))
    assert over * 10 + sum(net.flow(a) * costs[i][j] for (i, j), a in arcs.items()) == brute_cost([1] * n, quotas, costs)


RECORD = "record_id bigint, source_split string, source_group string, specimen_id string, annotations array<struct<class_id:int>>, grp string, group_id int"


def records(spark, rows):
    return spark.createDataFrame([(i, s, g, p, [(i % 3,)] if i and i % 2 else None, "x", 0) for i, s, g, p in rows], RECORD)


def test_sets_and_torn(spark):
    rows = [
        (1, "train", "Pier\\A.jpg", None), (2, "val", " pier/a ", None), (3, None, "TBD", "sp-1"), (4, "train", "unknown", "sp-1"), (5, "test", "b", "SP-1 "), (6, "test", "?", "none"), (7, "train", "c", None),
        (8, "locked_test", "c", None), (8, "locked_test", "c", None), (9, "whatever", "b", None), (None, "train", "a", None),
    ]
    members = splits.sets(records(spark, rows))
    got = {r.record_id: r.group_id for r in members.collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 9: 3, 6: 6, 7: 7, 8: 7}
    assert {tuple(r) for r in splits.torn(members).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (8, 7)}


def targets(spark):
    return spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "target_split string, share double")


def test_splits_keep_sets_and_shares(spark, monkeypatch):
    monkeypatch.setattr(splits, "RANGE_SETS", 10)
    sizes = [60, 25] + [5] * 12 + [2] * 20 + [1] * 80
    rows = [(k * 100 + i, "train", f"g{k}", None) for k, n in enumerate(sizes) for i in range(n)]
    out = splits.assign(records(spark, rows), targets(spark)).collect()
    assert len(out) == sum(sizes) and len({r.record_id for r in out}) == sum(sizes)
    by = defaultdict(set)
    for r in out:
        by[r.group_id].add(r.new_split)
    assert all(len(s) == 1 for s in by.values())
    share = Counter(r.new_split for r in out)
    assert all(abs(share[s] - p * sum(sizes)) <= 1 for s, p in (("train", 0.7), ("validation", 0.15), ("test", 0.15)))


def test_one_set_may_hold_most(spark):
    rows = [(i, "train", "big" if i < 70 else f"g{i}", None) for i in range(100)]
    out = splits.assign(records(spark, rows), targets(spark)).collect()
    assert Counter(r.new_split for r in out) == {"train": 70, "validation": 15, "test": 15}


def test_empty_table(spark):
    assert splits.assign(records(spark, []), targets(spark)).count() == 0
    assert splits.torn(splits.sets(records(spark, []))).count() == 0
