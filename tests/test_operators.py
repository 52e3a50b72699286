import itertools
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import geometry, numbers
from tidewright.operators import duplicates, graph, history, matching, metrics, store, windows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_numbers(spark):
    assert one(spark, numbers.finite(F.lit("nan"))) is None and one(spark, numbers.finite(F.lit("1e2"))) == 100 and one(spark, numbers.finite(F.lit("x"))) is None
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) is None and one(spark, numbers.f1_or_zero(F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, numbers.noisy_or(F.array(F.lit(0.5), F.lit(0.5)))) == 0.75
    assert one(spark, numbers.weighted_present([(0.5, F.lit(1.0)), (0.5, F.lit(None).cast("double"))])) == 1
    assert one(spark, numbers.logistic(F.lit(-1000.0))) == 0 and one(spark, numbers.scaled(F.lit(0.125), 1, 2)) == 0.12


def test_geometry(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))))
    assert one(spark, geometry.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, geometry.clamp(box(-5, 0, -1, 9), F.lit(10.0), F.lit(10.0))) is None
    square = F.array(*(F.lit(float(v)) for v in (0, 0, 2, 0, 2, 2, 0, 2)))
    assert one(spark, geometry.polygon_area(square)) == 4 and one(spark, geometry.is_rectangle(square))
    line = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "x double, y double")
    assert line.agg(geometry.principal_angle(F.col("x"), F.col("y"))).first()[0] == pytest.approx(np.pi / 4)


def test_days_are_wall_days(spark):
    rows = spark.createDataFrame([("2026-01-01T23:30:00-05:00",), ("2026-01-02T00:30:00+09:00",), ("bad",), (None,)], "ts string")
    assert history.between_days(rows, "ts", date(2026, 1, 1), date(2026, 1, 1)).count() == 1
    assert history.between_days(rows, "ts", None, date(2026, 1, 2)).count() == 2
    with pytest.raises(ValueError):
        history.between_days(rows, "ts", date(2026, 1, 2), date(2026, 1, 1))


def test_search_and_pages(spark):
    rows = spark.range(1, 31).withColumnRenamed("id", "n")
    assert history.id_search(rows, "n", "Fish #2 ").count() == 12 and history.id_search(rows, "n", "").count() == 30
    assert [r.n for r in history.page(rows, [F.desc("n")], 2, 10).collect()] == list(range(20, 10, -1))
    assert tuple(history.page_counts(rows.limit(0), 10).first()) == (0, 1)
    assert history.newest(rows, [F.desc("n")], 0).count() == 1


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y"), (None, 1, "z")], "k string, v int, t string")
    assert sorted(map(tuple, store.latest(rows, ["k"], F.col("v")).collect()), key=str) == sorted([("a", 2, "x"), ("b", 1, "y"), (None, 1, "z")], key=str)
    new = spark.createDataFrame([("b", 9, None), ("c", 5, "n")], "k string, v int, t string")
    merged = {r.k: (r.v, r.t) for r in store.merge(rows.where("k = 'b'"), new, ["k"], ("v",)).collect()}
    assert merged == {"b": (1, "y"), "c": (5, "n")}
    assert store.orphans(new, rows, ["k"]).count() == 1
    status = {r.k: r.status for r in store.compare(rows.where("v = 1 and k is not null"), new.withColumn("v", F.lit(1)), ["k"], ["v"]).collect()}
    assert status == {"a": "left_only", "b": "same", "c": "right_only"}
    path = str(tmp_path / "store")
    assert store.read_current(spark, path) is None
    store.upsert(rows.where("k is not null"), path, ["k"], F.col("v"))
    store.upsert(new, path, ["k"], F.col("v"))
    assert {r.k: r.v for r in store.read_current(spark, path).collect()} == {"a": 2, "b": 9, "c": 5}


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    """A write that dies leaves the last snapshot; old snapshots go, the newest stay."""
    path = str(tmp_path / "store")
    for v in range(5):
        store.upsert(spark.createDataFrame([("a", v)], "k string, v int"), path, ["k"], F.col("v"))
    assert len(list((tmp_path / "store").glob("snapshot-*"))) == store.KEPT

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "latest", dies)
        with pytest.raises(OSError):
            store.upsert(spark.createDataFrame([("a", 9)], "k string, v int"), path, ["k"], F.col("v"))
    (tmp_path / "store" / ".draft-of-a-dead-writer").mkdir()
    assert [tuple(r) for r in store.read_current(spark, path).collect()] == [("a", 4)]


def test_running_number(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    out = windows.running_number(rows, F.floor(F.col("v") / 100), [F.asc("v")])
    assert out.where("running <> v + 1").count() == 0 and out.count() == 1000


def test_sessions_and_crossings(spark):
    rows = spark.createDataFrame([(1, i, float(t), float(v)) for i, (t, v) in enumerate([(0, 1), (10, 9), (20, 1), (31, 9), (32, 9)])], "u int, i int, t double, v double")
    assert [r.session for r in windows.with_sessions(rows, ["u"], "t", F.lit(10.0), "i").orderBy("i").collect()] == [1, 1, 1, 2, 2]
    assert windows.first_crossings(rows, ["u"], "t", "i", "v", 5.0).first().i == 1
    assert one(spark, windows.gated(F.array(*(F.lit(v).cast("bigint") for v in (1, 5, 29, 31, 60, 62))), 30)) == [1, 31, 62]
    frames = spark.createDataFrame([("s", 1, n) for n in (62, 1, 5, 29, 31, 60, 60)] + [("s", 2, None), ("t", None, 9)], "s string, f bigint, n bigint")
    assert {tuple(r) for r in windows.gate(frames, ["s", "f"], "n", 30, "s string, f bigint").collect()} == {("s", 1, 6, 3), ("t", None, 1, 1)}
    assert one(spark, windows.smoothed(F.array(F.lit(1.0), F.lit(2.0)), 0.85)) == pytest.approx(1.15)
    assert one(spark, windows.decayed_maximum(F.array(F.lit(1.0), F.lit(0.0)), 0.1)) == pytest.approx(0.9)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_like_union_find(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {tuple(r) for r in got} == {(x, find(x)) for x in parent} and len(got) == len(parent)


def test_near_codes_find_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 40)
    codes = sorted({int(c) for b in base for c in (b, b ^ np.int64(1), b ^ np.int64(3 << 40), b ^ np.int64(0x1010101))})
    got = {(r.a, r.b, r.distance) for r in duplicates.near_codes(spark.createDataFrame([(c,) for c in codes] * 2 + [(None,)], "c bigint"), "c", 4).collect()}
    want = {(a, b, d) for a, b in itertools.combinations(codes, 2) if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 4}
    assert got == want and want


def test_matching():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(0, 5), range(1, 5)):
        score = rng.random((n, m)).round(3)
        best = max((sum(max(score[i, c] - 0.3, 0) for i, c in enumerate(p) if c < m) for p in itertools.permutations(range(max(n, m) + n), n)), default=0)
        got = matching.optimal_match(score, 0.3)
        assert sum(score[i, j] - 0.3 for i, j in enumerate(got) if j >= 0) == pytest.approx(best)
        assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30]], float)
    assert matching.suppress(boxes, np.array([0.5, 0.9, 0.1]), 0.5).tolist() == [1, 2]
    assert matching.greedy_match(boxes[:1], boxes, np.array([0.5, 0.9, 0.1]), 0.5) == [-1, 0, -1]


def test_owner_cases(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"frame int, parts array<struct<id:int,box:{box}>>, parents array<struct<id:int,box:{box}>>"
    two = [(1, (0.0, 0.0, 100.0, 100.0)), (2, (140.0, 0.0, 240.0, 100.0))]
    near = [(1, (0.0, 0.0, 120.0, 100.0)), (2, (5.0, 0.0, 125.0, 100.0))]
    rows = [(1, [(0, (12.0, 20.0, 40.0, 50.0))], two), (2, [(0, (50.0, 20.0, 75.0, 55.0))], near), (3, [(0, (220.0, 220.0, 260.0, 260.0))], two[:1]), (4, [(0, (0.0, 0.0, 1.0, 1.0))], [])]
    got = {r.frame: r for r in matching.owners(spark.createDataFrame(rows, schema), "parts", "parents", 0.3, 0.1).collect()}
    assert got[1].status == "ASSIGNED" and got[1].parent == 1 and got[1].score > 0.7
    assert [got[i].status for i in (2, 3, 4)] == ["AMBIGUOUS", "UNASSIGNED", "UNASSIGNED"]


def test_metrics(spark):
    pairs = spark.createDataFrame(list(zip("AABB", "ABBB")), "a string, b string")
    m = metrics.confusion(pairs, F.col("a"), F.col("b"))
    k = metrics.kappa(m).first()
    assert (k.n, k.observed, k.kappa) == (4, 0.75, 0.5)
    per = {r["class"]: r for r in metrics.per_class(m).collect()}
    assert per["A"].precision == 1 and per["A"].recall == 0.5 and per["B"].precision == pytest.approx(2 / 3)
    perfect = spark.createDataFrame([("x", i, 1.0 - i / 10, 1) for i in range(5)] + [("y", i, 1.0 - i / 10, i % 2) for i in range(4)], "k string, i int, s double, hit int")
    ranked = metrics.ranked(perfect, ["k"], "s", "i", F.col("hit") == 1)
    assert {r.k: round(r.ap, 6) for r in metrics.average_precision_101(ranked, ["k"]).collect()} == {"x": 1.0, "y": 0.5}
    assert {r.k: round(r.ap, 6) for r in metrics.average_precision_envelope(ranked, ["k"]).collect()} == {"x": 1.0, "y": 0.5}
    e = {r.subset: r for r in metrics.counting_error(spark.createDataFrame([("a", 3, 4), ("a", 5, 5), (None, 1, 3)], "g string, t int, p int"), F.col("t"), F.col("p"), "g").collect()}
    assert e["all"].mae == 1 and e["all"].within_one == pytest.approx(2 / 3) and set(e) == {"all", "a"}


def test_confounding_and_crossing(spark):
    rows = spark.createDataFrame([("g1", "a", "train"), ("g1", "a", "test"), ("g2", "b", "test")], "g string, l string, s string")
    assert tuple(duplicates.confounded(rows, F.col("g"), F.col("l")).first()) == (2, 2, True)
    assert [(r.kind, r.value, r.n_parts) for r in duplicates.crossing_values(rows, {"g": F.col("g")}, F.col("s")).collect()] == [("g", "g1", 2)]


def test_pixels(spark):
    from tidewright.operators import pixels

    assert pixels.hsv(np.array([[[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [0.5, 0.5, 0.5]]]))[0].round(6).tolist() == [[0, 1, 1], [120, 1, 1], [240, 1, 1], [0, 0, 0.5]]
    assert pixels.lab(np.array([[[1.0, 1, 1], [0, 0, 0]]]))[0].round(2).tolist() == [[100, 0.0, 0.0], [0, 0, 0]] or np.allclose(pixels.lab(np.ones((1, 1, 3))), [[[100, 0, 0]]], atol=0.02)
    mask = np.zeros((6, 8), bool)
    mask[1:3, 1:4] = mask[4, 6] = True
    mask[3, 5] = True
    parts = pixels.components(mask)
    assert parts.max() == 2 and (parts == 0).sum() == 48 - 8
    only = parts == 1
    assert pixels.perimeter(only) == 10 and pixels.hull(only) == (6.0, 10.0) and pixels.widths(only).tolist() == [3, 3] and pixels.mirror_overlap(only) == 1.0
    long, short, angle = pixels.axes(only)
    assert long > short and min(angle, np.pi - angle) < 1e-6
    flat = pixels.cooccurrence(np.full((5, 5), 100.0), np.ones((5, 5), bool))
    assert pixels.texture(flat)["energy"] == 1 and pixels.texture(flat)["entropy"] == 0
    assert pixels.binary_patterns(np.full((5, 5), 9.0), np.ones((5, 5), bool))[8] == 1
    assert pixels.components(np.ones((3, 3), bool)).tolist() == [[1] * 3] * 3 and pixels.hull(np.zeros((2, 2), bool)) == (0.0, 0.0)
    hues = spark.createDataFrame([(350.0, 1.0), (10.0, 1.0), (180.0, 0.0)], "h double, w double")
    mean = hues.agg(pixels.hue_mean(F.col("h"), F.col("w"))).first()[0]
    assert min(mean, 360 - mean) < 1e-6


def test_decode_runs():
    from tidewright.operators import pixels

    def encode(mask):
        flat, counts, last = mask.T.ravel(), [], False
        for v in flat:
            if not counts or v != last:
                if not counts and v:
                    counts.append(0)
                counts.append(0)
                last = v
            counts[-1] += 1
        out = ""
        for i, c in enumerate(counts):
            x = c - counts[i - 2] if i > 2 else c
            while True:
                bits, x = x & 31, x >> 5
                done = (x == -1) if bits & 16 else (x == 0)
                out += chr((bits if done else bits | 32) + 48)
                if done:
                    break
        return out

    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 70)) < rng.random()
        assert (pixels.decode_runs(encode(mask), 9, 70) == mask).all()
    with pytest.raises(ValueError):
        pixels.decode_runs("1", 9, 9)


def test_kappa_of_all_reviewers(spark, tmp_path):
    """Three reviewers' last reviews with y and n, against all their pairs in both orders."""
    from datetime import datetime

    from tidewright.plans import evaluation

    said = {"f1": [("yes", "minor"), ("Y", "severe"), ("no", "none"), (" n ", "minor")], "f2": [("y", "severe"), ("yes", "severe"), ("yes", "moderate")], "f3": [("no", "none")], "f4": [("no", "none"), ("uncertain", None), ("no", "none")]}
    rows = [(f"o{f}{i}", f, "x", f"r{i}", " Reviewed", p, s, datetime(2031, 1, 2)) for f, ps in said.items() for i, (p, s) in enumerate(ps)]
    rows += [("z1", "f1", "x", "r0", "reviewed", "no", "none", datetime(2031, 1, 1)), ("z2", "f1", "x", "r9", "pending", "no", "none", datetime(2031, 1, 9)), ("z3", "f2", "x", "r8", "adjudicated", "no", "none", datetime(2031, 1, 9))]
    schema = "observation_id string, fish_instance_id string, finding_id string, reviewer_id string, review_status string, presence string, severity string, recorded_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "belly_observations.parquet"))

    def want(values, weight):
        pairs = [p for vs in values for p in itertools.permutations([v for v in vs if v is not None], 2)]
        o = np.mean([weight(a, b) for a, b in pairs])
        e = np.mean([weight(a, c) for a, _ in pairs for _, c in pairs])
        return len(pairs) // 2, round(1 - o, 6), round(1 - e, 6), round(1 - o / e, 6)

    presence = [[{"y": 1, "n": 0}.get(p.strip().lower()[0]) for p, _ in ps] for ps in said.values()]
    assert tuple(evaluation.cohens_kappa(spark, str(tmp_path)).first()) == pytest.approx(want(presence, lambda a, b: float(a != b)))
    ranks = [[{"none": 0, "minor": 1, "moderate": 2, "severe": 3}.get(s) for _, s in ps] for ps in said.values()]
    assert tuple(evaluation.weighted_kappa(spark, str(tmp_path)).first()) == pytest.approx(want(ranks, lambda a, b: (a - b) ** 2 / 9))


def test_proposal(spark):
    from tidewright.operators import proposal

    rows = spark.range(20_000).select(F.concat(F.lit("g"), (F.col("id") % 997).cast("string")).alias("g"), (F.col("id") % 3).alias("c"), F.lit(1).alias("rows"))
    out = proposal.propose(rows, "g", {"train": 0.7, "validation": 0.15, "test": 0.15}, ranges=16)
    share = {r.split: r.n / 20_000 for r in out.groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["test"] - 0.15) < 0.01 and out.select("g").distinct().count() == 997
    assert proposal.propose(rows.limit(0), "g", {"train": 1.0}).count() == 0
    bad = spark.createDataFrame([("a", "train", 0), ("a", "test", 1), ("b", None, 0)], "g string, split string, c int")
    got = {tuple(r) for r in proposal.problems(bad, "split", ["g"], "c", [0, 1]).collect()}
    assert got == {("crosses:g", "a", None), ("lacks", "1", "train"), ("lacks", "0", "test"), ("without_split", "1", None)}


def test_proposal_places_every_record_and_tears_nothing(spark, tmp_path):
    from tidewright.operators import proposal
    from tidewright.plans import lineage

    rows = [(i, f"g{i // 3}" if i % 5 else (None if i % 2 else "N/A"), f"s{i // 4}" if i % 7 else None, f"{i // 2:064x}" if i % 11 else "?") for i in range(300, 900)]
    rows += [(i, None, None, None) for i in range(900, 940)] + rows[:5]
    schema = "record_id bigint, source_group string, specimen_id string, sha256 string"
    table = spark.createDataFrame(rows, schema).selectExpr("*", "'train' as source_split", "'0000000000000000' as average_hash")
    table.write.parquet(str(tmp_path / "source_records.parquet"))
    split = {r.record_id: r.split for r in lineage.proposed_records(spark, str(tmp_path)).collect()}
    assert set(split) == set(range(300, 940)) and set(split.values()) == {"train", "validation", "test"}
    for column in (1, 2, 3):
        of = {}
        for r in rows:
            if r[column] not in (None, "N/A", "?"):
                of.setdefault(r[column], set()).add(split[r[0]])
        assert all(len(s) == 1 for s in of.values())
    assert sum(r.records for r in lineage.proposed_splits(spark, str(tmp_path)).collect()) == 640
    with pytest.raises(Exception, match="can't be placed"):
        proposal.propose(spark.createDataFrame([("a",), (None,)], "g string"), "g", {"train": 1.0}).collect()


def test_learning(spark):
    from tidewright.operators import learning

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(float(a), None if i % 17 == 0 else float(b), "up" if a + (b if i % 17 else 0) > 0 else "down") for i, (a, b) in enumerate(x)], "a double, b double, y string")
    for model in ("logistic", "forest"):
        out = learning.predictions(learning.fit(rows, ["a", "b"], "y", model), rows, "y")
        assert out.where("truth = predicted").count() > 360


def test_names(spark):
    from tidewright.functions import names

    paths = ["export/train/Cap_00513_jpg.rf.abefa13230.jpg", "a\\b\\x.PNG", None]
    assert [one(spark, names.origin_name(F.lit(p).cast("string"))) for p in paths] == ["cap_00513", "x", None]
    assert one(spark, names.cell_of(names.counts_of(F.lit("2:1|0:3|2:4|x:1|7")))) == "0:3|2:5" and one(spark, names.cell_of(names.counts_of(F.lit(None).cast("string")))) == ""
    assert one(spark, names.canonical_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    boxes = one(spark, names.tiles(F.lit(1000), F.lit(500), 640, 64))
    assert [tuple(b) for b in boxes] == [(0, 0, 640, 500), (360, 0, 1000, 500)]
    a, b = (one(spark, names.group_label(F.array(*map(F.lit, ids)))) for ids in (("x", "y"), ("y", "x")))
    assert a == b and a.startswith("lg_")


def test_detections(spark):
    from tidewright.operators import detections

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"picture string, truth array<struct<class:int,box:{box}>>, found array<struct<class:int,box:{box},score:double>>"
    b = (0.0, 0.0, 10.0, 10.0)
    rows = [("p", [(0, b), (1, b), (2, b)], [(0, b, 0.9), (1, b, 0.9), (1, b, 0.8), (2, (50.0, 50.0, 60.0, 60.0), 0.9)]), ("q", [], [])]
    got = {r["class"]: round(r.ap, 6) for r in detections.average_precision(spark.createDataFrame(rows, schema), (0.5,)).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.0}
    frames = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, "b")], "fish int, frame int, track string")
    assert tuple(detections.track_quality(frames, ["fish"], "frame", "track").first())[1:] == (4, 2, 1, 1)


def test_object_confusion(spark):
    """One right box, one of the wrong class, a second detection of the first, a missed one and one on nothing."""
    from tidewright.operators import detections

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"picture string, truth array<struct<class:int,box:{box}>>, found array<struct<class:int,box:{box},score:double>>"
    a, b, c, nothing = (0.0, 0.0, 10.0, 10.0), (20.0, 0.0, 30.0, 10.0), (40.0, 0.0, 50.0, 10.0), (90.0, 90.0, 95.0, 95.0)
    rows = [("p", [(1, a), (2, b), (3, c)], [(1, a, 0.9), (1, (1.0, 0.0, 11.0, 10.0), 0.8), (5, b, 0.7), (4, nothing, 0.6)]), ("q", [], []), ("r", None, None), ("s", [(1, a)], [])]
    matched = detections.objects(spark.createDataFrame(rows, schema))
    assert sorted(tuple(r)[1:] for r in matched.collect()) == sorted([("1", "1", False), ("background", "1", True), ("2", "5", False), ("background", "4", False), ("3", "background", False), ("1", "background", False)])
    got = detections.summary(matched).first()
    assert (got.presented, got.detected, got.right_class, got.false_positives, got.duplicates, got.found) == (4, 2, 1, 1, 1, 4)
    assert got.detection_rate == pytest.approx(0.5) and got.duplicate_rate == pytest.approx(0.25)


def test_followed_boxes(spark):
    """Boxes that move keep their track, crossing batches and streams; one that stays away too long gets a new track."""
    from tidewright.operators import tracks

    schema = "stream string, frame int, ordinal int, x0 double, y0 double, x1 double, y1 double"
    rows = [("a", f, 0, f * 2.0, 0.0, f * 2.0 + 10, 10.0) for f in range(6)] + [("a", f, 1, 50.0, 50.0, 60.0, 60.0) for f in (0, 1, 5)] + [("b", 0, 0, 0.0, 0.0, 10.0, 10.0), (None, 0, 0, 0.0, 0.0, 1.0, 1.0), ("b", 1, 0, None, 0.0, 1.0, 1.0)]
    got = lambda patience: {(r.stream, r.frame, r.ordinal): r.track for r in tracks.follow(spark.createDataFrame(rows, schema), patience=patience).collect()}
    long, short = got(3), got(2)
    assert [long["a", f, 0] for f in range(6)] == [1] * 6 and [long["a", f, 1] for f in (0, 1, 5)] == [2, 2, 2]
    assert [short["a", f, 1] for f in (0, 1, 5)] == [2, 2, 3] and long["b", 0, 0] == 1 and len(long) == 10
    assert tracks.follow(spark.createDataFrame([], schema)).count() == 0
    follower = tracks.Follower(0.3, 30)
    assert follower.frame([(0, 0, 10, 10), (1, 0, 11, 10)]) == [1, 2] and follower.frame([(1, 0, 11, 10), (1, 0, 11, 10), (1, 0, 11, 10)]) == [2, 1, 3]


def test_small_forms(spark):
    import numpy as np

    from tidewright.functions import geometry, names, numbers, text
    from tidewright.operators import proposal

    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(names.status_token(lit("Not-Associated (2)!"))) == "notassociated2" and one(names.status_token(lit(None).cast("string"))) == ""
    assert one(names.source_name(lit(" x "), lit("a.jpg"))) == "x" and one(names.source_name(lit(""), lit("d\\IMG_1.rf.ab12.jpg"))) == "IMG_1"
    assert one(names.first_folder(lit("A/b/c.jpg"))) == "A" and one(names.first_folder(lit("c.jpg"))) == ""
    assert one(names.markdown_cell(lit("a|b\nc"))) == "a\\|b c" and one(names.file_token(lit("a b/ü-1"))) == "a_b_ü-1" and one(names.file_token(lit(None).cast("string"))) == "unknown"
    assert [one(text.class_name(lit(v))) for v in (" Class_A ", "2", "REJECT", "d")] == ["Class A", "Class C", "Rejected", None]
    assert [one(text.has_zone(lit(v))) for v in ("2031-01-01T10:00:00Z", "2031-01-01T10:00+0800", "2031-01-01T10:00", "2031-01-01")] == [True, True, False, False]
    square = F.array(*map(lit, (0.0, 0.0, 10.0, 0.0, 10.0, 20.0)))
    assert one(geometry.scaled_polygon(square, lit(10), lit(20))) == [0, 0, 1, 0, 1, 1] and one(geometry.scaled_polygon(square, lit(9), lit(20))) is None
    assert one(geometry.scaled_polygon(F.array(*map(lit, (0.0, 0.0, 1.0, 1.0, 2.0, 2.0))), lit(10), lit(20))) is None
    a, b = np.arange(16.0), np.arange(16.0)[::-1] * 3
    var = lambda x, y: ((x - x.mean()) * (y - y.mean())).mean()
    want = (2 * a.mean() * b.mean() + 6.5025) * (2 * var(a, b) + 58.5225) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (var(a, a) + var(b, b) + 58.5225))
    arr = lambda x: F.array(*(lit(float(v)) for v in x))
    assert one(numbers.similarity(arr(a), arr(b))) == pytest.approx(want) and one(numbers.similarity(arr(a), arr(a))) == pytest.approx(1) and one(numbers.similarity(arr(a), arr(b[:3]))) is None
    assert proposal.ratios_of("train=0.7, VAL=0.15,test=0.15") == {"train": 0.7, "validation": 0.15, "test": 0.15}
    for bad in ("train=0.7,test=0.3", "train=1", "train=0.5,dev=0.2,test=0.3", "train=0.7,validation=-0.1,test=0.4", "train"):
        with pytest.raises(ValueError):
            proposal.ratios_of(bad)
