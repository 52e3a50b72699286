import json

from pyspark.sql import functions as F

from tidewright.operators import flatten

SCHEMA = "session_id string, track_id bigint, updated_at string, part_results_json string, weighted_scores_json string, color_measurements_json string, tag string, item string"


def table(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), "clash", "clash") for r in rows], SCHEMA)


def found(spark, *rows):
    return sorted(tuple(r)[2:] for r in flatten.found(table(spark, *rows)).collect())


def test_three_layouts_agree(spark):
    part = {"present": True, "grade_evidence": {"Class A": 0.5, "class_b": "0.25", "Class C": None, "Rejected": True}, "detections": [None, {"x": 1}, 3]}
    layouts = [{"Body": part}, [{"region": "BODY", **part}], {"schema_version": 2, "regions": {"body": part}}]
    want = [("detection", "Body", "1"), ("evidence", "Body", "Class A"), ("evidence", "Body", "Class B"), ("part", "Body", "")]
    for layout in layouts:
        assert found(spark, ("s", 1, "2031-01-01T00:00:00Z", json.dumps(layout))) == want
    assert found(spark, ("s", 1, "2031-01-01T00:00:00Z", json.dumps(json.dumps(json.dumps(layouts[0]))))) == want


def test_scores_and_colors(spark):
    colors = {"whole_fish": {"frame_rois": {"a": 1}}, "Head": {"frame_rois": [{}, None, {}]}, "Tail": "unavailable", "Fin": {}}
    got = found(spark, ("s", 1, "2031-01-01", None, json.dumps({"scores": {"CLASS A": " 0.5 ", "Class B": "n/a", "Class C": 1e400}}), json.dumps(colors)))
    assert got == [("color", "Head", ""), ("color", "Whole Fish", ""), ("roi", "Head", "0"), ("roi", "Head", "2"), ("roi", "Whole Fish", "0"), ("score", "", "Class A")]


def test_unreadable_and_wrong_types(spark):
    bad = ["", "{", "7", "null", '"n/a"', "[]", "[1]", '{"Body": []}', '{"Body": {"detections": "x", "grade_evidence": 3}}', "[" * 100_000]
    assert found(spark, *[("s", i, "x", b, b, b) for i, b in enumerate(bad)]) == [("color", "Body", ""), ("part", "Body", "")]


def test_latest_version_is_an_instant(spark):
    old, new = json.dumps({"Body": {}}), json.dumps({"Tail": {}})
    rows = [("s", 1, "2031-01-01T10:00:00+08:00", old), ("s", 1, "2031-01-01T03:00:00Z", new), ("s", 1, None, old), ("s", 1, "2031-01-01T03:00:00Z", new)]
    assert found(spark, *rows) == [("part", "Tail", "")]


def test_null_keys_empty_table_and_links(spark, tmp_path):
    assert found(spark) == []
    rows = flatten.children(table(spark, (None, None, "2031", json.dumps({"Body": {"detections": [{"confidence": 0.5, "bbox": [1, 2, 3, 4]}]}}))))
    assert {r.node_id: r.parent_id for r in rows.collect()} == {"~/~/part/Body": "~/~", "~/~/part/Body/detection/0": "~/~/part/Body"}
    flatten.write_tables(rows, str(tmp_path / "t"))
    only = flatten.read_table(spark, str(tmp_path / "t"), "detection").first()
    assert only.confidence == 0.5 and only.bbox == [1, 2, 3, 4] and only.mask is None


def test_long_and_repeated(spark):
    many = json.dumps({"Body": {"detections": [{"i": i} for i in range(5000)]}, "body": {}})
    assert flatten.found(table(spark, ("s", 1, "2031", many), ("s", 1, "2031", many))).groupBy("child").count().orderBy("child").select(F.col("count")).collect() == [(5000,), (1,)]


def test_no_member_is_lost(spark):
    statistics = {"region_observation_count": 3, "top_grade_statistics": {"standard_deviation": 0.25, "more": [1]}}
    part = {"present": True, "grade_evidence": {"Class A": 0.5, "Class B": None}, "detections": [{"confidence": 0.5, "more": {"x": 1}}, 7], "temporal_statistics": statistics, "list": [[2]]}
    color = {"status": "ok", "frame_rois": [{"frame_id": 4, "deep": [8]}], "nested": {"y": 9}}
    rows = table(spark, ("s", 1, "2031", json.dumps({"schema_version": 2, "regions": {"Body": part, "Fin": {"z": 1}, "Tail": "none"}}), json.dumps({"scores": {"Class A": 0.1, "Class C": "n/a"}, "v": 2}), json.dumps([{"region": "Head", **color}, 5])))
    children = flatten.children(rows)
    got = {r.node_id[4:]: json.loads(r.payload) for r in children.collect()}
    assert got == {
        "part/Body": {"present": True, "grade_evidence": {"Class B": None}, "detections": {"1": 7}, "temporal_statistics": statistics, "list": [[2]]},
        "part/Body/evidence/Class A": {"value": 0.5}, "part/Body/detection/0": part["detections"][0], "rest/part_results_json": {"members": {"schema_version": 2, "regions": {"Fin": {"z": 1}, "Tail": "none"}}},
        "score/Class A": {"value": 0.1}, "rest/weighted_scores_json": {"members": {"v": 2, "scores": {"Class C": "n/a"}}},
        "color/Head": {"region": "Head", "status": "ok", "nested": {"y": 9}}, "color/Head/roi/0": color["frame_rois"][0], "rest/color_measurements_json": {"members": {"1": 5}},
    }
    typed = flatten.table(children, "part").first()
    assert typed.temporal_statistics.region_observation_count == 3 and typed.temporal_statistics.top_grade_statistics.standard_deviation == 0.25
    assert json.loads(flatten.table(children, "rest").where("item = 'color_measurements_json'").first().members) == {"1": 5}
    assert "rest" not in {r.child for r in flatten.found(rows).collect()}
