import json
import struct
import zlib

import numpy as np
import pytest

from tidewright.sources import annotations, images, manifests


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Image ID,Source-Group,split,SHA256\n1,Pier/1,Train,\n2,,unknown,ab\n3,"a,b",val,cd\n4,x\n')
    rows = {r.sample_id: r for r in manifests.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows["1"].source_group == "Pier/1" and rows["1"].file_sha256 is None and rows["2"].split is None and rows["3"].source_group == "a,b"
    raw = manifests.read_csv(spark, str(tmp_path / "m.csv"), ("split",))
    assert [r[0] for r in raw.where("_corrupt_record is not null").select("Image ID").collect()] == ["4"]
    with pytest.raises(ValueError):
        manifests.read_csv(spark, str(tmp_path / "m.csv"), ("nothing",))
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "samples": [{"id": "a", "subset": "dev"}, {"id": "b"}]}))
    assert [r.split for r in manifests.read_manifest(spark, str(tmp_path / "m.json"), "test").collect()] == ["test", "test"]
    (tmp_path / "m.jsonl").write_text('{"id": "a"}\n{"id": "b", "path": "x.jpg"}\n')
    assert manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).where("image_path = 'x.jpg'").count() == 1
    with pytest.raises(ValueError):
        manifests.resolve(spark.createDataFrame([(1,)], "other int"), required=("split",))


def test_manifest_spellings(spark):
    rows = spark.createDataFrame([("Dev",), (" validation_independent",), ("locked_test",), ("NA",), ("holdout",), (None,)], "canonical_split string")
    got = manifests.resolve(rows).select("split", manifests.split_of(manifests.F.col("split")).alias("s")).collect()
    assert [r.s for r in got] == ["train", "validation", "test", None, None, None]
    assert got[3].split is None and got[4].split == "holdout"
    assert len(manifests.resolve(rows).columns) == 13


def test_clashing_headers(spark):
    assert manifests.snake_case(spark.createDataFrame([(1, 2, 3)], "`A b` int, `a-B` int, `` int")).columns == ["a_b", "a_b_2", "column"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ü", 1)], "a string, b int").coalesce(1)
    manifests.export_csv(df, str(tmp_path / "e"), {"a": "Größe", "b": "n"})
    data = next((tmp_path / "e").glob("*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and "Größe,n" in data.decode("utf-8-sig")
    manifests.write_once(df, str(tmp_path / "w"))
    with pytest.raises(Exception, match="(?i)exist"):
        manifests.write_once(df, str(tmp_path / "w"))


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n9 0.5 0.5 0.2 0.2\n1 0.5 x 0.2 0.2\n1 0.5\n\n0 0.5 0.5 1.2 0.2\n")
    got = {r.line: r for r in annotations.read_boxes(spark, str(tmp_path), 3).collect()}
    assert got["0 0.5 0.5 0.2 0.2"].issues == [] and got["0 0.5 0.5 0.2 0.2"].box.x0 == pytest.approx(0.4)
    assert got["9 0.5 0.5 0.2 0.2"].issues == ["class"] and got["1 0.5"].issues == ["tokens"] and "not_numeric" in got["1 0.5 x 0.2 0.2"].issues and got["0 0.5 0.5 1.2 0.2"].issues == ["range"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "b.txt").write_text("1 0 0 1 0 1 1\n1 0 0 1 0\n0 0 0 1 0 1 2\n")
    assert [r.issues for r in annotations.read_polygons(spark, str(tmp_path / "p"), 3).orderBy("line").collect()] == [["range"], ["tokens"], []]


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "x.jpg", "width": 4, "height": 3}], "categories": [{"id": 5, "name": "Tail"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 5, "bbox": [0, 0, 1, 1]}, {"id": 8, "image_id": 2, "category_id": 9}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = {r.annotation_id: r for r in annotations.read_coco(spark, str(tmp_path / "c.json")).collect()}
    assert rows[7].file_name == "x.jpg" and rows[7].category == "Tail" and rows[8].file_name is None


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(0)
    picture = np.repeat(np.repeat(rng.integers(30, 200, (8, 8, 3)), 8, 0), 8, 1)
    png(tmp_path / "a.png", picture)
    png(tmp_path / "b.png", np.clip(picture + 5, 0, 255))
    png(tmp_path / "c.png", rng.integers(0, 255, (64, 64, 3)))
    (tmp_path / "d.png").write_bytes(b"no picture")
    inventory = {r.path.rsplit("/", 1)[1]: r for r in images.inventory(spark, str(tmp_path)).collect()}
    assert inventory["a.png"].valid and inventory["a.png"].width == 64 and not inventory["d.png"].valid and inventory["d.png"].bytes == 10
    h = {r.path.rsplit("/", 1)[1]: r for r in images.hashes(spark, str(tmp_path)).collect()}
    far = lambda a, b, k: bin(int(h[a][k], 16) ^ int(h[b][k], 16)).count("1")
    for kind in ("average", "difference", "perceptual"):
        assert far("a.png", "b.png", kind) <= 3 < far("a.png", "c.png", kind)
    assert h["c.png"].sharpness > h["a.png"].sharpness > 0
