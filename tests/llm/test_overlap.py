import itertools

import numpy as np

from tidewright.llm import overlap

SCHEMA = "record_id bigint, source_split string, source_group string, sha256 string, average_hash string, width int, height int, annotations array<struct<class_id:int,points:array<double>,source_encoding:string>>, code string, boxes int"


def polygon(x, y, w, h, width=640, height=480, jitter=0.0):
    return [v for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h)) for v in ((px + jitter) * width, (py - jitter) * height)]


def row(i, split, code, boxes=None, sha=None, width=640, height=480, jitter=0.0):
    notes = None if boxes is None else [(c, polygon(*b, width, height, jitter), "polygon") for c, *b in boxes]
    return (i, split, "g", sha, code, width, height, notes, "clash", 1)


def found(spark, rows):
    return {tuple(r) for r in overlap.found(spark.createDataFrame(rows, SCHEMA)).collect()}


A = [(1, 0.1, 0.1, 0.2, 0.1), (2, 0.5, 0.5, 0.1, 0.1)]
B = [(1, 0.3, 0.1, 0.2, 0.1), (5, 0.2, 0.6, 0.1, 0.1)]


def test_rules(spark):
    sha = "ab" * 32
    rows = [
        row(1, "train", "3c516377fc2dc750", A, sha), row(2, "val", "ffff0000ffff0000", B, f"SHA256:{sha.upper()} "), row(3, "Test", "3c516177fc2dc550", A, width=1280, height=960, jitter=0.003),
        row(4, "test", "3c516377fc2dc750", B), row(5, "unknown", "3c516377fc2dc750", A, sha), row(6, None, "3c516377fc2dc750", A), row(7, "test", "0000000000000000", A), row(8, "train", "0000000000000000", A),
        row(9, "train", "0000000000000000", B), row(10, "test", "3c516377fc2dc750", None), row(11, "train", "0000000000000000", None), row(12, "test", "bad", A, "short"), row(13, "test", "ffffffffffffffff", []),
        row(1, "train", "3c516377fc2dc750", A, sha), (None, "test", "g", sha, "3c516377fc2dc750", 640, 480, None, "clash", 1), row(14, "validation", None, A, None, 0, 0),
    ]
    assert found(spark, rows) == {(1, 2), (1, 3), (7, 8), (1, 10)}


def test_dropped_and_added_annotations(spark):
    code = "3c516377fc2dc750"
    more = [*A, (7, 0.8, 0.8, 0.1, 0.1)]
    assert found(spark, [row(1, "train", code, more), row(2, "test", code, A[:1]), row(3, "test", code, [*A[1:], *B, *B])]) == {(1, 2)}


def test_near_codes_find_all_within_radius(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        code = int(rng.integers(0, 2**63))
        rows.append(row(2 * i, "train", f"{code:016x}", [(i % 12, 0.1 + i / 300, 0.2, 0.1, 0.1)]))
        for bit in rng.choice(64, size=i % 10, replace=False):
            code ^= 1 << int(bit)
        rows.append(row(2 * i + 1, "test", f"{code:016x}", [(i % 12, 0.1 + i / 300, 0.2, 0.1, 0.1)]))
    want = {(a[0], b[0]) for a, b in itertools.product(rows[::2], rows[1::2]) if bin(int(a[4], 16) ^ int(b[4], 16)).count("1") <= 7 and a[7] == b[7]}
    assert found(spark, rows) == want and len(want) == 96


def test_hot_flat_code(spark):
    rng = np.random.default_rng(1)
    rows = [row(i, "train" if i % 2 else "test", "ffffffffffffffff", [(int(rng.integers(12)), *rng.uniform(0.05, 0.5, 2).tolist(), *rng.uniform(0.05, 0.3, 2).tolist())]) for i in range(2000)]
    rows.append(row(5000, "test", "ffffffffffffffff", [(c, p[0] / 640, p[1] / 480, (p[2] - p[0]) / 640, (p[5] - p[1]) / 480) for c, p, _ in rows[1][7]]))
    assert (1, 5000) in found(spark, rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert overlap.by_split_and_group(spark.createDataFrame([], SCHEMA)).count() == 0
