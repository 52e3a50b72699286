from pyspark.sql import functions as F

from tidewright.functions import text


def values(spark, function, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_no_value(spark):
    assert values(spark, text.value_or_null, [None, "", " \t", "Unknown", "N/A", "?", "TBD", "null", "x ", " y"]) == [None] * 8 + ["x", "y"]


def test_splits(spark):
    got = values(spark, text.split_name, ["TRAIN", "training", "development", "val", "Valid", "locked_test", "testing", "Locked-holdout", "none", None, "other"])
    assert got == ["train", "train", "train", "validation", "validation", "test", "test", "test", None, None, None]


def test_grades(spark):
    got = values(spark, text.grade_name, ["Class A", " grade_b", "C", "\tClass-C", "Rejected", "REJECT", "Grade_Rejected", "Ungraded", "n/a", None, "class d"])
    assert got == ["Class A", "Class B", "Class C", "Class C", "Rejected", "Rejected", "Rejected", None, None, None, None]


def test_groups(spark):
    got = values(spark, text.group_name, ["Pier-1\\Img_2.JPG", " pier-1/img_2 ", "pier-1/img_2.png", "TBD", "unknown.jpg", ""])
    assert got == ["pier-1/img_2"] * 3 + [None, None, None]


def test_hashes(spark):
    h = "AB" * 32
    assert values(spark, text.sha256_name, [h, f"sha256:{h} ", "ab", None, "?"]) == [h.lower(), h.lower(), None, None, None]
    assert values(spark, text.hash64, ["ffffffffffffffff", "8000000000000000", "0000000000000001", "xyz", None]) == [-1, -(1 << 63), 1, None, None]


def test_instants(spark):
    got = values(spark, lambda c: F.unix_seconds(text.instant(c)), ["2031-01-01T00:00:00Z", "2031-01-01T01:00:00+01:00", "2031-01-01T00:00:00", "soon", None])
    assert got[0] == got[1] == got[2] and got[3:] == [None, None]
