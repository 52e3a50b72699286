"""The same photographs in training and evaluation splits (problem 6).

Two records show the same photograph if their bytes are the same, or if their
similarity hashes lie within RADIUS bits and their annotations show the same
geometry: an export may scale, recompress, drop or add annotations, but what is
annotated stays where it is in the picture. Another photograph of the same
scene has a near hash too, with its annotations elsewhere.

1. Codes. Distinct 64-bit codes, not records, are compared: the four 16-bit
   segments of a training code are keys; an evaluation code asks for its
   segments and their 16 neighbours at one bit. Of at most 7 differing bits some
   segment has at most one, so no pair within RADIUS is missed. However many
   records share a code, it takes part once.
2. Verification. Records of near codes meet by code pair and by the place of an
   annotation's box on a grid (evaluation boxes also in the neighbouring cells
   they are within TOLERANCE of), so records with one hot code, such as that of
   a blank picture, meet only where their annotations agree. A pair holds if
   at least MATCHED of the annotations of the record with fewer of them agree.
3. Records without annotations can't be verified. They pair only with records
   of the same code, and only if the code is no pattern: fewer than
   MIN_CHANGES changes from bit to bit are a flat picture's.

Defined results: repeated record identifiers count once (greatest values hold),
null identifiers, unknown splits, unreadable digests and codes match nothing,
boxes need positive width and height of their picture.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import group_name, hash64, sha256_name, split_name
from tidewright.session import cut

RADIUS = 7
SEGMENTS = 4
#: Largest difference of a box's edges, as a share of the picture's width or height.
TOLERANCE = 0.0075
CELL = 0.03
MATCHED = 0.6
MIN_CHANGES = 14


def photographs(records: DataFrame) -> DataFrame:
    """(record_id, split, train, sha, code, grp, boxes) of every record with a known split."""

    def box(a: Column) -> Column:
        x = F.filter(a["points"], lambda v, i: (i % 2 == 0) & v.isNotNull())
        y = F.filter(a["points"], lambda v, i: (i % 2 == 1) & v.isNotNull())
        w, h = F.col("width"), F.col("height")
        return F.struct(a["class_id"].alias("class"), (F.array_min(x) / w).alias("x0"), (F.array_min(y) / h).alias("y0"), (F.array_max(x) / w).alias("x1"), (F.array_max(y) / h).alias("y1"))

    usable = F.filter("annotations", lambda a: a["class_id"].isNotNull() & (F.size(a["points"]) >= 2))
    boxes = F.when((F.col("width") > 0) & (F.col("height") > 0), F.transform(usable, box))
    split = split_name(F.col("source_split"))
    base = records.where("record_id is not null").select(
        "record_id", split.alias("split"), sha256_name(F.col("sha256")).alias("sha"), hash64(F.col("average_hash")).alias("code"), group_name(F.col("source_group")).alias("grp"), boxes.alias("boxes")
    )
    once = base.groupBy("record_id").agg(F.max(F.struct("split", "sha", "code", "grp", "boxes")).alias("r")).select("record_id", "r.*")
    return once.where("split is not null").withColumn("train", F.col("split") == "train").withColumn("boxes", F.filter("boxes", lambda b: b["x1"].isNotNull() & b["y1"].isNotNull()))


def _segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, 16 * i).bitwiseAND(F.lit(0xFFFF))


def near_codes(photos: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(t, e): training and evaluation codes within ``radius`` <= 7 bits."""
    train = photos.where("train and code is not null").select("code").distinct()
    other = photos.where("not train and code is not null").select("code").distinct()
    keys = [_segment(F.col("code"), i) + (i << 16) for i in range(SEGMENTS)]
    asked = [_segment(F.col("code"), i).bitwiseXOR(F.lit(flip)) + (i << 16) for i in range(SEGMENTS) for flip in (0, *(1 << b for b in range(16)))]
    left = train.select(F.col("code").alias("t"), F.explode(F.array(*(k.cast("int") for k in keys))).alias("k"))
    right = other.select(F.col("code").alias("e"), F.explode(F.array(*(k.cast("int") for k in asked))).alias("k"))
    return left.join(right, "k").where(F.bit_count(F.col("t").bitwiseXOR(F.col("e"))) <= radius).select("t", "e").distinct()


def _cells(b: Column, margin: float) -> list[Column]:
    """The box's cells in four dimensions; with a margin the neighbours within it as well."""
    sides = ((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, b["x1"] - b["x0"], b["y1"] - b["y0"])
    reach = (margin, margin, 2 * margin, 2 * margin)
    return [F.sequence(F.floor((s - r) / CELL).cast("int"), F.floor((s + r) / CELL).cast("int")) for s, r in zip(sides, reach)]


def _cell_keys(b: Column, margin: float) -> Column:
    x, y, w, h = _cells(b, margin)
    pack = lambda i, j, k, l: (((b["class"].cast("long") * 4096 + i) * 4096 + j) * 4096 + k) * 4096 + l  # noqa: E731, E741
    return F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.flatten(F.transform(w, lambda k: F.transform(h, lambda l: pack(i, j, k, l))))))))  # noqa: E741


def _agree(a: Column, b: Column) -> Column:
    edges = [F.abs(a[s] - b[s]) <= TOLERANCE for s in ("x0", "y0", "x1", "y1")]
    return reduce(lambda p, q: p & q, edges, a["class"] == b["class"])


def _changes(code: Column) -> Column:
    return F.bit_count(code.bitwiseXOR(F.shiftrightunsigned(code, 1)).bitwiseAND(F.lit((1 << 63) - 1)))


def pairs(records: DataFrame) -> DataFrame:
    """(t, e, by): training and evaluation records of one photograph; by is bytes or picture."""
    photos = cut(photographs(records))
    side = lambda train, *cols: photos.where(F.col("train") == train).select(*cols)
    by_bytes = side(True, "sha", F.col("record_id").alias("t")).join(side(False, "sha", F.col("record_id").alias("e")), "sha").select("t", "e", F.lit("bytes").alias("by"))

    codes = cut(near_codes(photos))
    # one row per box of a record with a near code, by code pair and cell
    box = F.explode("boxes").alias("b")
    of_train = side(True, F.col("record_id").alias("t_id"), F.col("code").alias("t"), F.size("boxes").alias("t_n"), box).join(codes, "t")
    of_other = side(False, F.col("record_id").alias("e_id"), F.col("code").alias("e"), F.size("boxes").alias("e_n"), box).join(codes, "e")
    left = of_train.select("t", "e", "t_id", "t_n", F.col("b").alias("tb"), F.explode(_cell_keys(F.col("b"), 0.0)).alias("cell"))
    right = of_other.select("t", "e", "e_id", "e_n", F.col("b").alias("eb"), F.explode(_cell_keys(F.col("b"), TOLERANCE)).alias("cell"))
    matched = (
        left.join(right, ["t", "e", "cell"])
        .where(_agree(F.col("tb"), F.col("eb")))
        .groupBy("t_id", "e_id")
        .agg(F.countDistinct("tb").alias("tm"), F.countDistinct("eb").alias("em"), F.min(F.least("t_n", "e_n")).alias("n"))
        .where(F.least("tm", "em") >= MATCHED * F.col("n"))
    )
    by_picture = matched.select(F.col("t_id").alias("t"), F.col("e_id").alias("e"), F.lit("picture").alias("by"))

    bare = F.coalesce(F.size("boxes"), F.lit(0)) <= 0
    same = lambda train, name: side(train, "code", F.col("record_id").alias(name), bare.alias(f"{name}_bare")).where(_changes(F.col("code")) >= MIN_CHANGES)
    unverified = same(True, "t").join(same(False, "e"), "code").where("t_bare or e_bare").select("t", "e", F.lit("picture").alias("by"))
    return by_bytes.unionByName(by_picture).unionByName(unverified).groupBy("t", "e").agg(F.min("by").alias("by"))


def found(records: DataFrame) -> DataFrame:
    return pairs(records).select(F.least("t", "e").alias("record_id_a"), F.greatest("t", "e").alias("record_id_b"))


def by_split_and_group(records: DataFrame) -> DataFrame:
    """Overlapping pairs and records per evaluation split and source group ('' for none)."""
    photos = photographs(records).select(F.col("record_id").alias("e"), F.col("split"), F.coalesce("grp", F.lit("")).alias("source_group"))
    return (
        pairs(records)
        .join(photos, "e")
        .groupBy("split", "source_group")
        .agg(F.count("*").alias("pairs"), F.count_if(F.col("by") == "bytes").alias("same_bytes"), F.countDistinct("e").alias("records"))
    )
