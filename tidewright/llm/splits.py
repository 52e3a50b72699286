"""Splits that keep related records together (problem 3).

Records that share a source group or a specimen, also through others, form a
set (seedtree.components over links to each value's smallest record). Sets of
the same size and label profile are bundled; a minimum-cost flow over the
bundles meets the splits' quotas, with costs on deviating from a split's quota
and, lower, from a label's quota within a split; the flow is rounded to whole
sets and a bundle's sets take their places in the order of a hash.

A set's label profile is the class with most annotations in it (label_balance
tells how all classes' annotations come out). Whole class vectors would make
nearly every larger set a bundle of its own, as many as there are sets.

Only bundles reach the driver. With N records there are at most sqrt(2 N)
sizes, times the labels, so their number is bounded by the square root of the
input; sets and records stay distributed. A set's place in its bundle comes
from counts by hash range, so that no bundle is ordered in one task.

Defined results: a record without any value is a set of its own; repeated
record identifiers count once (their greatest group, specimen and split hold),
null identifiers are left out; unknown splits spread nothing; an empty table
gives an empty result. Targets' shares need not add up to 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.text import group_name, split_name, value_or_null
from tidewright.llm.flow import Network
from tidewright.llm.seedtree import components
from tidewright.session import cut

SPLITS = ("train", "validation", "test")
#: Sets ordered in one task when a bundle's places are given out.
RANGE_SETS = 200_000
#: Cost of a record beyond a split's quota, in records beyond a label's quota.
QUOTA_COST = 1000


def keyed(records: DataFrame) -> DataFrame:
    """(record_id, grp, specimen, split) of every record once, normalised."""
    return (
        records.where("record_id is not null")
        .select("record_id", group_name(F.col("source_group")).alias("grp"), value_or_null(F.col("specimen_id")).alias("specimen"), split_name(F.col("source_split")).alias("split"))
        .groupBy("record_id")
        .agg(*(F.max(c).alias(c) for c in ("grp", "specimen", "split")))
    )


def links(records: DataFrame) -> DataFrame:
    """(a, b): every record with the smallest record of each of its values."""
    values = records.select(
        F.explode(F.array(F.struct(F.lit("g").alias("kind"), F.col("grp").alias("value")), F.struct(F.lit("s").alias("kind"), F.col("specimen").alias("value")))).alias("x"), "record_id"
    ).select("x.kind", "x.value", "record_id").where("value is not null")
    first = values.groupBy("kind", "value").agg(F.min("record_id").alias("first"))
    return values.join(first, ["kind", "value"]).where("record_id <> first").select(F.col("record_id").alias("a"), F.col("first").alias("b"))


def sets(records: DataFrame) -> DataFrame:
    """(record_id, split, group_id) of every record; group_id is its set's smallest record."""
    base = cut(keyed(records))
    member = components(links(base), "a", "b").withColumnsRenamed({"vertex": "record_id", "component": "group_id"})
    return base.select("record_id", "split").join(member, "record_id", "left").withColumn("group_id", F.coalesce("group_id", "record_id"))


def torn(members: DataFrame) -> DataFrame:
    """(record_id, group_id) of the sets that the delivered splits tear apart."""
    spread = members.groupBy("group_id").agg(F.bit_or(F.coalesce(*(F.when(F.col("split") == s, 1 << i) for i, s in enumerate(SPLITS)), F.lit(0))).alias("in"))
    spread = spread.where(F.bit_count("in") >= 2).select("group_id")
    return members.join(spread, "group_id", "left_semi").select("record_id", "group_id")


def allocate(bundles: list[tuple[int, int, int]], shares: dict[str, float]) -> dict[tuple[int, int], list[int]]:
    """Sets of each bundle (size, label, number) for each split, by min-cost flow and integral rounding.

    Sizes are placed from the largest down, those within a factor of two at
    once. Before each step a flow sends all open records of every label to the
    splits at least deviation from what the quotas leave. The step's bundles
    take their part of it in whole sets; a set that a split's part doesn't fill
    goes where its size and then its label have most room, and the next flow
    makes up for it. The flow's network has a node per label and split, not per
    bundle, so a step costs as much as its bundles are many. Sets of size 1
    follow an integral flow exactly.
    """
    names, total = list(shares), sum(shares.values()) or 1.0
    part = [shares[s] / total for s in names]
    splits = range(len(names))
    labels = sorted({label for _, label, _ in bundles})
    # what each label's quota in each split still wants, and the records that are open
    wants = {label: [0.0] * len(names) for label in labels}
    open_ = dict.fromkeys(labels, 0)
    for size, label, n in bundles:
        open_[label] += size * n
        for s in splits:
            wants[label][s] += size * n * part[s]
    out: dict[tuple[int, int], list[int]] = {}
    todo = sorted(bundles, reverse=True)
    at = 0
    while at < len(todo):
        largest = todo[at][0]
        flows = _divide(labels, open_, wants)
        amount = dict(open_)
        need = {label: list(f) for label, f in flows.items()}
        room = [sum(wants[label][s] for label in labels) for s in splits]
        while at < len(todo) and 2 * todo[at][0] > largest:
            size, label, n = todo[at]
            counts = [n * flows[label][s] // amount[label] for s in splits]
            for s in splits:
                need[label][s] -= size * counts[s]
                room[s] -= size * counts[s]
            for _ in range(n - sum(counts)):
                best = max(splits, key=lambda s: (room[s] >= size - 0.5, need[label][s], room[s], -s))
                counts[best] += 1
                need[label][best] -= size
                room[best] -= size
            for s in splits:
                wants[label][s] -= size * counts[s]
            open_[label] -= size * n
            out[size, label] = counts
            at += 1
    return out


def _divide(labels: list[int], open_: dict[int, int], wants: dict[int, list[float]]) -> dict[int, list[int]]:
    """Records of each label's open sets for each split: the flow of least deviation from the quotas."""
    k, source, sink = len(next(iter(wants.values()))), 0, 1
    split_at, label_at = 2, 2 + k
    cell_at, room = label_at + len(labels), sum(open_.values())
    net = Network(cell_at + k * len(labels))
    quotas = _whole([max(0.0, sum(wants[label][s] for label in labels)) for s in range(k)], room)
    for s in range(k):
        net.arc(split_at + s, sink, quotas[s])
        net.arc(split_at + s, sink, room, QUOTA_COST)
    arcs = {}
    for i, label in enumerate(labels):
        wanted = _whole([max(0.0, w) for w in wants[label]], open_[label])
        net.arc(source, label_at + i, open_[label])
        arcs[label] = [net.arc(label_at + i, cell_at + i * k + s, open_[label]) for s in range(k)]
        for s in range(k):
            net.arc(cell_at + i * k + s, split_at + s, wanted[s])
            net.arc(cell_at + i * k + s, split_at + s, room, 1)
    net.send(source, sink)
    return {label: [net.flow(a) for a in of] for label, of in arcs.items()}


def _whole(parts: list[float], total: int) -> list[int]:
    """Parts as whole numbers, rounded so that they add up to ``total`` where they nearly do."""
    out = [int(p + 1e-9) for p in parts]
    if abs(sum(parts) - total) < 0.5:
        for s in sorted(range(len(parts)), key=lambda s: (out[s] - parts[s], s))[: total - sum(out)]:
            out[s] += 1
    return out


def profiles(records: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, size, label): label is the class with most annotations in the set, -1 for none."""
    classes = records.where("record_id is not null").groupBy("record_id").agg(F.max(F.col("annotations.class_id")).alias("classes"))
    counted = members.join(classes, "record_id").select("group_id", F.explode("classes").alias("class")).where("class is not null").groupBy("group_id", "class").count()
    top = counted.groupBy("group_id").agg(F.max(F.struct("count", -F.col("class"))).alias("m")).select("group_id", (-F.col("m").getField("col2")).alias("label"))
    size = members.groupBy("group_id").agg(F.count("*").alias("size"))
    return size.join(top, "group_id", "left").select("group_id", "size", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def assign(records: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(record_id, group_id, old_split, new_split) of every record."""
    spark: SparkSession = records.sparkSession
    members = cut(sets(records))
    groups = cut(profiles(records, members))
    bundles = [tuple(r) for r in groups.groupBy("size", "label").count().collect()]
    shares = {r[0]: r[1] for r in targets.select("target_split", "share").where("share > 0").orderBy("target_split").collect()}
    placed = allocate(bundles, shares) if bundles else {}
    ends = [(size, label, split, sum(counts[:i]), sum(counts[: i + 1])) for (size, label), counts in placed.items() for i, split in enumerate(shares)]
    places = spark.createDataFrame(ends, "size bigint, label int, new_split string, from_ bigint, to_ bigint")
    ranges = 1 + max((n for _, _, n in bundles), default=0) // RANGE_SETS
    hashed = groups.withColumn("h", F.xxhash64("group_id", F.lit(seed))).withColumn("range", F.pmod("h", F.lit(ranges)))
    before = Window.partitionBy("size", "label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = hashed.groupBy("size", "label", "range").count().select("size", "label", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("size", "label", "range").orderBy("h", "group_id")
    place = hashed.withColumn("n", F.row_number().over(inside) - 1).join(start, ["size", "label", "range"]).withColumn("place", F.col("start") + F.col("n"))
    chosen = place.join(places, ["size", "label"]).where("place >= from_ and place < to_").select("group_id", "new_split")
    return members.join(chosen, "group_id").select("record_id", "group_id", F.col("split").alias("old_split"), "new_split")


def balance(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target split: its share, the records it got and the share it got."""
    got = assigned.groupBy(F.col("new_split").alias("target_split")).agg(F.count("*").alias("records"), F.countDistinct("group_id").alias("sets"))
    joined = targets.select("target_split", "share").join(got, "target_split", "left").na.fill(0, ["records", "sets"])
    return joined.withColumn("share_got", F.try_divide(F.col("records").cast("double"), F.sum("records").over(Window.partitionBy())))


def label_balance(records: DataFrame, assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(class, target_split, annotations, share, share_got): of each class's annotations, the share that each split got."""
    classes = records.where("record_id is not null").groupBy("record_id").agg(F.max(F.col("annotations.class_id")).alias("classes"))
    per = assigned.join(classes, "record_id").select(F.col("new_split").alias("target_split"), F.explode("classes").alias("class")).where("class is not null").groupBy("class", "target_split").agg(F.count("*").alias("annotations"))
    each = F.explode(F.array(*(F.struct(F.lit(r[0]).alias("target_split"), F.lit(r[1]).alias("share")) for r in targets.select("target_split", "share").orderBy("target_split").collect())))  # one row per split
    grid = per.select("class").distinct().select("class", each.alias("t")).select("class", "t.*")
    full = grid.join(per, ["class", "target_split"], "left").na.fill(0, ["annotations"])
    return full.select("class", "target_split", "annotations", "share", F.try_divide(F.col("annotations").cast("double"), F.sum("annotations").over(Window.partitionBy("class"))).alias("share_got"))
