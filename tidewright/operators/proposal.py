"""Group-safe split proposals without any driver-side state, and checks of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.manifests import SPLITS


def propose(rows: DataFrame, group: str, ratios: dict[str, float], seed: int = 11, ranges: int = 1024) -> DataFrame:
    """(group, rows, split): groups in the order of a hash fill the splits one after another.

    A group goes to the split that holds the middle of its stretch of the
    running number of rows, so a split misses its share by half a group at most.
    Running numbers come from ranges of the hash. ``group`` must place every
    row, so that none is left out in silence: a null group is an error.
    """
    placed_in = F.coalesce(F.col(group), F.raise_error(F.lit(f"a row without {group} can't be placed")))
    sizes = rows.select(placed_in.alias(group)).groupBy(group).agg(F.count("*").alias("rows"))
    hashed = sizes.withColumn("h", F.xxhash64(group, F.lit(seed))).withColumn("range", F.floor((F.col("h") / 2.0**63 + 1) / 2 * ranges).cast("int"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` + 1 rows
    starts = hashed.groupBy("range").agg(F.sum("rows").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy("h", group).rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.withColumn("end", F.sum("rows").over(inside)).join(starts, "range").withColumn("share", (F.col("start") + F.col("end") - F.col("rows") / 2) / F.col("total"))
    choice, reached, whole = None, 0.0, sum(ratios.values())
    names = list(ratios)
    for name in names[:-1]:
        reached += ratios[name] / whole
        choice = F.when(F.col("share") <= reached, name) if choice is None else choice.when(F.col("share") <= reached, name)
    split = F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])
    return placed.select(group, "rows", split.alias("split"))


def problems(rows: DataFrame, split: str, isolated: list[str], label: str, labels: list) -> DataFrame:
    """(kind, value, split) of a split's faults: values in several splits, labels that a split lacks, rows without a split."""
    crossing = None
    for c in isolated:
        one = rows.where(F.col(c).isNotNull() & F.col(split).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.countDistinct(split).alias("n")).where("n > 1")
        one = one.select(F.lit(f"crosses:{c}").alias("kind"), "value", F.lit(None).cast("string").alias("split"))
        crossing = one if crossing is None else crossing.unionByName(one)
    seen = rows.where(F.col(split).isNotNull()).groupBy(F.col(split).alias("split")).agg(F.collect_set(F.col(label).cast("string")).alias("s"))  # labels are a closed domain
    missing = seen.select(F.lit("lacks").alias("kind"), F.explode(F.array_except(F.array(*(F.lit(str(v)) for v in labels)), "s")).alias("value"), "split")
    unset = rows.where(F.col(split).isNull()).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("without_split").alias("kind"), F.col("n").cast("string").alias("value"), F.lit(None).cast("string").alias("split"))
    out = missing.unionByName(unset)
    return out if crossing is None else out.unionByName(crossing)


def ratios_of(text: str) -> dict[str, float]:
    """'train=0.7,validation=0.15,test=0.15' as shares; every split once, positive, and together 1."""
    out: dict[str, float] = {}
    for item in text.split(","):
        name, equals, number = (p.strip() for p in item.partition("="))
        split = next((s for s, spellings in SPLITS.items() if name.lower() in spellings), None)
        if not equals or split is None or split in out:
            raise ValueError(f"no share of a split, or a second one: {item!r}")
        out[split] = float(number)
        if not out[split] > 0:
            raise ValueError(f"a share must be positive: {item!r}")
    if set(out) != set(SPLITS) or abs(sum(out.values()) - 1) > 1e-9:
        raise ValueError("shares must name train, validation and test and add up to 1")
    return out
