"""Evaluation: confusion, rates, agreement, ranked precision, counting error, bootstrap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.numbers import f1_or_null, ratio


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return df.select(truth.alias("truth"), predicted.alias("predicted")).groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class of a confusion table; null where undefined. Null predictions are abstentions."""
    n, hit = F.col("n"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    true = matrix.where("truth is not null").groupBy(F.col("truth").alias("class")).agg(F.sum(n).alias("true_n"), F.sum(hit).alias("hits"))
    said = matrix.where("predicted is not null").groupBy(F.col("predicted").alias("class")).agg(F.sum(n).alias("said_n"))
    both = true.join(said, "class", "full_outer").na.fill(0, ["true_n", "hits", "said_n"])
    precision, recall = ratio(F.col("hits"), F.col("said_n")), ratio(F.col("hits"), F.col("true_n"))
    return both.select("class", "true_n", "said_n", "hits", precision.alias("precision"), recall.alias("recall"), f1_or_null(precision, recall).alias("f1"))


def kappa(matrix: DataFrame, weight: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Cohen's kappa of a two-rater table (truth, predicted, n): agreement, expected agreement, kappa.

    ``weight`` is the disagreement of two categories (0 for equal ones). The
    table has one row per pair of categories, a closed and small domain, so it
    is gathered into one row.
    """
    weight = weight or (lambda a, b: (a != b).cast("double"))
    add = lambda acc, v: acc + v
    one = matrix.agg(F.collect_list(F.struct("truth", "predicted", "n")).alias("m"), F.sum("n").alias("total"))
    observed = F.aggregate(F.transform("m", lambda x: weight(x["truth"], x["predicted"]) * x["n"]), F.lit(0.0), add)
    across = lambda x: F.aggregate(F.transform("m", lambda y: weight(x["truth"], y["predicted"]) * x["n"] * y["n"]), F.lit(0.0), add)
    o, e = ratio(observed, F.col("total")), ratio(F.aggregate(F.transform("m", across), F.lit(0.0), add), F.col("total") * F.col("total"))
    return one.select(F.col("total").cast("bigint").alias("n"), (1 - o).alias("observed"), (1 - e).alias("expected"), (1 - F.try_divide(o, e)).alias("kappa"))


def pair_table(df: DataFrame, unit: list[str], label: str, domain: list) -> DataFrame:
    """(truth, predicted, n) of all ordered pairs of two labels of one unit, so every pair counts twice and the table is symmetric.

    Pairs are not emitted: a unit's counts per label of the closed domain give
    their numbers. Labels outside the domain pair with nothing.
    """
    per = df.groupBy(*unit).agg(*(F.count_if(F.col(label) == v).alias(f"n{i}") for i, v in enumerate(domain)))
    cell = lambda i, j: F.sum(F.col(f"n{i}") * (F.col(f"n{j}") - int(i == j)))
    cells = [F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted"), cell(i, j).alias("n")) for i, a in enumerate(domain) for j, b in enumerate(domain)]
    return per.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("c")).select("c.*").where("n > 0")


def ranked(df: DataFrame, keys: list[str], score: str, tie: str, hit: Column) -> DataFrame:
    """Adds tp, precision and recall along the ranking by score within each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    so_far, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    out = df.withColumn("__hit", hit.cast("long")).withColumn("rank", F.row_number().over(w)).withColumn("tp", F.sum("__hit").over(so_far)).withColumn("positives", F.sum("__hit").over(all_))
    return out.withColumn("precision", ratio(F.col("tp"), F.col("rank"))).withColumn("recall", ratio(F.col("tp"), F.col("positives"))).drop("__hit")


def average_precision_101(ranked_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over 101 recall levels of the best precision at that recall or beyond."""
    # best precision from each reached level on; a row reaches levels up to floor(100 * recall)
    reached = ranked_rows.withColumn("level", F.floor(F.col("tp") * 100 / F.col("positives")).cast("int"))
    best = reached.where("positives > 0").groupBy(*keys, "level").agg(F.max("precision").alias("p"))
    below = Window.partitionBy(*keys).orderBy("level")
    # each level's precision holds for the levels after the next lower one
    steps = best.withColumn("lower", F.coalesce(F.lag("level").over(below), F.lit(-1))).withColumn("p", F.max("p").over(below.rowsBetween(0, Window.unboundedFollowing)))
    return steps.groupBy(*keys).agg((F.sum(F.col("p") * (F.col("level") - F.col("lower"))) / 101).alias("ap"))


def average_precision_envelope(ranked_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the precision envelope: sum of recall steps times the best later precision."""
    w = Window.partitionBy(*keys).orderBy("rank")
    envelope = F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    return ranked_rows.where("positives > 0").select(*keys, (step * envelope).alias("a")).groupBy(*keys).agg(F.sum("a").alias("ap"))


def counting_error(df: DataFrame, true: Column, predicted: Column, group: str) -> DataFrame:
    """Errors of counts over everything ('all') and per group value."""
    e = df.select(F.col(group).alias("subset"), (predicted - true).cast("double").alias("e"))
    stats = e.rollup("subset").agg(
        F.count("e").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"),
        F.avg((F.col("e") == 0).cast("double")).alias("exact"), F.avg((F.abs("e") <= 1).cast("double")).alias("within_one"), F.grouping("subset").alias("g"),
    )
    return stats.where("g = 1 or subset is not null").withColumn("subset", F.when(F.col("g") == 1, "all").otherwise(F.col("subset"))).drop("g")


def cluster_bootstrap(clusters: DataFrame, hits: str, n: str, replicates: int) -> DataFrame:
    """(low, high): 95 % interval of sum(hits) / sum(n) when clusters are drawn anew.

    ``clusters`` has one row per cluster and a column idx from 0 to its number
    minus 1. A draw's cluster comes from a multiplicative generator on
    (replicate, draw), so any engine gives the same draws.
    """
    draws = _draws(clusters, replicates)
    per = draws.join(clusters, "idx").groupBy("rep").agg((F.sum(hits) / F.sum(n)).alias("value"))
    return per.agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def _draws(clusters: DataFrame, replicates: int) -> DataFrame:
    """(rep, idx): as many clusters per replicate as there are, drawn with replacement."""
    k = clusters.select("idx").distinct().count()
    return clusters.sparkSession.range(replicates * k).select(F.expr(f"id div {k}").alias("rep"), F.expr(f"(((id div {k}) * 48271 + (id % {k}) * 69621 + ((id * id) % 1000003)) * 16807 % 2147483647) % {k}").alias("idx"))


def paired_macro_f1(clusters: DataFrame, replicates: int) -> DataFrame:
    """(first, second, delta, low, high): macro F1 of two predictors of the same rows, the difference and its 95 % interval.

    ``clusters`` has one row per cluster (idx from 0 on) and class: true_n, and
    for either predictor said_a, hits_a, said_b, hits_b. Both predictors see the
    same draws. A class counts where a draw has true rows of it.
    """
    sums = [F.sum(c).alias(c) for c in ("true_n", "said_a", "hits_a", "said_b", "hits_b")]
    f1 = lambda p: F.coalesce(F.try_divide(2 * F.col(f"hits_{p}"), F.col(f"said_{p}") + F.col("true_n")), F.lit(0.0))
    macro = lambda df, *keys: df.where("true_n > 0").groupBy(*keys).agg(F.avg(f1("a")).alias("first"), F.avg(f1("b")).alias("second"))
    point = macro(clusters.groupBy("class").agg(*sums))
    drawn = macro(_draws(clusters, replicates).join(clusters, "idx").groupBy("rep", "class").agg(*sums), "rep")
    delta = F.col("second") - F.col("first")
    interval = drawn.agg(F.percentile(delta, F.lit(0.025)).alias("low"), F.percentile(delta, F.lit(0.975)).alias("high"))  # one value per replicate
    return point.select("first", "second", delta.alias("delta"), F.lit(1).alias("one")).join(interval.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
