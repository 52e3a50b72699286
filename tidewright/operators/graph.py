"""Connected components of lineage links, by alternating stars.

Large-star links a vertex's larger neighbours to its smallest neighbour,
small-star its smaller ones; both keep components and each round shortens
paths, until every edge points at a component's smallest vertex. Links are
cut() every round; the number of edges that still change decides the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut

MAX_ROUNDS = 60


def token_links(df: DataFrame, vertex: str, tokens: list[str]) -> DataFrame:
    """(a, b): each vertex with the first vertex that shares the value of one of its token columns."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(t).cast("string").alias("value")) for i, t in enumerate(tokens)))
    values = df.select(F.col(vertex).alias("v"), F.explode(kinds).alias("t")).select("v", "t.*").where("value is not null and v is not null")
    first = values.groupBy("kind", "value").agg(F.min("v").alias("first"))
    return values.join(first, ["kind", "value"]).where("v <> first").select(F.col("v").alias("a"), F.col("first").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u > v)."""
    if large:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is its smallest vertex."""
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    size = None
    for _ in range(MAX_ROUNDS):
        after = cut(_star(_star(now, large=True), large=False))
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == size:
            break
        now, size = after, mark
    else:
        raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
