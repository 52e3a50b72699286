"""Groups of records that are linked directly or indirectly.

Seed-tree pruning. In each round every vertex points its neighbourhood at the
neighbourhood's minimum; vertices that are nobody's minimum leave the graph and
hang themselves below a smaller vertex in the propagation forest; the minima
stay, linked to each other. When no edge is left the remaining minima are the
seeds, one per component and its smallest vertex, and their identifiers flow
down the forest, last round first.

A round's joins are skewed on hub vertices. Their other side has one row per
vertex and an exchange follows, so adaptive execution may split the hub's
partition; nothing collects a vertex's neighbours into one row. Each round
leaves a fraction of the vertices and is written to the shared checkpoint
folder.

Defined results: edges with a null end and loops are ignored, repeated and
reversed edges count once, an empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut

MAX_ROUNDS = 100


def _both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v) for either direction of every pair; one pass over the pairs."""
    there = F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    back = F.struct(F.col(b).alias("u"), F.col(a).alias("v"))
    return pairs.select(F.explode(F.array(there, back)).alias("e")).select("e.u", "e.v")


def _point_at_minimum(graph: DataFrame) -> DataFrame:
    """(v, m): m is the minimum of the neighbourhood of v or of a neighbour of v."""
    minima = graph.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
    to_neighbours = graph.join(minima, "u").select("v", "m")
    return to_neighbours.union(minima.select(F.col("u").alias("v"), "m")).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is its smallest vertex."""
    pairs = (
        edges.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r"))
        .where("l is not null and r is not null and l <> r")
        .select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
        .distinct()
    )
    graph = _both_ways(pairs, "a", "b")
    forest: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        pointed = cut(_point_at_minimum(graph))
        nearest = pointed.groupBy("v").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("v")).alias("stays"))
        # a vertex that is nobody's minimum leaves and hangs below the smallest it saw
        forest.append(nearest.where(~F.col("stays")).select(F.col("v").alias("child"), F.col("low").alias("parent")))
        links = pointed.join(nearest.select("v", "low"), "v").where("m <> low").select(F.least("m", "low").alias("a"), F.greatest("m", "low").alias("b"))
        remaining = cut(links.distinct())
        if remaining.isEmpty():
            break
        graph = _both_ways(remaining, "a", "b")
    else:
        raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
    return _flow_down(forest)


def _flow_down(forest: list[DataFrame]) -> DataFrame:
    """Seeds' identifiers down the trees: a round's parents either are seeds or left in a later round."""
    labels = None
    for trees in reversed(forest):
        if labels is None:
            labels = trees.select(F.col("child").alias("vertex"), F.col("parent").alias("component"))
            continue
        known = labels.select(F.col("vertex").alias("parent"), "component")
        lower = trees.join(known, "parent", "left").select(F.col("child").alias("vertex"), F.coalesce("component", "parent").alias("component"))
        labels = cut(labels.unionByName(lower))
    seeds = labels.select(F.col("component").alias("vertex"), "component").distinct()
    return labels.unionByName(seeds)
