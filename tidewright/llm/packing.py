"""Filling containers of fixed capacity with whole texts (problem 8).

Sizes are tokens of the byte_bpe_50k vocabulary. A text larger than the
capacity fills containers of its own; what remains of it is an item like any
other. Items are dealt by hash to parts of about PART_ITEMS, and each part is
packed by best-fit decreasing. Dual-feasible functions bound the number of
containers any packing of the part needs; a part that needs no more is
certified. Certified parts give only their emptiest container back, the others
all that have a gap; what was given back is dealt anew to fewer parts and
packed again, until one part is left or nothing is gained. Parts are bounded,
so no task grows with the input, and the last round is one part of leftovers
only once they fit into one.

Defined results: null and empty texts have size 0 and lie in some container
like other items; a budget without a positive capacity has no containers;
repeated rows are items of their own, also under one doc_id; at most MAX_ROUNDS
rounds exchange items, and what the last one packs stays so (p8_summary tells
the rounds and certified parts); the fill of a container is the sum of its
items' tokens.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.bpe import encode_column
from tidewright.session import cut

PART_ITEMS = 20_000
MAX_ROUNDS = 6
MAX_BUDGETS = 100
#: Members of the two families of dual-feasible functions that are tried.
STEPS = tuple(range(2, 21))
CUTS = 64


def bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of the sizes needs, by dual-feasible functions.

    A dual-feasible function never sums to more than 1 over sizes that fit into
    one container, so its sum over all sizes, rounded up, is a bound.
    """
    sizes = sizes[sizes > 0].astype(np.int64)
    if len(sizes) == 0:
        return 0
    best = -(-int(sizes.sum()) // capacity)
    for k in STEPS:  # x stays where (k+1)x is whole, else is rounded down to k-ths
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # in units of 1 / (capacity * k)
        total = int((sizes[whole] * k).sum()) + capacity * int((scaled[~whole] // capacity).sum())
        best = max(best, -(-total // (capacity * k)))
    halves = np.unique(sizes[sizes * 2 <= capacity])
    for cut_ in halves[np.linspace(0, len(halves) - 1, min(CUTS, len(halves))).astype(int)] if len(halves) else ():
        large = sizes > capacity - cut_
        middle = sizes[(sizes >= cut_) & ~large]
        best = max(best, int(large.sum()) + -(-int(middle.sum()) // capacity))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size, by best-fit decreasing."""
    container = np.empty(len(sizes), np.int64)
    rooms: list[int] = []  # distinct rooms of open containers, ascending
    open_: dict[int, list[int]] = {}
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            which = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        else:
            which, room, n = n, capacity, n + 1
        container[i] = which
        left = room - size
        if left in open_:
            open_[left].append(which)
        else:
            open_[left] = [which]
            insort(rooms, left)
    return container


ITEM = "budget_id int, capacity_tokens int, doc_id bigint, row bigint, piece int, n_tokens int"
CERTIFICATE = "budget_id int, round int, part int, bins bigint, bound bigint"
PACKED = ITEM + ", part int, bin bigint, fill bigint, back boolean, bins bigint, bound bigint"


def _pack(items: pd.DataFrame) -> pd.DataFrame:
    items = items.sort_values(["n_tokens", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable")
    sizes, capacity = items["n_tokens"].to_numpy(), int(items["capacity_tokens"].iloc[0])
    bins = best_fit(sizes, capacity)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    need, has = bound(sizes, capacity), len(fill)
    # an item of size 0 may need a container that no bound counts
    back = fill < capacity
    if has <= max(need, 1):
        back = np.zeros(has, bool)
        back[np.argmin(fill)] = fill.min() < capacity
    return items.assign(bin=bins, fill=fill[bins], back=back[bins], bins=has, bound=need)


def items(documents: DataFrame, budgets: DataFrame, path: str | None = None) -> DataFrame:
    """(budget_id, capacity_tokens, doc_id, row, piece, n_tokens, full): every text's pieces for every budget.

    ``row`` tells rows of one doc_id apart; it numbers rows that lie in the checkpoint, so it stays the same when read again.
    """
    sizes = cut(encode_column(documents, "doc_id", "text", path, lengths_only=True)).withColumn("row", F.monotonically_increasing_id())
    # the budgets are a fixed, small table; more than MAX_BUDGETS of them are refused
    usable = budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().orderBy("budget_id", "capacity_tokens").limit(MAX_BUDGETS + 1).collect()
    if len(usable) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    each = F.array(*(F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("int").alias("capacity_tokens")) for b, c in usable)) if usable else F.array().cast("array<struct<budget_id:int,capacity_tokens:int>>")
    n, capacity = F.col("n_tokens"), F.col("capacity_tokens")
    whole = F.when(n > capacity, F.floor(n / capacity)).otherwise(0).cast("int")
    pieces = F.concat(
        F.transform(F.sequence(F.lit(1), whole), lambda i: F.struct((i - 1).alias("piece"), capacity.alias("n_tokens"), F.lit(True).alias("full"))),
        F.array(F.struct(whole.alias("piece"), (n - whole * capacity).alias("n_tokens"), F.lit(False).alias("full"))),
    )
    only_rest = F.array(F.struct(F.lit(0).alias("piece"), n.alias("n_tokens"), F.lit(False).alias("full")))
    exploded = sizes.select("doc_id", "row", "n_tokens", F.explode(each).alias("b")).select("doc_id", "row", "n_tokens", "b.*").select("budget_id", "capacity_tokens", "doc_id", "row", F.explode(F.when(whole > 0, pieces).otherwise(only_rest)).alias("p"))
    # a text of a whole number of capacities leaves no rest
    return exploded.select("budget_id", "capacity_tokens", "doc_id", "row", "p.*").where("full or n_tokens > 0 or piece = 0")


def containers(documents: DataFrame, budgets: DataFrame, path: str | None = None) -> DataFrame:
    """(budget_id, capacity_tokens, doc_id, piece, n_tokens, container, fill_tokens) of every piece."""
    return pack(documents, budgets, path)[0]


def pack(documents: DataFrame, budgets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces with their containers, all items, the certificate of every part of every round: its containers and its bound)."""
    all_items = cut(items(documents, budgets, path))
    full = all_items.where("full")
    done = [
        full.select("budget_id", "capacity_tokens", "doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit("full"), "budget_id", "doc_id", "row", "piece").alias("container"), F.col("n_tokens").cast("bigint").alias("fill_tokens"))
    ]
    columns = [c.split()[0] for c in ITEM.split(", ")]
    shown = [c for c in columns if c != "row"]
    certificates = all_items.sparkSession.createDataFrame([], CERTIFICATE)
    todo = all_items.where("not full").select(*columns)
    for round_ in range(MAX_ROUNDS):
        # per budget few numbers reach the driver: how many parts its items need
        counts = {b: n for b, n in todo.groupBy("budget_id").count().collect()}
        if not counts:
            break
        parts = F.coalesce(*(F.when(F.col("budget_id") == b, math.ceil(n / PART_ITEMS)) for b, n in counts.items()), F.lit(1))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(round_)), parts).cast("int"))
        result = cut(dealt.groupBy("budget_id", "part").applyInPandas(_pack, PACKED))
        certificates = certificates.unionByName(result.groupBy("budget_id", F.lit(round_).alias("round"), "part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound")))
        ends = round_ == MAX_ROUNDS - 1
        # a budget whose items were one part has nothing to exchange with
        single = F.coalesce(*(F.when(F.col("budget_id") == b, n <= PART_ITEMS) for b, n in counts.items()), F.lit(True))
        keep = F.lit(True) if ends else ~F.col("back") | single
        named = F.concat_ws("-", F.lit(f"r{round_}"), "budget_id", "part", "bin").alias("container")
        done.append(result.where(keep).select(*shown, named, F.col("fill").alias("fill_tokens")))
        todo = result.where(~keep).select(*columns)
        if ends or all(n <= PART_ITEMS for n in counts.values()):
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, all_items, certificates


def total_bound(every: DataFrame) -> DataFrame:
    """(budget_id, capacity_tokens, bound): dual-feasible functions summed over all items, which holds for any packing.

    Both families of ``bound`` are sums over items, so they need one aggregation; the second takes its cuts at 32nds of the capacity.
    """
    n, c = F.col("n_tokens").cast("bigint"), F.col("capacity_tokens").cast("bigint")
    sums = [F.ceil(F.sum(n) / F.max(c))]
    for k in STEPS:
        scaled = (k + 1) * n
        sums.append(F.ceil(F.sum(F.when(scaled % c == 0, n * k).otherwise(c * F.floor(scaled / c))) / (F.max(c) * k)))
    for e in range(1, 17):
        least = F.greatest(F.floor(c * e / 32), F.lit(1))
        sums.append(F.count_if(n > c - least) + F.ceil(F.sum(F.when((n >= least) & (n <= c - least), n).otherwise(0)) / F.max(c)))
    return every.where("n_tokens > 0").groupBy("budget_id", "capacity_tokens").agg(F.greatest(*sums).alias("bound"))


def summary(documents: DataFrame, budgets: DataFrame, path: str | None = None) -> DataFrame:
    """Per budget: containers, tokens, the bound on containers, the share of room that is filled, rounds of exchange,
    and of the parts of the last round how many there were and how many are certified to need no fewer containers."""
    packed, every, certificates = pack(documents, budgets, path)
    used = packed.groupBy("budget_id", "capacity_tokens").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    last = certificates.groupBy("budget_id").agg(F.max("round").alias("round"))
    certified = F.count_if(F.col("bins") <= F.greatest("bound", F.lit(1)))
    parts = certificates.join(last, ["budget_id", "round"]).groupBy("budget_id").agg((F.max("round") + 1).alias("rounds"), F.count("*").alias("last_parts"), certified.alias("certified_parts"))
    out = used.join(total_bound(every), ["budget_id", "capacity_tokens"], "left").join(parts, "budget_id", "left")
    return out.na.fill(0, ["bound", "rounds", "last_parts", "certified_parts"]).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
