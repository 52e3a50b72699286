"""Joins, set operations, grouping sets and scalar functions over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.numbers import finite, logistic, ratio, weighted_present
from tidewright.operators import store
from tidewright.plans.dashboard import read


def five_way_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines, orders, customers, nations and regions joined on their keys, with a count per region and year."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("int").alias("year"))
    customers = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = read(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    regions = read(spark, d, "region").select("r_regionkey", "r_name")
    joined = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(nations, "n_nationkey").join(regions, "r_regionkey")
    return joined.groupBy("r_name", "year").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


def anti_join_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order and orders without a customer."""
    customers, orders = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    missing = store.orphans(customers, orders, ["c_custkey"]).select(F.lit("without_order").alias("kind"), "c_custkey")
    return missing.unionByName(store.orphans(orders, customers, ["c_custkey"]).select(F.lit("without_customer").alias("kind"), "c_custkey"))


def semi_join_subset(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select("p_partkey", "p_brand")
    large = read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return parts.join(large, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("parts"))


def conditional_union(spark: SparkSession, d: str) -> DataFrame:
    """Bag union of customers and suppliers with their origin and a forced group."""
    customers = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("origin"))
    suppliers = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("origin"))
    return customers.unionByName(suppliers).groupBy("origin", "nation").agg(F.count("*").alias("n"))


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Nations with customers and suppliers: intersection, both differences, union."""
    c = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation")).distinct()
    s = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")).distinct()
    parts = {"both": c.intersect(s), "customers_only": c.subtract(s), "suppliers_only": s.subtract(c), "any": c.union(s).distinct()}
    out = None
    for name, df in parts.items():
        tagged = df.select(F.lit(name).alias("kind"), "nation")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return rows


def rollup_classes(spark: SparkSession, d: str) -> DataFrame:
    """One table of annotation counts by class, by quality, by region and in total, in one pass."""
    a = read(spark, d, "source_records").dropDuplicates(["record_id"]).select(F.explode("annotations.class_id").alias("class"))
    a = a.where("class is not null").withColumns({"region": F.floor(F.col("class") / 3).cast("int"), "quality": (F.col("class") % 3).cast("int")})
    a.createOrReplaceTempView("annotation_classes")
    return spark.sql("select class, region, quality, count(*) as n from annotation_classes group by grouping sets ((class), (region), (quality), ())")


def lag_of_types(spark: SparkSession, d: str) -> DataFrame:
    """How often a user's consecutive events have another type."""
    rows = read(spark, d, "events").withColumn("before", F.expr("lag(event_type) over (partition by user_id order by ts, event_id)"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("before") != F.col("event_type")).alias("switches"), F.count("*").alias("events"))


def json_extract_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return rows.where("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def alias_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Languages by alias, sources as snake case, rows without value as unknown."""
    lang = F.lower(F.trim(F.coalesce("lang", F.lit(""))))
    code = F.when(lang.isin("en", "en-gb", "en-us"), "en").when(lang.isin("fil", "tl"), "fil").when(lang.isin("es", "de"), lang).otherwise("unknown")
    source = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("source", F.lit("unknown"))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return read(spark, d, "documents").groupBy(code.alias("lang"), source.alias("source")).agg(F.count("*").alias("n"))


def multi_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of a separated cell in order, each once, unknown ones dropped, then one row each."""
    cell = F.concat_ws("|", F.regexp_replace("p_type", " ", "|"), "p_brand", F.lit("unknown"), "p_brand")
    parts = F.array_distinct(F.filter(F.transform(F.split(cell, r"\|"), lambda v: F.trim(v)), lambda v: ~F.lower(v).isin("", "unknown", "none", "n/a")))
    rows = read(spark, d, "part").select("p_partkey", F.posexplode(parts).alias("pos", "value"))
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def group_balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by which each source counts the same within its kind; from two small aggregates, no window over rows."""
    rows = read(spark, d, "documents").where("doc_kind is not null and source is not null")
    cells = rows.groupBy("doc_kind", "source").agg(F.count("*").alias("n"))
    kinds = cells.groupBy("doc_kind").agg(F.count("*").alias("sources"), F.sum("n").alias("total"))
    return cells.join(kinds, "doc_kind").select("doc_kind", "source", "n", F.round(ratio(F.col("total"), F.col("sources") * F.col("n")), 6).alias("weight"))


def order_independent_hash(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a small table's rows that no order changes."""
    line = F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    return read(spark, d, "nation").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def population_stats(spark: SparkSession, d: str) -> DataFrame:
    v = finite(F.col("value"))
    return read(spark, d, "events").groupBy("event_type").agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(ratio(F.count_if(v > 50), F.count("*")), 6).alias("frequency")
    )


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Exact linear percentiles per type."""
    p = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))))
    rows = read(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("low"), p.alias("p"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return rows.select("event_type", "n", F.round("low", 3).alias("low"), *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95"))), F.round("mean", 3).alias("mean"), F.round("high", 3).alias("high"))


def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change and rate of the event number between each user's first and last event; null where it fell."""
    rows = read(spark, d, "events").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("a"), F.max_by("value", F.struct("ts", "event_id")).alias("b"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("s"))
    delta = F.when(F.col("b") >= F.col("a"), F.col("b") - F.col("a"))
    return rows.select("user_id", F.round(delta, 6).alias("delta"), F.round(F.try_divide(delta * 1e6, "s"), 6).alias("per_million_s"))


def best_frames(spark: SparkSession, d: str) -> DataFrame:
    """Best frame per fish: weights renormalised over the factors present, earliest frame on ties."""
    score = weighted_present([(0.6, finite(F.col("provisional_score"))), (0.4, finite(F.col("detection_confidence")))])
    rows = read(spark, d, "frame_grades").select("session_id", "fish_id", "frame", F.round(score, 9).alias("score"))
    best = rows.groupBy("session_id", "fish_id").agg(F.max(F.struct("score", (-F.col("frame")).alias("minus"))).alias("m"))
    return best.select("session_id", "fish_id", (-F.col("m.minus")).alias("frame"), F.round("m.score", 6).alias("score"))


def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    z = (F.col("p_retailprice") - 1400) / 200 * 0.7 - (F.col("p_size") - 25) / 14 * 0.3
    return read(spark, d, "part").select(logistic(z).alias("p")).groupBy(F.floor(F.col("p") * 10).cast("int").alias("decile")).agg(F.count("*").alias("n"))


def tumbling_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and hour window (the batch form of the streaming query)."""
    rows = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "value")


QUERIES = {
    f.__name__: f
    for f in (
        five_way_join, anti_join_orphans, semi_join_subset, conditional_union, set_ops, cube_counts, rollup_classes, lag_of_types, json_extract_filter, alias_normalise, multi_values,
        group_balanced_weights, order_independent_hash, population_stats, latency_summary, nearest_rank_p95, counter_deltas, best_frames, logistic_scores, tumbling_hours,
    )
}

ORACLES = {
    "five_way_join": """select r_name, year(o_orderdate)::int as year, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""",
    "anti_join_orphans": """select 'without_order' as kind, c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)
        union all select 'without_customer', o_custkey from orders where o_custkey not in (select c_custkey from customer)""",
    "semi_join_subset": "select p_brand, count(*) as parts from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 49) group by p_brand",
    "conditional_union": "select origin, nation, count(*) as n from (select 'customer' as origin, c_nationkey as nation from customer union all select 'supplier', s_nationkey from supplier) group by all",
    "set_ops": """with c as (select distinct c_nationkey as nation from customer where c_acctbal > 5000), s as (select distinct s_nationkey as nation from supplier where s_acctbal > 5000)
        select 'both' as kind, nation from (select * from c intersect select * from s) union all select 'customers_only', nation from (select * from c except select * from s)
        union all select 'suppliers_only', nation from (select * from s except select * from c) union all select 'any', nation from (select * from c union select * from s)""",
    "cube_counts": "select o_orderstatus, o_orderpriority, count(*) as n, grouping_id(o_orderstatus, o_orderpriority)::int as level from orders group by cube (o_orderstatus, o_orderpriority)",
    "rollup_classes": """select class, region, quality, count(*) as n from (select a.class_id as class, (a.class_id // 3)::int as region, (a.class_id % 3)::int as quality from
        (select unnest(annotations) as a from (select distinct on (record_id) * from source_records))) group by grouping sets ((class), (region), (quality), ())""",
    "lag_of_types": "select user_id, count(*) filter (before <> event_type) as switches, count(*) as events from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) group by user_id",
    "json_extract_filter": "select event_type, count(*) as n, sum(k)::bigint as k from (select event_type, (props::json ->> '$.k')::int as k from events) where k >= 50 group by event_type",
    "alias_normalise": """select case when l in ('en', 'en-gb', 'en-us') then 'en' when l in ('fil', 'tl') then 'fil' when l in ('es', 'de') then l else 'unknown' end as lang, source, count(*) as n from
        (select lower(trim(coalesce(lang, ''))) as l, regexp_replace(regexp_replace(lower(coalesce(source, 'unknown')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as source from documents) group by all""",
    "multi_values": """select value, count(*) as n, min(pos)::int as first_pos from (select unnest(v) as value, unnest(range(len(v))) as pos from (select list_filter(list_distinct_ordered, lambda x: lower(x) not in ('', 'unknown', 'none', 'n/a')) as v from
        (select list_filter(p, lambda x, i: list_position(p, x) = i) as list_distinct_ordered from (select string_split(replace(p_type, ' ', '|') || '|' || p_brand || '|unknown|' || p_brand, '|') as p from part)))) group by value""",
    "group_balanced_weights": """with cells as (select doc_kind, source, count(*) as n from documents where doc_kind is not null and source is not null group by all)
        select doc_kind, source, n, round(sum(n) over k / (count(*) over k * n), 6)::double as weight from cells window k as (partition by doc_kind)""",
    "order_independent_hash": "select sha256(string_agg(n_nationkey || '|' || n_name || '|' || n_regionkey, chr(10) order by n_nationkey || '|' || n_name || '|' || n_regionkey)) as digest from nation",
    "population_stats": """select event_type, count(value) as n, round(avg(value), 6) as mean, max(value) as max, min(value) as min, round(stddev_pop(value), 6) as std,
        round(count(*) filter (value > 50) / count(*), 6) as frequency from events group by event_type""",
    "latency_summary": """select event_type, count(value) as n, round(min(value), 3) as low, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75,
        round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 3) as mean, round(max(value), 3) as high from events group by event_type""",
    "nearest_rank_p95": "select event_type, quantile_disc(value, 0.95) as p95 from events group by event_type",
    "counter_deltas": """select user_id, round(case when b >= a then b - a end, 6) as delta, round(case when b >= a and s <> 0 then (b - a) * 1e6 / s end, 6) as per_million_s from (select user_id, arg_min(value, (ts, event_id)) as a,
        arg_max(value, (ts, event_id)) as b, (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) as s from events group by user_id)""",
    "best_frames": """select session_id, fish_id, frame, round(score, 6) as score from (select session_id, fish_id, frame, round(case when provisional_score is null or isnan(provisional_score) then (0.4 * detection_confidence) / 0.4
        else (0.6 * provisional_score + 0.4 * detection_confidence) / (0.6 + 0.4) end, 9) as score from frame_grades) qualify row_number() over (partition by session_id, fish_id order by score desc, frame) = 1""",
    "logistic_scores": "select floor(10 / (1 + exp(-((p_retailprice - 1400) / 200 * 0.7 - (p_size - 25) / 14 * 0.3))))::int as decile, count(*) as n from part group by decile",
    "tumbling_hours": "select epoch(time_bucket(interval 1 hour, ts))::bigint as start_s, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
}
