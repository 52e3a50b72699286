"""Evaluation queries over grades, reviews and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.numbers import f1_or_zero, finite, ratio
from tidewright.functions.text import grade_name, squeezed, value_or_null
from tidewright.operators import learning, metrics
from tidewright.plans.dashboard import latest_inspections, read
from tidewright.plans.sequences import _G, vote_of_frames



def _truth(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, track_id, truth, predicted, confidence) of fish with an inspection and graded frames."""
    last = latest_inspections(spark, d, "final_grade", "model1_confidence")
    votes = vote_of_frames(spark, d).select("session_id", F.col("fish_id").alias("track_id"), "grade")
    return last.join(votes, ["session_id", "track_id"]).select("session_id", "track_id", F.nullif("final_grade", F.lit("Ungraded")).alias("truth"), F.col("grade").alias("predicted"), finite(F.col("model1_confidence")).alias("confidence"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    t = _truth(spark, d)
    return metrics.confusion(t, F.coalesce("truth", F.lit("Ungraded")), F.coalesce("predicted", F.lit("Ungraded")))


def precision_recall_f1(spark: SparkSession, d: str) -> DataFrame:
    t = _truth(spark, d).where("truth is not null")
    out = metrics.per_class(metrics.confusion(t, F.col("truth"), F.col("predicted")))
    return out.select("class", "true_n", "said_n", "hits", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of agreement at 19 confidence thresholds, from one histogram of the confidences."""
    t = _truth(spark, d).where("truth is not null and confidence is not null")
    # a row counts for every threshold up to its confidence: cumulate a histogram from above
    cell = F.least(F.floor(F.col("confidence") * 20), F.lit(19)).cast("int")
    h = t.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))
    grid = spark.range(1, 20).select(F.col("id").cast("int").alias("cell"))
    full = grid.join(h, "cell", "full_outer").na.fill(0)
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)  # 20 rows
    said, hits, total = F.sum("n").over(above), F.sum("hits").over(above), F.sum("hits").over(Window.partitionBy())
    out = full.select("cell", said.alias("said"), hits.alias("hits"), total.alias("total")).where("cell >= 1")
    p, r = F.coalesce(ratio(F.col("hits"), F.col("said")), F.lit(0.0)), F.coalesce(ratio(F.col("hits"), F.col("total")), F.lit(0.0))
    return out.select((F.col("cell") / 20).alias("threshold"), "said", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1_or_zero(p, r), 6).alias("f1"))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of most F1, the lower one on ties."""
    return threshold_sweep(spark, d).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("threshold"), "m.f1")


def _all_reviews(spark: SparkSession, d: str, label: Column) -> DataFrame:
    """(fish_instance_id, finding_id, label): the last review of every reviewer of a finding, where it has a label."""
    rows = read(spark, d, "belly_observations").where((squeezed(F.col("review_status")) == "reviewed") & F.col("fish_instance_id").isNotNull() & F.col("finding_id").isNotNull())
    word = F.struct("recorded_at", "observation_id", label.alias("label"))
    last = rows.select("fish_instance_id", "finding_id", F.coalesce("reviewer_id", F.lit("")).alias("reviewer_id"), word.alias("word")).groupBy("fish_instance_id", "finding_id", "reviewer_id").agg(F.max("word").alias("word"))
    return last.select("fish_instance_id", "finding_id", "word.label").where("label is not null")


def _pairs_kappa(labels: DataFrame, domain: list, weight: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    out = metrics.kappa(metrics.pair_table(labels, ["fish_instance_id", "finding_id"], "label", domain), weight)
    return out.select((F.col("n") / 2).cast("bigint").alias("n"), *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


def cohens_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Kappa of presence over all pairs of a finding's reviewers; they are interchangeable, so both have the same marginals."""
    says = value_or_null(F.col("presence"))
    return _pairs_kappa(_all_reviews(spark, d, F.when(says.isin("yes", "y", "true"), "yes").when(says.isin("no", "n", "false"), "no")), ["no", "yes"])


def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Quadratic weights over the rank of severities, over all pairs of a finding's reviewers."""
    how = squeezed(F.col("severity"))
    rank = F.coalesce(*(F.when(how == name, i) for i, name in enumerate(("none", "minor", "moderate", "severe"))))
    return _pairs_kappa(_all_reviews(spark, d, rank), [0, 1, 2, 3], lambda a, b: (a - b) * (a - b) / F.lit(9.0))


def counting_error(spark: SparkSession, d: str) -> DataFrame:
    """Fish counted in frames against fish inspected, per session and tracker."""
    frames = read(spark, d, "frame_grades").groupBy("session_id").agg(F.countDistinct("fish_id").alias("predicted"))
    true = read(spark, d, "fish_inspections").groupBy("session_id").agg(F.countDistinct("track_id").alias("true"))
    sessions = read(spark, d, "inspection_sessions").select("session_id", F.coalesce("tracker_backend", F.lit("none")).alias("backend"))
    rows = sessions.join(frames, "session_id", "left").join(true, "session_id", "left").na.fill(0, ["predicted", "true"])
    out = metrics.counting_error(rows, F.col("true"), F.col("predicted"), "backend")
    return out.select("subset", "n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "exact", "within_one")))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    t = _truth(spark, d).where("truth is not null and predicted is not null and confidence is not null")
    t = t.withColumn("id", F.concat_ws("/", "session_id", F.col("track_id").cast("string")))
    return metrics.ranked(t, ["predicted"], "confidence", "id", F.col("truth") == F.col("predicted"))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision at 101 recall levels per predicted grade."""
    return metrics.average_precision_101(_ranked(spark, d), ["predicted"]).select("predicted", F.round("ap", 6).alias("ap"))


def average_precision_area(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision_envelope(_ranked(spark, d), ["predicted"]).select("predicted", F.round("ap", 6).alias("ap"))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the share of agreeing fish when sessions are drawn anew, 200 times."""
    t = _truth(spark, d).where("truth is not null").groupBy("session_id").agg(F.count_if(F.col("truth") == F.col("predicted")).alias("hits"), F.count("*").alias("n"))
    clusters = t.withColumn("idx", F.row_number().over(Window.orderBy("session_id")) - 1)  # one row per session, a table that does not grow
    return metrics.cluster_bootstrap(clusters, "hits", "n", 200).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def paired_f1_interval(spark: SparkSession, d: str) -> DataFrame:
    """Macro F1 of the frames' vote and of the inspection's second grade against its final one: difference and interval over sessions, 200 draws."""
    last = latest_inspections(spark, d, "final_grade", "second_grade")
    votes = vote_of_frames(spark, d).select("session_id", F.col("fish_id").alias("track_id"), "grade")
    t = last.join(votes, ["session_id", "track_id"]).select("session_id", F.nullif("final_grade", F.lit("Ungraded")).alias("truth"), F.col("grade").alias("a"), F.col("second_grade").alias("b")).where("truth is not null")
    each = t.select("session_id", F.explode(F.array_distinct(F.array("truth", "a", "b"))).alias("class"), "truth", "a", "b").where("class is not null")
    is_ = lambda c: F.coalesce(F.col(c) == F.col("class"), F.lit(False))
    per = each.groupBy("session_id", "class").agg(F.count_if(is_("truth")).alias("true_n"), *(f(p) for p in "ab" for f in (lambda p: F.count_if(is_(p)).alias(f"said_{p}"), lambda p: F.count_if(is_(p) & is_("truth")).alias(f"hits_{p}"))))
    number = F.dense_rank().over(Window.orderBy("session_id")) - 1  # a few rows per session, a table that does not grow
    return metrics.paired_macro_f1(per.withColumn("idx", number), 200).select(*(F.round(c, 6).alias(c) for c in ("first", "second", "delta", "low", "high")))


def review_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by whether reviewers agree on presence and how many adjudications they have."""
    rows = read(spark, d, "belly_observations").select("fish_instance_id", "finding_id", value_or_null(F.col("presence")).alias("p"), (squeezed(F.col("review_status")) == "adjudicated").alias("adj"))
    per = rows.groupBy("fish_instance_id", "finding_id").agg(F.countDistinct(F.substring("p", 1, 1)).alias("labels"), F.count_if("adj").alias("adjudications"))
    return per.groupBy((F.col("labels") > 1).alias("conflict"), F.least("adjudications", F.lit(2)).alias("adjudications")).agg(F.count("*").alias("findings"))


def weighted_support(spark: SparkSession, d: str) -> DataFrame:
    """Weighted evidence per fish: frames' grades weigh by confidence; best grade, second and margin, ties in the order of grades."""
    g = grade_name(F.col("provisional_grade"))
    rows = read(spark, d, "frame_grades").select("session_id", "fish_id", *(F.when(g == name, F.round(F.col("detection_confidence") * 1000)).otherwise(0).cast("bigint").alias(f"g{i}") for i, name in enumerate(("Class A", "Class B", "Class C", "Rejected"))))
    sums = rows.groupBy("session_id", "fish_id").agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(4)))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"g{i}")).alias("minus"), F.lit(i).alias("grade")) for i in range(4))))
    total = sum((F.col(f"g{i}") for i in range(1, 4)), F.col("g0"))
    first, second = ranked[0], ranked[1]
    return sums.where(total > 0).select("session_id", "fish_id", first["grade"].alias("best"), second["grade"].alias("second"), F.round(ratio(second["minus"] - first["minus"], total), 6).alias("margin"))


def feature_model(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of a classifier of embeddings' labels on the fifth of the rows that a hash holds out."""
    table = read(spark, d, "embeddings")
    columns = [f"x{i}" for i in range(table.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    rows = table.select("vec_id", F.col("label").cast("string").alias("label"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)))
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    model = learning.fit(rows.where(~held), columns, "label")
    out = learning.predictions(model, rows.where(held), "label")
    return metrics.confusion(out, F.col("truth"), F.col("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_model, confusion_matrix, precision_recall_f1, threshold_sweep, best_threshold, cohens_kappa, weighted_kappa, counting_error, average_precision, average_precision_area, bootstrap_interval, paired_f1_interval, review_conflicts, weighted_support,
    )
}

_TRUTH = f"""r as (select session_id, fish_id, {_G} as grade, round(detection_confidence * 1000)::bigint as c from frame_grades), v as (select session_id, fish_id, grade, sum(c)::bigint as total, count(*) as n from r where grade is not null and c is not null group by all),
votes as (select session_id, fish_id as track_id, grade from v qualify row_number() over (partition by session_id, fish_id order by total desc, n desc, grade desc) = 1),
last as (select * from (select *, row_number() over (partition by session_id, track_id order by try_cast(updated_at as timestamptz) desc nulls last) as rn from fish_inspections) where rn = 1),
t as (select session_id, track_id, nullif(final_grade, 'Ungraded') as truth, grade as predicted, case when isfinite(model1_confidence) then model1_confidence end as confidence from last join votes using (session_id, track_id))"""
_SQ = lambda c: f"lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_PAIRS = lambda label: f"""last as (select fish_instance_id, finding_id, coalesce(reviewer_id, '') as r, arg_max({{'l': {label}}}, (coalesce(recorded_at, timestamp '1000-01-01'), observation_id)).l as l
  from belly_observations where {_SQ("review_status")} = 'reviewed' and fish_instance_id is not null and finding_id is not null group by all),
one as (select x.l as a, y.l as b from last x join last y on x.fish_instance_id = y.fish_instance_id and x.finding_id = y.finding_id and x.r < y.r where x.l is not null and y.l is not null),
ab as (select a, b from one union all select b, a from one)"""  # noqa: E731
_RANKED = f"""{_TRUTH}, k as (select *, row_number() over w as rank, sum((truth = predicted)::int) over (w rows unbounded preceding) as tp, sum((truth = predicted)::int) over (partition by predicted) as positives from
  (select *, session_id || '/' || track_id as id from t where truth is not null and predicted is not null and confidence is not null) window w as (partition by predicted order by confidence desc, id)),
q as (select predicted, rank, tp::double / rank as precision, tp::double / positives as recall, floor(tp * 100 / positives)::int as level from k where positives > 0)"""

_SWEEP = f"""with {_TRUTH}, u as (select * from t where truth is not null and confidence is not null),
s as (select g.i, count(u.truth) as said, count(*) filter (u.truth = u.predicted) as hits, (select count(*) filter (truth = predicted) from u) as total from range(1, 20) g(i) left join u on least(floor(u.confidence * 20), 19) >= g.i group by g.i),
f as (select i / 20 as threshold, said, hits, coalesce(hits / nullif(said, 0), 0)::double as p, coalesce(hits / nullif(total, 0), 0)::double as r from s),
sweep as (select threshold::double as threshold, said, hits, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6)::double as f1 from f)"""

ORACLES = {
    "confusion_matrix": f"with {_TRUTH} select coalesce(truth, 'Ungraded') as truth, coalesce(predicted, 'Ungraded') as predicted, count(*) as n from t group by all",
    "precision_recall_f1": f"""with {_TRUTH}, u as (select * from t where truth is not null), c as (select distinct x as class from (select truth as x from u union select predicted from u) where x is not null),
        m as (select class, (select count(*) from u where truth = class) as true_n, (select count(*) from u where predicted = class) as said_n, (select count(*) from u where predicted = class and truth = class) as hits from c)
        select class, true_n, said_n, hits, round(hits / nullif(said_n, 0), 6)::double as precision, round(hits / nullif(true_n, 0), 6)::double as recall,
        round(case when said_n > 0 and true_n > 0 and hits > 0 then 2 * (hits / said_n) * (hits / true_n) / (hits / said_n + hits / true_n) end, 6)::double as f1 from m""",
    "threshold_sweep": f"{_SWEEP} select * from sweep",
    "best_threshold": f"{_SWEEP} select threshold, f1 from sweep order by f1 desc, threshold limit 1",
    "cohens_kappa": f"""with {_PAIRS(f"case when {_SQ('presence')} in ('yes', 'y', 'true') then 1 when {_SQ('presence')} in ('no', 'n', 'false') then 0 end")}, o as (select count(*) // 2 as n, avg((a = b)::int) as o, avg(a) as p from ab)
        select n, round(o, 6) as observed, round(p * p + (1 - p) * (1 - p), 6) as expected, round(1 - (1 - o) / (1 - p * p - (1 - p) * (1 - p)), 6) as kappa from o""",
    "weighted_kappa": f"""with {_PAIRS(f"case {_SQ('severity')} when 'none' then 0 when 'minor' then 1 when 'moderate' then 2 when 'severe' then 3 end")}, o as (select count(*) // 2 as n, avg((a - b) * (a - b) / 9.0) as o, avg(a * a) as aa, avg(a) as ma from ab)
        select n, round(1 - o, 6) as observed, round(1 - 2 * (aa - ma * ma) / 9.0, 6) as expected, round(1 - o / (2 * (aa - ma * ma) / 9.0), 6) as kappa from o""",
    "counting_error": """with e as (select coalesce(tracker_backend, 'none') as backend, (coalesce(f.n, 0) - coalesce(i.n, 0))::double as e from inspection_sessions s left join (select session_id, count(distinct fish_id) as n from frame_grades group by 1) f using (session_id)
        left join (select session_id, count(distinct track_id) as n from fish_inspections group by 1) i using (session_id))
        select coalesce(backend, 'all') as subset, count(*) as n, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(avg(e), 6) as bias, round(avg((e = 0)::int), 6) as exact, round(avg((abs(e) <= 1)::int), 6) as within_one from e group by rollup (backend)""",
    "average_precision": f"with {_RANKED} select predicted, round(sum(p) / 101, 6) as ap from (select predicted, l, max(precision) as p from q join range(0, 101) g(l) on q.level >= g.l group by predicted, l) group by predicted",
    "average_precision_area": f"""with {_RANKED} select predicted, round(sum(step * env), 6) as ap from (select predicted, recall - coalesce(lag(recall) over w, 0) as step, max(precision) over (partition by predicted order by rank rows between current row and unbounded following) as env
        from q window w as (partition by predicted order by rank)) group by predicted""",
    "bootstrap_interval": f"""with {_TRUTH}, c as (select row_number() over (order by session_id) - 1 as idx, hits, n from (select session_id, count(*) filter (truth = predicted) as hits, count(*) as n from t where truth is not null group by 1)), k as (select count(*) as k from c),
        draws as (select id // k as rep, (((id // k) * 48271 + (id % k) * 69621 + ((id * id) % 1000003)) * 16807 % 2147483647) % k as idx from k, range(0, 200 * k) r(id)), per as (select rep, sum(hits) / sum(n) as v from draws join c using (idx) group by rep)
        select round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from per""",
    "paired_f1_interval": f"""with {_TRUTH}, u as (select l.session_id, nullif(l.final_grade, 'Ungraded') as truth, v.grade as a, l.second_grade as b from last l join votes v using (session_id, track_id)), g as (select * from u where truth is not null),
        x as (select session_id, unnest(list_distinct([truth, a, b])) as class, truth, a, b from g),
        per as (select session_id, class, count(*) filter (truth = class) as n, count(*) filter (a = class) as sa, count(*) filter (a = class and truth = class) as ha, count(*) filter (b = class) as sb, count(*) filter (b = class and truth = class) as hb from x where class is not null group by all),
        c as (select *, dense_rank() over (order by session_id) - 1 as idx from per), k as (select count(distinct idx) as k from c),
        draws as (select id // k as rep, (((id // k) * 48271 + (id % k) * 69621 + ((id * id) % 1000003)) * 16807 % 2147483647) % k as idx from k, range(0, 200 * k) r(id)),
        s as (select rep, class, sum(n) as n, sum(sa) as sa, sum(ha) as ha, sum(sb) as sb, sum(hb) as hb from draws join c using (idx) group by all), d as (select rep, avg(2 * hb / (sb + n)) - avg(2 * ha / (sa + n)) as v from s where n > 0 group by rep),
        p as (select avg(2 * ha / (sa + n)) as f, avg(2 * hb / (sb + n)) as s from (select class, sum(n) as n, sum(sa) as sa, sum(ha) as ha, sum(sb) as sb, sum(hb) as hb from c group by class) where n > 0)
        select round(f, 6) as first, round(s, 6) as second, round(s - f, 6) as delta, (select round(quantile_cont(v, 0.025), 6) from d) as low, (select round(quantile_cont(v, 0.975), 6) from d) as high from p""",
    "review_conflicts": f"""select labels > 1 as conflict, least(adj, 2)::bigint as adjudications, count(*) as findings from (select fish_instance_id, finding_id, count(distinct case when {_SQ("presence")} not in ('', 'unknown', 'unassigned', 'none', 'n/a', 'tbd', '?', 'null') then {_SQ("presence")}[1:1] end) as labels,
        count(*) filter ({_SQ("review_status")} = 'adjudicated') as adj from belly_observations group by 1, 2) group by all""",
    "weighted_support": f"""with r as (select session_id, fish_id, case {_G} when 'Class A' then 0 when 'Class B' then 1 when 'Class C' then 2 when 'Rejected' then 3 end as g, round(detection_confidence * 1000)::bigint as c from frame_grades),
        s as (select session_id, fish_id, [{', '.join(f"coalesce(sum(c) filter (g = {i}), 0)::bigint" for i in range(4))}] as v from r group by all), o as (select session_id, fish_id, list_sum(v) as total, list_sort(list_transform(v, lambda x, i: {{'m': -x, 'g': i - 1}})) as o from s)
        select session_id, fish_id, o[1].g::int as best, o[2].g::int as second, round((o[2].m - o[1].m) / total, 6) as margin from o where total > 0""",
}
