"""Duplicates, lineage, splits and geometry over exported images and documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import geometry
from tidewright.functions.text import group_name, hash64, sha256_name, split_name, value_or_null
from tidewright.operators import duplicates, graph, matching, proposal, store
from tidewright.plans.dashboard import read
from tidewright.session import cut


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Each record once, with normalised keys."""
    rows = read(spark, d, "source_records").select(
        "record_id", split_name(F.col("source_split")).alias("split"), group_name(F.col("source_group")).alias("grp"), value_or_null(F.col("specimen_id")).alias("specimen"),
        sha256_name(F.col("sha256")).alias("sha"), hash64(F.col("average_hash")).alias("code"),
    )
    return rows.groupBy("record_id").agg(*(F.max(c).alias(c) for c in ("split", "grp", "specimen", "sha", "code")))


def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text: first document, size, and whether they come from different sources."""
    return duplicates.exact_groups(read(spark, d, "documents"), F.sha2("text", 256), "doc_id", F.col("source"))


def near_hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct hashes within 5 bits, each with the number of its records."""
    rows = _records(spark, d).where("code is not null")
    size = rows.groupBy("code").agg(F.count("*").alias("n"))
    pairs = duplicates.near_codes(size, "code", 5)
    return pairs.join(size.withColumnsRenamed({"code": "a", "n": "a_records"}), "a").join(size.withColumnsRenamed({"code": "b", "n": "b_records"}), "b").select("a", "b", "distance", "a_records", "b_records")


def hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its hash, the smallest record of the hash, and how many other hashes lie within 3 bits."""
    rows = _records(spark, d).where("code is not null")
    first = rows.groupBy("code").agg(F.min("record_id").alias("class_id"))
    pairs = duplicates.near_codes(first, "code", 3)
    links = pairs.select(F.explode(F.array("a", "b")).alias("code")).groupBy("code").agg(F.count("*").alias("links"))
    classes = first.join(links, "code", "left").na.fill(0, ["links"])
    return rows.select("record_id", "code").join(classes, "code").select("record_id", "class_id", "links")


def lineage_links(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the first record that shares its digest or specimen."""
    return graph.token_links(_records(spark, d), "record_id", ["sha", "specimen"])


def lineage_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over digests and specimens: smallest record, size, splits."""
    rows = _records(spark, d)
    member = graph.components(graph.token_links(rows, "record_id", ["sha", "specimen"]), "a", "b").withColumnRenamed("vertex", "record_id")
    return member.join(rows, "record_id").groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("split").alias("splits"))


def crossing_values(spark: SparkSession, d: str) -> DataFrame:
    """Groups, specimens and digests that occur in several splits."""
    kinds = {"group": F.col("grp"), "specimen": F.col("specimen"), "sha256": F.col("sha")}
    return duplicates.crossing_values(_records(spark, d), kinds, F.col("split"))


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Digests shared by each pair of splits."""
    per = _records(spark, d).where("sha is not null and split is not null").groupBy("sha").agg(F.collect_set("split").alias("s"))
    pairs = [("test", "train"), ("test", "validation"), ("train", "validation")]
    has = [F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs]
    return per.agg(*has)


def lineage_gate(spark: SparkSession, d: str) -> DataFrame:
    """PASS, FAIL or INCOMPLETE per evaluation split: no digest may also be in train, every record needs one."""
    rows = _records(spark, d)
    train = rows.where("split = 'train' and sha is not null").select("sha").distinct().withColumn("in_train", F.lit(True))
    marked = rows.where("split in ('validation', 'test')").join(train, "sha", "left")
    counts = marked.groupBy("split").agg(F.count("*").alias("records"), F.count_if("in_train").alias("shared"), F.count_if(F.col("sha").isNull()).alias("unhashed"))
    status = F.when(F.col("shared") > 0, "FAIL").when(F.col("unhashed") > 0, "INCOMPLETE").otherwise("PASS")
    return counts.withColumn("status", status)


def confounding_check(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.confounded(read(spark, d, "documents"), F.col("source"), F.col("doc_kind"))


def split_class_counts(spark: SparkSession, d: str) -> DataFrame:
    """Annotations per split and class, and splits' missing classes."""
    rows = read(spark, d, "source_records").dropDuplicates(["record_id"]).select(split_name(F.col("source_split")).alias("split"), F.explode("annotations.class_id").alias("class"))
    return rows.where("split is not null and class is not null").groupBy("split", "class").agg(F.count("*").alias("n"))


def unmatched_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends of pairwise matches that are in no source record, per side."""
    pairs = read(spark, d, "token_members")
    ids = read(spark, d, "source_records").select("record_id").distinct()
    sides = [pairs.select(F.lit(side).alias("side"), F.col(f"{side}_record_id").alias("record_id")) for side in ("left", "right")]
    ends = sides[0].unionByName(sides[1]).where("record_id is not null")
    return store.orphans(ends, ids, ["record_id"]).groupBy("side").agg(F.count("*").alias("rows"), F.countDistinct("record_id").alias("records"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, boxes): per picture its annotations' boxes in array order."""
    rows = read(spark, d, "source_records").dropDuplicates(["record_id"]).where("size(annotations) > 0")
    box = lambda a, i: F.struct(i.alias("id"), a["class_id"].alias("class"), geometry.box_of(a["points"]).alias("box"))
    return rows.select("record_id", F.transform("annotations", box).alias("boxes"))


def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area per class of the polygons, by the shoelace formula."""
    rows = read(spark, d, "source_records").dropDuplicates(["record_id"]).select(F.explode("annotations").alias("a"))
    return rows.groupBy(F.col("a.class_id").alias("class")).agg(F.count("*").alias("n"), F.round(F.avg(geometry.polygon_area(F.col("a.points"))), 6).alias("area"), F.count_if(geometry.is_rectangle(F.col("a.points"))).alias("rectangles"))


def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of annotations of one picture whose boxes overlap by at least 5 % of their union."""
    rows = _boxes(spark, d)
    pairs = F.flatten(F.transform("boxes", lambda a: F.transform(F.filter("boxes", lambda b: b["id"] > a["id"]), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b"), F.round(geometry.iou(a["box"], b["box"]), 6).alias("iou")))))
    return rows.select("record_id", F.explode(pairs).alias("p")).select("record_id", "p.*").where("iou >= 0.05")


def part_owners(spark: SparkSession, d: str) -> DataFrame:
    """Each picture's boxes of classes over 5 with the best of its other boxes as owner."""
    rows = _boxes(spark, d).select("record_id", F.filter("boxes", lambda b: b["class"] > 5).alias("parts"), F.filter("boxes", lambda b: b["class"] <= 5).alias("parents"))
    out = matching.owners(rows, "parts", "parents", 0.1, 0.05)
    return out.select("record_id", "part", F.when(F.col("status") != "UNASSIGNED", F.col("parent")).alias("owner"), F.round("score", 6).alias("score"), "status")


def _array(boxes) -> np.ndarray:
    return np.array([[b["box"]["x0"], b["box"]["y0"], b["box"]["x1"], b["box"]["y1"]] for b in boxes], float).reshape(-1, 4)


def suppressed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes left per picture by greedy suppression, larger boxes first."""

    def kernel(row):
        boxes = _array(row.boxes)
        size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        yield row.record_id, len(boxes), len(matching.suppress(boxes, size, 0.05))

    return matching.in_pictures(_boxes(spark, d), kernel, "record_id bigint, boxes int, kept int")


def matched_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of even and odd position matched one to one: greedily and with the greatest total overlap."""

    def kernel(row):
        boxes = _array(row.boxes)
        a, b = boxes[::2], boxes[1::2]
        score = matching.iou_matrix(a, b)
        greedy = matching.greedy_match(b, a, -np.arange(len(a), dtype=float), 0.01)
        best = matching.optimal_match(score, 0.01)
        total = float(sum(score[i, j] for i, j in enumerate(best) if j >= 0))
        yield row.record_id, sum(j >= 0 for j in greedy), sum(j >= 0 for j in best), round(total, 6)

    return matching.in_pictures(_boxes(spark, d), kernel, "record_id bigint, greedy int, optimal int, overlap double")


def _units(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, unit): records that share a source group, specimen or digest, also through others, are one unit; a record without any of them is one of its own."""
    rows = cut(_records(spark, d))
    member = graph.components(graph.token_links(rows, "record_id", ["grp", "specimen", "sha"]), "a", "b").withColumnsRenamed({"vertex": "record_id", "component": "unit"})
    return rows.select("record_id").join(member, "record_id", "left").withColumn("unit", F.coalesce("unit", "record_id"))


_RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}


def proposed_splits(spark: SparkSession, d: str) -> DataFrame:
    """Units of related records filled into splits in the order of a hash: units (groups) and records per split; the records add up to the table."""
    out = proposal.propose(_units(spark, d), "unit", _RATIOS)
    return out.groupBy("split").agg(F.count("*").alias("groups"), F.sum("rows").alias("records"))


def proposed_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its unit and the split proposed for it."""
    units = cut(_units(spark, d))
    return units.join(proposal.propose(units, "unit", _RATIOS).select("unit", "split"), "unit").select("record_id", "unit", "split")


def split_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the delivered splits: values that cross them, classes of annotations that one lacks, and records without one."""
    classes = read(spark, d, "source_records").select("record_id", F.explode("annotations.class_id").alias("label")).where("label is not null").distinct()
    rows = _records(spark, d).join(classes, "record_id", "left")
    domain = [r[0] for r in classes.select("label").distinct().orderBy("label").limit(1000).collect()]  # classes are a closed domain
    return proposal.problems(rows, "split", ["grp", "specimen", "sha"], "label", domain).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        proposed_splits, proposed_records, split_problems, exact_duplicate_groups, near_hash_pairs, hash_classes, lineage_links, lineage_components, crossing_values, split_overlap, lineage_gate, confounding_check, split_class_counts, unmatched_ends,
        polygon_areas, overlapping_boxes, part_owners, suppressed_boxes, matched_boxes,
    )
}

_NO = "('', 'unknown', 'unassigned', 'none', 'n/a', 'tbd', '?', 'null')"
_SQ = lambda c: f"lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_VAL = lambda c: f"(case when {_SQ(c)} not in {_NO} then {_SQ(c)} end)"
_SPLIT = f"""(case when {_SQ("source_split")} in ('train', 'training', 'development') then 'train' when {_SQ("source_split")} in ('val', 'valid', 'validation', 'validating') then 'validation'
  when {_SQ("source_split")} in ('test', 'testing') or contains({_SQ("source_split")}, 'locked') then 'test' end)"""
_GRP0 = f"regexp_replace(replace({_VAL('source_group')}, chr(92), '/'), '\\.(jpe?g|png|bmp|tiff?|webp|gif)$', '')"
_SHA0 = f"regexp_replace({_VAL('sha256')}, '^sha-?256[:\\s]*', '')"
_RECORDS = f"""records as (select record_id, max({_SPLIT}) as split, max(case when {_GRP0} not in {_NO} then {_GRP0} end) as grp, max({_VAL("specimen_id")}) as specimen,
  max(case when regexp_full_match({_SHA0}, '[0-9a-f]{{64}}') then {_SHA0} end) as sha, max(('0x' || trim(average_hash))::ubigint) as code from source_records group by record_id)"""
_SIGNED = lambda c: f"(case when {c} >= 9223372036854775808 then ({c}::hugeint - 18446744073709551616)::bigint else {c}::bigint end)"
_BOX = """boxes as (select record_id, (i - 1)::int as id, a.class_id as class, list_min(list_filter(a.points, lambda v, k: k % 2 = 1)) as x0, list_min(list_filter(a.points, lambda v, k: k % 2 = 0)) as y0,
  list_max(list_filter(a.points, lambda v, k: k % 2 = 1)) as x1, list_max(list_filter(a.points, lambda v, k: k % 2 = 0)) as y1 from (select record_id, unnest(annotations) as a, unnest(range(1, len(annotations) + 1)) as i from (select distinct on (record_id) * from source_records)))"""
_LINKS = f"""{_RECORDS}, tokens as (select record_id, 0 as kind, sha as v from records where sha is not null union all select record_id, 1, specimen from records where specimen is not null),
  first as (select kind, v, min(record_id) as f from tokens group by all), links as (select distinct record_id as a, f as b from tokens join first using (kind, v) where record_id <> f)"""

ORACLES = {
    "split_problems": f"""with {_RECORDS}, x as (select 'grp' as k, grp as v, split from records union all select 'specimen', specimen, split from records union all select 'sha', sha, split from records),
        c as (select k, v from x where v is not null and split is not null group by all having count(distinct split) > 1)
        , l as (select distinct record_id, unnest(annotations).class_id as class from source_records), has as (select distinct split, class from l join records using (record_id) where split is not null and class is not null)
        select 'crosses:' || k as kind, count(*) as n from c group by k union all select 'without_split', 1 from records where split is null having count(*) > 0
        union all select 'lacks', count(*) from (select s.split, k.class from (select distinct split from records where split is not null) s, (select distinct class from l where class is not null) k except select split, class from has) having count(*) > 0""",
    "exact_duplicate_groups": "select sha256(text) as key, min(doc_id) as canonical, count(*) as size, min(source) <> max(source) as mixed_labels from documents where text is not null group by text having count(*) > 1",
    "near_hash_pairs": f"""with {_RECORDS}, s as (select {_SIGNED("code")} as code, any_value(code) as u, count(*) as n from records group by 1)
        select x.code as a, y.code as b, bit_count(xor(x.u, y.u))::int as distance, x.n as a_records, y.n as b_records from s x, s y where x.code < y.code and bit_count(xor(x.u, y.u)) <= 5""",
    "hash_classes": f"""with {_RECORDS}, s as (select code, min(record_id) as class_id from records group by code), l as (select x.code, count(*) as links from s x, s y where x.code <> y.code and bit_count(xor(x.code, y.code)) <= 3 group by x.code)
        select record_id, class_id, coalesce(links, 0) as links from records join s using (code) left join l using (code)""",
    "lineage_links": f"with {_LINKS} select a, b from links",
    "lineage_components": f"""with recursive {_LINKS}, both_ways as (select a, b from links union select b, a from links), reached(v, c) as (select distinct a, a from both_ways union select e.b, r.c from reached r join both_ways e on e.a = r.v where r.c < e.b),
        l as (select v, min(c) as c from reached group by v) select c as component, count(*) as size, count(distinct split) as splits from l join records on v = record_id group by c""",
    "crossing_values": f"""with {_RECORDS}, x as (select split, 'group' as kind, grp as value from records union select split, 'specimen', specimen from records union select split, 'sha256', sha from records)
        select kind, value, count(*) as n_parts from x where split is not null and value is not null group by all having count(*) > 1""",
    "split_overlap": f"""with {_RECORDS}, p as (select sha, list(distinct split) as s from records where sha is not null and split is not null group by sha) select count(*) filter (list_has_all(s, ['test', 'train'])) as test_train,
        count(*) filter (list_has_all(s, ['test', 'validation'])) as test_validation, count(*) filter (list_has_all(s, ['train', 'validation'])) as train_validation from p""",
    "lineage_gate": f"""with {_RECORDS}, c as (select split, count(*) as records, count(*) filter (sha in (select sha from records where split = 'train' and sha is not null)) as shared, count(*) filter (sha is null) as unhashed from records where split in ('validation', 'test') group by split)
        select *, case when shared > 0 then 'FAIL' when unhashed > 0 then 'INCOMPLETE' else 'PASS' end as status from c""",
    "confounding_check": "select count(*) as groups, count(*) filter (n = 1) as pure_groups, count(*) > 1 and count(*) filter (n = 1) = count(*) as confounded from (select source, count(distinct doc_kind) as n from documents where source is not null and doc_kind is not null group by source)",
    "split_class_counts": f"select split, class, count(*) as n from (select {_SPLIT} as split, unnest(annotations).class_id as class from (select distinct on (record_id) * from source_records)) where split is not null and class is not null group by all",
    "unmatched_ends": """select side, count(*) as rows, count(distinct r) as records from (select 'left' as side, left_record_id as r from token_members union all select 'right', right_record_id from token_members)
        where r is not null and r not in (select record_id from source_records where record_id is not null) group by side""",
    "polygon_areas": """with a as (select unnest(annotations) as a from (select distinct on (record_id) * from source_records)), p as (select a.class_id as class, a.points as p, list_distinct(list_filter(a.points, lambda v, k: k % 2 = 1)) as xs, list_distinct(list_filter(a.points, lambda v, k: k % 2 = 0)) as ys from a)
        select class, count(*) as n, round(avg(abs(list_sum(list_transform(range(0, len(p) // 2), lambda i: p[2 * i + 1] * p[(2 * i + 3) % len(p) + 1] - p[(2 * i + 2) % len(p) + 1] * p[2 * i + 2]))) / 2), 6) as area,
        count(*) filter (len(p) = 8 and len(xs) = 2 and len(ys) = 2) as rectangles from p group by class""",
    "overlapping_boxes": f"""with {_BOX}, o as (select a.record_id, a.id as a, b.id as b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as i, (a.x1 - a.x0) * (a.y1 - a.y0) as sa, (b.x1 - b.x0) * (b.y1 - b.y0) as sb
        from boxes a join boxes b on a.record_id = b.record_id and a.id < b.id) select record_id, a, b, round(i / (sa + sb - i), 6) as iou from o where round(i / (sa + sb - i), 6) >= 0.05""",
}
