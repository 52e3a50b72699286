"""SQL for DuckDB with the same results as the queries that SQL can express on whole tables."""

from __future__ import annotations

_NO = "('', 'unknown', 'unassigned', 'none', 'n/a', 'tbd', '?', 'null')"


def _squeezed(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def _value(c: str) -> str:
    return f"case when {_squeezed(c)} not in {_NO} then {_squeezed(c)} end"


def _split(c: str) -> str:
    v = f"({_value(c)})"
    return f"case when {v} in ('train', 'training', 'development') then 'train' when {v} in ('val', 'valid', 'validation', 'validating') then 'validation' when {v} in ('test', 'testing') or contains({v}, 'locked') then 'test' end"


_GRADE = f"""case regexp_replace(regexp_replace({_squeezed("provisional_grade")}, '[\\s_\\-]+', '', 'g'), '^(class|grade)', '')
  when 'a' then 4 when 'b' then 3 when 'c' then 2 when 'rejected' then 1 when 'reject' then 1 else 0 end"""

_LABELLED = """select *, sum(case when g > 0 and before_g = g and frame - before_frame <= 30 then 0 else 1 end) over (partition by session_id, fish_id order by frame) as part
from (select *, lag(frame) over w as before_frame, lag(g) over w as before_g from frames window w as (partition by session_id, fish_id order by frame))"""

_FRAMES = f"""with received as (select session_id, fish_id, frame, {_GRADE} as g, received_at, observed_at from frame_grades
  where session_id is not null and fish_id is not null and frame is not null),
frames as (select session_id, fish_id, frame, arg_max(g, (coalesce(received_at, timestamp '1000-01-01'), g)) as g, min(observed_at) as seen from received group by all),
labelled as ({_LABELLED})"""

# Labels spread from pass to pass: components by repeated minima over neighbours.
_COMPONENTS = """reached(v, c) as (select v, v from nodes union select e.b, r.c from reached r join both_ways e on e.a = r.v where r.c < e.b),
labels as (select v, min(c) as c from reached group by v)"""

_PAIRS = f"""with recursive ids as (select distinct record_id from source_records),
rows_ as (select least(left_record_id, right_record_id) as a, greatest(left_record_id, right_record_id) as b, recorded_at, pair_id,
    regexp_replace({_squeezed("verdict")}, '[\\s_\\-]+', '_', 'g') as verdict
  from token_members where left_record_id <> right_record_id and ({_value("regexp_replace(token, '^[^:]*:', '')")}) is not null),
last as (select a, b from rows_ group by a, b having arg_max(verdict, (coalesce(recorded_at, timestamp '1000-01-01'), pair_id)) = 'match'),
linked as (select a, b from last semi join ids i on a = i.record_id semi join ids j on b = j.record_id),
both_ways as (select a, b from linked union select b, a from linked),
nodes as (select distinct a as v from both_ways), {_COMPONENTS}"""

_GROUP = f"(case when regexp_replace(replace({_value('source_group')}, chr(92), '/'), '\\.(jpe?g|png|bmp|tiff?|webp|gif)$', '') not in {_NO} then regexp_replace(replace({_value('source_group')}, chr(92), '/'), '\\.(jpe?g|png|bmp|tiff?|webp|gif)$', '') end)"

_SETS = f"""with recursive records as (select record_id, max({_GROUP}) as grp, max({_value("specimen_id")}) as specimen, max({_split("source_split")}) as split from source_records where record_id is not null group by 1),
keyed as (select record_id, 'g' || grp as k from records where grp is not null union select record_id, 's' || specimen from records where specimen is not null),
first as (select k, min(record_id) as f from keyed group by k),
links as (select distinct record_id as a, f as b from keyed join first using (k) where record_id <> f),
both_ways as (select a, b from links union select b, a from links),
nodes as (select distinct a as v from both_ways), {_COMPONENTS},
members as (select r.record_id, r.split, coalesce(l.c, r.record_id) as group_id from records r left join labels l on l.v = r.record_id)"""

_SHA = f"case when regexp_full_match(regexp_replace({_value('sha256')}, '^sha-?256[:\\s]*', ''), '[0-9a-f]{{64}}') then regexp_replace({_value('sha256')}, '^sha-?256[:\\s]*', '') end"

# every pair of codes is compared here, and every pair of boxes of near records
_PHOTOS = f"""with photos as (select distinct on (record_id) record_id, {_split("source_split")} as split, {_SHA} as sha, {_GROUP} as grp,
    case when regexp_full_match(trim(average_hash), '[0-9a-fA-F]{{16}}') then ('0x' || trim(average_hash))::ubigint end as code, annotations, width, height from source_records where record_id is not null),
known as (select * from photos where split is not null),
boxes as (select record_id, code, split, row_number() over () as box, count(*) over (partition by record_id) as n, a.class_id as class,
    list_min(list_filter(a.points, lambda v, i: i % 2 = 1)) / width as x0, list_min(list_filter(a.points, lambda v, i: i % 2 = 0)) / height as y0,
    list_max(list_filter(a.points, lambda v, i: i % 2 = 1)) / width as x1, list_max(list_filter(a.points, lambda v, i: i % 2 = 0)) / height as y1
  from (select *, unnest(annotations) as a from known) where len(a.points) >= 2),
near as (select t.record_id as t, e.record_id as e from known t, known e where t.split = 'train' and e.split <> 'train' and bit_count(xor(t.code, e.code)) <= 7),
agree as (select near.t, near.e, least(count(distinct b.box), count(distinct c.box)) as m, min(least(b.n, c.n)) as n
  from near join boxes b on b.record_id = near.t join boxes c on c.record_id = near.e and c.class = b.class
   and abs(b.x0 - c.x0) <= 0.0075 and abs(b.y0 - c.y0) <= 0.0075 and abs(b.x1 - c.x1) <= 0.0075 and abs(b.y1 - c.y1) <= 0.0075 group by all),
found as (select t, e from agree where m >= 0.6 * n
  union select t.record_id, e.record_id from known t join known e using (sha) where t.split = 'train' and e.split <> 'train'
  union select t.record_id, e.record_id from known t join known e using (code) where t.split = 'train' and e.split <> 'train'
    and (coalesce(len(t.annotations), 0) = 0 or coalesce(len(e.annotations), 0) = 0) and bit_count(xor(code, code >> 1) & 9223372036854775807::ubigint) >= 14)"""

ORACLES: dict[str, str] = {
    "p6_by_split_and_group": f"""{_PHOTOS}, told as (select f.t, f.e, k.split, coalesce(k.grp, '') as source_group, b.t is not null as bytes from found f join known k on k.record_id = f.e
  left join (select t.record_id as t, e.record_id as e from known t join known e using (sha) where t.split = 'train' and e.split <> 'train') b on b.t = f.t and b.e = f.e)
select split, source_group, count(*) as pairs, count(*) filter (bytes) as same_bytes, count(distinct e) as records from told group by all""",
    "p7_round_trip": "select doc_id, true as same from documents",
    "p6_found": f"{_PHOTOS} select least(t, e) as record_id_a, greatest(t, e) as record_id_b from found",
    "p2_found": f"{_PAIRS} select v as record_id, c as group_id from labels",
    "p3_found": f"{_SETS} select record_id, group_id from members where group_id in (select group_id from members group by 1 having count(distinct split) >= 2)",
    "p4_found": f"{_FRAMES} select session_id, fish_id, min(frame) as start_frame, max(frame) as end_frame from labelled where g > 0 group by session_id, fish_id, part having count(*) >= 2",
    "p4_runs": f"""{_FRAMES} select session_id, fish_id, case max(g) when 4 then 'Class A' when 3 then 'Class B' when 2 then 'Class C' else 'Rejected' end as grade,
  min(frame) as start_frame, max(frame) as end_frame, count(*)::bigint as n_frames, 0::bigint as foreign_frames,
  case when arg_min(seen, frame) is not null and arg_max(seen, frame) is not null then (epoch_us(arg_max(seen, frame)) - epoch_us(arg_min(seen, frame))) / 1e6 end as duration_s
from labelled where g > 0 group by session_id, fish_id, part""",
}
