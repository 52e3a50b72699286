"""Deeply nested JSON members of inspections as flat, related tables.

Every inspection's documents are read once by a depth-first visitor that emits
one tagged row per child: the table it belongs to (``tag``), its own key
(``node_id``), its parent's key (``parent_id``) and the child as JSON
(``payload``). The rows are written partitioned by tag; a schema is applied to
a tag's payloads when its table is read, and the payload stays beside it.

No member of a document is left out: a region's payload has every member, also
nested ones, that is not emitted as children of its own, and what belongs to no
child (members beside the regions or scores, regions of unknown names or wrong
types) is the payload of one ``rest`` row per document. Those rows are no
children of problem 5 and not in ``found``.

Defined results: a null, empty or unreadable document has no children, nor has
a member of a wrong type; a document inside a JSON text (also several deep) is
taken out first; of two spellings of one region in one document both are
visited and of children with one key the first holds; null keys are kept as keys; the latest
version of a key is the one with the greatest ``updated_at`` as an instant
(unreadable instants come first, equal ones are settled by the content's hash).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import GRADES, instant

DOCUMENTS = ("part_results_json", "weighted_scores_json", "color_measurements_json")
KEY = ("session_id", "track_id")
CHILD_SCHEMA = (
    "session_id string, track_id bigint, tag string, node_id string, parent_id string, "
    "region string, item string, payload string"
)
#: Schemas of the payloads, by tag.
PAYLOADS = {
    "part": "present boolean, presence_confidence double, grade string, temporal_statistics struct<region_observation_count: bigint, top_grade_statistics: struct<standard_deviation: double>>",
    "evidence": "value double",
    "detection": "source_class_id int, confidence double, bbox array<double>, mask array<array<double>>",
    "score": "value double",
    "color": "status string, mean_hue_deg double, yellow_ratio_proxy double",
    "roi": "frame_id bigint, crop_local_bbox array<double>",
    "rest": "members string",
}

_REGIONS = {"body": "Body", "head": "Head", "tail": "Tail", "whole fish": "Whole Fish"}
_GRADES = {g.lower(): g for g in GRADES} | {"a": "Class A", "b": "Class B", "c": "Class C", "reject": "Rejected"}
_NUMBER = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*")
_BREAKS = re.compile(r"[\s_\-]+")


def _name(key: object, names: dict[str, str]) -> str | None:
    return names.get(_BREAKS.sub(" ", key).strip().lower()) if isinstance(key, str) else None


def _number(value: object) -> float | None:
    """The number in a value that is one, also as text; booleans are none."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value) if abs(value) < 1.8e308 else None
    return float(value) if isinstance(value, str) and _NUMBER.fullmatch(value) else None


def _document(text: object) -> object:
    """The document in a JSON text, or None if it can't be read."""
    try:
        while isinstance(text, str):
            text = json.loads(text, parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return None
    return text


def _unwrapped(document: object, member: str, kinds: type | tuple[type, ...]) -> tuple[object, dict]:
    """The part of a document under ``member``, if it has one of these kinds, and the members beside it."""
    if isinstance(document, dict) and isinstance(document.get(member), kinds):
        return document[member], {k: v for k, v in document.items() if k != member}
    return document, {}


def _by_region(document: object) -> tuple[list[tuple[str, dict]], object]:
    """The objects of regions in any of the three layouts (by region, listed, or under ``regions``), and all else."""
    inner, beside = _unwrapped(document, "regions", (dict, list))
    if isinstance(inner, dict):
        found = [(_name(k, _REGIONS), v, k) for k, v in inner.items()]
    elif isinstance(inner, list):
        found = [(_name(v.get("region"), _REGIONS) if isinstance(v, dict) else None, v, str(i)) for i, v in enumerate(inner)]
    else:
        return [], inner
    left = {k: v for r, v, k in found if not (r and isinstance(v, dict))}
    return [(r, v) for r, v, _ in found if r and isinstance(v, dict)], _joined(beside, "regions", left)


def _joined(beside: dict, member: str, left: dict) -> dict:
    return (beside | ({member: left} if left else {})) if beside else left


def _grades(values: object) -> tuple[list[tuple[str, float]], object]:
    """The numbers of grades, and all else."""
    if not isinstance(values, dict):
        return [], values
    found = [(_name(k, _GRADES), _number(v), k, v) for k, v in values.items()]
    return [(g, n) for g, n, _, _ in found if g and n is not None], {k: v for g, n, k, v in found if not g or n is None}


def _objects(values: object) -> tuple[list[tuple[str, dict]], object]:
    """The objects in an array with their positions (a single object has position 0), and all else by position."""
    if not isinstance(values, list):
        return ([("0", values)], {}) if isinstance(values, dict) else ([], values)
    found = [(str(i), v) for i, v in enumerate(values)]
    return [(i, v) for i, v in found if isinstance(v, dict)], {i: v for i, v in found if not isinstance(v, dict)}


def _payload(region: dict, left: dict[str, object]) -> dict:
    """A region's members; of those with children only what is left of them, if anything."""
    return {k: left.get(k, v) for k, v in region.items() if k not in left or left[k] != {}}


def visit(part_results: object, weighted_scores: object, colors: object) -> Iterator[tuple]:
    """(tag, node, parent, region, item, payload) of every child, depth first; node paths start at ''."""
    parts, rest = _by_region(_document(part_results))
    for region, part in parts:
        node = f"part/{region}"
        evidence, no_evidence = _grades(part.get("grade_evidence"))
        detections, no_detections = _objects(part.get("detections"))
        yield "part", node, "", region, "", _payload(part, {"grade_evidence": no_evidence, "detections": no_detections})
        for grade, number in evidence:
            yield "evidence", f"{node}/evidence/{grade}", node, region, grade, {"value": number}
        for i, detection in detections:
            yield "detection", f"{node}/detection/{i}", node, region, i, detection
    yield from _rest(DOCUMENTS[0], rest)
    inner, beside = _unwrapped(_document(weighted_scores), "scores", dict)
    scores, rest = _grades(inner)
    for grade, number in scores:
        yield "score", f"score/{grade}", "", "", grade, {"value": number}
    yield from _rest(DOCUMENTS[1], _joined(beside, "scores", rest) if isinstance(rest, dict) else rest)
    regions, rest = _by_region(_document(colors))
    for region, color in regions:
        node = f"color/{region}"
        rois, no_rois = _objects(color.get("frame_rois"))
        yield "color", node, "", region, "", _payload(color, {"frame_rois": no_rois})
        for i, roi in rois:
            yield "roi", f"{node}/roi/{i}", node, region, i, roi
    yield from _rest(DOCUMENTS[2], rest)


def _rest(document: str, left: object) -> Iterator[tuple]:
    if left is not None and left != {}:
        yield "rest", f"rest/{document}", "", "", document, {"members": left}


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in CHILD_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for key, session_id, track_id, *documents in batch.itertuples(index=False, name=None):
            seen = set()
            for tag, node, parent, region, item, payload in visit(*documents):
                if node not in seen:
                    seen.add(node)
                    track = None if pd.isna(track_id) else int(track_id)
                    rows.append((session_id, track, tag, f"{key}/{node}", f"{key}/{parent}".rstrip("/"), region, item, json.dumps(payload)))
        out = pd.DataFrame(rows, columns=names)
        out["track_id"] = out["track_id"].astype("Int64")
        yield out


def latest(inspections: DataFrame) -> DataFrame:
    """The last version of each inspection, with its key and documents."""
    version = F.struct(instant(F.col("updated_at")).alias("at"), F.xxhash64(*DOCUMENTS).alias("h"))
    return (
        inspections.select(*KEY, F.struct(*DOCUMENTS).alias("docs"), version.alias("version"))
        .groupBy(*KEY)
        .agg(F.max_by("docs", "version").alias("docs"))
        .select(*KEY, "docs.*")
    )


def children(inspections: DataFrame) -> DataFrame:
    """One row per child of every inspection's last version, and the rest rows, as in CHILD_SCHEMA."""
    key = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in KEY)).alias("key")
    return latest(inspections).select(key, *KEY, *DOCUMENTS).mapInPandas(_emit, CHILD_SCHEMA)


def table(child_rows: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag, typed; a payload member of a wrong type is null."""
    parsed = F.from_json("payload", PAYLOADS[tag]).alias("p")
    return child_rows.where(F.col("tag") == tag).select(*KEY, "node_id", "parent_id", "region", "item", "payload", parsed).select("*", "p.*").drop("p")


def write_tables(child_rows: DataFrame, path: str) -> None:
    """All tables in one pass, partitioned by tag."""
    child_rows.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One table from the folder that write_tables wrote; only that tag's files are read."""
    return table(spark.read.parquet(path), tag)


def found(inspections: DataFrame) -> DataFrame:
    return children(inspections).where(F.col("tag") != "rest").select(*KEY, F.col("tag").alias("child"), "region", "item")
