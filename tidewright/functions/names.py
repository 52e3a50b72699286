"""Names, cells of counts, and canonical texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin_name(path: Column) -> Column:
    """The picture an export was made of: base name without the export's hash, the ending and its repetition."""
    base = F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))
    for pattern in (r"\.(jpe?g|png|bmp)$", r"\.rf\.[0-9a-f]+$", r"\.(jpe?g|png|bmp)$", r"_(jpe?g|png|bmp)$"):
        base = F.regexp_replace(base, pattern, "")
    return base


def counts_of(cell: Column) -> Column:
    """'class:count|class:count' as a map; counts of a repeated class add up, unreadable parts are left out."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda p: F.split(p, ":"))
    pairs = F.filter(F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("int").alias("k"), F.get(p, F.lit(1)).try_cast("bigint").alias("v"))), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["k"])))
    total = lambda k: F.aggregate(F.filter(pairs, lambda x: x["k"] == k), F.lit(0).cast("bigint"), lambda a, x: a + x["v"])
    return F.map_from_arrays(keys, F.transform(keys, total))


def cell_of(counts: Column) -> Column:
    """A map of counts as 'class:count|class:count', classes in order."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), "|")


def canonical_map(m: Column) -> Column:
    """A map of texts as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def group_label(ids: Column) -> Column:
    """A stable label for a set of identifiers, whatever their order."""
    return F.concat(F.lit("lg_"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 16))


def tiles(width: Column, height: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` over a picture with an overlap; the last ones end at the border."""
    step = size - overlap

    def starts(n: Column) -> Column:
        last = F.greatest(n - size, F.lit(0))
        return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))

    box = lambda x, y: F.struct(x.alias("x0"), y.alias("y0"), F.least(x + size, width).alias("x1"), F.least(y + size, height).alias("y1"))
    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: box(x, y))))


def status_token(c: Column) -> Column:
    """Letters, digits and underscores of a text, in lower case; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]", "")


def source_name(noted: Column, path: Column) -> Column:
    """The picture's name before augmentation: the noted one, else the file's without ending and the export's hash."""
    base = F.substring_index(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    stem = F.regexp_replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), r"\.rf\.[0-9A-Za-z]+$", "")
    return F.coalesce(F.nullif(F.trim(noted), F.lit("")), stem)


def first_folder(path: Column) -> Column:
    """The first part of a relative path of several parts, else ''."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.size(parts) > 1, parts[0]).otherwise("")


def markdown_cell(c: Column) -> Column:
    """A text that is safe inside a cell of a Markdown table."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def file_token(c: Column) -> Column:
    """A text as part of a file name: what is no letter, digit, dash or underscore becomes one; 'unknown' for null."""
    return F.regexp_replace(F.coalesce(c, F.lit("unknown")), r"[^\p{L}\p{N}\-_]", "_")
