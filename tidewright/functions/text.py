"""Normalisation of dirty text columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for no value, in any letter case, and spellings of splits.
NO_VALUE = ("", "unknown", "unassigned", "none", "n/a", "tbd", "?", "null")
SPLIT_SPELLINGS = {
    "train": ("train", "training", "development"),
    "validation": ("val", "valid", "validation", "validating"),
    "test": ("test", "testing"),
}
GRADES = ("Class A", "Class B", "Class C", "Rejected")


def squeezed(c: Column) -> Column:
    """Without outer white space of any kind, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def value_or_null(c: Column) -> Column:
    """``c`` squeezed, or null where the text only says that there is no value."""
    s = squeezed(c)
    return F.when(~s.isin(*NO_VALUE), s)


def split_name(c: Column) -> Column:
    """train, validation, test, or null for a text that names no split."""
    s = value_or_null(c)
    out = F.when(s.isin(*SPLIT_SPELLINGS["train"]), "train")
    out = out.when(s.isin(*SPLIT_SPELLINGS["validation"]), "validation")
    return out.when(s.isin(*SPLIT_SPELLINGS["test"]) | s.contains("locked"), "test")


def grade_name(c: Column) -> Column:
    """One of GRADES, or null for no value and for ungraded."""
    core = F.regexp_replace(F.regexp_replace(squeezed(c), r"[\s_\-]+", ""), r"^(class|grade)", "")
    return (
        F.when(core == "a", GRADES[0])
        .when(core == "b", GRADES[1])
        .when(core == "c", GRADES[2])
        .when(core.isin("rejected", "reject"), GRADES[3])
    )


def group_name(c: Column) -> Column:
    """A source group without the differences that make no other group:
    letter case, outer blanks, direction of slashes, an image-file ending."""
    s = F.regexp_replace(value_or_null(c), r"\\", "/")
    s = F.regexp_replace(s, r"\.(jpe?g|png|bmp|tiff?|webp|gif)$", "")
    return value_or_null(s)


def sha256_name(c: Column) -> Column:
    """64 lower-case hex digits, or null where the text is no such digest."""
    s = F.regexp_replace(value_or_null(c), r"^sha-?256[:\s]*", "")
    return F.when(s.rlike("^[0-9a-f]{64}$"), s)


def hash64(c: Column) -> Column:
    """A text of 16 hex digits as a signed 64-bit number, else null."""
    s = squeezed(c)
    return F.when(s.rlike("^[0-9a-f]{16}$"), F.conv(s, 16, -10).cast("long"))


def instant(c: Column) -> Column:
    """An ISO-8601 text as an instant; a text without an offset is taken as UTC."""
    s = F.trim(c)
    zoned = F.when(s.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & s.contains(":"), s).otherwise(F.concat(s, F.lit("Z")))
    return zoned.try_cast("timestamp")


# Spellings of the classes in feature tables, by letter, name or number.
CLASS_SPELLINGS = {"Class A": ("a", "class a", "0"), "Class B": ("b", "class b", "1"), "Class C": ("c", "class c", "2"), "Rejected": ("rejected", "reject", "3")}


def class_name(c: Column) -> Column:
    """One of GRADES by its spelling in feature tables, else null."""
    s = F.translate(squeezed(c), "_-", "  ")
    return F.coalesce(*(F.when(s.isin(*spellings), name) for name, spellings in CLASS_SPELLINGS.items()))


def has_zone(c: Column) -> Column:
    """Whether an ISO-8601 text names its offset; a time without one is no instant."""
    return F.coalesce(F.trim(c).rlike(r"(?i)\d[T ]\d.*(z|[+-]\d{2}:?\d{2})$"), F.lit(False))
