"""Names as column expressions: stems, class keys with instance numbers, natural order, metric keys, image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, in lower case; empty for names without one or that only begin with it."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def base_class(key: Column) -> Column:
    """A class key without its instance number: "Black#0" is Black; "C#Sharp" and "#0" are themselves."""
    return F.regexp_replace(key, r"(?<=.)#[0-9]+$", "")


def base_item(key: Column) -> Column:
    """A configured item's name up to its first #."""
    return F.substring_index(key, "#", 1)


def natural_key(name: Column, width: int = 20) -> Column:
    """Sorts names with runs of digits as numbers: the runs are padded with zeros, equal ones keep the shorter first."""
    runs = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    padded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), width, "0")).otherwise(r))
    return F.struct(F.array_join(padded, ""), F.length(name))


def metric_key(key: Column) -> Column:
    return F.regexp_replace(F.trim(key), r"[^a-zA-Z0-9_\-. /]", "_")


def metric_value(text: Column) -> Column:
    """A metric's number: digits with at most one dot, after any minus signs; null for other text."""
    bare = F.regexp_replace(text, r"^-+", "")
    return F.when(bare.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double"))


def centre(given: Column, low: Column, high: Column) -> Column:
    return F.coalesce(given, (low + high) / 2)
