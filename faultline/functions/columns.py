"""Small column helpers shared by the other function modules. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """A fixed lookup table as a map literal: no join, null for an unknown key."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def ordinal(key: Column, scale: list[str]) -> Column:
    """Position of `key` on a scale listed lowest first; null when it is not on the scale."""
    return lookup(key, {name: position for position, name in enumerate(scale)})


def first_or_blank(items: Column) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, null for a zero denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent_text(value: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", value * F.lit(100.0)), F.lit("n/a"))


def key_counts(keys: Column, counts: Column) -> Column:
    """Aggregate already-counted keys into text like `a=1;b=2`, in key order."""
    entries = F.array_sort(F.collect_list(F.struct(keys.alias("key"), counts.alias("n"))))
    return F.concat_ws(";", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["n"].cast("string"))))
