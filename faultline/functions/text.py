"""Text columns: label parsing, ids, notes, metadata lines and the flat export fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capture_date(exif_text: Column) -> Column:
    """`YYYY:MM:DD hh:mm:ss` to `YYYY-MM-DD`; null when the first word is not ten characters long."""
    day = F.replace(F.split_part(exif_text, F.lit(" "), F.lit(1)), F.lit(":"), F.lit("-"))
    return F.when(F.length(day) == 10, day)


def parse_fractions(text: Column) -> Column:
    """`a=0.1;b=0.2` to a map of doubles, dropping empty parts. A name given twice keeps its last value."""
    pairs = F.transform(F.filter(F.split(text, ";"), lambda part: part != ""), lambda part: F.split(part, "="))
    names = F.transform(pairs, lambda pair: pair[0])
    values = F.transform(pairs, lambda pair: F.get(pair, F.lit(1)).try_cast("double"))
    distinct = F.array_distinct(names)
    last = F.transform(
        distinct, lambda name: F.element_at(values, (F.size(names) + 1 - F.array_position(F.reverse(names), name)).cast("int"))
    )
    return F.map_from_arrays(distinct, last)


def parse_names(text: Column) -> Column:
    """`a;b;c` to a sorted array of distinct names, dropping empty parts."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, ";"), lambda name: name != "")))


def numbered_id(prefix: Column | str, number: Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("_"), F.lpad(number.cast("string"), F.greatest(F.lit(5), F.length(number.cast("string"))), F.lit("0")))


def file_stem(path: Column) -> Column:
    """File name without its folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(.)\.[^.]*$", "$1")


def metadata_lines(asset_class: Column, gsd: Column, irradiance: Column, captured_on: Column, width: Column,
                   height: Column) -> Column:
    """The metadata block a grader receives, one `key: value` line each; missing values say so."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("unknown")))

    return F.concat_ws(
        "\n",
        line("asset_class", asset_class),
        line("gsd_mm_per_px", gsd),
        line("irradiance_wm2", irradiance),
        line("captured_on", captured_on),
        line("image_size", F.concat(width.cast("string"), F.lit("x"), height.cast("string"))),
    )


def exemplar_note(classes_present: Column, source_class: Column) -> Column:
    visible = F.when(F.size(classes_present) > 0, F.concat(F.lit("visible: "), F.array_join(classes_present, ", ")))
    named = F.when(source_class != "", F.concat(F.lit("dataset class: "), source_class))
    return F.concat_ws("; ", visible, named)


def truth_label(labels: Column) -> Column:
    return F.coalesce(F.nullif(labels["grade_native"], F.lit("")), labels["source_class"])


def element_of(defect_type: Column) -> Column:
    """The bridge element named in the last bracket of a defect description, else blank."""
    tail = F.substring_index(defect_type, " (", -1)
    return F.when(F.instr(defect_type, " (") > 0, F.regexp_replace(tail, r"\)+$", "")).otherwise(F.lit(""))
