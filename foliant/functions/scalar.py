"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_folded(text: Column, query: str) -> Column:
    """Literal containment without regard to case; no wildcards."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def day(millis: Column) -> Column:
    """As in `Jan 2, 2024`, in the session's zone."""
    return F.date_format(F.timestamp_millis(millis), "MMM d, yyyy")


def short_day(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "MMM d")


def stamp(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyyMMdd_HHmmss")


def plural(n: Column, word: str) -> Column:
    """`0 page`, `1 page`, `2 pages`."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))


def format_label(fmt: Column) -> Column:
    return F.when(fmt == "pdf", "PDF").when(fmt == "jpg", "JPG").otherwise("PDF + JPG")


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def round_half_up(v: Column) -> Column:
    """floor(v + 0.5), which differs from round() below zero."""
    return F.floor(v + 0.5).cast("int")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_ratio(text: Column) -> Column:
    """A number with a decimal point or comma, else null."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def keep_ratio_characters(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.,]", "")


def mod_180(angle: Column) -> Column:
    return F.pmod(angle, F.lit(180.0))


def unpack(argb: Column) -> list[Column]:
    """r, g, b of a packed 0xAARRGGBB."""
    return [F.shiftright(argb, s).bitwiseAND(255) for s in (16, 8, 0)]


def pack(r: Column, g: Column, b: Column) -> Column:
    """An opaque 0xFFRRGGBB as an int."""
    return F.lit(-16777216).bitwiseOR(F.shiftleft(r, 16)).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def theme_is_dark(theme: Column, system_dark: Column) -> Column:
    return F.when(theme == "dark", True).when(theme == "light", False).otherwise(system_dark)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: inside a lambda nothing else keeps it from being repeated."""
    return F.element_at(F.transform(F.array(value), then), 1)


def computed(df: DataFrame) -> DataFrame:
    """df, with its columns computed here: filters above are not pushed through, which would repeat long
    expressions in each of them. A generator of one row, inside the same stage."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
