"""Columns read out of file and folder names. A name that doesn't match gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import SEASON_OF_MONTH, SEASONS


def _found(name: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def _day(token: Column) -> Column:
    return F.when(token.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(token, F.lit("yyyyMMdd"))))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def orbit(name: Column) -> Column:
    """Digits after the last underscore of a tif."""
    return _found(name, r"(?i)_(\d+)\.(tif|tiff)$")


def second_token(name: Column) -> Column:
    return F.try_element_at(F.split(stem(name), "_"), F.lit(2))


def month(name: Column) -> Column:
    """Of the second token if that is a date; else of the first eight digits anywhere, whose day may be impossible."""
    loose = _found(name, r"\d{4}(\d{2})\d{2}").cast("int")
    return F.coalesce(F.month(_day(second_token(name))), F.when(loose.between(1, 12), loose))


def strict_date(name: Column) -> Column:
    """The second token as a date."""
    return _day(second_token(name))


def date_token(name: Column) -> Column:
    """The first token of eight digits, between underscores or hyphens, be it a date or not."""
    return F.try_element_at(F.filter(F.split(stem(name), r"[_\-]"), lambda t: t.rlike(r"^\d{8}$")), F.lit(1))


def first_date(name: Column) -> Column:
    """The first token that is a date."""
    return F.try_element_at(F.filter(F.transform(F.split(stem(name), r"[_\-]"), _day), lambda d: d.isNotNull()), F.lit(1))


def date_id(name: Column) -> Column:
    """Key of a mosaic: digits after Fx or event, else eight digits, else six. The first pattern that matches wins,
    so Fx_20230101 gives 20230."""
    patterns = (r"(?i)Fx[_-]?(\d{5})", r"(?i)event[_-]?(\d+)", r"(\d{8})", r"(\d{6})")
    return F.coalesce(*(_found(name, p) for p in patterns))


def folder_month(name: Column) -> Column:
    m = _found(name, r"(?i)month[_-]?(\d{1,2})").cast("int")
    return F.when(m.between(1, 12), m)


def season_of(month: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in SEASON_OF_MONTH.items() for x in kv)), month.cast("int"))


def season_place(season: Column) -> Column:
    """1 for the first season; NULL for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEASONS)), season), F.lit(0))


def grid_prefix(folder: Column) -> Column:
    return _found(folder, r"^(.+_)\d{2,}$")


def grid_number(folder: Column) -> Column:
    return _found(folder, r"_(\d{2})(?:_|$)").cast("int")


def masked_name(name: Column) -> Column:
    return F.replace(name, F.lit("event_Fx_"), F.lit("event_Fx_Masked_"))


def grid_label(number: Column) -> Column:
    return F.concat(F.lit("grid_"), F.lpad(number.cast("string"), 2, "0"))


def month_label(number: Column) -> Column:
    return F.concat(F.lit("month_"), F.lpad(number.cast("string"), 2, "0"))
