"""Parsing of feed values: dates, notices, circles, model replies; and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import places

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def approximate_date(text: Column) -> Column:
    """`March 2025` is its first day and `2014` the first of the year; anything else is null."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]+)\s+\d{4}\s*$", 1))).cast("int")
    year = F.regexp_extract(text, r"(\d{4})\s*$", 1)
    return F.when((month > 0) & (year != ""), F.make_date(year.try_cast("int"), month, F.lit(1))).when(text.rlike(r"^\s*\d{4}\s*$"), F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)))


def notice_time(text: Column) -> Column:
    """Times of aviation notices, 10 digits yymmddhhmm; PERM and anything else is null."""
    return F.when(text.rlike(r"^\d{10}"), F.try_to_timestamp(F.concat(F.lit("20"), F.substring(text, 1, 10)), F.lit("yyyyMMddHHmm")))


Q_LINE = r"Q\)\s*([A-Z]{4})/Q([A-Z]{4})/[A-Z]*/[A-Z]*/[A-Z]*/(\d{3})/(\d{3})/(\d{2})(\d{2})([NS])(\d{3})(\d{2})([EW])(\d{3})"


def q_line(text: Column) -> Column:
    """struct<region, code, lower_ft, upper_ft, latitude, longitude, radius_nm> of a Q line; null if there is none."""
    g = lambda i: F.regexp_extract(text, Q_LINE, i)
    n = lambda i: g(i).try_cast("double")
    lat = (n(5) + n(6) / 60) * F.when(g(7) == "S", -1).otherwise(1)
    lon = (n(8) + n(9) / 60) * F.when(g(10) == "W", -1).otherwise(1)
    return F.when(text.rlike(Q_LINE), F.struct(g(1).alias("region"), g(2).alias("code"), (n(3) * 100).alias("lower_ft"), (n(4) * 100).alias("upper_ft"), lat.alias("latitude"), lon.alias("longitude"), n(11).alias("radius_nm")))


def circle(latitude: Column, longitude: Column, radius_nm: Column, points: int = 32) -> Column:
    """A closed ring of [longitude, latitude] around a point."""
    degrees = radius_nm / 60

    def at(i: Column) -> Column:
        angle = i * (2 * 3.141592653589793 / points)
        return F.array(F.round(longitude + degrees * F.cos(angle) / F.cos(F.radians(latitude)), 6), F.round(latitude + degrees * F.sin(angle), 6))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), at)


def change_pct(value: Column, previous: Column) -> Column:
    return places(F.when((previous != 0) & value.isNotNull(), (value - previous) / previous * 100), 4)


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def nice_max(x: Column) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    f = x / base
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0) * base)


def json_reply(text: Column, schema: str) -> Column:
    """Items of a model's reply: fences around the JSON are taken off; what isn't JSON gives null."""
    return F.from_json(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""), schema)


def json_items(text: Column, schema: str) -> Column:
    """The items of a reply that is one object or an array of them; those that aren't objects are left out, and a reply that
    isn't JSON, or is cut off, has none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
    kind = f"array<struct<{schema.replace(' ', ': ', 1)}>>"
    whole = F.try_parse_json(bare).isNotNull()  # from_json alone makes an item of nulls of what isn't JSON
    items = F.when(whole & bare.rlike(r"(?s)^\[.*\]$"), F.from_json(bare, kind)).when(whole & bare.rlike(r"(?s)^\{.*\}$"), F.array(F.from_json(bare, schema)))
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array().cast(kind))


def merge_status(status: Column, stage: Column, ok: Column, at: Column, error: Column) -> Column:
    """map with the stage's entry replaced; success clears the error."""
    entry = F.struct(ok.alias("ok"), at.alias("at"), F.when(~ok, error).alias("error"))
    return F.map_concat(F.map_filter(status, lambda k, v: k != stage), F.create_map(stage, entry))
