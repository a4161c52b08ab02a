"""Paths, durations and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_number(path: Column) -> Column:
    """Number in the last ``_<number>`` (or ``=<number>``) of a path, e.g. ``sample_12.csv`` or ``sample_id=12/part-0.csv``."""
    return F.regexp_extract(path, r"^.*[_=](\d+)(?:_short)?(?:\.csv|/[^/]*)$", 1).try_cast("bigint")


def path_tail(path: Column, skip: int = 1) -> Column:
    """Folder of a file without its first ``skip`` parts, with a closing slash."""
    parts = F.split(path, "/")
    inner = F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip - 1, F.lit(0)))
    return F.concat(F.array_join(inner, "/"), F.lit("/"))


def parse_duration(text: Column) -> Column:
    """Seconds of ``[D day[s], ]H:MM:SS[.ffffff]``; NULL for other text."""
    pattern = r"^(?:(-?\d+) days?, )?(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$"

    def part(group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    days = F.when(part(1) == "", F.lit(0.0)).otherwise(part(1).try_cast("double"))
    seconds = (
        days * 86400
        + part(2).try_cast("double") * 3600
        + part(3).try_cast("double") * 60
        + part(4).try_cast("double")
    )
    return F.when(text.rlike(pattern), seconds)


def json_merge(left: Column, right: Column) -> Column:
    """Union of two JSON objects as a string map; the right side wins on shared keys, nested values become text.

    A side that is null or not an object adds nothing.
    """
    kind, none = "map<string,string>", F.create_map().cast("map<string,string>")
    a, b = (F.coalesce(F.from_json(side, kind), none) for side in (left, right))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
