"""Window work on series of any length.

A plain ``Window.partitionBy("sample_id")`` sends a whole series to one task. That is the right plan while every
series is short, and the wrong one when a single series holds a third of the table. The helpers here cut a series
into chunks of consecutive ticks, so a window never sees more than one chunk:

* ``windowed``  - bounded look-back/look-ahead; the few rows at a chunk's edge are copied to its neighbour.
* ``running``   - cumulative sum/min/max/last; each chunk is accumulated alone and the totals of the earlier chunks
  are added by a join on (series, chunk).
* ``next_tick`` - distance to the next row of a sparse series.
* ``ordinals``  - the 0-based position of a row in its group, the only step that starts without dense ticks.

All give the same rows as the plain window. ``Layout.longest`` is the known bound on the length of a series (the
``max_length`` of the dataset's sidecar, or one measured by ``measure``); when it fits in one chunk the plain window is used.
Look-backs are counted in rows. ``Layout.dense`` states that ticks are consecutive integers, so that they count the rows;
otherwise rows are numbered before a series is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from itertools import takewhile
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_TICKS = 1 << 22
HOT_GROUPS = 100_000

_CHUNK = "_chunk"
_ROW = "_row"


@dataclass(frozen=True)
class Layout:
    """Columns that identify a series and order it, and how long a series may get."""

    keys: tuple[str, ...] = ("sample_id",)
    tick: str = "time"
    chunk: int = CHUNK_TICKS
    longest: int | None = None
    dense: bool = False

    @property
    def split(self) -> bool:
        return self.longest is None or self.longest > self.chunk

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.tick)

    def chunk_of(self, shift: int = 0) -> Column:
        return F.floor((F.col(self.tick) + F.lit(shift)) / F.lit(self.chunk)).cast("bigint")

    def by(self, *keys: str, tick: str | None = None) -> Layout:
        return replace(self, keys=keys, tick=tick or self.tick)


SIGNALS = Layout()


class Size(NamedTuple):
    """Rows of the longest group, rows in all, number of groups; upper bounds do as well."""

    longest: int
    total: int
    groups: int


def measure(df: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> Size:
    """Size of the groups of a table: one pass over the key columns, one row to the driver."""
    counts = df.groupBy(*keys).count()
    row = counts.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    return Size(*row)


def windowed(
    df: DataFrame,
    layout: Layout,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Add columns computed over a window that reaches at most ``before`` rows back and ``after`` rows ahead."""
    if not layout.split:
        return df.select("*", *[c.alias(name) for name, c in columns(layout.window()).items()])
    if not layout.dense:
        numbered, by_row = with_rows(df, layout)
        return windowed(numbered, by_row, columns, before, after).drop(_ROW)
    first = F.greatest(layout.chunk_of(-after), F.lit(0).cast("bigint"))
    reach = df.withColumn(_CHUNK, F.explode(F.sequence(first, layout.chunk_of(before))))
    window = Window.partitionBy(*layout.keys, _CHUNK).orderBy(layout.tick)
    named = [c.alias(name) for name, c in columns(window).items()]
    return reach.select("*", *named).where(F.col(_CHUNK) == layout.chunk_of()).drop(_CHUNK)


def with_rows(df: DataFrame, layout: Layout) -> tuple[DataFrame, Layout]:
    """``df`` with the rows of each series numbered from 0, and a layout that has them as ticks."""
    size = None if layout.split else Size(layout.longest, 0, 0)
    numbered = ordinals(df, layout.keys, (layout.tick,), _ROW, size, layout.chunk)
    return numbered, replace(layout, tick=_ROW, dense=True)


_TOTAL = {
    "sum": lambda value, tick: F.sum(value),
    "min": lambda value, tick: F.min(value),
    "max": lambda value, tick: F.max(value),
    "last": lambda value, tick: F.max_by(value, F.when(value.isNotNull(), tick)),
}
_OVER = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
_MERGE = {
    "sum": lambda prior, own: F.when(prior.isNull(), own).when(own.isNull(), prior).otherwise(prior + own),
    "min": lambda prior, own: F.least(prior, own),
    "max": lambda prior, own: F.greatest(prior, own),
    "last": lambda prior, own: F.coalesce(own, prior),
}


def running(
    df: DataFrame, layout: Layout, columns: Mapping[str, tuple[str, Column]], exclusive: bool = False
) -> DataFrame:
    """Add cumulative columns ``{name: (sum|min|max|last, value)}`` in tick order, without the own row if exclusive."""
    upto = -1 if exclusive else 0
    if not layout.split:
        window = layout.window().rowsBetween(Window.unboundedPreceding, upto)
        return df.select("*", *[_OVER[kind](value).over(window).alias(n) for n, (kind, value) in columns.items()])

    chunked = df.withColumn(_CHUNK, layout.chunk_of())
    totals = chunked.groupBy(*layout.keys, _CHUNK).agg(
        *[_TOTAL[kind](value, F.col(layout.tick)).alias(f"_p_{n}") for n, (kind, value) in columns.items()]
    )
    earlier = Window.partitionBy(*layout.keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    priors = totals.select(
        *layout.keys, _CHUNK, *[_OVER[kind](f"_p_{n}").over(earlier).alias(f"_p_{n}") for n, (kind, _) in columns.items()]
    )
    inside = Window.partitionBy(*layout.keys, _CHUNK).orderBy(layout.tick).rowsBetween(Window.unboundedPreceding, upto)
    own = chunked.select("*", *[_OVER[kind](value).over(inside).alias(f"_o_{n}") for n, (kind, value) in columns.items()])
    merged = [
        _MERGE[kind](F.col(f"_p_{n}"), F.col(f"_o_{n}")).alias(n) for n, (kind, _) in columns.items()
    ]
    return own.join(priors, [*layout.keys, _CHUNK], "left").select(*df.columns, *merged)


def next_tick(df: DataFrame, layout: Layout, out: str = "next_tick") -> DataFrame:
    """Tick of the following row of the same series; ticks may have gaps. NULL on the last row."""
    if not layout.split:
        return df.withColumn(out, F.lead(layout.tick).over(layout.window()))
    chunked = df.withColumn(_CHUNK, layout.chunk_of())
    firsts = chunked.groupBy(*layout.keys, _CHUNK).agg(F.min(layout.tick).alias("_first"))
    order = Window.partitionBy(*layout.keys).orderBy(_CHUNK)
    later = firsts.select(*layout.keys, _CHUNK, F.lead("_first").over(order).alias("_later"))
    inside = Window.partitionBy(*layout.keys, _CHUNK).orderBy(layout.tick)
    own = chunked.withColumn("_own", F.lead(layout.tick).over(inside))
    return own.join(later, [*layout.keys, _CHUNK], "left").select(
        *df.columns, F.coalesce("_own", "_later").alias(out)
    )


def ordinals(
    df: DataFrame,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    out: str,
    size: Size | None = None,
    chunk: int = CHUNK_TICKS,
    group_size: str | None = None,
) -> DataFrame:
    """0-based position of every row in its ``keys`` group by ``order`` (a total order; numbers or times first).

    Groups above ``chunk`` rows are cut into ranges of the order columns. Each range is numbered alone, and the number of
    rows in the earlier ranges of the group is added. Ranges that turn out too large, because values crowd in them, are
    cut again, as long as that makes the largest one smaller. What is broadcast has one row per oversized group or per range of one; the
    threshold keeps that near ``HOT_GROUPS`` whatever the size of the table. ``group_size`` names a column for the rows of
    the group.
    """
    longest, total, _ = size or measure(df, keys)
    if longest <= chunk or _kind(df, order[0]) not in _POSITION:
        group = Window.partitionBy(*keys)
        named = {out: F.row_number().over(group.orderBy(*order)).cast("bigint") - 1}
        return df.withColumns(named | ({group_size: F.count("*").over(group)} if group_size else {}))

    limit = max(chunk, total // HOT_GROUPS)
    cut, ranges = df, []
    while longest > limit:
        tried = _cut(cut, (*keys, *ranges), order, f"_r{len(ranges)}", limit)
        left = measure(tried, (*keys, *ranges, f"_r{len(ranges)}")).longest
        if left >= longest and ranges:
            break  # rows that are equal in all columns with a place on a line
        cut, longest = tried, left
        ranges.append(f"_r{len(ranges)}")

    earlier = Window.partitionBy(*keys).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, *ranges).count()
    starts = counts.select(*keys, *ranges, F.sum("count").over(earlier).alias("_start")).where("_start > 0")
    inside = Window.partitionBy(*keys, *ranges).orderBy(*order)
    numbered = (
        cut.join(F.broadcast(starts), [*keys, *ranges], "left")
        .withColumn(out, F.row_number().over(inside) - 1 + F.coalesce("_start", F.lit(0)))
        .select(*df.columns, out)
    )
    if not group_size:
        return numbered
    return numbered.join(df.groupBy(*keys).agg(F.count("*").alias(group_size)), [*keys])


_FAR = 1e300


def _first_bytes(text: Column) -> Column:
    """The first six bytes of a text as a number."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


_POSITION = {
    **{t: lambda c: c.cast("double") for t in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")},
    "date": lambda c: F.unix_date(c).cast("double"),
    "timestamp": lambda c: F.unix_micros(c).cast("double"),
    "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp")).cast("double"),
    "string": _first_bytes,
}


def _shared(low: Column, high: Column) -> Column:
    """How many characters the beginnings of two texts share; all texts that sort between them share those too."""
    most = F.coalesce(F.least(F.length(low), F.length(high)), F.lit(0))
    equal = F.filter(F.sequence(F.lit(0), most), lambda k: F.left(low, k) == F.left(high, k))
    return F.coalesce(F.array_max(equal), F.lit(0))


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column].split("(")[0]


def position(df: DataFrame, column: str) -> Column:
    """Place of a value on a line, in sort order: NULL first, NaN last. Values that are close may share a place."""
    place = F.coalesce(_POSITION[_kind(df, column)](F.col(column)), F.lit(-_FAR))
    return F.greatest(F.least(F.nanvl(place, F.lit(_FAR)), F.lit(_FAR)), F.lit(-_FAR))


def _cut(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], out: str, limit: int) -> DataFrame:
    """Number equal ranges within each group of more than ``limit`` rows; 0 in all other groups.

    The ranges are of the first order column that is not constant in the group. Only the leading columns that have a
    position on a line are considered. The place of a text is that of the bytes after the beginning that all texts of its
    group share.
    """
    usable = list(takewhile(lambda c: _kind(df, c) in _POSITION, order))
    places = {c: position(df, c) for c in usable}
    texts = [c for c in usable if _kind(df, c) == "string"]
    stats = [F.count("*").alias("_n")]
    for c in usable:
        mixed = (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
        stats += [
            F.coalesce(mixed, F.lit(False)).alias(f"_varies_{c}"),
            F.min(c if c in texts else places[c]).alias(f"_lo_{c}"),
            F.max(c if c in texts else places[c]).alias(f"_hi_{c}"),
        ]
    any_varies = reduce(Column.__or__, [F.col(f"_varies_{c}") for c in usable])
    big = df.groupBy(*keys).agg(*stats).where((F.col("_n") > limit) & any_varies)
    for c in texts:
        big = big.withColumn(f"_shared_{c}", _shared(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")))
        after = lambda text, n=f"_shared_{c}": _first_bytes(F.substr(text, F.col(n) + 1))
        big = big.withColumns({f"_{end}_{c}": after(F.col(f"_{end}_{c}")) for end in ("lo", "hi")})
        # a null comes before all texts
        places[c] = F.when(F.col(c).isNull(), F.col(f"_lo_{c}")).otherwise(after(F.col(c)))
    parts = F.ceil(2 * F.col("_n") / limit)
    place = F.lit(0).cast("bigint")
    for c in reversed(usable):
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        share = F.coalesce(F.try_divide(places[c] - lo, hi - lo), F.lit(0.0))
        place = F.when(F.col(f"_varies_{c}"), F.floor(share * parts)).otherwise(place)
    return (
        df.join(F.broadcast(big), [*keys], "left")
        .withColumn(out, F.when(F.col("_n").isNull(), 0).otherwise(F.least(place, parts - 1)).cast("bigint"))
        .select(*df.columns, out)
    )
