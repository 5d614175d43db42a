"""Rows by their rank in an order, found by counts over ranges instead of sorting all rows.

Values become numbers in the same order (`number_of`), perhaps several values the same number. Counts of
ranges of those numbers, which combine in each task, tell which range holds a rank; only the rows of that
range are ever sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.session import broadcast_if_small, durable, number_rows

#: Ranges that a pass divides the one before into, and rows that are sorted without another pass.
RANGES, SORTED = 1024, 100_000
#: Ranges over all ids in which the rows of a datum are counted.
ID_RANGES = 1 << 12
_BYTES = 6  # of a string, so that their number is exact in a double


def _prefix(low: str | None, high: str | None) -> int:
    """Bytes that all strings between the two begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def number_of(column: Column, kind: T.DataType, prefix: int = 0) -> Column | None:
    """A double in the order of ``column``. Of a string it has six bytes after a common prefix. None for
    types without one."""
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return column.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.StringType):
        some = F.hex(F.substring(column.cast("binary"), prefix + 1, _BYTES))
        return F.conv(F.rpad(some, 2 * _BYTES, "0"), 16, 10).cast("double")
    return None


def _one_value(kind: T.DataType, number: float) -> bool:
    """Whether only one value has this number."""
    return isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType)) and abs(number) < 2**53


def _range_of(number: Column, low: float, high: float, ranges: int) -> Column:
    """Which of equal ranges a number falls into; never decreasing."""
    width = (high - low) / ranges
    place = F.floor((number - F.lit(low)) / F.lit(width if width > 0 else 1.0))
    return F.greatest(F.lit(0), F.least(F.lit(ranges - 1), place)).cast("int")


def first_rows(df: DataFrame, order: list[str], n: int, ranges: int = RANGES, most_sorted: int = SORTED) -> DataFrame:
    """The first ``n`` rows in the ascending order of some columns, nulls first.

    A pass counts the rows of each range of the first column; the range in which the n-th row lies is
    divided in the next pass, and when it is one value, by the next column. Rows before that range are
    taken by a filter, and of its rows, once they are few, as many as are missing by a sort.
    """
    sure, inside, left, rows = F.lit(False), F.lit(True), n, None
    if n <= 0:
        return df.limit(0)
    for name in order:
        column, kind, prefix = F.col(name), df.schema[name].dataType, 0
        if isinstance(kind, T.StringType):
            prefix = _prefix(*df.where(inside).agg(F.min(column), F.max(column)).first())
        number = number_of(column, kind, prefix)
        if number is None:
            break
        facts = df.where(inside).agg(F.count_if(column.isNull()), F.count(column), F.min(number), F.max(number)).first()
        nulls, rows, low, high = facts
        if nulls + rows <= left:
            return df.where(sure | inside)
        if nulls > left:
            rows, inside = nulls, inside & column.isNull()
            continue
        sure, inside, left = sure | (inside & column.isNull()), inside & column.isNotNull(), left - nulls
        while rows > most_sorted and low < high:
            place = _range_of(number, low, high, ranges)
            counts = df.where(inside).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"))
            taken = 0
            for r in sorted(counts.collect()):
                if taken + r.n > left:
                    break
                taken += r.n
            sure, left = sure | (inside & (place < r.place)), left - taken
            inside, rows, low, high = inside & (place == r.place), r.n, r.low, r.high
        if rows <= most_sorted or not _one_value(kind, low):
            break
    rest = df.where(inside)
    if left > most_sorted:
        numbered = number_rows(rest, *[F.col(c) for c in order], name="_at")
        rest = numbered.where(F.col("_at") <= left).drop("_at")
    else:
        rest = rest.orderBy(*order).limit(left)
    return df.where(sure).unionByName(rest)


def rows_at_ranks(
    rows: DataFrame,
    group: list[str],
    key: str,
    ranks: Callable[[Column], Column],
    bounds: DataFrame | None = None,
    ranges: int = ID_RANGES,
) -> DataFrame:
    """``(group..., total, nth, key)``: the rows of each group at some 0-based ranks in the order of
    ``key``, which no group has twice. ``ranks`` gives the array of them for a group's number of rows.

    Rows are counted by group and range of keys; only rows of ranges that hold a wanted rank are ranked by
    a sort, each range by itself. ``bounds`` may be a smaller table with all keys, for their least and
    greatest. Keys of a type without numbers are all in one range. ``rows`` is read twice, and best is a
    table; what is found is written, so that its readers know how little it is.
    """
    kind = rows.schema[key].dataType
    low, high = (rows if bounds is None else bounds).agg(F.min(key), F.max(key)).first()
    prefix = _prefix(low, high) if isinstance(kind, T.StringType) else 0
    number, place = number_of(F.col(key), kind, prefix), F.lit(0)
    if number is not None and low is not None:
        ends = rows.sparkSession.range(1).select(*[number_of(F.lit(x).cast(kind), kind, prefix) for x in (low, high)])
        place = _range_of(number, *ends.first(), ranges)
    placed = rows.select(F.struct(*group).alias("_group"), F.col(key).alias("_key"), place.alias("_place"))
    counts = durable(placed.groupBy("_group", "_place").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("_group").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    totals = counts.groupBy("_group").agg(F.sum("_n").alias("total"))
    asked = totals.select("_group", "total", F.posexplode(ranks(F.col("total"))).alias("nth", "_at"))
    inside = (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_n"))
    wanted = durable(asked.join(starts, "_group").where(inside).drop("_n"))
    near = placed.join(broadcast_if_small(wanted.select("_group", "_place", "_start").distinct()), ["_group", "_place"])
    within = Window.partitionBy("_group", "_place").orderBy("_key")
    ranked = near.select("_group", F.col("_key").alias(key), (F.col("_start") + F.row_number().over(within) - 1).alias("_at"))
    found = ranked.join(broadcast_if_small(wanted.select("_group", "_at", "total", "nth")), ["_group", "_at"])
    return durable(found.select("_group.*", "total", "nth", key))
