"""Counting distinct entities per bucket.

Everything is derived from one long table ``(series, key, is_unknown, entity_id)`` holding each
entity at most once per series and key. Counts are then plain ``count(*)``, combined map-side, so
a bucket holding most of the data costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V
from tallyproof.operators.dimensions import Dimension
from tallyproof.session import durable, keep, number_report_rows, number_rows, one_row, small

NO_SERIES = None


def _with_series(rows: DataFrame, series: DataFrame | None) -> DataFrame:
    """Attach every series an entity belongs to; ids only in ``series`` are ignored."""
    if series is None:
        return rows.withColumn("series", F.lit(NO_SERIES).cast("string"))
    return rows.join(series.select("series", "entity_id").distinct(), "entity_id")


def membership(
    entities: DataFrame, dimension: Dimension, id_col: str | Column, series: DataFrame | None = None
) -> DataFrame:
    """Membership of an entity table holding one row per id.

    Repeated keys are removed inside the row, so no shuffle is needed here unless there is a
    series table to join.
    """
    entity_id = F.col(id_col) if isinstance(id_col, str) else id_col
    keys = F.array_distinct(dimension.keys())
    rows = _with_series(entities.select(entity_id.alias("entity_id"), keys.alias("_keys")), series)
    key = F.col("_key")
    return rows.select("series", "entity_id", F.explode_outer("_keys").alias("_key")).select(
        "series",
        F.coalesce(key, F.lit(dimension.unknown_label)).alias("key"),
        key.isNull().alias("is_unknown"),
        "entity_id",
    )


def membership_of_pairs(
    ids: DataFrame, pairs: DataFrame, dimension: Dimension, series: DataFrame | None = None
) -> DataFrame:
    """Membership where attributes arrive as rows ``(entity_id, key)``, repeats allowed.

    ``ids`` holds each ``entity_id`` once. Known and unknown entities are two joins over the same
    shuffled inputs rather than one outer join, because an inner join can be split when one
    entity holds a large share of the pairs.
    """
    valid = (
        pairs.where(F.col("key").isNotNull() & (F.col("key") != ""))
        .select("entity_id", "key")
        .distinct()
    )
    owners = _with_series(ids.select("entity_id"), series)
    known = owners.join(valid, "entity_id").select(
        "series", "key", F.lit(False).alias("is_unknown"), "entity_id"
    )
    unknown = owners.join(valid.select("entity_id"), "entity_id", "left_anti").select(
        "series",
        F.lit(dimension.unknown_label).alias("key"),
        F.lit(True).alias("is_unknown"),
        "entity_id",
    )
    return known.unionByName(unknown)


def _charted(members: DataFrame, include_unknown: bool) -> DataFrame:
    return members if include_unknown else members.where(~F.col("is_unknown"))


def bucket_sizes(members: DataFrame, include_unknown: bool = True) -> DataFrame:
    """``(series, key, value, unknown)``: entities per bucket, and how many of them lack a key."""
    return (
        _charted(members, include_unknown)
        .groupBy("series", "key")
        .agg(F.count("*").alias("value"), F.count_if("is_unknown").alias("unknown"))
    )


def top_rows(counts: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` keys with the largest totals over all series; ties by raw key.

    Ranked in place: a semi-join with the kept keys would be pushed below the counting and make
    Spark count everything twice. The rank limit applies in every task before rows come together.
    """
    total = F.sum("value").over(Window.partitionBy("key"))
    nth = F.dense_rank().over(Window.orderBy(F.desc("_total"), "key"))
    return (
        counts.withColumn("_total", total)
        .withColumn("_nth", nth)
        .where(F.col("_nth") <= n)
        .drop("_total", "_nth")
    )


def restrict(rows: DataFrame, keys: DataFrame, n: int, on: str = "key") -> DataFrame:
    """Rows whose ``on`` is one of at most ``n`` kept keys."""
    return rows.join(small(keys, n), on, "left_semi")


def bucket_counts(
    members: DataFrame,
    dimension: Dimension,
    top_n: int | None = None,
    include_unknown: bool = True,
) -> DataFrame:
    """``(position, series, raw_key, key, value, is_unknown)`` in the dimension's order.

    Unknown last, then the dimension's own order, larger counts, label, series. With neither a
    top-N nor a closed vocabulary the report can be as large as the data, and positions come from
    a distributed sort.
    """
    counts = bucket_sizes(members, include_unknown)
    if top_n is not None:
        counts = top_rows(counts, top_n)
    is_unknown = F.col("key") == dimension.unknown_label
    rows = counts.select(
        "series",
        F.col("key").alias("raw_key"),
        F.when(is_unknown, F.col("key")).otherwise(dimension.display(F.col("key"))).alias("key"),
        "value",
        is_unknown.alias("is_unknown"),
        F.when(is_unknown, F.lit(0)).otherwise(dimension.order(F.col("key"))).alias("_order"),
    )
    bounded = dimension.closed or top_n is not None
    number = number_report_rows if bounded else number_rows
    order = [
        F.col("is_unknown"),
        F.col("_order"),
        F.desc("value"),
        F.col("key"),
        F.coalesce("series", F.lit("")),
    ]
    return number(rows, *order).select(
        "position", "series", "raw_key", "key", "value", "is_unknown"
    )


def bucket_totals(
    members: DataFrame,
    dimension: Dimension,
    top_n: int | None = None,
    include_unknown: bool = True,
    entities: DataFrame | None = None,
) -> DataFrame:
    """One row: distinct entities matched and unbucketed, categories in total and displayed.

    The per-category totals are written once and read for every figure about categories.
    ``entities`` (one row per id), where there are no series, spares a pass and a shuffle by
    entity: all of them matched, and each unbucketed one has exactly one membership row.
    """
    held: list[DataFrame] = []
    if entities is None:
        members = keep(members, held)
    categories = durable(
        bucket_sizes(members)
        .groupBy("key")
        .agg(F.sum("value").alias("value"), F.sum("unknown").alias("unknown"))
    )
    if entities is None:
        matched = durable(
            members.groupBy("entity_id")
            .agg(F.bool_or("is_unknown").alias("unknown"))
            .agg(F.count("*").alias("matched"), F.count_if("unknown").alias("unbucketed"))
        )
        for table in held:
            table.unpersist()
    else:
        matched = one_row(
            entities.agg(F.count("*").alias("matched")),
            categories.agg(F.coalesce(F.sum("unknown"), F.lit(0)).alias("unbucketed")),
        )
    if not include_unknown:
        known = categories.withColumn("value", F.col("value") - F.col("unknown"))
        categories = known.where(F.col("value") > 0).withColumn("unknown", F.lit(0).cast("bigint"))
    shown = categories
    if top_n is not None:
        shown = categories.orderBy(F.desc("value"), "key").limit(top_n)
    # Counted by entity rather than by label: a real key may be spelled like the label.
    one = one_row(
        matched,
        categories.agg(F.count("*").alias("total_categories")),
        shown.agg(
            F.count("*").alias("displayed_categories"),
            F.coalesce(F.sum("unknown"), F.lit(0)).alias("_unknown"),
        ),
    )
    return one.select(
        "matched",
        "unbucketed",
        (F.col("_unknown") > 0).alias("unknown_shown"),
        F.lit(dimension.multi_valued).alias("multi_valued"),
        "total_categories",
        "displayed_categories",
        (F.col("total_categories") - F.col("displayed_categories")).alias("omitted_categories"),
        F.lit(top_n).cast("bigint").alias("category_limit"),
    )


def zero_fill_series(rows: DataFrame, promised: list[str]) -> DataFrame:
    """Append zero rows for promised series that have no row at all, over the keys shown.

    Series with only some keys missing are left alone. The zero rows follow all others, series by
    series in the promised order, keys in display order. Which series are absent, at most as many
    as were promised, and the number of rows come to the driver; the zero rows are numbered by a
    distributed sort. The report is written once and read from then on.
    """
    rows = durable(rows)
    shown = rows.where(F.col("series").isin(promised)).select("series").distinct()
    present = {r.series for r in shown.collect()}
    absent = [s for s in promised if s not in present]
    if not absent:
        return rows
    facts = ["raw_key", "is_unknown"]
    keys = rows.groupBy("key").agg(
        F.min("position").alias("_first"), *[F.min_by(c, "position").alias(c) for c in facts]
    )
    series = F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(s).alias("series")) for i, s in enumerate(absent)]))
    zeros = keys.select("*", series.alias("_s")).select(
        "key", *facts, F.col("_s.series").alias("series"), F.lit(0).cast("bigint").alias("value"), "_first", F.col("_s.nth").alias("_nth")
    )
    numbered = number_rows(zeros, F.col("_nth"), F.col("_first"), name="_after")
    placed = numbered.withColumn("position", F.col("_after") + F.lit(rows.count()))
    return rows.unionByName(placed.select(*rows.columns))


def zero_fill_years(
    rows: DataFrame, start: int | None = None, end: int | None = None, max_years: int | None = None
) -> DataFrame:
    """Insert zero rows for the years of the axis that nothing falls into.

    The axis runs over the given bounds, else over what was observed. With fewer than two dated
    rows both bounds are needed. A reversed axis, or one longer than ``max_years``, is refused, and
    the rows come back unchanged. The axis comes to the driver; the rows, written once before, do not.
    """
    rows = durable(rows)
    year = F.when(F.col("key").rlike("^[0-9]+$"), F.col("key").try_cast("int"))
    dated = rows.withColumn("_year", year)
    first, last, n = dated.agg(F.min("_year"), F.max("_year"), F.count("_year")).first()
    low, high = first if start is None else start, last if end is None else end
    needed = 1 if start is not None and end is not None else 2
    if n < needed or high < low or (max_years is not None and high - low + 1 > max_years):
        return rows
    axis = F.sequence(F.lit(low), F.lit(high))
    missing = dated.groupBy("series").agg(F.array_except(axis, F.collect_set("_year")).alias("_missing"))
    text = F.col("_year").cast("string")
    zeros = missing.select("series", F.explode("_missing").alias("_year")).select(
        "series", "_year", text.alias("raw_key"), text.alias("key"),
        F.lit(0).cast("bigint").alias("value"), F.lit(False).alias("is_unknown"),
    )
    filled = dated.drop("position").unionByName(zeros)
    order = [F.col("_year").isNull(), F.col("_year"), F.coalesce("series", F.lit(""))]
    return number_rows(filled, *order).select(*rows.columns)
