"""Distributions, trends, comparisons and their totals over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.functions import text as X
from tallyproof.operators import filters, measure, series
from tallyproof.operators.dimensions import DIMENSIONS, Dimension, bin_label, listed_order
from tallyproof.plans import star
from tallyproof.plans.registry import query

NATION = DIMENSIONS["country"]


@query(
    """
    select row_number() over (order by key) as position, key, value
    from (select o_orderpriority as key, count(*) as value from orders group by 1)
    """
)
def dist_priority(spark, sf):
    members = measure.membership(star.table(spark, sf, "orders"), star.PRIORITY, "o_orderkey")
    return measure.bucket_counts(members, star.PRIORITY).select("position", "key", "value")


_NATION_MEMBERS_SQL = """
pairs as (
  select distinct l_orderkey as id, n_name as key
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
),
members as (
  select o_orderkey as id, coalesce(key, 'No location listed') as key, key is null as is_unknown
  from orders left join pairs on o_orderkey = id
),
counts as (select key, count(*) as value from members group by key)
"""


def _nation_members(spark, sf):
    return measure.membership_of_pairs(
        star.order_ids(spark, sf), star.nations_of_orders(spark, sf), NATION
    )


@query(
    f"""
    with {_NATION_MEMBERS_SQL},
    kept as (select * from counts order by value desc, key limit 20)
    select row_number() over (order by key = 'No location listed', value desc, key) as position,
           key, value
    from kept
    """
)
def dist_multivalued_nation_top20(spark, sf):
    rows = measure.bucket_counts(_nation_members(spark, sf), NATION, top_n=V.TOP_N["country"])
    return rows.select("position", "key", "value")


@query(
    f"""
    with {_NATION_MEMBERS_SQL}
    select row_number() over (order by key = 'No location listed', value desc, key) as position,
           key, value
    from counts
    """
)
def dist_multivalued_nation_all(spark, sf):
    rows = measure.bucket_counts(_nation_members(spark, sf), NATION)
    return rows.select("position", "key", "value")


@query(
    f"""
    with {_NATION_MEMBERS_SQL},
    kept as (select key from counts order by value desc, key limit 20)
    select (select count(distinct id) from members) as matched,
           (select count(distinct id) from members where is_unknown) as unbucketed,
           (select count(*) from kept where key = 'No location listed') as unknown_shown,
           cast(1 as bigint) as multi_valued,
           (select count(*) from counts) as total_categories,
           (select count(*) from kept) as displayed_categories,
           (select count(*) from counts) - (select count(*) from kept) as omitted_categories,
           cast(20 as bigint) as category_limit
    """
)
def dist_totals(spark, sf):
    totals = measure.bucket_totals(
        _nation_members(spark, sf), NATION, V.TOP_N["country"], entities=star.order_ids(spark, sf)
    )
    return totals.withColumns(
        {c: F.col(c).cast("bigint") for c in ("unknown_shown", "multi_valued")}
    )


_EACH_SQL = f"""
with {star.STUDIES_SQL},
types as (
  select distinct l_orderkey as id, p_type as key from lineitem join part on l_partkey = p_partkey
),
members as (
  select distinct 'phase' as dimension, o_orderkey as id, unnest(
    case when phases is null then ['No phase data'] else phases end) as key from studies
  union all select 'start_year', o_orderkey, coalesce(left(start_date, 4), 'No start date') from studies
  union all select 'status', o_orderkey, coalesce(status, 'No status') from studies
  union all select 'sponsor', o_orderkey, c_name from studies
  union all select 'sponsor_class', o_orderkey, c_mktsegment from studies
  union all select 'enrollment_bucket', o_orderkey,
    case when enrolled < 10 then '0-9' when enrolled < 50 then '10-49'
         when enrolled < 100 then '50-99' when enrolled < 500 then '100-499'
         when enrolled < 1000 then '500-999' else '1000+' end from studies
  union all select 'intervention_type', o_orderkey, coalesce(key, 'No interventions listed')
    from orders left join types on o_orderkey = id
),
counts as (select dimension, key, count(*) as value from members group by all),
ranked as (
  select *, row_number() over (partition by dimension order by value desc, key) as nth from counts
),
labelled as (
  select dimension, value, key like 'No %' as is_unknown,
    case when dimension = 'phase' and key not like 'No %' then
      case key when 'EARLY_PHASE1' then 'Early Phase 1' when 'PHASE1' then 'Phase 1'
           when 'PHASE2' then 'Phase 2' when 'PHASE3' then 'Phase 3' else 'Not Applicable' end
      when dimension in ('status', 'sponsor_class', 'intervention_type') and key not like 'No %'
        then upper(key[1]) || lower(key[2:])
      when dimension = 'enrollment_bucket' then key || ' participants'
      else key end as label,
    case dimension
      when 'phase' then list_position(
        ['EARLY_PHASE1', 'PHASE1', 'PHASE2', 'PHASE3', 'PHASE4', 'NA'], key)
      when 'start_year' then try_cast(key as integer)
      when 'enrollment_bucket' then list_position(
        ['0-9', '10-49', '50-99', '100-499', '500-999', '1000+'], key)
      else 0 end as ordinal
  from ranked where dimension not in ('sponsor', 'intervention_type') or nth <= 15
)
select dimension, row_number() over (
    partition by dimension order by is_unknown, ordinal, value desc, label) as position,
  label as key, value
from labelled
"""


@query(_EACH_SQL)
def dist_each_dimension(spark, sf):
    studies = star.studies(spark, sf)
    parts = []
    for name, dimension in DIMENSIONS.items():
        if name == "country":
            continue
        if name == "intervention_type":
            pairs = star.parts_of_orders(spark, sf, "p_type").withColumnRenamed("p_type", "key")
            members = measure.membership_of_pairs(star.order_ids(spark, sf), pairs, dimension)
        else:
            members = measure.membership(studies, dimension, "o_orderkey")
        rows = measure.bucket_counts(members, dimension, V.TOP_N.get(name))
        parts.append(rows.select(F.lit(name).alias("dimension"), "position", "key", "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    """
    with quantity as (
      select o_orderkey, cast(sum(l_quantity) as bigint) as n
      from orders left join lineitem on o_orderkey = l_orderkey group by 1
    ),
    bins as (
      select case when n is null then 'No enrollment data' when n < 10 then '0-9 participants'
        when n < 50 then '10-49 participants' when n < 100 then '50-99 participants'
        when n < 500 then '100-499 participants' when n < 1000 then '500-999 participants'
        else '1000+ participants' end as key,
        case when n is null then 9 when n < 10 then 0 when n < 50 then 1 when n < 100 then 2
        when n < 500 then 3 when n < 1000 then 4 else 5 end as nth
      from quantity
    )
    select row_number() over (order by nth) as position, key, count(*) as value
    from bins group by key, nth
    """
)
def hist_quantity_bins(spark, sf):
    quantity = (
        star.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
    )
    orders = star.table(spark, sf, "orders").select("o_orderkey").join(quantity, "o_orderkey", "left")
    enrollment = DIMENSIONS["enrollment_bucket"]
    dimension = Dimension(
        "quantity",
        enrollment.unknown_label,
        lambda: X.single(bin_label(F.col("quantity"), V.ENROLLMENT_BINS)),
        enrollment.display,
        listed_order([b[2] for b in V.ENROLLMENT_BINS]),
        closed=True,
    )
    members = measure.membership(orders, dimension, "o_orderkey")
    return measure.bucket_counts(members, dimension).select("position", "key", "value")


@query(
    f"""
    with {star.STUDIES_SQL},
    years as (
      select left(start_date, 4) as key, count(*) as n from studies
      where cast(left(start_date, 4) as integer) between 1992 and 2004 group by 1
    )
    select row_number() over (order by y) as position, cast(y as varchar) as key,
           coalesce(n, 0) as value
    from generate_series(1992, 2004) as axis(y) left join years on key = cast(y as varchar)
    """
)
def trend_year_filled(spark, sf):
    year = X.leading_year(F.col(S.DATE_PATH)).try_cast("int")
    studies = star.studies(spark, sf).where(filters.year_between(year, 1992, 2004))
    dimension = DIMENSIONS["start_year"]
    members = measure.membership(studies, dimension, "o_orderkey")
    rows = measure.bucket_counts(members, dimension, include_unknown=False)
    return measure.zero_fill_years(rows, 1992, 2004).select("position", "key", "value")


def _segments(spark, sf, *labels):
    """Series of orders by their customer's segment."""
    orders = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    return series.series_where(
        orders, "o_orderkey", {label: F.col("c_mktsegment") == label for label in labels}
    )


def _compare(spark, sf, membership):
    members = measure.membership(
        star.table(spark, sf, "orders"), star.PRIORITY, "o_orderkey", membership
    )
    return measure.bucket_counts(members, star.PRIORITY)


@query(
    """
    select row_number() over (order by key, value desc, series) as position, series, key, value
    from (select c_mktsegment as series, o_orderpriority as key, count(*) as value
          from orders join customer on o_custkey = c_custkey
          where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1, 2)
    """
)
def compare_segments(spark, sf):
    rows = _compare(spark, sf, _segments(spark, sf, "BUILDING", "MACHINERY"))
    return rows.select("position", "series", "key", "value")


def _returned(spark, sf):
    """Series by return flag; an order may be in both."""
    return star.table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(
        F.col("l_returnflag").alias("series"), F.col("l_orderkey").alias("entity_id")
    )


_RETURNED_SQL = """
members as (
  select distinct l_returnflag as series, o_orderkey, o_orderpriority as key
  from orders join lineitem on o_orderkey = l_orderkey where l_returnflag in ('A', 'R')
)
"""


@query(
    f"""
    with {_RETURNED_SQL}
    select row_number() over (order by key, value desc, series) as position, series, key, value
    from (select series, key, count(*) as value from members group by 1, 2)
    """
)
def compare_overlapping(spark, sf):
    return _compare(spark, sf, _returned(spark, sf)).select("position", "series", "key", "value")


@query(
    f"""
    with {_RETURNED_SQL}
    select count(distinct o_orderkey) as matched, cast(0 as bigint) as unbucketed,
           count(distinct key) as total_categories
    from members
    """
)
def compare_overlapping_totals(spark, sf):
    members = measure.membership(
        star.table(spark, sf, "orders"), star.PRIORITY, "o_orderkey", _returned(spark, sf)
    )
    totals = measure.bucket_totals(members, star.PRIORITY)
    return totals.select("matched", "unbucketed", "total_categories")


@query(
    """
    with counts as (
      select c_mktsegment as series, o_orderpriority as key, count(*) as value
      from orders join customer on o_custkey = c_custkey
      where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1, 2
    ),
    shown as (
      select row_number() over (order by key, value desc, series) as position, * from counts
    ),
    empty as (
      select nth, s.series, key, min(position) as first
      from (values (1, 'AEROSPACE'), (2, 'RAILWAY')) as s(nth, series), shown group by 1, 2, 3
    )
    select * from shown
    union all
    select (select count(*) from shown) + row_number() over (order by nth, first), series, key, 0
    from empty
    """
)
def compare_empty_series(spark, sf):
    promised = ["BUILDING", "AEROSPACE", "MACHINERY", "RAILWAY"]
    rows = _compare(spark, sf, _segments(spark, sf, *promised))
    return measure.zero_fill_series(rows, promised).select("position", "series", "key", "value")


@query(
    """
    with years as (
      select distinct c_mktsegment as series, year(o_orderdate) as y, count(*) as n
      from orders join customer on o_custkey = c_custkey
      where c_mktsegment in ('BUILDING', 'FURNITURE')
        and (c_mktsegment = 'BUILDING' or year(o_orderdate) not in (1996, 1999))
      group by 1, 2
    ),
    bounds as (select min(y) as low, max(y) as high from years)
    select row_number() over (order by axis.y, s.series) as position, s.series,
           cast(axis.y as varchar) as key, coalesce(n, 0) as value
    from (select distinct series from years) s,
         (select unnest(generate_series(low, high)) as y from bounds) axis
         left join years on years.series = s.series and years.y = axis.y
    """
)
def trend_series_gaps(spark, sf):
    """Gaps of one series are filled over the years observed in any."""
    orders = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    segment, year = F.col("c_mktsegment"), F.year("o_orderdate")
    membership = series.series_where(
        orders,
        "o_orderkey",
        {
            "BUILDING": segment == "BUILDING",
            "FURNITURE": (segment == "FURNITURE") & ~year.isin(1996, 1999),
        },
    )
    start_year = DIMENSIONS["start_year"]
    dimension = Dimension(
        "order_year",
        start_year.unknown_label,
        lambda: X.single(X.leading_year(year.cast("string"))),
        order=start_year.order,
        closed=True,
    )
    members = measure.membership(
        star.table(spark, sf, "orders"), dimension, "o_orderkey", membership
    )
    rows = measure.bucket_counts(members, dimension, include_unknown=False)
    return measure.zero_fill_years(rows).select("position", "series", "key", "value")
