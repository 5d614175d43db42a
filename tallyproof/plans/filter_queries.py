"""Filters, accounting, capped reading and deduplication over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import text as X
from tallyproof.operators import filters, manifest, series
from tallyproof.plans import star
from tallyproof.plans.registry import query
from tallyproof.sources import pages


@query(
    f"""
    with {star.STUDIES_SQL},
    flags as (
      select coalesce(status <> 'F', true) as p1,
             coalesce(cast(left(start_date, 4) as integer) >= 1997, false) as p2,
             start_date is null as undated
      from studies
    ),
    totals as (
      select count(*) as n0, count(*) filter (where p1) as n1,
             count(*) filter (where p1 and p2) as n2,
             count(*) filter (where p1 and undated) as undated from flags
    )
    select cast(1 as bigint) as step, 'status_excluded' as filter, n0 as before, n1 as after,
           cast(0 as bigint) as missing
    from totals
    union all select 2, 'year', n1, n2, undated from totals
    """
)
def filter_status_exclude_nulls(spark, sf):
    studies = star.studies(spark, sf)
    year = X.leading_year(F.col(S.DATE_PATH)).try_cast("int")
    return filters.filter_accounting(
        studies,
        {
            "status_excluded": filters.status_not_in([" f "], F.col(S.STATUS_PATH)),
            "year": filters.year_between(year, 1997, None),
        },
        {"year": year.isNull()},
    )


@query(
    """
    with requested as (
      select distinct replace(upper(trim(substr(o_orderpriority, 3))), ' ', '_') as status
      from orders
    ),
    excluded as (
      select distinct replace(upper(trim(substr(o_orderpriority, 3))), ' ', '_') as status
      from orders where o_orderpriority < '2' or o_orderpriority like '4%'
    ),
    kept as (select * from requested except select * from excluded)
    select status, count(*) as orders
    from kept join orders
      on status = replace(upper(trim(substr(o_orderpriority, 3))), ' ', '_')
    group by 1
    """
)
def filter_status_sets(spark, sf):
    orders = star.table(spark, sf, "orders").select(
        "o_orderpriority", F.substring("o_orderpriority", 3, 100).alias("word")
    )
    requested = orders.select(F.concat(F.lit(" "), F.lower("word")).alias("status"))
    first = F.substring("o_orderpriority", 1, 1)
    excluded = orders.where(first.isin("1", "4")).select(
        F.concat(F.initcap("word"), F.lit("\t ")).alias("status")
    )
    kept = filters.effective_status_rows(requested, excluded)
    found = orders.select(X.status_code(F.col("word")).alias("status"))
    return found.join(kept, "status", "left_semi").groupBy("status").agg(
        F.count("*").alias("orders")
    )


@query(
    """
    with scoped as (
      select distinct l_orderkey from lineitem join part on l_partkey = p_partkey
      where regexp_matches(p_name, '(^| )(ring|widget)($| )')
    ),
    worded as (
      select distinct l_orderkey from lineitem join part on l_partkey = p_partkey
      where contains(lower(p_name || ' ' || p_type), 'old')
        and contains(lower(p_name || ' ' || p_type), 'promo')
    )
    select o_orderpriority as priority, count(*) as orders,
           count(*) filter (where o_orderkey in (select l_orderkey from worded)) as worded
    from orders join customer on o_custkey = c_custkey
    where c_mktsegment = 'BUILDING' and o_orderkey in (select l_orderkey from scoped)
    group by 1
    """
)
def filter_scope_text(spark, sf):
    """Two part words OR-ed, and a customer segment; how many also match free text."""
    names = star.parts_of_orders(spark, sf, "p_name", "p_type")
    scoped = names.where(filters.scope([" Ring", "widget ", ""], F.col("p_name")))
    worded = filters.free_text("OLD promo", F.col("p_name"), F.col("p_type"))
    customers = star.table(spark, sf, "customer").where(
        filters.scope(["building"], F.col("c_mktsegment"))
    )
    orders = (
        star.table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .select(F.col("o_orderkey").alias("entity_id"), "o_orderpriority")
        .join(scoped.select("entity_id"), "entity_id", "left_semi")
    )
    hits = names.where(worded).select("entity_id", F.lit(1).alias("hit")).distinct()
    return (
        orders.join(hits, "entity_id", "left")
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count("*").alias("orders"), F.count("hit").alias("worded"))
    )


@query(
    """
    select o_orderpriority as priority, count(*) as orders from orders
    where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1
    """
)
def filter_array_overlap(spark, sf):
    studies = star.studies(spark, sf).join(
        star.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey"
    )
    return (
        studies.where(filters.phases_in([0, 2, 2], F.col(S.PHASES_PATH)))
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count("*").alias("orders"))
    )


@query(
    """
    select count(*) filter (where o_orderstatus = 'X') as matched, count(*) as unfiltered
    from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'
    """
)
def filter_empty_probe(spark, sf):
    orders = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    return filters.empty_probe(
        orders, F.col("c_mktsegment") == "BUILDING", filters.status_in(["x"], F.col("o_orderstatus"))
    )


_CAP = 1000


@query(
    f"""
    with urgent as (
      select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as nth
      from orders where o_orderpriority = '1-URGENT' and o_totalprice > 495000
    ),
    pending as (
      select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as nth
      from orders where o_orderstatus = 'P'
    ),
    early as (
      select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as nth from orders
    ),
    s1 as (select 'urgent' as series, o_orderkey from urgent where nth <= {_CAP} // 3),
    s2 as (
      select 'pending' as series, o_orderkey from pending
      where nth <= ({_CAP} - (select count(*) from s1)) // 2
    ),
    s3 as (
      select 'early' as series, o_orderkey from early
      where nth <= {_CAP} - (select count(distinct o_orderkey) from (from s1 union all from s2))
    )
    select series, o_orderkey as entity_id from (from s1 union all from s2 union all from s3)
    """
)
def cap_series_budget(spark, sf):
    """One cap shared by three overlapping series; the first does not use its share."""
    orders = star.table(spark, sf, "orders")
    searches = {
        "urgent": orders.where(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 495000)
        ),
        "pending": orders.where(F.col("o_orderstatus") == "P"),
        "early": orders,
    }
    rows, _facts = pages.split_cap(searches, "o_orderkey", ["o_orderdate", "o_orderkey"], _CAP)
    return rows.select("series", F.col("o_orderkey").alias("entity_id"))


def _landed(spark, sf):
    """Two overlapping searches: all orders, and every line item as one more copy of its order.
    Pending low-priority orders come with an unusable id."""
    orders = star.table(spark, sf, "orders")
    usable = F.format_string("NCT%08d", F.col("o_orderkey"))
    refused = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    entity_id = F.when(refused, F.concat(F.lit("BAD"), usable)).otherwise(usable).alias("entity_id")

    def place(search, page, pos):
        return [
            F.lit(search).cast("bigint").alias("search_no"),
            page.cast("bigint").alias("page_no"),
            pos.cast("bigint").alias("pos"),
        ]

    whole = orders.select(
        entity_id, *place(1, F.floor(F.col("o_custkey") / 100), F.col("o_orderkey"))
    )
    lines = star.table(spark, sf, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    copies = lines.select(entity_id, *place(2, F.col("l_linenumber"), F.col("l_partkey")))
    return whole, copies


_LANDED_SQL = """
landed as (
  select case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'BAD' else '' end
           || 'NCT' || lpad(cast(o_orderkey as varchar), 8, '0') as entity_id,
         cast(1 as bigint) as search_no, o_custkey // 100 as page_no, o_orderkey as pos
  from orders
  union all
  select case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'BAD' else '' end
           || 'NCT' || lpad(cast(o_orderkey as varchar), 8, '0'),
         2, cast(l_linenumber as bigint), l_partkey
  from orders join lineitem on o_orderkey = l_orderkey
)
"""


@query(
    f"""
    with {_LANDED_SQL}
    select entity_id, search_no, page_no, pos from (
      select *, row_number() over (partition by entity_id order by search_no, page_no, pos) as nth
      from landed where regexp_full_match(entity_id, 'NCT[0-9]{{8}}')
    ) where nth = 1
    """
)
def dedup_first_writer(spark, sf):
    admitted = [pages.admit(part, "entity_id")[0] for part in _landed(spark, sf)]
    return pages.union_first(admitted, "entity_id", ["search_no", "page_no", "pos"])


@query(
    f"""
    with {_LANDED_SQL}
    select search_no, count(*) as refused from landed
    where not regexp_full_match(entity_id, 'NCT[0-9]{{8}}') group by 1
    """
)
def admit_refused(spark, sf):
    whole, copies = _landed(spark, sf)
    _usable, refused = pages.admit(whole.unionByName(copies), "entity_id")
    return refused.groupBy("search_no").agg(F.count("*").alias("refused"))


@query(
    """
    select c_mktsegment as series, count(*) as orders
    from orders join customer on o_custkey = c_custkey
    where c_mktsegment <> 'HOUSEHOLD' group by 1
    """
)
def series_table(spark, sf):
    """Series definitions with spelling duplicates, joined to entities by identity. One segment
    has no definition."""
    customers = star.table(spark, sf, "customer")
    segments = customers.select("c_mktsegment").distinct().where(F.col("c_mktsegment") != "HOUSEHOLD")
    spelled = [
        segments.select(F.col("c_mktsegment").alias("label"), F.lit(1).alias("ord")),
        segments.select(
            F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("\t")).alias("label"),
            F.lit(2).alias("ord"),
        ),
        segments.select(F.initcap("c_mktsegment").alias("label"), F.lit(3).alias("ord")),
    ]
    definitions = series.collapse_series(
        spelled[2].unionByName(spelled[1]).unionByName(spelled[0])
    ).select("label", F.col("label").alias("term"))
    attributes = (
        star.table(spark, sf, "orders")
        .join(star.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("entity_id"), F.lower("c_mktsegment").alias("term"))
    )
    return (
        series.series_of_terms(definitions, attributes)
        .groupBy("series")
        .agg(F.count("*").alias("orders"))
    )


@query(
    """
    with searches as (
      select c_nationkey, count(*) as fetched, count(*) > 600 as capped,
             case when c_nationkey % 5 > 0 then count(*) + c_nationkey % 2 end as total_matching
      from orders join customer on o_custkey = c_custkey group by 1
    )
    select max(total_matching) as total_matching,
           max(cast(coalesce(fetched < total_matching, capped) as integer)) as truncated
    from searches
    """
)
def fetch_completeness(spark, sf):
    """Customers' nations as searches: some complete, some short of their total, some without."""
    orders = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    nation = F.col("c_nationkey")
    searches = (
        orders.groupBy("c_nationkey")
        .agg(F.count("*").alias("fetched"))
        .select(
            "fetched",
            (F.col("fetched") > 600).alias("capped"),
            F.when(nation % 5 > 0, F.col("fetched") + nation % 2).alias("total_matching"),
        )
    )
    return manifest.fetch_totals(searches).withColumn("truncated", F.col("truncated").cast("int"))
