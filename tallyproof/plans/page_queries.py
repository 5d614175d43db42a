"""Landed pages: parsing, admission and ingest, over JSON documents made from the orders.

A page lists up to a hundred orders as study records. Pages alternate between two searches; some
ids are unusable, and some documents are not JSON or have the wrong shape.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof.operators import manifest
from tallyproof.plans import star
from tallyproof.plans.registry import query
from tallyproof.sources import pages, synonyms
from tallyproof.streaming import ingest

_PAGE = 100


def _documents(spark, sf):
    """``(value, source)``: a JSON document for each hundred order keys."""
    orders = star.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    usable = F.format_string("NCT%08d", key)
    ident = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("BAD"), usable)).otherwise(usable)
    study = F.struct(
        F.struct(
            F.struct(ident.alias("nctId"), F.col("o_orderpriority").alias("briefTitle")).alias("identificationModule"),
            F.struct(F.col("o_orderstatus").alias("overallStatus")).alias("statusModule"),
        ).alias("protocolSection")
    )
    number = F.floor(key / _PAGE)
    listed = orders.groupBy(number.alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), study.alias("s")))), lambda e: e["s"]).alias("studies")
    )
    page = F.struct(
        (F.col("page") % 2).cast("int").alias("searchNo"),
        F.col("page").cast("int").alias("pageNo"),
        F.when(F.col("page") % 2 == 0, "even").otherwise("odd").alias("series"),
        F.when(F.col("page") % 3 == 0, F.col("page") * 10).alias("totalCount"),
        F.concat(F.lit("2026-01-"), F.lpad((F.col("page") % 28 + 1).cast("string"), 2, "0")).alias("dataTimestamp"),
        F.col("studies"),
    )
    value = (
        F.when(F.col("page") % 7 == 3, F.lit("not json"))
        .when(F.col("page") % 7 == 5, F.lit('{"studies": "none"}'))
        .otherwise(F.to_json(page))
    )
    return listed.select(value.alias("value"), F.concat(F.lit("page-"), F.col("page").cast("string")).alias("source"))


def _pages(spark, sf):
    return pages.parse_pages(_documents(spark, sf))


_LISTED_SQL = f"""
all_pages as (select distinct o_orderkey // {_PAGE} as page from orders),
good as (select page from all_pages where page % 7 not in (3, 5)),
listed as (
  select page, page % 2 as search_no, case page % 2 when 0 then 'even' else 'odd' end as series, o_orderkey,
         row_number() over (partition by page order by o_orderkey) - 1 as pos, o_orderpriority = '5-LOW' as bad,
         case when o_orderpriority = '5-LOW' then 'BAD' else '' end || 'NCT' || lpad(cast(o_orderkey as varchar), 8, '0') as id
  from orders join good on page = o_orderkey // {_PAGE}
)
"""


@query(
    f"""
    with {_LISTED_SQL}
    select search_no, page as page_no, pos, series, id as entity_id, o_orderstatus as status
    from listed join orders using (o_orderkey)
    """
)
def pages_studies(spark, sf):
    """Every study that well-formed pages list, with its place and one field of the record."""
    rows = pages.studies_of_pages(_pages(spark, sf))
    return rows.select(
        F.col("search_no").cast("long").alias("search_no"),
        F.col("page_no").cast("long").alias("page_no"),
        F.col("pos").cast("long").alias("pos"),
        "series",
        "entity_id",
        F.col("protocolSection.statusModule.overallStatus").alias("status"),
    )


@query(
    f"""
    with {_LISTED_SQL}
    select 'page-' || page as source, 'wrong type or not an object' as problem from all_pages where page % 7 in (3, 5)
    """
)
def pages_malformed(spark, sf):
    return pages.malformed_pages(_pages(spark, sf))


@query(
    f"""
    with {_LISTED_SQL}
    select search_no, cast(count(*) as bigint) as fetched,
           cast((select min(page) * 10 from good g where g.page % 2 = search_no and g.page % 3 = 0) as bigint) as total_matching,
           (select max('2026-01-' || lpad(cast(page % 28 + 1 as varchar), 2, '0')) from good g where g.page % 2 = search_no) as data_as_of
    from listed group by search_no
    """
)
def pages_search_facts(spark, sf):
    """What each search fetched, the total it reports, and the newest data in it."""
    facts = pages.search_facts(_pages(spark, sf).where(F.col("searchNo").isNotNull()))
    return facts.select(F.col("search_no").cast("long").alias("search_no"), "fetched", "total_matching", "data_as_of")


@query(f"with {_LISTED_SQL} select 'page-' || page as source from all_pages")
def pages_provenance(spark, sf):
    return manifest.provenance(_pages(spark, sf))


@query(
    f"""
    with {_LISTED_SQL},
    usable as (select * from listed where not bad),
    stored as (select id from usable where page % 4 = 0)
    select 'studies' as "table", count(*) as "rows" from usable where id not in (from stored)
    union all select 'membership', count(*) from usable where not (page % 4 = 0 and pos < 10)
    union all select 'refused', count(*) from listed where bad
    union all select 'malformed', count(*) from all_pages where page % 7 in (3, 5)
    """
)
def ingest_batch(spark, sf):
    """One batch of pages against what is stored: every fourth page's studies, and the series of the
    first ten places of these pages."""
    landed = _pages(spark, sf)
    listed, _ = pages.admit(pages.studies_of_pages(landed), "entity_id")
    before = listed.where(F.col("page_no") % 4 == 0)
    batch = ingest.split_batch(
        landed, before.select("entity_id"), before.where(F.col("pos") < 10).select("series", "entity_id")
    )
    return batch.counts()


@query(
    """
    select p_name as name, 'C' || p_partkey as rxcui, cast(p_size as varchar) as score, cast(0 as bigint) as rank from part
    where p_size % 4 > 0
    union all select p_name, 'D' || p_partkey, '1.5', 1 from part where p_size % 4 > 0
    """
)
def synonym_payloads(spark, sf):
    """Lookup answers as they are landed, one document for each part; every fourth has no match."""
    parts = star.table(spark, sf, "part")
    first = F.struct(F.concat(F.lit("C"), "p_partkey").alias("rxcui"), F.col("p_size").cast("string").alias("score"), F.lit("1").alias("rank"))
    second = F.struct(F.concat(F.lit("D"), "p_partkey").alias("rxcui"), F.lit("1.5").alias("score"), F.lit("2").alias("rank"))
    found = F.when(F.col("p_size") % 4 > 0, F.array(first, second))
    answer = F.struct(F.col("p_name").alias("term"), F.struct(found.alias("candidate")).alias("approximateGroup"))
    rows = synonyms.candidates_of_documents(parts.select(F.to_json(answer).alias("value")))
    return rows.select("name", "rxcui", "score", F.col("rank").cast("long").alias("rank"))
