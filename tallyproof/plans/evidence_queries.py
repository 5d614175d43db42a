"""Citations, excerpts and quality checks over the order tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.functions import text as X
from tallyproof.operators import checks, measure, network
from tallyproof.operators.citations import cite, evidence_totals, quote, study_fragment
from tallyproof.operators.dimensions import DIMENSIONS
from tallyproof.plans import star
from tallyproof.plans.job import Job, run
from tallyproof.plans.registry import query
from tallyproof.session import durable, scratch_path
from tallyproof.sources.results import read_result, write_result

NATION = DIMENSIONS["country"]


def _sample_sql(members: str, limit: int) -> str:
    """Rows of ``members(key, id)`` at the cited positions."""
    return f"""
ranked as (
  select key, id, row_number() over (partition by key order by id) - 1 as place,
         count(*) over (partition by key) as total from {members}
),
cited as (
  select key, id, total, row_number() over (partition by key order by place) as ordinal
  from ranked
  where total <= {limit} or place in (
    select cast(round_even(i * (total - 1) / {float(limit - 1)}, 0) as bigint)
    from generate_series(0, {limit - 1}) as steps(i))
)
"""


_NATIONS_SQL = """
pairs as (
  select distinct l_orderkey as id, n_name as key
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
),
members as (
  select o_orderkey as id, coalesce(key, 'No location listed') as key
  from orders left join pairs on o_orderkey = id
)
"""


def _nation_members(spark, sf):
    return measure.membership_of_pairs(
        star.order_ids(spark, sf), star.nations_of_orders(spark, sf), NATION
    )


@query(
    f"""
    with {_NATIONS_SQL}, {_sample_sql("members", 3)}
    select key, ordinal, id as entity_id, total from cited
    """
)
def cite_sample(spark, sf):
    evidence = durable(_nation_members(spark, sf).select("key", "entity_id"))
    return cite(evidence, ["key"], 3, star.order_ids(spark, sf))


@query(
    f"""
    with members as (select o_orderstatus as key, o_orderkey as id from orders),
    {_sample_sql("members", 20)}
    select key, ordinal, id as entity_id, total from cited
    """
)
def cite_sample_large_buckets(spark, sf):
    """Three buckets, each with about a third of all rows."""
    orders = star.table(spark, sf, "orders")
    evidence = orders.select(F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("entity_id"))
    return cite(evidence, ["key"], V.MAX_CITATIONS)


@query(f"with {_NATIONS_SQL} select key, count(distinct id) as total from members group by 1")
def cite_totals(spark, sf):
    # Written as the totals: what a task sorts and joins before is bounded there.
    return durable(evidence_totals(_nation_members(spark, sf).select("key", "entity_id"), ["key"]))


def _studies(spark, sf):
    return star.studies(spark, sf)


def _two_fields():
    return X.excerpt(
        F.col(S.TITLE_PATH),
        study_fragment("sponsor"),
        study_fragment("phase"),
        study_fragment("start_year"),
        limit=V.TITLE_CLIP,
    )


_EXCERPT_SQL = """
'"' || case when length(title) > 160 then rtrim(left(title, 160)) || '...' else title end
|| '" — sponsorCollaboratorsModule.leadSponsor.name: "' || c_name
|| '"; designModule.phases: '
|| case when phases is null then 'not reported'
        else '[' || array_to_string(phases, ', ') || ']' end
|| '; statusModule.startDateStruct.date: '
|| case when start_date is null then 'not reported' else '"' || start_date || '"' end
"""


@query(
    f"""
    with {star.STUDIES_SQL},
    members as (select c_name as key, o_orderkey as id from studies),
    {_sample_sql("members", 3)}
    select key, ordinal, 'NCT' || lpad(cast(id as varchar), 8, '0') as entity_id, total,
           {_EXCERPT_SQL} as excerpt,
           'https://clinicaltrials.gov/study/NCT' || lpad(cast(id as varchar), 8, '0') as url
    from cited join studies on id = o_orderkey
    """
)
def cite_excerpt(spark, sf):
    studies = _studies(spark, sf)
    evidence = studies.select(
        F.col(S.SPONSOR_PATH).alias("key"), F.col(S.ID_PATH).alias("entity_id")
    )
    cited = cite(evidence, ["key"], 3)
    return quote(cited, studies, S.ID_PATH, _two_fields()).select(
        "key", "ordinal", "entity_id", "total", "excerpt", "url"
    )


@query(
    f"""
    with {star.STUDIES_SQL}
    select o_orderkey,
      '"' || case when length(title) > 160 then rtrim(left(title, 160)) || '...' else title end
      || '" — designModule.enrollmentInfo.count: ' || enrolled as enrollment,
      'statusModule.overallStatus: ' || case when status is null then 'not reported'
        else '[' || status || ']' end as status
    from studies
    """
)
def render_evidence(spark, sf):
    return _studies(spark, sf).select(
        "o_orderkey",
        X.excerpt(F.col(S.TITLE_PATH), study_fragment("enrollment_bucket"), limit=V.TITLE_CLIP).alias("enrollment"),
        X.excerpt(F.lit(None).cast("string"), study_fragment("status")).alias("status"),
    )


# --- checks ----------------------------------------------------------------------------------


def _published(spark, sf):
    """Bucket rows with citations over customers' nations, and what they rest on."""
    members = durable(_nation_members(spark, sf))
    rows = durable(measure.bucket_counts(members, NATION, V.TOP_N["country"]))
    evidence = measure.restrict(
        members.select("key", "entity_id"), rows.select("key"), V.TOP_N["country"]
    )
    excerpts = star.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entity_id"),
        X.excerpt(F.col("o_orderpriority"), X.render_text("status", F.col("o_orderstatus"))).alias(
            "excerpt"
        ),
    )
    return rows, evidence, excerpts


_URL = "order/%s"


def _quoted(evidence, excerpts):
    cited = cite(evidence, ["key"], 3)
    return durable(quote(cited, excerpts, "entity_id", F.col("excerpt"), _URL))


def _row_checks(rows, computed, evidence, citations, excerpts):
    return checks.violations(
        checks.value_is_contributors(rows, evidence, ["key"]),
        checks.rows_are_computed(rows, computed, ["key", "value"]),
        checks.citation_membership(citations, evidence, excerpts, ["key"]),
        checks.citation_totals(rows, citations, evidence_totals(evidence, ["key"]), evidence, ["key"], 3),
        checks.citation_texts(citations, excerpts, ["key"], _URL),
    )


@query(
    f"""
    with {_NATIONS_SQL},
    kept as (select key, count(*) as value from members group by 1 order by 2 desc, 1 limit 20)
    select count(*) as buckets, cast(sum(value) as bigint) as entities, cast(0 as bigint) as violations
    from kept
    """
)
def check_clean(spark, sf):
    """A right result has no violations; the sizes of what was checked stand beside it."""
    rows, evidence, excerpts = _published(spark, sf)
    # Counted once more, from the line items.
    again = durable(measure.bucket_counts(_nation_members(spark, sf), NATION, V.TOP_N["country"]))
    found = _row_checks(rows, again, evidence, _quoted(evidence, excerpts), excerpts)
    checked = rows.select(
        F.lit(1).alias("buckets"), F.col("value").alias("entities"), F.lit(0).alias("violations")
    )
    failed = found.select(
        F.lit(0).alias("buckets"), F.lit(0).cast("bigint").alias("entities"), F.lit(1).alias("violations")
    )
    return checked.unionByName(failed).agg(
        F.sum("buckets").alias("buckets"),
        F.sum("entities").alias("entities"),
        F.sum("violations").alias("violations"),
    )


def _per_check(found: DataFrame, *damaged: str) -> DataFrame:
    """How often each check objected; a damaged property that no row had is counted too, as none."""
    none = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in damaged])).alias("check"), F.lit(0).alias("n"))
    return found.select("check", F.lit(1).alias("n")).unionByName(none).groupBy("check").agg(F.sum("n").alias("n"))


@query(
    f"""
    with {_NATIONS_SQL},
    kept as (select key, count(*) as value from members group by 1 order by 2 desc, 1 limit 20),
    {_sample_sql("members", 3)},
    quoted as (select * from cited where key in (select key from kept))
    select 'value_is_contributors' as "check", count(*) as n from kept where key < 'NATION_15'
    union all select 'rows_are_computed', count(*) from kept where key < 'NATION_15'
    union all select 'cited_non_contributor', count(*) from (
      select q.key, q.id from quoted q where q.key >= 'NATION_20'
        and not exists (select 1 from members m where m.key = q.key and m.id = q.id + 1))
    union all select 'supporting_total', count(*) from kept where key like 'NATION_1%'
    union all select 'excerpt', count(*) from quoted where ordinal = 2
    union all select 'link', count(*) from quoted where ordinal = 3
    """
)
def check_tampered(spark, sf):
    """One kind of damage per check, each found as often as it was done."""
    rows, evidence, excerpts = _published(spark, sf)
    key, ordinal = F.col("key"), F.col("ordinal")
    damaged = rows.withColumn("value", F.when(key < "NATION_15", F.col("value") + 1).otherwise(F.col("value")))
    citations = _quoted(evidence, excerpts)
    moved = citations.withColumn(
        "entity_id", F.when(key >= "NATION_20", F.col("entity_id") + 1).otherwise(F.col("entity_id"))
    )
    miscounted = evidence_totals(evidence, ["key"]).withColumn(
        "total", F.when(key.startswith("NATION_1"), F.col("total") + 1).otherwise(F.col("total"))
    )
    misquoted = citations.withColumn(
        "excerpt", F.when(ordinal == 2, F.lit("something else")).otherwise(F.col("excerpt"))
    ).withColumn("url", F.when(ordinal == 3, F.lit("elsewhere")).otherwise(F.col("url")))
    found = checks.violations(
        checks.value_is_contributors(damaged, evidence, ["key"]),
        checks.rows_are_computed(damaged, rows, ["key", "value"]),
        checks.citation_membership(moved, evidence, excerpts, ["key"]).where(
            F.col("check") == "cited_non_contributor"
        ),
        checks.citation_totals(rows, citations, miscounted, evidence, ["key"], 3),
        checks.citation_texts(misquoted, excerpts, ["key"], _URL),
    )
    damaged = ["value_is_contributors", "rows_are_computed", "cited_non_contributor", "supporting_total", "excerpt", "link"]
    return _per_check(found, *damaged)


def _graph(spark, sf):
    return network.cooccurrence(star.part_names(spark, sf), kind="part", max_nodes=20)


_GRAPH_SQL = """
names as (
  select distinct l_orderkey as id, p_name as key from lineitem join part on l_partkey = p_partkey
),
pairs as (
  select a.key as source, b.key as target, a.id
  from names a join names b on a.id = b.id and a.key < b.key
),
kept as (select key from names group by 1 order by count(*) desc, key limit 20),
drawn as (
  select source, target, count(*) as weight from pairs
  where source in (from kept) and target in (from kept) group by 1, 2 having count(*) >= 2
)
"""


@query(
    f"""
    with {_GRAPH_SQL},
    gone as (
      select source || '|' || target as e, source, target from drawn
      where source like 'blue%' or target like 'blue%'
    )
    select 'node_size' as "check", count(*) as n from kept where key like 'blue%' or key like 'red%'
    union all select 'edge_weight', count(*) from drawn where source like 'hot%'
    union all select 'dangling_edge', cast(coalesce(sum(
        (source like 'blue%')::int + (target like 'blue%')::int), 0) as bigint) from gone
    union all select 'published_node', 2 * count(*) filter (where key like 'red%')
        + count(*) filter (where key like 'blue%') from kept
    union all select 'published_edge', 2 * count(*) from drawn where source like 'hot%'
    """
)
def check_graph_tampered(spark, sf):
    """Blue nodes are lost, red ones grow by one and edges from hot ones weigh one more."""
    graph = _graph(spark, sf)
    graph = replace(
        graph,
        nodes=durable(graph.nodes),
        edges=durable(graph.edges),
        edge_evidence=graph.edge_evidence.persist(StorageLevel.MEMORY_AND_DISK),
    )
    red = F.col("id").startswith("part:red")
    nodes = graph.nodes.where(~F.col("id").startswith("part:blue")).withColumn(
        "size", F.when(red, F.col("size") + 1).otherwise(F.col("size"))
    )
    hot = F.col("source").startswith("part:hot")
    edges = graph.edges.withColumn(
        "weight", F.when(hot, F.col("weight") + 1).otherwise(F.col("weight"))
    )
    found = checks.violations(
        checks.graph_counts(nodes, edges, graph.edge_evidence),
        checks.dangling_edges(nodes, edges),
        checks.published_graph(nodes, edges, graph.nodes, graph.edges),
        checks.node_contributors(graph.node_evidence, graph.edge_evidence),
    )
    return _per_check(found, "node_size", "edge_weight", "dangling_edge", "published_node", "published_edge")


@query(
    f"""
    with {_GRAPH_SQL},
    evidence as (
      select distinct unnest([source, target]) as key, id from pairs join drawn using (source, target)
    ),
    nodes as (select distinct key from evidence),
    damage as (
      select 'node_contributors' as "check", count(*) as n from evidence where key like 'red%' and id % 10 = 0
      union all select 'node_contributors', count(*) from nodes where key like 'hot%'
      union all select unnest(['published_node', 'published_node_repeated']), count(*) from nodes where key like 'cold%'
      union all select unnest(['published_edge', 'published_edge_repeated']), count(*) from drawn where source like 'blue%'
    )
    select "check", cast(sum(n) as bigint) as n from damage group by 1 having sum(n) > 0
    """
)
def check_graph_repeats(spark, sf):
    """Red nodes lose a tenth of their orders, hot ones claim one that is not theirs, cold ones and
    edges from blue ones are published twice."""
    graph = _graph(spark, sf)
    edge_evidence = graph.edge_evidence.persist(StorageLevel.MEMORY_AND_DISK)
    nodes, edges = durable(graph.nodes), durable(graph.edges)
    claimed = network.node_evidence(edge_evidence).where(~(F.col("id").startswith("part:red") & (F.col("entity_id") % 10 == 0)))
    invented = nodes.where(F.col("id").startswith("part:hot")).select("id", F.lit(-1).cast("bigint").alias("entity_id"))
    found = checks.violations(
        checks.node_contributors(claimed.unionByName(invented), edge_evidence),
        checks.published_graph(
            nodes.unionByName(nodes.where(F.col("id").startswith("part:cold"))),
            edges.unionByName(edges.where(F.col("source").startswith("part:blue"))),
            nodes,
            edges,
        ),
    )
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query(
    f"""
    with {_NATIONS_SQL},
    kept as (select key, count(*) as value from members group by 1 order by 2 desc, 1 limit 20),
    {_sample_sql("members", 3)},
    quoted as (select * from cited where key in (select key from kept)),
    damage as (
      select unnest(['cited_unknown_record', 'cited_non_contributor']) as "check", count(*) as n
      from quoted where key < 'NATION_15'
      union all select unnest(['supporting_total', 'more_citations_than_total']), count(*) from kept where key like 'NATION_2%'
      union all select 'uncited_value', count(*) from kept where key like 'NATION_1%'
      union all select 'unwanted_citations', count(*) from kept
      union all select unnest(['empty_excerpt', 'excerpt']), count(*) from quoted where ordinal = 1
      union all select 'not_empty', 1
      union all select 'provenance', 1
    )
    select "check", cast(sum(n) as bigint) as n from damage group by 1 having sum(n) > 0
    """
)
def check_citations_tampered(spark, sf):
    """Citations of records that do not exist, more of them than the total admits, values without any,
    citations that nobody asked for, empty excerpts, and a result without rows, reason or sources."""
    rows, evidence, excerpts = _published(spark, sf)
    citations, totals = _quoted(evidence, excerpts), durable(evidence_totals(evidence, ["key"]))
    key = F.col("key")
    unknown = citations.withColumn("entity_id", F.when(key < "NATION_15", -1 - F.col("entity_id")).otherwise(F.col("entity_id")))
    one = F.when(key.startswith("NATION_2"), F.lit(1).cast("bigint")).otherwise(F.col("total"))
    blank = citations.withColumn("excerpt", F.when(F.col("ordinal") == 1, F.lit("  ")).otherwise(F.col("excerpt")))
    empty = rows.agg(F.count("*").alias("processed")).withColumn("empty_reason", F.lit(None).cast("string"))
    sources = star.table(spark, sf, "orders").select(F.col("_metadata.file_path").alias("source"))
    found = checks.violations(
        checks.citation_membership(unknown, evidence, excerpts, ["key"]),
        checks.citation_totals(rows, citations.withColumn("total", one), totals.withColumn("total", one), evidence, ["key"], 3),
        checks.citation_totals(rows, citations.where(~key.startswith("NATION_1")), totals, evidence, ["key"], 3),
        checks.citation_totals(rows, citations, totals, evidence, ["key"], 0),
        checks.citation_texts(blank, excerpts, ["key"], _URL),
        checks.not_empty(rows.where(F.lit(False)), empty),
        checks.processed_count(empty, rows, sources.where(F.lit(False))),
    )
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query(
    f"""
    with {_GRAPH_SQL},
    members as (
      select 'part:' || source || '|part:' || target as key, id
      from pairs join drawn using (source, target)
    ),
    {_sample_sql("members", 3)}
    select key, ordinal, id as entity_id, total,
      '"' || o_orderpriority || '" — customer: "' || c_name || '"; parts.name: not reported' as excerpt
    from cited join orders on id = o_orderkey join customer on o_custkey = c_custkey
    """
)
def cite_edges(spark, sf):
    """Edges of a pruned graph, each with sampled orders and evidence from two fields."""
    evidence = _graph(spark, sf).edge_evidence
    cited = cite(evidence, ["source", "target"], 3)
    orders = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    excerpt = X.excerpt(
        F.col("o_orderpriority"),
        X.render_text("customer", F.col("c_name")),
        X.render_list("parts.name", F.lit(None).cast("array<string>")),
    )
    return quote(cited, orders, "o_orderkey", excerpt, _URL).select(
        F.concat_ws("|", "source", "target").alias("key"), "ordinal", "entity_id", "total", "excerpt"
    )


@query(
    """
    select 'merge_of_one' as "check", count(*) as n from part where p_type = 'PROMO'
    union all select 'merge_without_identity', count(*) from part where p_type = 'LARGE'
    union all select 'processed_count', 1
    union all select 'series_complete', count(distinct c_mktsegment) from customer
      where c_mktsegment like '%E'
    """
)
def check_claims_tampered(spark, sf):
    """Wrong merge claims, a manifest that is one off, and series left out of the rows."""
    kind = F.col("p_type")
    nodes = star.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(kind != "LARGE", F.col("p_brand")).alias("rxcui"),
        F.when(kind == "PROMO", 1).when(kind.isin("LARGE", "SMALL"), 2).alias("merged_names"),
    )
    orders = star.table(spark, sf, "orders")
    counted = orders.agg(F.count("*").alias("n")).select(
        (F.col("n") + 1).alias("processed"), F.lit(None).cast("string").alias("empty_reason")
    )
    promised = star.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("series")).distinct()
    found = checks.violations(
        checks.merge_claims(nodes),
        checks.processed_count(counted, orders, orders.select(F.col("_metadata.file_path").alias("source"))),
        checks.series_complete(promised.where(~F.col("series").endswith("E")), promised),
        checks.not_empty(orders, counted),
    )
    return _per_check(found, "merge_of_one", "merge_without_identity", "processed_count", "series_complete")


# --- whole jobs ------------------------------------------------------------------------------


@query(
    f"""
    with {star.STUDIES_SQL},
    kept as (
      select *, unnest(case when phases is null then ['No phase data'] else phases end) as key
      from studies where coalesce(status <> 'F', true)
        and cast(left(start_date, 4) as integer) between 1996 and 1999
    ),
    counts as (select key, count(*) as value from kept group by 1)
    select row_number() over (order by coalesce(list_position(
             ['EARLY_PHASE1', 'PHASE1', 'PHASE2', 'PHASE3', 'PHASE4', 'NA'], key), 99)) as position,
           case key when 'EARLY_PHASE1' then 'Early Phase 1' when 'PHASE1' then 'Phase 1'
             when 'PHASE2' then 'Phase 2' when 'PHASE3' then 'Phase 3'
             when 'NA' then 'Not Applicable' else key end as key, value
    from counts
    """
)
def job_phase_rows(spark, sf):
    job = Job(excluded_statuses=["f"], start_year=1996, end_year=1999, group_by="phase")
    return run(job, _studies(spark, sf)).rows.select("position", "key", "value")


@query(
    f"""
    with {star.STUDIES_SQL},
    members as (
      select 'Customer#' || lpad(n, 9, '0') as series, o_orderkey as id,
             coalesce(left(start_date, 4), 'No start date') as key
      from (values ('000000010'), ('000000011'), ('999999999')) as s(n)
           left join studies on c_name = 'Customer#' || lpad(n, 9, '0')
    ),
    counts as (select series, key, count(*) as value from members where id is not null group by 1, 2),
    shown as (
      select row_number() over (order by key = 'No start date', key, value desc, series) as position, *
      from counts
    )
    select * from shown
    union all
    select (select count(*) from shown) + row_number() over (order by min(position)),
           'Customer#999999999', key, 0 from shown group by key
    """
)
def job_compare_sponsors(spark, sf):
    """Two customers and one that does not exist, by year."""
    names = ["Customer#000000010", "Customer#000000011", "Customer#999999999"]
    job = Job(compare_kind="sponsor", compare=names, group_by="start_year")
    return run(job, _studies(spark, sf)).rows.select("position", "series", "key", "value")


@query(
    f"""
    with {star.STUDIES_SQL},
    kept as (select * from studies where status = 'O')
    select (select count(*) from kept) as processed, (select count(*) from kept) as fetched,
           (select count(*) from kept) as total_matching, (select count(*) from kept) as matched,
           cast(0 as bigint) as unbucketed, (select count(distinct c_name) from kept) as total_categories,
           cast(15 as bigint) as displayed_categories,
           (select count(distinct c_name) from kept) - 15 as omitted_categories,
           cast(null as varchar) as empty_reason
    """
)
def job_manifest(spark, sf):
    job = Job(statuses=[" o"], group_by="sponsor", top_n=15)
    return run(job, _studies(spark, sf)).manifest.select(
        "processed",
        "fetched",
        "total_matching",
        "matched",
        "unbucketed",
        "total_categories",
        "displayed_categories",
        "omitted_categories",
        "empty_reason",
    )


@query(
    f"""
    with {star.STUDIES_SQL},
    counts as (select c_name as key, count(*) as value from studies group by 1)
    select row_number() over (order by value desc, key) as position, key, value from counts
    """
)
def job_sponsors_all(spark, sf):
    """Without a top-N every category is reported."""
    return run(Job(group_by="sponsor"), _studies(spark, sf)).rows.select("position", "key", "value")


@query(
    f"""
    with {star.STUDIES_SQL}
    select 'NO_CHARTABLE_DATA' as empty_reason, count(*) as processed from studies
    where status is null
    """
)
def job_empty(spark, sf):
    """Orders with neither status are undated, and have no place on a year axis."""
    job = Job(excluded_statuses=["f", "o"], group_by="start_year", time_series=True)
    return run(job, _studies(spark, sf)).manifest.select("empty_reason", "processed")


def _placed(spark, sf):
    """Studies with their place in landed pages of a hundred."""
    key = F.col("o_orderkey")
    return _studies(spark, sf).withColumns(
        {"search_no": F.lit(0), "page_no": F.floor(key / 100).cast("int"), "pos": (key % 100).cast("int")}
    )


@query(
    f"""
    with {star.STUDIES_SQL},
    undated as (select count(*) as n from studies where status is null)
    select 'scope' as job, 'NO_MATCHING_TRIALS' as empty_reason, cast(0 as bigint) as processed, cast(0 as bigint) as fetched,
           false as truncated, cast(null as bigint) as cap, false as unscoped_sample, false as capped_before_filter,
           cast(null as bigint) as unfiltered_matching
    union all
    select 'status', 'NO_MATCHING_TRIALS', 0, 0, false, null, false, false, (select count(*) from studies)
    union all
    select 'undated', 'NO_CHARTABLE_DATA', n, (select count(*) from studies), false, null, false, false, null from undated
    union all
    select 'sample', 'NO_MATCHES_IN_FETCHED_SAMPLE', 0, 40, true, 40, false, true, null
    union all
    select 'unscoped', null, 40, 40, true, 40, true, false, null
    """
)
def job_empty_reasons(spark, sf):
    """Each of the three reasons for an empty result, and what a cap discloses."""
    studies = _placed(spark, sf)
    late = {"max_studies": 40, "start_year": 3000}
    jobs = {
        "scope": Job(sponsors=["nobody of this name"]),
        "status": Job(statuses=["withdrawn"]),
        "undated": Job(excluded_statuses=["f", "o"], group_by="start_year", time_series=True),
        "sample": Job(sponsors=["customer"], **late),
        "unscoped": Job(max_studies=40),
    }
    parts = [
        run(job, studies).manifest.select(
            F.lit(name).alias("job"), "empty_reason", "processed", "fetched", "truncated", "cap", "unscoped_sample",
            "capped_before_filter", "unfiltered_matching",
        )
        for name, job in jobs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_SHARED_CAP = 30

_SERIES_SQL = f"""
with {star.STUDIES_SQL},
placed as (select *, o_orderkey // 100 as page, o_orderkey % 100 as place from studies),
small as (
  select *, row_number() over (order by page, place) as nth from placed where c_name in ('Customer#000000001', 'Customer#000000002')
),
every as (select *, row_number() over (order by page, place) as nth from placed),
s1 as (select o_orderkey from small where nth <= {_SHARED_CAP} // 2),
left_over as (select {_SHARED_CAP} - (select count(*) from s1) as n),
s2 as (select o_orderkey from every where nth <= (select n from left_over))
"""


@query(
    f"""
    {_SERIES_SQL}
    select 'every one=' || (select n from left_over) || ',two customers=' || ({_SHARED_CAP} // 2) as shares,
           (select count(*) from (select * from s1 union select * from s2)) as processed,
           (select count(*) from (select * from s1 union select * from s2)) as fetched,
           (select greatest((select count(*) from small), (select count(*) from every))) as total_matching,
           true as truncated, cast({_SHARED_CAP} as bigint) as cap, false as unscoped_sample, false as capped_before_filter
    """
)
def job_shared_cap(spark, sf):
    """A cap shared by two series, of several values each; one does not use its share."""
    series = {
        "two customers": {"sponsors": ["Customer#000000001", "Customer#000000002"]},
        "every one": {"sponsors": ["customer", "nobody of this name"]},
    }
    job = Job(series=series, max_studies=_SHARED_CAP, group_by="status")
    shares = F.array_join(
        F.array_sort(F.transform(F.map_entries("series_shares"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ","
    )
    return run(job, _placed(spark, sf)).manifest.select(
        shares.alias("shares"), "processed", "fetched", "total_matching", "truncated", "cap", "unscoped_sample", "capped_before_filter"
    )


@query(
    f"""
    with {star.STUDIES_SQL},
    kept as (select coalesce(status, 'No status') as key from studies)
    select 'rows' as name, key, count(*) as n from kept group by key
    union all select 'totals', key, count(*) from kept group by key
    union all select 'manifest', null, 1
    union all select 'citations', key, 3 from kept group by key
    """
)
def result_written(spark, sf):
    """A result written table by table and read again."""
    result = run(Job(group_by="status", max_citations=3), _studies(spark, sf))
    folder = scratch_path(spark, "result")
    write_result(result.tables(), folder)
    found = read_result(spark, folder, ["rows", "citations", "manifest", "totals"])
    shown = found["rows"].select("position", "raw_key", "value")
    none = F.lit(None).cast("string")
    parts = [
        shown.select(F.lit("rows").alias("name"), F.col("raw_key").alias("key"), F.col("value").alias("n")),
        found["totals"].join(shown, "position").select(F.lit("totals").alias("name"), F.col("raw_key").alias("key"), F.col("total").alias("n")),
        found["manifest"].agg(F.count("*").alias("n")).select(F.lit("manifest").alias("name"), none.alias("key"), "n"),
        found["citations"].join(shown, "position").groupBy(F.col("raw_key").alias("key")).agg(F.count("*").alias("n"))
        .select(F.lit("citations").alias("name"), "key", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- studies with all their lists ------------------------------------------------------------


@query(f"with {star.LISTS_SQL} select entity_id, key, min(label) as label from agents group by 1, 2")
def study_agents_of_lists(spark, sf):
    return network.study_agents(star.full_studies(spark, sf))


@query(
    f"""
    with {star.LISTS_SQL}
    select 'intervention_type' as dimension, kind as key, count(distinct entity_id) as value
    from listed group by kind
    union all
    select 'country', nation, count(distinct entity_id) from listed group by nation
    union all
    select d, label, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem))
    from (values ('intervention_type', 'No interventions listed'), ('country', 'No location listed')) as u(d, label)
    """
)
def dist_of_lists(spark, sf):
    """Studies per intervention type and per country, from the lists of the record."""
    studies = star.full_studies(spark, sf)
    parts = []
    for name in ("intervention_type", "country"):
        members = measure.membership(studies, DIMENSIONS[name], S.ID_PATH)
        parts.append(measure.bucket_sizes(members).select(F.lit(name).alias("dimension"), "key", "value"))
    return parts[0].unionByName(parts[1])


@query(
    f"""
    with {star.LISTS_SQL},
    firsts as (select entity_id, key, min(label) as label from agents group by 1, 2)
    select entity_id, 'armsInterventionsModule.interventions[].name: ['
      || string_agg(label, ', ' order by key) || ']' as quoted
    from firsts group by 1
    """
)
def cite_agents(spark, sf):
    """Agent names of a record as evidence quotes them: the first form of each, by name."""
    studies = star.full_studies(spark, sf)
    quoted = studies.select(F.col(S.ID_PATH).alias("entity_id"), study_fragment("drug").alias("_q"))
    # Opened from a list of one, so that the filter does not quote every record a second time.
    opened = quoted.select("entity_id", F.explode(F.array("_q")).alias("quoted"))
    return opened.where(~F.col("quoted").endswith("not reported"))


@query(
    f"""
    with {star.LISTS_SQL},
    names as (select distinct entity_id as id, key from agents),
    pairs as (
      select a.key as source, b.key as target from names a join names b on a.id = b.id and a.key < b.key
    ),
    edges as (select source, target, count(*) as weight from pairs group by 1, 2 having count(*) >= 2)
    select row_number() over (order by weight desc, source, target) as position,
           'drug:' || source as source, 'drug:' || target as target, weight
    from edges
    """
)
def job_graph_all(spark, sf):
    """A graph job without limits, over all names of all records."""
    return run(Job(graph="drug_drug"), star.full_studies(spark, sf)).graph.edges


@query(
    f"""
    with {star.LISTS_SQL},
    names as (
      select distinct key as name, not regexp_full_match(key, '[a-z]{{1,4}}[0-9]{{3,}}') as single from agents
    )
    select count(*) as names, count(*) filter (where single) as resolved,
           count(*) filter (where not single) as unresolved,
           cast(0 as bigint) as merged, cast(0 as bigint) as violations from names
    """
)
def job_graph_resolved(spark, sf):
    """Every name of a graph job is looked up, however many there are, and all checks run. Short names
    with numbers are research codes, which are no single agents."""
    parts = star.table(spark, sf, "part").select(star.agent_name().alias("name")).distinct()
    key = X.normalize_name(F.col("name"))
    candidates = parts.select(
        key.alias("name"), key.alias("rxcui"), F.lit("20").alias("score"), F.lit(0).alias("rank")
    )
    ingredients = candidates.select(
        "rxcui", F.col("rxcui").alias("ingredient_rxcui"), F.col("rxcui").alias("ingredient_name")
    )
    result = run(Job(graph="drug_drug", max_nodes=10, max_citations=1), star.full_studies(spark, sf), candidates, ingredients)
    wrong = result.violations.count()
    return result.manifest.select(
        "names", "resolved", "unresolved", "merged", F.lit(wrong).cast("bigint").alias("violations")
    )
