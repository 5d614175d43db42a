"""Names, synonyms and graphs over the order tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tallyproof.functions import text as X
from tallyproof.operators import network, synonyms
from tallyproof.plans import star
from tallyproof.plans.registry import query
from tallyproof.session import durable

# --- names -----------------------------------------------------------------------------------


def _decorated(spark, sf):
    """``(entity_id, type, name, pos)``: part names the way a registry would spell them."""
    name = F.col("p_name")
    spelled = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.upper(name), F.lit(" 200 mg/kg/day")))
        .when(F.col("l_returnflag") == "N", F.concat(name, F.lit(" (MK-3475) IV")))
        .otherwise(F.concat(F.lit(" "), F.initcap(name), F.lit("  Tablets ")))
    )
    kind = F.when(F.col("p_type") == "PROMO", F.lit("PROCEDURE")).otherwise(F.lit("DRUG"))
    return star.parts_of_orders(spark, sf, "p_name", "p_type").select(
        "entity_id", kind.alias("type"), spelled.alias("name"), "pos"
    )


_SPELLED_SQL = """
spelled as (
  select l_orderkey as id, p_name as key, l_linenumber as pos,
         case l_returnflag when 'A' then upper(p_name) || ' 200 mg/kg/day'
              when 'N' then p_name || ' (MK-3475) IV'
              else upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' '
                   || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]
                   || '  Tablets' end as surface
  from lineitem join part on l_partkey = p_partkey where p_type <> 'PROMO'
)
"""


def _agents(spark, sf):
    raw = _decorated(spark, sf).where(F.col("type") == "DRUG")
    return network.first_surface(network.agent_rows(raw))


@query(
    f"""
    with {_SPELLED_SQL}
    select key, count(distinct id) as size from spelled group by 1 order by 2 desc, 1 limit 25
    """
)
def names_candidates(spark, sf):
    return network.candidate_names(_agents(spark, sf), 25)


@query(f"with {_SPELLED_SQL} select distinct key as name, surface from spelled")
def names_surface_forms(spark, sf):
    return synonyms.surface_forms(_decorated(spark, sf))


@query(
    f"""
    with {_SPELLED_SQL},
    firsts as (
      select key, surface from (
        select *, row_number() over (partition by id, key order by pos, surface) as nth
        from spelled) where nth = 1
    ),
    votes as (select key, surface, count(*) as votes from firsts group by 1, 2)
    select key, surface as label, votes from (
      select *, row_number() over (partition by key order by votes desc, surface) as nth from votes
    ) where nth = 1
    """
)
def label_mode(spark, sf):
    return network.modal_labels(_agents(spark, sf))


@query("select p_partkey, p_name as key from part")
def normalize_names(spark, sf):
    name = F.col("p_name")
    decorated = (
        F.when(F.col("p_type") == "PROMO", F.concat(name, F.lit(" 200 mg")))
        .when(F.col("p_type") == "ECONOMY", F.concat(F.upper(name), F.lit(" (MK-3475)")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("Oral "), name, F.lit(" 5.5 mg / m2 / day")))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit(" +"), name, F.lit(" 1000 IU capsules -")))
        .when(F.col("p_type") == "SMALL", F.concat(name, F.lit(", subcutaneously; 200mg IV infusion")))
        .otherwise(F.concat(F.initcap(name), F.lit("  (a) 3%")))
    )
    return star.table(spark, sf, "part").select(
        "p_partkey", X.normalize_name(decorated).alias("key")
    )


@query(
    """
    select p_partkey,
           case p_type when 'SMALL' then 1 when 'LARGE' then 1 else 0 end as control,
           case p_type when 'PROMO' then 1 when 'ECONOMY' then 1 else 0 end as single_agent
    from part
    """
)
def names_single_agent(spark, sf):
    """Control arms and single agents, among names built from the part's words."""
    word = F.substring_index("p_name", " ", -1)
    built = (
        F.when(F.col("p_type") == "STANDARD", F.col("p_name"))
        .when(F.col("p_type") == "PROMO", word)
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("pegylated "), word, F.lit("-acid 5")))
        .when(F.col("p_type") == "LARGE", F.lit("standard of care"))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("mk-"), (F.col("p_size") + 1000).cast("string")))
        .otherwise(F.concat(F.lit("placebo for "), word))
    )
    key = X.normalize_name(built)
    return star.table(spark, sf, "part").select(
        "p_partkey",
        X.is_control_name(key).cast("int").alias("control"),
        X.is_single_agent(key).cast("int").alias("single_agent"),
    )


# --- co-occurrence ---------------------------------------------------------------------------

_PARTS_SQL = "names as (select distinct l_orderkey as id, l_partkey as key from lineitem)"
_NAMES_SQL = """
names as (
  select distinct l_orderkey as id, p_name as key from lineitem join part on l_partkey = p_partkey
)
"""


def _edges_sql(names: str, cap: int | None = None) -> str:
    limit = "false" if cap is None else f"count(*) > {cap}"
    return f"""
{names},
dense as (select id from names group by 1 having {limit}),
pairs as (
  select a.key as source, b.key as target, a.id from names a join names b
    on a.id = b.id and a.key < b.key where a.id not in (select id from dense)
),
edges as (select source, target, count(*) as weight from pairs group by 1, 2 having count(*) >= 2)
"""


@query(f"with {_edges_sql(_PARTS_SQL)} select * from edges")
def cooc_parts(spark, sf):
    return network.edge_weights(star.part_keys(spark, sf))


@query(f"with {_edges_sql(_PARTS_SQL, 8)} select * from edges")
def cooc_dense_guard(spark, sf):
    return network.edge_weights(star.part_keys(spark, sf), max_entities=8)


@query(f"with {_edges_sql(_PARTS_SQL, 8)} select count(*) as dense_records_skipped from dense")
def cooc_dense_skipped(spark, sf):
    return network.dense_skipped(star.part_keys(spark, sf), 8)


_NATIONS_SQL = """
names as (
  select distinct c_nationkey as id, p_name as key from lineitem join part on l_partkey = p_partkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
)
"""


@query(f"with {_edges_sql(_NATIONS_SQL)} select * from edges")
def cooc_uncapped(spark, sf):
    """Entities with all names of the parts table, far more than a record of the definition has."""
    buyers = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    names = star.parts_of_orders(spark, sf, "p_name").join(
        buyers.select(F.col("o_orderkey").alias("entity_id"), "c_nationkey"), "entity_id"
    )
    keys = names.select(F.col("c_nationkey").alias("entity_id"), F.col("p_name").alias("key")).distinct()
    return network.edge_weights(keys)


def _pruned_sql(names: str, max_nodes: int) -> str:
    return f"""
{_edges_sql(names)},
kept as (
  select key from names
  where key in (select source from edges union select target from edges)
  group by 1 order by count(*) desc, 'part:' || key limit {max_nodes}
),
drawn as (
  select * from edges where source in (from kept) and target in (from kept)
),
evidence as (
  select source, target, id from pairs join drawn using (source, target)
),
sized as (
  select key, count(distinct id) as size from (
    select source as key, id from evidence union all select target, id from evidence) group by 1
)
"""


_PRUNED_NAMES = _pruned_sql(_NAMES_SQL, 30)


@query(
    f"""
    with {_PRUNED_NAMES}
    select row_number() over (order by size desc, key) as position, 'part:' || key as id,
           key as label, size from sized
    """
)
def cooc_names_pruned(spark, sf):
    graph = network.cooccurrence(star.part_names(spark, sf), max_nodes=30, kind="part")
    return graph.nodes.select("position", "id", "label", "size")


@query(
    f"""
    with {_PRUNED_NAMES}
    select row_number() over (order by weight desc, source, target) as position,
           'part:' || source as source, 'part:' || target as target, weight from drawn
    """
)
def cooc_names_edges(spark, sf):
    return network.cooccurrence(star.part_names(spark, sf), max_nodes=30, kind="part").edges


_PARTS_TEXT_SQL = (
    "names as (select distinct l_orderkey as id, cast(l_partkey as varchar) as key from lineitem)"
)


def _parts_graph(spark, sf):
    names = star.part_keys(spark, sf).select(
        "entity_id",
        F.col("key").cast("string").alias("key"),
        F.col("key").cast("string").alias("label"),
    )
    return network.cooccurrence(names, max_nodes=50, kind="part")


@query(
    f"""
    with {_pruned_sql(_PARTS_TEXT_SQL, 50)}
    select row_number() over (order by size desc, key) as position, 'part:' || key as id, size
    from sized
    """
)
def cooc_parts_pruned(spark, sf):
    """Many small nodes: the pool of largest ones decides the graph."""
    return _parts_graph(spark, sf).nodes.select("position", "id", "size")


@query(
    f"""
    with {_pruned_sql(_PARTS_TEXT_SQL, 50)}
    select (select count(*) from sized) as nodes, (select count(*) from drawn) as edges,
           (select count(*) from sized) as truncated_to, cast(2 as bigint) as min_edge_weight,
           (select count(*) from dense) as dense_records_skipped
    """
)
def cooc_parts_totals(spark, sf):
    return _parts_graph(spark, sf).totals


# --- bipartite -------------------------------------------------------------------------------


def _bipartite(spark, sf):
    orders = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer").select("c_custkey", "c_name"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    sponsors = network.sponsor_rows(orders, "o_orderkey", "c_name")
    return network.bipartite(sponsors, star.part_names(spark, sf), 15, 25, right_kind="part")


_BIPARTITE_SQL = f"""
sponsors as (
  select o_orderkey as id, lower(c_name) as key, c_name as label
  from orders join customer on o_custkey = c_custkey
),
{_NAMES_SQL},
top_left as (select key from sponsors group by 1 order by count(*) desc, key limit 15),
links as (
  select s.key as source, n.key as target, n.id from sponsors s join names n using (id)
  where s.key in (from top_left)
),
top_right as (select target from links group by 1 order by count(*) desc, target limit 25),
drawn as (select * from links where target in (from top_right)),
edges as (
  select 'sponsor:' || source as source, 'part:' || target as target, count(*) as weight
  from drawn group by 1, 2
),
sized as (
  select 'sponsor' as kind, 'sponsor:' || source as id, count(distinct d.id) as size,
         (select min(label) from sponsors where key = source) as label
  from drawn d group by source
  union all
  select 'part', 'part:' || target, count(distinct d.id), target from drawn d group by target
)
"""


@query(
    f"""
    with {_BIPARTITE_SQL}
    select row_number() over (order by weight desc, source, target) as position, * from edges
    """
)
def bip_customer_name(spark, sf):
    return _bipartite(spark, sf).edges


@query(
    f"""
    with {_BIPARTITE_SQL}
    select row_number() over (order by kind, size desc, id) as position, id, label, kind, size
    from sized
    """
)
def bip_customer_name_nodes(spark, sf):
    return _bipartite(spark, sf).nodes.select("position", "id", "label", "kind", "size")


@query(
    f"""
    with {_BIPARTITE_SQL}
    select (select count(*) from sized) as nodes, (select count(*) from edges) as edges,
           (select count(*) from sized) as truncated_to, cast(1 as bigint) as min_edge_weight
    """
)
def bip_totals(spark, sf):
    return _bipartite(spark, sf).totals.select("nodes", "edges", "truncated_to", "min_edge_weight")


# --- synonyms --------------------------------------------------------------------------------


def _brands(spark, sf):
    """``(entity_id, type, name, pos)``: "blue bolt" becomes "bolt <qualifier>"."""
    first = F.substring_index("p_name", " ", 1)
    word = F.substring_index("p_name", " ", -1)
    qualifier = X.literal_map(_QUALIFIERS)[first]
    return star.parts_of_orders(spark, sf, "p_name").select(
        "entity_id",
        F.lit("DRUG").alias("type"),
        F.concat(word, F.lit(" "), qualifier).alias("name"),
        "pos",
    )


#: First word of a part name -> qualifier of the brand made from it.
_QUALIFIERS = {
    "blue": "acid",
    "cold": "sodium",
    "hot": "human",
    "large": "extended",
    "new": "free",
    "old": "base",
    "red": "therapy",
    "small": "arm",
}
#: Qualifier -> match score: on, above and below the threshold, not a number, not finite.
_SCORES = {
    "acid": "12.5",
    "sodium": "11",
    "human": "10.99",
    "extended": "NaN",
    "free": "high",
    "base": "14.25",
    "therapy": "13",
    "arm": "Infinity",
}


def _lookup_tables(spark, sf):
    """Candidates and ingredients for those brands. Anvils have two ingredients, gears none, and
    "base" brands rank a weak candidate before the strong one."""
    words = star.table(spark, sf, "part").select("p_name").distinct()
    first = F.substring_index("p_name", " ", 1)
    word = F.substring_index("p_name", " ", -1)
    qualifier = X.literal_map(_QUALIFIERS)[first]
    name = F.concat(word, F.lit(" "), qualifier).alias("name")
    ranked = words.select(
        name, F.concat(F.lit("C-"), word).alias("rxcui"), X.literal_map(_SCORES)[qualifier].alias("score"),
        F.lit(1).alias("rank"),
    )
    weak = words.where(first == "old").select(
        name, F.lit("C-other").alias("rxcui"), F.lit("3").alias("score"), F.lit(0).alias("rank")
    )
    concepts = words.select(word.alias("word")).distinct().where(F.col("word") != "gear")
    concept = F.concat(F.lit("C-"), "word").alias("rxcui")
    ingredients = concepts.select(
        concept, F.concat(F.lit("I-"), "word").alias("ingredient_rxcui"), F.col("word").alias("ingredient_name")
    ).unionByName(
        concepts.where(F.col("word") == "anvil").select(
            concept, F.lit("I-hammer").alias("ingredient_rxcui"), F.lit("hammer").alias("ingredient_name")
        )
    )
    return ranked.unionByName(weak), ingredients.unionByName(ingredients)  # landed twice


_SYNONYM_SQL = """
brands as (
  select distinct l_orderkey as id, split_part(p_name, ' ', 2) as word,
         case split_part(p_name, ' ', 1) when 'blue' then 'acid' when 'cold' then 'sodium'
              when 'hot' then 'human' when 'large' then 'extended' when 'new' then 'free'
              when 'old' then 'base' when 'red' then 'therapy' else 'arm' end as qualifier
  from lineitem join part on l_partkey = p_partkey
),
mapped as (
  select id, word || ' ' || qualifier as name,
         qualifier in ('acid', 'sodium', 'therapy') and word not in ('anvil', 'gear') as resolved,
         word
  from brands
),
keyed as (
  select id, name, case when resolved then 'rxcui:I-' || word else name end as key,
         case when resolved then word else name end as label, resolved from mapped
)
"""


def _crosswalk(spark, sf):
    forms = durable(synonyms.surface_forms(_brands(spark, sf)))
    candidates, ingredients = _lookup_tables(spark, sf)
    return forms, durable(synonyms.resolve_names(forms, candidates, ingredients))


@query(
    f"""
    with {_SYNONYM_SQL}
    select key, any_value(label) as label, count(distinct id) as size,
           case when any_value(resolved) then count(distinct name) end as sources
    from keyed group by key
    """
)
def synonym_merge(spark, sf):
    """Names merged before they are counted, with the number of names behind each merge."""
    forms, crosswalk = _crosswalk(spark, sf)
    rows = network.agent_rows(_brands(spark, sf), crosswalk)
    names = network.first_surface(rows).persist(StorageLevel.MEMORY_AND_DISK)
    sources = synonyms.merge_sources(forms, crosswalk).select("key", "sources").distinct()
    return (
        network.sizes(names)
        .join(network.modal_labels(names).select("key", "label"), "key")
        .join(sources, "key", "left")
        .select("key", "label", "size", "sources")
    )


@query(f"with {_SYNONYM_SQL} select distinct key, name as surface from keyed where resolved")
def synonym_sources(spark, sf):
    forms, crosswalk = _crosswalk(spark, sf)
    return synonyms.merge_sources(forms, crosswalk).select("key", "surface")


@query(
    f"""
    with {_SYNONYM_SQL}
    select count(distinct name) as names, count(distinct name) filter (where resolved) as resolved,
           count(distinct name) filter (where not resolved) as unresolved,
           count(distinct key) filter (where resolved) as merged
    from keyed
    """
)
def synonym_totals(spark, sf):
    forms, crosswalk = _crosswalk(spark, sf)
    return synonyms.resolution_totals(forms, crosswalk)


@query(
    f"""
    with {_pruned_sql(f'''{_SYNONYM_SQL}, names as (select distinct id, key from keyed)''', 10)}
    select row_number() over (order by size desc, key) as position, 'part:' || key as id, size,
           case when key like 'rxcui:%' then key[7:] end as rxcui
    from sized
    """
)
def synonym_graph(spark, sf):
    """A graph over merged names."""
    _forms, crosswalk = _crosswalk(spark, sf)
    rows = network.agent_rows(_brands(spark, sf), crosswalk)
    graph = network.cooccurrence(network.first_surface(rows), max_nodes=10, kind="part")
    return graph.nodes.select("position", "id", "size", "rxcui")
