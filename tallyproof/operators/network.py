"""Graphs of entities that share a record.

Names arrive as ``(entity_id, key, label)`` rows, one per entity and key. A node's size and an
edge's weight are counts of distinct entities; the entities themselves stay in evidence rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.functions.names import is_agent
from tallyproof.functions.text import is_control_name, normalize_name, strip
from tallyproof.operators.measure import restrict
from tallyproof.session import broadcast_if_small, collected, delete_paths, durable, keep, kept as kept_table, number_report_rows, number_rows, one_row, small

MERGED_PREFIX = "rxcui:"
#: Entities with more keys give pairs only where those can be edges.
DENSE_KEYS = 1000


class _Table:
    """A table of a graph, or a function that gives it when it is first read. The paths of tables that are
    written for it are noted in the graph."""

    def __set_name__(self, owner, name: str) -> None:
        self.name = name

    def __set__(self, graph: Graph, given: DataFrame | Callable[[], DataFrame]) -> None:
        vars(graph)[self.name] = given

    def __get__(self, graph: Graph | None, owner=None) -> DataFrame:
        if graph is None:
            raise AttributeError(self.name)  # a field without a default
        found = vars(graph)[self.name]
        if callable(found):
            made: list[str] = []
            with collected(made):
                found = vars(graph)[self.name] = found()
            graph.made.extend(made)
        return found


@dataclass(frozen=True)
class Graph:
    """``nodes(position, id, label, kind, size, rxcui)``, ``edges(position, source, target,
    weight)``, ``edge_evidence(source, target, entity_id)`` and a one-row ``totals``."""

    nodes: DataFrame = _Table()
    edges: DataFrame = _Table()
    edge_evidence: DataFrame = _Table()
    totals: DataFrame = _Table()
    held: list[DataFrame] = field(default_factory=list)
    #: Paths of the tables that the graph reads.
    made: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Drop what was kept for reading the graph more than once, and delete what was written. The
        graph cannot be read after that."""
        delete_paths(self.made)
        for table in self.held:
            table.unpersist()

    @property
    def node_evidence(self) -> DataFrame:
        return node_evidence(self.edge_evidence)


# --- entities of a record --------------------------------------------------------------------


def first_surface(rows: DataFrame) -> DataFrame:
    """``(entity_id, key, label, pos)`` -> one row per entity and key with its first label."""
    return (
        rows.groupBy("entity_id", "key")
        .agg(F.min(F.struct("pos", "label")).alias("_first"))
        .select("entity_id", "key", F.col("_first.label").alias("label"))
    )


def merge_names(names: DataFrame, crosswalk: DataFrame | None) -> DataFrame:
    """Replace resolved keys by the shared identity, and their labels by the canonical name.

    Done before anything is counted, so that fragments of one compound add up. Names without an
    identity keep their own key.
    """
    if crosswalk is None:
        return names
    known = crosswalk.select(
        F.col("name").alias("key"), F.col("rxcui").alias("_id"), "canonical_name"
    )
    merged = F.concat(F.lit(MERGED_PREFIX), F.col("_id"))
    others = [c for c in names.columns if c not in ("key", "label")]
    return names.join(known, "key", "left").select(
        *others,
        F.coalesce(merged, F.col("key")).alias("key"),
        F.coalesce("canonical_name", "label").alias("label"),
    )


def agent_rows(raw: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """``(entity_id, name, pos)`` -> ``(entity_id, key, label, pos)`` without control arms.

    Names are cleaned in their rows, by built-in functions; only the crosswalk is joined. The key is a list
    of one that is opened: a plain column would be worked out again for each condition on it.
    """
    cleaned = raw.select(
        "entity_id",
        F.explode(F.array(normalize_name(F.col("name")))).alias("key"),
        strip(F.col("name")).alias("label"),
        "pos",
    ).where((F.col("key") != "") & ~is_control_name(F.col("key")))
    return merge_names(cleaned, crosswalk).select("entity_id", "key", "label", "pos")


def study_agents(studies: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """Agents of a study table: one row per study and agent."""
    listed = studies.select(
        F.col(S.ID_PATH).alias("entity_id"), F.posexplode(S.INTERVENTIONS_PATH).alias("pos", "_i")
    )
    raw = listed.where(is_agent(F.col("_i.type"), F.col("_i.name"))).select(
        "entity_id", F.col("_i.name").alias("name"), "pos"
    )
    return first_surface(agent_rows(raw, crosswalk))


def sponsor_rows(entities: DataFrame, id_col: str | Column, name: str | Column) -> DataFrame:
    """``(entity_id, key, label)`` of a scalar name column; blank names are no sponsor."""
    entity_id = F.col(id_col) if isinstance(id_col, str) else id_col
    label = strip(F.col(name) if isinstance(name, str) else name)
    return entities.select(
        entity_id.alias("entity_id"), F.lower(label).alias("key"), label.alias("label")
    ).where(F.coalesce(F.col("label"), F.lit("")) != "")


def study_sponsors(studies: DataFrame) -> DataFrame:
    return sponsor_rows(studies, S.ID_PATH, S.SPONSOR_PATH)


# --- sizes and labels ------------------------------------------------------------------------


def sizes(names: DataFrame) -> DataFrame:
    """Distinct entities per key."""
    return names.groupBy("key").agg(F.count("*").alias("size"))


def candidate_names(names: DataFrame, k: int | None = None) -> DataFrame:
    """All names with their sizes, or the ``k`` in most entities; ties by name."""
    counted = sizes(names)
    return counted if k is None else counted.orderBy(F.desc("size"), "key").limit(k)


def modal_labels(names: DataFrame) -> DataFrame:
    """Most frequent label per key, one vote per entity; ties alphabetical."""
    votes = names.groupBy("key", "label").agg(F.count("*").alias("_votes"))
    best = Window.partitionBy("key").orderBy(F.desc("_votes"), "label")
    return (
        votes.withColumn("_nth", F.row_number().over(best))
        .where(F.col("_nth") == 1)
        .select("key", "label", F.col("_votes").alias("votes"))
    )


# --- pairs inside an entity ------------------------------------------------------------------


def dense_entities(names: DataFrame, max_entities: int) -> DataFrame:
    """``(entity_id)`` of the entities with more than ``max_entities`` keys."""
    keys = names.groupBy("entity_id").agg(F.count("*").alias("_keys"))
    return keys.where(F.col("_keys") > max_entities).select("entity_id")


def dense_skipped(names: DataFrame, max_entities: int | None) -> DataFrame:
    """One row: how many entities are left out of the pairs; none without a limit."""
    if max_entities is None:
        return names.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("dense_records_skipped"))
    return dense_entities(names, max_entities).agg(F.count("*").alias("dense_records_skipped"))


def paired_names(
    names: DataFrame, min_weight: int, max_entities: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """``(entity_id, key)`` that can be on an edge of ``min_weight``. ``counted`` are the `sizes` of ``names``, if
    they are at hand.

    An edge is never heavier than its smaller end, so keys of fewer entities are dropped without
    loss; where those are few, rows stay where they are. ``names`` is best a table. Only a caller's ``max_entities`` leaves out whole entities.
    """
    rows = names.select("entity_id", "key")
    if max_entities is not None:
        rows, counted = rows.join(dense_entities(names, max_entities), "entity_id", "left_anti"), None
    if min_weight > 1:
        if counted is None:
            counted = durable(sizes(rows))
        counted = counted.where(F.col("key").isNotNull())
        rare, rows = counted.where(F.col("size") < min_weight).select("key"), rows.where(F.col("key").isNotNull())
        few = broadcast_if_small(rare)
        if few is rare:
            return durable(rows.join(counted.where(F.col("size") >= min_weight).select("key"), "key", "left_semi"))
        rows = rows.join(few, "key", "left_anti")
    return rows


def pairs(names: DataFrame) -> DataFrame:
    """``(source, target, entity_id)`` for every unordered pair of keys of an entity.

    An inner join of rows: Spark can split the rows of an entity that has very many.
    """
    one = names.select("entity_id", F.col("key").alias("source"))
    other = names.select("entity_id", F.col("key").alias("target"))
    return one.join(other, "entity_id").where(F.col("source") < F.col("target")).select(
        "source", "target", "entity_id"
    )


def hub_rows(names: DataFrame, hubs: DataFrame, n_hubs: int) -> DataFrame:
    """``(entity_id, _hub)`` of ``hubs(key)``: written, so that a few are known to be few and the names need
    not move."""
    return durable(restrict(names, hubs.select("key"), n_hubs).select("entity_id", F.col("key").alias("_hub")))


def hub_pairs(names: DataFrame, hubs: DataFrame, n_hubs: int, hub: DataFrame | None = None) -> DataFrame:
    """As :func:`pairs`, but only pairs with one of ``hubs(key)`` in them: hubs times names, never
    names times names. ``hub`` are their `hub_rows`, if they are at hand."""
    hub = hub_rows(names, hubs, n_hubs) if hub is None else hub
    marked = names.join(small(hubs.select("key", F.lit(True).alias("_is_hub")), n_hubs), "key", "left")
    marked = marked.withColumn("_is_hub", F.coalesce("_is_hub", F.lit(False)))
    both = hub.join(marked, "entity_id")
    # Between two hubs the pair is met from both sides; one of them is enough.
    once = (F.col("key") != F.col("_hub")) & (~F.col("_is_hub") | (F.col("_hub") < F.col("key")))
    return both.where(once).select(
        F.least("_hub", "key").alias("source"), F.greatest("_hub", "key").alias("target"), "entity_id"
    )


def weights(pair_rows: DataFrame, min_weight: int = 1) -> DataFrame:
    return (
        pair_rows.groupBy("source", "target")
        .agg(F.count("*").alias("weight"))
        .where(F.col("weight") >= min_weight)
    )


def split_dense(rows: DataFrame, dense: int) -> tuple[DataFrame, DataFrame | None]:
    """``(entity_id, key)`` of the entities with at most ``dense`` keys, and ``(entity_id, key, nth)`` of
    the others, numbered from the one with the fewest keys; None when there are none."""
    counted = rows.groupBy("entity_id").agg(F.count("*").alias("_keys")).where(F.col("_keys") > dense)
    counted = durable(counted)
    if counted.isEmpty():
        return rows, None
    ordered = number_rows(counted, F.col("_keys"), F.col("entity_id"), name="nth").select("entity_id", "nth")
    return rows.join(counted.select("entity_id"), "entity_id", "left_anti"), rows.join(ordered, "entity_id")


def _heavy_pairs(sets: DataFrame, min_weight: int) -> DataFrame:
    """``(source, target, weight)`` of the keys that share at least ``min_weight`` dense entities.

    Two sets that share w elements, in one order of all elements, share one among the first
    ``size - w + 1`` of each: those alone are met, so a key of fewer than w dense entities meets none,
    and the densest entities, which are last in the order, are met by the fewest. A pair is formed
    where its first common element is met.
    """
    first = F.slice("entities", F.lit(1), F.size("entities") - min_weight + 1)
    met = sets.where(F.size("entities") >= min_weight).select("key", "entities", F.explode(first).alias("nth"))
    one = met.select(F.col("key").alias("source"), F.col("entities").alias("_a"), "nth")
    other = met.select(F.col("key").alias("target"), F.col("entities").alias("_b"), "nth")
    common = F.array_intersect("_a", "_b")
    return (
        one.join(other, "nth")
        .where(F.col("source") < F.col("target"))
        .where(F.arrays_overlap("_a", "_b") & (F.array_min(common) == F.col("nth")))
        .select("source", "target", F.size(common).cast("bigint").alias("weight"))
        .where(F.col("weight") >= min_weight)
    )


def weighed_edges(rows: DataFrame, min_weight: int, dense: int = DENSE_KEYS) -> tuple[DataFrame, DataFrame]:
    """All edges ``(source, target, weight)`` of ``rows(entity_id, key)``, and their evidence
    ``(source, target, entity_id)``.

    Pairs are formed of the entities with at most ``dense`` keys. Of the denser ones each key has the
    sorted set; the sets add to the pairs that were formed, and bring the pairs that they alone make
    heavy enough, which are found through parts of the sets (`_heavy_pairs`). So a dense entity gives
    pairs only where they can be edges.
    """
    light, heavy = split_dense(rows, dense)
    evidence = pairs(light)
    if heavy is None:
        edges = durable(weights(evidence, min_weight))
        connected = rows.join(_ends(edges).distinct(), "key", "left_semi")
        return edges, pairs(connected).join(edges.select("source", "target"), ["source", "target"], "left_semi")
    sets = durable(heavy.groupBy("key").agg(F.array_sort(F.collect_set("nth")).alias("entities")))
    of = {end: sets.select(F.col("key").alias(end), F.col("entities").alias(f"_{end}")) for end in ("source", "target")}
    none = F.array().cast("array<bigint>")
    shared = F.size(F.array_intersect(F.coalesce("_source", none), F.coalesce("_target", none))).cast("bigint")
    formed = durable(weights(evidence))
    both = formed.join(of["source"], "source", "left").join(of["target"], "target", "left")
    both = both.select("source", "target", (F.col("weight") + shared).alias("weight")).where(F.col("weight") >= min_weight)
    alone = _heavy_pairs(sets, min_weight).join(formed.select("source", "target"), ["source", "target"], "left_anti")
    edges = durable(both.unionByName(alone))
    ends = edges.select("source", "target")
    numbers = heavy.select("entity_id", "nth").distinct()
    dense_evidence = (
        ends.join(of["source"], "source").join(of["target"], "target")
        .select("source", "target", F.explode(F.array_intersect("_source", "_target")).alias("nth"))
        .join(numbers, "nth").select("source", "target", "entity_id")
    )
    return edges, evidence.join(ends, ["source", "target"], "left_semi").unionByName(dense_evidence)


def edge_weights(
    names: DataFrame, min_weight: int = V.MIN_EDGE_WEIGHT, max_entities: int | None = None, dense: int = DENSE_KEYS
) -> DataFrame:
    """All edges ``(source, target, weight)`` of the unpruned co-occurrence graph."""
    return weighed_edges(paired_names(kept_table(names), min_weight, max_entities), min_weight, dense)[0]


# --- published graph -------------------------------------------------------------------------


def _ends(edges: DataFrame, *more: str) -> DataFrame:
    """Each edge once per end."""
    return edges.select(F.explode(F.array("source", "target")).alias("key"), *more)


def node_evidence(edge_evidence: DataFrame) -> DataFrame:
    """``(id, entity_id)``: the entities on a node's drawn edges."""
    return _ends(edge_evidence, "entity_id").distinct().withColumnRenamed("key", "id")


def _prefixed(edges: DataFrame, source_kind: str, target_kind: str) -> DataFrame:
    return edges.withColumn(
        "source", F.concat(F.lit(f"{source_kind}:"), "source")
    ).withColumn("target", F.concat(F.lit(f"{target_kind}:"), "target"))


def _numbered(rows: DataFrame, bounded: bool, *order) -> DataFrame:
    """Positions in one task only where a caller's limit bounds the graph."""
    return (number_report_rows if bounded else number_rows)(rows, *order)


def _numbered_edges(edges: DataFrame, bounded: bool) -> DataFrame:
    return _numbered(edges, bounded, F.desc("weight"), F.col("source"), F.col("target")).select(
        "position", "source", "target", "weight"
    )


def _published_nodes(
    evidence: DataFrame, names_by_kind: dict[str, DataFrame], kept: DataFrame | None, n: int | None
) -> DataFrame:
    """Nodes over the drawn edges: size from the edges, label from all records."""
    labels = None
    for kind, names in names_by_kind.items():
        if kept is not None:
            names = restrict(names, kept.where(F.col("kind") == kind).select("key"), n)
        part = modal_labels(names).select(
            F.lit(kind).alias("kind"), "key", "label"
        )
        labels = part if labels is None else labels.unionByName(part)
    labels = labels.withColumn("id", F.concat_ws(":", "kind", "key"))
    drawn = node_evidence(evidence).groupBy("id").agg(F.count("*").alias("size"))
    merged = F.startswith(F.col("key"), F.lit(MERGED_PREFIX))
    rxcui = F.when(merged, F.substring(F.col("key"), len(MERGED_PREFIX) + 1, 1_000_000))
    nodes = drawn.join(labels if n is None else small(labels, n), "id").select(
        "id", "label", "kind", "size", rxcui.alias("rxcui")
    )
    return _numbered(nodes, n is not None, F.col("kind"), F.desc("size"), F.col("id")).select(
        "position", "id", "label", "kind", "size", "rxcui"
    )


def _connected_hubs(
    ranked: DataFrame, rows: DataFrame, min_weight: int, max_nodes: int, pool: int
) -> tuple[DataFrame, DataFrame]:
    """The ``max_nodes`` largest keys with a partner, and one more if there is one; and the rows of all keys
    that were looked at.

    Pairs are counted around the largest keys only: when more than ``max_nodes`` of them turn out
    to be connected, no smaller key can be drawn, and the answer is exact. Otherwise the pool grows
    fourfold, up to all keys. A turn counts the pairs of its new keys with each other and with smaller
    ones; those with larger keys were counted in the turns before, which are stored.
    """
    hubs, touched, seen, left = None, None, None, rows
    while True:
        pooled = durable(ranked.orderBy(F.desc("size"), "key").limit(pool))
        new = pooled if hubs is None else pooled.join(small(hubs.select("key"), pool), "key", "left_anti")
        own = hub_rows(left, new, pool)
        seen = own if seen is None else seen.unionByName(own)
        counted = _ends(weights(hub_pairs(left, new, pool, own), min_weight)).distinct()
        counted = durable(counted)
        touched = counted if touched is None else touched.unionByName(counted)
        # Only what touches a hub was counted, so only hubs are known to be connected or not.
        connected = small(pooled, pool).join(touched.distinct(), "key")
        best = durable(connected.orderBy(F.desc("size"), "key").limit(max_nodes + 1))
        if best.count() > max_nodes or pooled.count() < pool:
            return best, seen.withColumnRenamed("_hub", "key")
        left = rows.join(small(pooled.select("key"), pool), "key", "left_anti")
        hubs, pool = pooled, pool * 4


def _owning(build):
    """A graph that knows, and deletes on an error, the tables that were written for it."""

    @wraps(build)
    def run(*given, **more) -> Graph:
        made: list[str] = []
        with collected(made):
            graph = build(*given, **more)
        graph.made.extend(made)
        return graph

    return run


@_owning
def cooccurrence(
    names: DataFrame,
    min_weight: int = V.MIN_EDGE_WEIGHT,
    max_nodes: int | None = None,
    max_entities: int | None = None,
    kind: str = "drug",
    first_pool: int | None = None,
    dense: int = DENSE_KEYS,
) -> Graph:
    """Undirected co-occurrence graph, of all connected keys or the ``max_nodes`` largest ones.

    Nodes rank by their global size among keys with at least one surviving edge. ``max_entities``
    leaves out entities with more keys; by default none is left out, and without ``max_nodes`` those
    with more than ``dense`` keys give pairs only where they can be edges.
    """
    names = kept_table(names)
    ranked = None
    if max_nodes is not None or min_weight > 1 and max_entities is None:
        ranked = durable(sizes(names))
    # What can be paired is read in every turn of the search for the largest connected keys.
    rows = paired_names(names, min_weight, max_entities, ranked)
    kept = found = None
    if max_nodes is None:
        edges, evidence = weighed_edges(rows, min_weight, dense)
    else:
        pool = first_pool or max(4 * max_nodes, V.CANDIDATE_POOL)
        best, seen = _connected_hubs(ranked, rows, min_weight, max_nodes, pool)
        found = best.count()
        kept = best.orderBy(F.desc("size"), "key").limit(max_nodes).withColumn("kind", F.lit(kind))
        evidence = pairs(restrict(seen, kept.select("key"), max_nodes))
        edges = durable(weights(evidence, min_weight))
        drawn = small(edges.select("source", "target"), max_nodes * max_nodes)
        evidence = evidence.join(drawn, ["source", "target"], "left_semi")

    # Who reads the edges does not pay for what supports them.
    def nodes() -> DataFrame:
        return _published_nodes(graph.edge_evidence, {kind: names}, kept, max_nodes)

    def totals() -> DataFrame:
        truncated = found is not None and found > max_nodes
        # Every end of an edge is a node, and no other key is.
        return one_row(
            dense_skipped(names, max_entities),
            _ends(edges).distinct().agg(F.count("*").alias("nodes")),
            edges.agg(F.count("*").alias("edges")),
        ).select(
            "nodes",
            "edges",
            (F.col("nodes") if truncated else F.lit(None).cast("bigint")).alias("truncated_to"),
            F.lit(min_weight).cast("bigint").alias("min_edge_weight"),
            "dense_records_skipped",
        )

    def numbered() -> DataFrame:
        return _numbered_edges(_prefixed(edges, kind, kind), max_nodes is not None)

    graph = Graph(nodes, numbered, lambda: durable(_prefixed(evidence, kind, kind)), totals)
    return graph


@_owning
def bipartite(
    left: DataFrame,
    right: DataFrame,
    max_left: int | None = None,
    max_right: int | None = None,
    left_kind: str = "sponsor",
    right_kind: str = "drug",
    min_weight: int = 1,
) -> Graph:
    """Links between two kinds of names of the same entity, of all names or the busiest.

    With ``max_left`` the busiest left keys are kept first, and the left side is cut to them before
    the join, so an entity contributes at most ``max_left`` rows per right name; with ``max_right``
    the right keys with most links to those.
    """
    held: list[DataFrame] = []
    left, right = keep(left, held), keep(right, held)
    ours = left if max_left is None else restrict(left, candidate_names(left, max_left).select("key"), max_left)
    links = ours.select("entity_id", F.col("key").alias("source")).join(
        right.select("entity_id", F.col("key").alias("target")), "entity_id"
    )
    if max_right is not None:
        top_right = links.groupBy("target").agg(F.count("*").alias("size"))
        top_right = durable(top_right.orderBy(F.desc("size"), "target").limit(max_right).select("target"))
        links = restrict(links, top_right, max_right, "target")
    links = links.select("source", "target", "entity_id")
    if min_weight > 1:
        heavy = weights(links, min_weight).select("source", "target")
        links = links.join(heavy, ["source", "target"], "left_semi")
    evidence = _prefixed(links, left_kind, right_kind)
    bounded = max_left is not None and max_right is not None
    bound = max_left + max_right if bounded else None
    nodes = _published_nodes(evidence, {left_kind: left, right_kind: right}, None, bound)
    edges = weights(evidence)
    over = F.lit(False)
    counts = []
    for rows, limit, name in ((left, max_left, "_left"), (right, max_right, "_right")):
        if limit is not None:
            counts.append(sizes(rows).limit(limit + 1).agg(F.count("*").alias(name)))
            over = over | (F.col(name) > limit)
    totals = one_row(
        nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")), *counts
    ).select(
        "nodes",
        "edges",
        F.when(over, F.col("nodes")).alias("truncated_to"),
        F.lit(min_weight).cast("bigint").alias("min_edge_weight"),
        F.lit(0).cast("bigint").alias("dense_records_skipped"),
    )
    return Graph(nodes, _numbered_edges(edges, bounded), evidence, totals, held)
