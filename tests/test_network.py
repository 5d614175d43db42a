import random

import pytest
from conftest import drugs, record, values
from pyspark.sql import functions as F

from tallyproof.operators import network, synonyms


def studies(studies_of, *groups, **fields):
    return studies_of([record(i + 1, interventions=drugs(*names), **fields) for i, names in enumerate(groups)])


def nodes(graph):
    return {r.id: r["size"] for r in graph.nodes.collect()}


def edges(graph):
    return [tuple(r) for r in graph.edges.orderBy("position").select("source", "target", "weight").collect()]


def test_sizes_weights_and_minimum(studies_of):
    agents = network.study_agents(studies(studies_of, ("P", "C"), ("P", "C"), ("P", "L")))
    loose = network.cooccurrence(agents, min_weight=1)
    assert edges(loose) == [("drug:c", "drug:p", 2), ("drug:l", "drug:p", 1)]
    assert nodes(loose) == {"drug:p": 3, "drug:c": 2, "drug:l": 1}
    strict = network.cooccurrence(agents)
    assert edges(strict) == [("drug:c", "drug:p", 2)]
    # The size describes the drawn graph, not all records.
    assert nodes(strict) == {"drug:p": 2, "drug:c": 2}
    assert strict.totals.first().truncated_to is None


def test_agents_of_a_study(studies_of):
    found = studies_of(
        [
            record(
                1,
                interventions=[
                    ("DRUG", "Pembrolizumab 200 mg"),
                    ("DRUG", " Pembrolizumab "),
                    ("DRUG", "Placebo for lenvatinib"),
                    ("PROCEDURE", "Surgery"),
                    ("DRUG", "  "),
                    ("COMBINATION_PRODUCT", "A and B"),
                    ("BIOLOGICAL", "200 mg"),
                ],
            )
        ]
    )
    assert sorted(values(network.study_agents(found), "key", "label")) == [
        ("a and b", "A and B"),
        ("pembrolizumab", "Pembrolizumab 200 mg"),
    ]


@pytest.mark.parametrize("first_pool", [1, 3, None])
def test_cap_reports_what_is_drawn(studies_of, first_pool):
    groups = [("Anchor", f"Drug x{i:02d}", "Shared") for i in range(40)]
    agents = network.study_agents(studies(studies_of, *groups))
    graph = network.cooccurrence(agents, min_weight=1, max_nodes=10, first_pool=first_pool)
    assert set(nodes(graph)) == {"drug:anchor", "drug:shared"} | {f"drug:drug x{i:02d}" for i in range(8)}
    assert graph.totals.first().truncated_to == 10
    assert len(edges(graph)) == 1 + 2 * 8


@pytest.mark.parametrize("first_pool", [2, None])
def test_unconnected_keys_do_not_take_a_place(studies_of, first_pool):
    # Loner is the largest node but has no edge of weight 2.
    groups = [("Loner",)] * 6 + [("A", "B")] * 2 + [("C", "D")] * 2 + [("E", "F")]
    agents = network.study_agents(studies(studies_of, *groups))
    graph = network.cooccurrence(agents, max_nodes=3, first_pool=first_pool)
    # C is ranked third, but its only partner is not drawn.
    assert nodes(graph) == {"drug:a": 2, "drug:b": 2}
    assert graph.totals.first().truncated_to == 2


def test_hub_size_is_its_visible_edges(studies_of):
    groups = [("Hub", f"Partner p{i:02d}") for i in range(40) for _ in range(2)]
    agents = network.study_agents(studies(studies_of, *groups))
    graph = network.cooccurrence(agents, max_nodes=5)
    assert nodes(graph)["drug:hub"] == 2 * 4
    assert len(nodes(graph)) == 5
    by_node = graph.node_evidence.groupBy("id").count()
    assert {r.id: r["count"] for r in by_node.collect()} == nodes(graph)


def test_dense_record_gives_no_pairs(studies_of):
    letters = [f"{a}{b}x" for a in "abcdefghij" for b in "abcdefghij"]
    agents = network.study_agents(studies(studies_of, letters, ("Alpha", "Beta"), ("Alpha", "Beta")))
    graph = network.cooccurrence(agents, min_weight=1, max_entities=40)
    assert edges(graph) == [("drug:alpha", "drug:beta", 2)]
    assert graph.totals.first().dense_records_skipped == 1
    # Only a caller's limit leaves anything out.
    whole = network.cooccurrence(agents, min_weight=1)
    assert len(edges(whole)) == 100 * 99 // 2 + 1
    assert whole.totals.first().dense_records_skipped == 0


def test_exactly_the_limit_is_paired(studies_of):
    letters = [f"{a}{b}x" for a in "abcdefgh" for b in "abcde"]
    agents = network.study_agents(studies(studies_of, letters))
    assert network.edge_weights(agents, 1, 40).count() == 40 * 39 // 2
    assert network.edge_weights(agents, 1, 39).count() == 0


def test_graph_does_not_depend_on_partitioning(studies_of):
    found = studies(studies_of, ("A", "B", "C"), ("B", "C", "D"), ("A", "C"), ("D", "A"))
    results = []
    for n in (1, 5):
        graph = network.cooccurrence(network.study_agents(found.repartition(n)), min_weight=1, max_nodes=3)
        results.append((edges(graph), nodes(graph)))
    assert results[0] == results[1]


def test_label_is_the_commonest_form(spark):
    rows = [(1, "k", "Beta"), (2, "k", "Alpha"), (3, "k", "Beta"), (4, "m", "Z"), (5, "m", "A")]
    names = spark.createDataFrame(rows, "entity_id int, key string, label string")
    assert sorted(values(network.modal_labels(names), "key", "label", "votes")) == [("k", "Beta", 2), ("m", "A", 1)]


def test_bipartite(studies_of):
    found = studies_of(
        [
            record(1, sponsor="Merck", interventions=drugs("P")),
            record(2, sponsor=" merck ", interventions=drugs("P")),
            record(3, sponsor="BMS", interventions=drugs("N")),
            record(4, sponsor="  ", interventions=drugs("Q")),
            record(5, sponsor="Idle"),
        ]
    )
    sponsors, agents = network.study_sponsors(found), network.study_agents(found)
    graph = network.bipartite(sponsors, agents)
    assert edges(graph) == [("sponsor:merck", "drug:p", 2), ("sponsor:bms", "drug:n", 1)]
    assert nodes(graph) == {"sponsor:merck": 2, "sponsor:bms": 1, "drug:p": 2, "drug:n": 1}
    assert [r.kind for r in graph.nodes.orderBy("position").collect()] == ["drug", "drug", "sponsor", "sponsor"]
    assert graph.totals.first().truncated_to is None
    cut = network.bipartite(sponsors, agents, max_left=1)
    assert nodes(cut) == {"sponsor:merck": 2, "drug:p": 2}
    # Reported for the number of right keys in the data, though all linked ones are drawn.
    assert network.bipartite(sponsors, agents, max_right=2).totals.first().truncated_to == 4


def test_custom_entities(spark):
    names = spark.createDataFrame(
        [(i, k, k.upper()) for i, ks in enumerate(["ab", "ab", "bc"]) for k in ks], "entity_id int, key string, label string"
    )
    graph = network.cooccurrence(names, kind="gene")
    assert edges(graph) == [("gene:a", "gene:b", 2)]
    assert sorted(values(graph.nodes, "label", "kind")) == [("A", "gene"), ("B", "gene")]


# --- synonyms --------------------------------------------------------------------------------


def lookup(spark):
    candidates = spark.createDataFrame(
        [
            ("keytruda", "1547550", "14.2536", 0),
            ("pembrolizumab", "1547545", "13.6875", 0),
            ("edge", "E", "11.0", 0),
            ("below", "E", "10.99", 0),
            ("nan", "E", "NaN", 0),
            ("junk", "E", "high", 0),
            ("first", "E", "3", 0),
            ("first", "E", "50", 1),
            ("trikafta", "T", "20", 0),
            ("two", "W", "20", 0),
            ("idless", "", "20", 0),
        ],
        "name string, rxcui string, score string, rank int",
    )
    ingredients = spark.createDataFrame(
        [
            ("1547550", "1547545", "pembrolizumab"),
            ("1547545", "1547545", "pembrolizumab"),
            ("E", "E1", "edgeine"),
            ("W", "W1", "one"),
            ("W", "W2", "other"),
            ("W", None, "unusable"),
            ("1547545", "1547545", "pembrolizumab"),  # landed again
        ],
        "rxcui string, ingredient_rxcui string, ingredient_name string",
    )
    return candidates, ingredients


def test_resolution(spark):
    names = "keytruda pembrolizumab edge below nan junk first trikafta two idless unheard".split()
    table = spark.createDataFrame([(n,) for n in names] + [("edge",), ("keytruda and edge",)], "name string")
    crosswalk = synonyms.resolve_names(table, *lookup(spark))
    assert sorted(values(crosswalk, "name", "rxcui", "canonical_name")) == [
        ("edge", "E1", "edgeine"),
        ("keytruda", "1547545", "pembrolizumab"),
        ("pembrolizumab", "1547545", "pembrolizumab"),
    ]
    pool = spark.createDataFrame([("edge",)], "name string")
    assert synonyms.resolve_names(table, *lookup(spark), pool=pool).count() == 1
    total = synonyms.resolution_totals(table, crosswalk).first()
    assert (total.names, total.resolved, total.unresolved, total.merged) == (12, 3, 9, 1)


def test_merge_happens_before_pruning(spark, studies_of):
    found = studies(studies_of, ("Keytruda", "Cisplatin"), ("Pembrolizumab", "Cisplatin"), ("Pembrolizumab", "Carboplatin"))
    assert edges(network.cooccurrence(network.study_agents(found))) == []
    forms = synonyms.study_surface_forms(found)
    crosswalk = synonyms.resolve_names(forms, *lookup(spark))
    graph = network.cooccurrence(network.study_agents(found, crosswalk))
    assert edges(graph) == [("drug:cisplatin", "drug:rxcui:1547545", 2)]
    merged = graph.nodes.where("rxcui is not null").first()
    assert (merged.label, merged.rxcui, merged["size"]) == ("pembrolizumab", "1547545", 2)
    assert sorted(values(synonyms.merge_sources(forms, crosswalk), "key", "surface", "sources")) == [
        ("rxcui:1547545", "Keytruda", 2),
        ("rxcui:1547545", "Pembrolizumab", 2),
    ]
    both = studies_of([record(9, interventions=drugs("Keytruda 200 mg", "pembrolizumab"))])
    assert values(network.study_agents(both, crosswalk), "key", "label") == [("rxcui:1547545", "pembrolizumab")]


def test_resolution_reaches_combination_products(spark, studies_of):
    found = studies_of(
        [record(1, interventions=[("DRUG", "Keytruda")]), record(2, interventions=[("COMBINATION_PRODUCT", "keytruda")])]
    )
    forms = synonyms.study_surface_forms(found)
    assert values(forms, "name", "surface") == [("keytruda", "Keytruda")]
    crosswalk = synonyms.resolve_names(forms, *lookup(spark))
    assert values(network.sizes(network.study_agents(found, crosswalk)), "key", "size") == [("rxcui:1547545", 2)]


def test_candidate_names_break_ties_by_name(studies_of):
    agents = network.study_agents(studies(studies_of, ("B", "A"), ("C", "A"), ("B", "D")))
    assert [k for (k,) in values(network.candidate_names(agents, 3).orderBy(F.desc("size"), "key"), "key")] == ["a", "b", "c"]


def brute_edges(rows, least):
    """Weights and entities of all pairs of keys with at least ``least`` entities in common."""
    by_key = {}
    for entity, key in rows:
        by_key.setdefault(key, set()).add(entity)
    keys = sorted(by_key)
    found = {(a, b): by_key[a] & by_key[b] for i, a in enumerate(keys) for b in keys[i + 1 :]}
    return {pair: entities for pair, entities in found.items() if len(entities) >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("dense", [3, 8, 1000])
def test_dense_entities_give_all_edges(spark, least, dense):
    rng = random.Random(least)
    rows = sorted({(e, f"k{rng.randrange(25):02d}") for e in range(40) for _ in range(rng.choice([1, 2, 4, 9, 20]))})
    names = spark.createDataFrame(rows, "entity_id long, key string")
    edges, evidence = network.weighed_edges(names, least, dense)
    expected = brute_edges(rows, least)
    assert {(r.source, r.target): r.weight for r in edges.collect()} == {p: len(e) for p, e in expected.items()}
    found = values(evidence, "source", "target", "entity_id")
    assert sorted(found) == sorted((*pair, e) for pair, entities in expected.items() for e in entities)


def test_one_dense_entity_forms_few_pairs(spark, monkeypatch):
    """A record of 3,000 names is 4,498,500 pairs; only those that may be edges of three are formed."""
    rows = [(0, f"k{i:04d}") for i in range(3000)]
    rows += [(1 + i, f"k{j:04d}") for i in range(600) for j in (5 * i, 5 * i + 1)]
    rows += [(1000 + i, f"k{j:04d}") for i in range(2) for j in range(40)]
    names = spark.createDataFrame(rows, "entity_id long, key string")
    formed = []

    def counted(build):
        def run(*given):
            formed.append(build(*given).count())
            return build(*given)

        return run

    monkeypatch.setattr(network, "pairs", counted(network.pairs))
    monkeypatch.setattr(network, "_heavy_pairs", counted(network._heavy_pairs))
    found = {(r.source, r.target): r.weight for r in network.edge_weights(names, 3).collect()}
    assert found == {p: len(e) for p, e in brute_edges([r for r in rows if r[1] < "k0040"], 3).items()}
    assert sum(formed) < 10_000


def test_each_turn_counts_its_new_hubs_only(spark, monkeypatch):
    """Two or more turns, and no pair of key and entity is met twice."""
    rows = [(e, f"a{k}") for e in range(30) for k in range(8) if (e + k) % 8 == 0]  # large, unconnected
    rows += [(100 + e, f"b{k}") for e in range(3) for k in range(6)]
    names = spark.createDataFrame([(*r, r[1]) for r in rows], "entity_id long, key string, label string")
    met, real = [], network.hub_pairs

    def recorded(*given):
        found = real(*given)
        met.extend(values(found, "source", "target", "entity_id"))
        return found

    monkeypatch.setattr(network, "hub_pairs", recorded)
    graph = network.cooccurrence(names, min_weight=2, max_nodes=4, first_pool=2)
    assert [r.id for r in graph.nodes.collect()] == [f"drug:b{k}" for k in range(4)]
    assert len(met) == len(set(met)) == 3 * 15


def test_release_deletes_what_a_graph_wrote(spark):
    import pathlib

    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    names = spark.createDataFrame([(i, f"k{j}", "x") for i in range(3) for j in range(4)], "entity_id long, key string, label string")
    for more in ({}, {"max_nodes": 2}):
        graph = network.cooccurrence(names, **more)
        assert graph.edges.count() > 0 and set(folder.iterdir()) - before
        graph.release()
        assert set(folder.iterdir()) <= before


def test_rare_names_are_dropped_where_the_rows_lie(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (1, "b", "b"), (2, None, "c"), (3, None, "c")], "entity_id long, key string, label string")
    paired = network.paired_names(rows, 2)
    assert sorted((r.entity_id, r.key) for r in paired.collect()) == [(1, "a"), (2, "a")]
    assert "Broadcast" in paired._jdf.queryExecution().executedPlan().toString()
    graph = network.cooccurrence(rows, 1, max_nodes=2)
    assert graph.edge_evidence.inputFiles() and graph.edge_evidence.count() == 1


def test_edges_and_totals_come_without_evidence_and_labels(spark, monkeypatch):
    """Nor are sizes counted more than once."""
    names = spark.createDataFrame([(i, f"k{j}", "x") for i in range(3) for j in range(i + 2)], "entity_id long, key string, label string")
    counted, real = [], network.sizes
    monkeypatch.setattr(network, "sizes", lambda rows: counted.append(1) or real(rows))
    labels = network.modal_labels
    for more in ({}, {"max_nodes": 5}):
        monkeypatch.setattr(network, "modal_labels", None)
        graph = network.cooccurrence(names, **more)
        assert counted.pop() and not counted
        assert graph.totals.select("nodes", "edges").first() == (3, 3) and graph.edges.count() == 3
        monkeypatch.setattr(network, "modal_labels", labels)
        written = len(graph.made)
        assert graph.nodes.count() == 3 and graph.edge_evidence.count() == 7 and len(graph.made) > written
        graph.release()
