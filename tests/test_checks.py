"""Damage one property of a right result at a time; exactly that check must object."""

from pathlib import Path

import pytest
from compare import connect, difference
from conftest import drugs, record, values
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyproof.operators import checks, measure, network
from tallyproof.operators.citations import cite, evidence_totals, quote, study_excerpt
from tallyproof.operators.dimensions import DIMENSIONS
from tallyproof.functions.fixed_values import STUDY_URL_FORMAT

KEYS = ["key"]
SF = "/root/testdata/sf0.001"


@pytest.fixture
def parts(four):
    members = measure.membership(four, DIMENSIONS["status"], "entity_id")
    rows = measure.bucket_counts(members, DIMENSIONS["status"])
    evidence = members.select(DIMENSIONS["status"].display(F.col("key")).alias("key"), "entity_id")
    citations = quote(cite(evidence, KEYS, 3), four, "entity_id", study_excerpt("status"))
    expected = four.select("entity_id", study_excerpt("status").alias("excerpt"))
    return {"rows": rows, "computed": rows, "evidence": evidence, "citations": citations, "records": expected, "limit": 3}


def failing(rows, computed, evidence, citations, records, limit):
    found = checks.violations(
        checks.value_is_contributors(rows, evidence, KEYS),
        checks.rows_are_computed(rows, computed, ["key", "value"]),
        checks.citation_membership(citations, evidence, records, KEYS),
        checks.citation_totals(rows, citations, evidence_totals(evidence, KEYS), evidence, KEYS, limit),
        checks.citation_texts(citations, records, KEYS, STUDY_URL_FORMAT),
    )
    assert found.columns == ["check", "datum", "expected", "actual"]
    return {c for (c,) in values(found, "check")}


def damage(name):
    some = F.col("ordinal") == 1

    def change(column, value):
        return lambda p: p["citations"].withColumn(column, F.when(some, value).otherwise(F.col(column)))

    return {
        "value": ("rows", lambda p: p["rows"].withColumn("value", F.col("value") + 1)),
        "zero": ("rows", lambda p: p["rows"].withColumn("value", F.lit(0).cast("bigint"))),
        "order": ("rows", lambda p: p["rows"].withColumn("position", F.col("position") + 1)),
        "foreign": ("citations", change("entity_id", F.lit("NCT99999999"))),
        "total": ("citations", lambda p: p["citations"].withColumn("total", F.lit(9).cast("bigint"))),
        "short": ("citations", lambda p: p["citations"].withColumn("total", F.lit(1).cast("bigint"))),
        "none": ("citations", lambda p: p["citations"].where("false")),
        "unwanted": ("limit", lambda p: 0),
        "excerpt": ("citations", change("excerpt", F.lit("made up"))),
        "blank": ("citations", change("excerpt", F.lit(" "))),
        "link": ("citations", change("url", F.lit("https://example.org"))),
    }[name]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("value", {"value_is_contributors", "rows_are_computed"}),
        ("zero", {"value_is_contributors", "rows_are_computed"}),
        ("order", {"rows_are_computed"}),
        ("foreign", {"cited_unknown_record", "cited_non_contributor", "link"}),
        ("total", {"supporting_total"}),
        ("short", {"supporting_total", "more_citations_than_total"}),
        ("none", {"uncited_value"}),
        ("unwanted", {"unwanted_citations"}),
        ("excerpt", {"excerpt"}),
        ("blank", {"empty_excerpt", "excerpt"}),
        ("link", {"link"}),
    ],
)
def test_damage_is_found(parts, name, expected):
    assert failing(**parts) == set()
    target, change = damage(name)
    assert failing(**{**parts, target: change(parts)}) == expected


def test_member_of_another_bucket_is_no_evidence(spark, four):
    evidence = spark.createDataFrame([("a", "NCT00000001"), ("b", "NCT00000002")], "key string, entity_id string")
    swapped = evidence.withColumn("key", F.when(F.col("key") == "a", "b").otherwise("a"))
    found = checks.citation_membership(swapped, evidence, four, KEYS)
    assert [c for (c,) in values(found, "check")] == ["cited_non_contributor"] * 2


@pytest.fixture
def graph(studies_of):
    groups = [("A", "B"), ("A", "B"), ("A", "C"), ("A", "C")]
    found = studies_of([record(i + 1, interventions=drugs(*g)) for i, g in enumerate(groups)])
    return network.cooccurrence(network.study_agents(found))


def graph_failures(graph, nodes=None, edges=None):
    nodes = graph.nodes if nodes is None else nodes
    edges = graph.edges if edges is None else edges
    found = checks.violations(
        checks.graph_counts(nodes, edges, graph.edge_evidence),
        checks.dangling_edges(nodes, edges),
        checks.published_graph(nodes, edges, graph.nodes, graph.edges),
    )
    return {c for (c,) in values(found, "check")}


def test_graph_damage_is_found(graph):
    assert graph_failures(graph) == set()
    a = F.col("id") == "drug:a"
    grown = graph.nodes.withColumn("size", F.when(a, 9).otherwise(F.col("size")).cast("bigint"))
    assert graph_failures(graph, nodes=grown) == {"node_size", "published_node"}
    lost = graph.nodes.where(~a)
    assert graph_failures(graph, nodes=lost) == {"node_size", "dangling_edge", "published_node"}
    heavy = graph.edges.withColumn("weight", F.col("weight") * 10)
    assert graph_failures(graph, edges=heavy) == {"edge_weight", "published_edge"}
    twice = graph.nodes.unionByName(graph.nodes.where(a))
    assert graph_failures(graph, nodes=twice) == {"published_node_repeated", "published_node"}
    some = graph.edges.unionByName(graph.edges.limit(1))
    assert graph_failures(graph, edges=some) == {"published_edge_repeated", "published_edge"}


def test_node_contributors(graph):
    right = graph.node_evidence
    assert checks.node_contributors(right, graph.edge_evidence).count() == 0
    assert checks.node_contributors(right.where("id <> 'drug:a'"), graph.edge_evidence).count() == 4


def test_merge_claims(spark):
    rows = [("a", "X", 2), ("b", None, 2), ("c", "X", 1), ("d", None, None)]
    nodes = spark.createDataFrame(rows, "id string, rxcui string, merged_names int")
    assert sorted(values(checks.merge_claims(nodes), "check", "datum")) == [("merge_of_one", "c"), ("merge_without_identity", "b")]


def test_manifest_checks(spark, four):
    manifest = lambda n, why: spark.createDataFrame([(n, why)], "processed bigint, empty_reason string")
    source = spark.createDataFrame([("file",)], "source string")
    names = lambda df: [c for (c,) in values(df, "check")]
    assert names(checks.processed_count(manifest(4, None), four, source)) == []
    assert names(checks.processed_count(manifest(5, None), four, source)) == ["processed_count"]
    assert names(checks.processed_count(manifest(4, None), four, source.where("false"))) == ["provenance"]
    assert names(checks.not_empty(four, manifest(4, None))) == []
    assert names(checks.not_empty(four.where("false"), manifest(0, None))) == ["not_empty"]
    assert names(checks.not_empty(four.where("false"), manifest(0, "NO_MATCHING_TRIALS"))) == []
    promised = spark.createDataFrame([("a",), ("b",)], "series string")
    assert values(checks.series_complete(promised.where("series = 'a'"), promised), "datum") == [("b",)]


@pytest.mark.parametrize("name, absent", [("check_graph_tampered", "blue"), ("check_claims_tampered", "PROMO")])
def test_damage_that_nothing_has_is_counted_as_none(spark, tmp_path, name, absent):
    for path in Path(SF).glob("*.parquet"):
        if path.stem != "part":
            (tmp_path / path.name).symlink_to(path)
    part = spark.read.parquet(f"{SF}/part.parquet")
    for column in ("p_name", "p_type"):
        part = part.withColumn(column, F.replace(column, F.lit(absent), F.lit("other")))
    part.write.parquet(str(tmp_path / "written"))
    (tmp_path / "part.parquet").symlink_to(next((tmp_path / "written").glob("*.parquet")))
    assert difference(entry.queries()[name](spark, str(tmp_path)), connect(str(tmp_path)), entry.oracle_sql()[name]) is None
