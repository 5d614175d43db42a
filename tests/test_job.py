import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from conftest import drugs, record, values
from test_network import lookup

from tallyproof.plans.job import Job, run
from tallyproof.sources.results import read_result, write_result


@pytest.fixture
def studies(studies_of):
    agents = [("Keytruda", "Cisplatin"), ("Pembrolizumab", "Cisplatin"), ("Nivolumab",), ("Keytruda 200 mg", "Placebo")]
    return studies_of(
        [
            record(
                i + 1,
                title=f"Study {i}",
                start=str(2018 + i) if i < 9 else None,
                status=["RECRUITING", "COMPLETED", None][i % 3],
                sponsor=["Merck", "BMS"][i % 2],
                phases=[["PHASE1", "PHASE2"], ["PHASE3"], None][i % 3],
                interventions=drugs(*agents[i % 4]),
                countries=["France", "Japan"][: i % 3],
                conditions=["Melanoma", "Lung Cancer"][: 1 + i % 2],
            )
            for i in range(12)
        ]
    )


def ordered(result, *columns):
    return values(result.rows.orderBy("position"), *columns)


def fact(result, name):
    return result.manifest.first()[name]


def test_chart(spark, studies, tmp_path):
    result = run(Job(group_by="phase"), studies)
    assert ordered(result, "key", "value") == [("Phase 1", 4), ("Phase 2", 4), ("Phase 3", 4), ("No phase data", 4)]
    assert result.violations.count() == 0
    assert result.citations.count() == 12
    assert (fact(result, "processed"), fact(result, "matched"), fact(result, "unbucketed")) == (12, 12, 4)
    assert fact(result, "empty_reason") is None and not fact(result, "truncated")
    write_result(result.tables(), str(tmp_path / "out"))
    found = read_result(spark, str(tmp_path / "out"), ["rows", "citations", "manifest"])
    assert found["rows"].count() == 4
    result.release()


def test_scope_status_and_years(studies):
    job = Job(conditions=["lung cancer"], excluded_statuses=["Completed"], start_year=2018, end_year=2024, group_by="start_year", time_series=True)
    result = run(job, studies)
    assert ordered(result, "key", "value") == [
        (str(y), 1 if y in (2021, 2023) else 0) for y in range(2018, 2025)
    ]
    assert values(result.accounting, "filter", "before", "after", "missing") == [
        ("status_excluded", 6, 4, 0),
        ("year", 4, 2, 2),
    ]
    assert result.violations.count() == 0


def test_comparison_with_an_empty_series(studies):
    job = Job(compare_kind="drug", compare=["cisplatin", "Nivolumab", "Aspirin"], group_by="status")
    result = run(job, studies)
    assert result.violations.count() == 0
    by_series = {}
    for series, value in ordered(result, "series", "value"):
        by_series[series] = by_series.get(series, 0) + value
    assert by_series == {"cisplatin": 6, "Nivolumab": 3, "Aspirin": 0}
    assert fact(result, "processed") == 9


def test_cap_is_disclosed(studies):
    result = run(Job(max_studies=5, group_by="country"), studies)
    assert (fact(result, "fetched"), fact(result, "total_matching"), fact(result, "truncated")) == (5, 12, True)
    assert fact(result, "unscoped_sample") and not fact(result, "capped_before_filter")
    none = run(Job(sponsors=["merck"], max_studies=2, start_year=2050), studies)
    assert fact(none, "empty_reason") == "NO_MATCHES_IN_FETCHED_SAMPLE" and fact(none, "capped_before_filter")
    assert none.rows.count() == 0 and none.violations.count() == 0


def test_cap_is_shared_by_series(studies):
    job = Job(compare_kind="drug", compare=["cisplatin", "nivolumab", "aspirin"], max_studies=7, group_by="status")
    result = run(job, studies)
    assert fact(result, "series_shares") == {"cisplatin": 2, "nivolumab": 2, "aspirin": 3}
    assert (fact(result, "processed"), fact(result, "total_matching"), fact(result, "truncated")) == (4, 6, True)
    by_series = {}
    for series, value in ordered(result, "series", "value"):
        by_series[series] = by_series.get(series, 0) + value
    assert by_series == {"cisplatin": 2, "nivolumab": 2, "aspirin": 0}
    assert result.violations.count() == 0


def test_empty_results_say_why(studies):
    assert fact(run(Job(drugs=["aspirin"]), studies), "empty_reason") == "NO_MATCHING_TRIALS"
    unheard = run(Job(sponsors=["merck"], statuses=["withdrawn"]), studies)
    assert (fact(unheard, "empty_reason"), fact(unheard, "unfiltered_matching")) == ("NO_MATCHING_TRIALS", 6)
    undated = studies.where("protocolSection.statusModule.startDateStruct.date is null")
    result = run(Job(group_by="start_year", time_series=True), undated)
    assert fact(result, "empty_reason") == "NO_CHARTABLE_DATA"
    assert result.violations.count() == 0


def test_no_citations(studies):
    result = run(Job(max_citations=0), studies)
    assert result.citations.count() == 0 and result.violations.count() == 0
    # What supports a number is still told.
    assert sorted(values(result.totals, "total")) == sorted(values(result.rows, "value"))
    graph = run(Job(graph="drug_drug", max_citations=0), studies)
    assert graph.totals.where("datum = 'edge'").count() == graph.graph.edges.count() > 0


def test_equal_series_are_one(studies):
    job = Job(compare_kind="drug", compare=["Cisplatin", "cisplatin ", "CISPLATIN", "nivolumab"], group_by="status")
    result = run(job, studies)
    assert {s for (s,) in ordered(result, "series")} == {"Cisplatin", "nivolumab"}
    assert fact(result, "series_collapsed") == 2 and result.violations.count() == 0


def test_limits_are_the_callers(spark, studies_of):
    many = studies_of(
        [record(i + 1, title="t" * 300, sponsor=f"Sponsor {i:02d}", interventions=drugs(*[f"agent{k}x" for k in range(45)])) for i in range(30)]
    )
    assert run(Job(group_by="sponsor"), many).rows.count() == 30
    top = run(Job(group_by="sponsor", top_n=4, title_length=20), many)
    assert top.rows.count() == 4 and top.violations.count() == 0
    assert all(r.excerpt.startswith('"' + "t" * 20 + '..."') for r in top.citations.collect())
    whole = run(Job(graph="drug_drug", max_citations=0), many)
    assert whole.graph.edges.count() == 45 * 44 // 2 and whole.graph.nodes.count() == 45
    assert run(Job(graph="sponsor_drug", max_left=3, max_right=5, max_citations=0), many).graph.edges.count() == 15


def test_violations_of_a_graph_are_found(studies, monkeypatch):
    """A damaged excerpt in a graph's citations does not pass."""
    from tallyproof.plans import job as plans

    honest = plans.quote
    monkeypatch.setattr(plans, "quote", lambda *a: honest(*a).withColumn("excerpt", F.lit("something else")))
    result = run(Job(graph="drug_drug"), studies)
    assert result.violations.where("check = 'excerpt'").count() == result.citations.count() > 0


@pytest.mark.parametrize("kind", ["drug_drug", "sponsor_drug"])
def test_graph(spark, studies, kind):
    result = run(Job(graph=kind), studies, *lookup(spark))
    assert result.violations.count() == 0
    merged = result.graph.nodes.where("rxcui = '1547545'").first()
    assert merged.label == "pembrolizumab"
    if kind == "drug_drug":
        assert values(result.graph.edges, "source", "target", "weight") == [("drug:cisplatin", "drug:rxcui:1547545", 6)]
    assert sorted(s for (s,) in values(result.merged_from, "surface")) == ["Keytruda", "Keytruda 200 mg", "Pembrolizumab"]
    quoted = [r.excerpt for r in result.citations.where("datum = 'edge'").collect()]
    assert quoted and all("interventions[].name: [" in q for q in quoted)
    assert all(("leadSponsor.name" in q) == (kind == "sponsor_drug") for q in quoted)
    assert fact(result, "resolved") == 2 and fact(result, "min_edge_weight") == (2 if kind == "drug_drug" else 1)


def test_release_deletes_what_was_written(spark, studies):
    import pathlib

    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    result = run(Job(group_by="sponsor"), studies)
    assert result.rows.count() == 2 and result.citations.count() > 0
    assert set(folder.iterdir()) - before
    result.release()
    assert set(folder.iterdir()) <= before
    with pytest.raises(AnalysisException):
        run(Job(graph="drug_drug"), studies, candidates=studies, ingredients=7)
    assert set(folder.iterdir()) <= before


def test_rejected_requests():
    for wrong in ({"max_citations": -1}, {"group_by": "colour"}, {"compare": ["a"], "compare_kind": "phase"}):
        with pytest.raises(ValueError):
            Job(**wrong)


def test_blank_values_are_none_and_years_in_order(studies):
    job = Job(conditions=["  ", "lung \t cancer"], sponsors=[" "], free_text="  ")
    assert (job.conditions, job.sponsors, job.free_text) == (["lung cancer"], [], None)
    assert fact(run(job, studies), "processed") == 6
    wrong = [
        {"start_year": 2021, "end_year": 2020},
        {"series": {"a": {"phases": ["1"]}}},
        {"series": {"a": {"drugs": [" "]}}},
        {"series": {" ": {"drugs": ["x"]}}},
        {"series": {"a": {"drugs": ["x"]}}, "compare": ["y"], "compare_kind": "drug"},
    ]
    for given in wrong:
        with pytest.raises(ValueError):
            Job(**given)


def test_series_with_scopes_of_their_own(studies):
    """Several values and several fields in a series; a field that a series leaves out is the job's."""
    scopes = {
        "PD-1": {"drugs": ["keytruda", "pembrolizumab", "nivolumab"], "sponsors": ["merck"]},
        "Platinum in Japan": {"drugs": ["cisplatin"], "countries": ["japan"]},
        "pd-1 ": {"drugs": ["cisplatin"]},
        "Nothing": {"drugs": ["aspirin"]},
    }
    job = Job(series=scopes, sponsors=["bms"], group_by="sponsor")
    assert list(job.scopes) == ["PD-1", "Platinum in Japan", "Nothing"]
    result = run(job, studies)
    found = {(r.series, r.key): r.value for r in result.rows.collect() if r.value}
    # Study i has agents i % 4, sponsor i % 2 and countries up to i % 3.
    pd1 = [i for i in range(12) if i % 2 == 0]
    platinum = [i for i in range(12) if i % 2 == 1 and i % 4 == 1 and i % 3 == 2]
    assert found == {("PD-1", "Merck"): len(pd1), ("Platinum in Japan", "BMS"): len(platinum)}
    assert {r.series for r in result.rows.collect()} == set(job.scopes)
    assert fact(result, "series_collapsed") == 1 and result.violations.count() == 0
    result.release()
    shared = run(Job(series=scopes, sponsors=["bms"], group_by="sponsor", max_studies=4), studies)
    assert set(fact(shared, "series_shares")) == set(job.scopes) and shared.violations.count() == 0


def test_rows_alone_compute_nothing_else(studies, monkeypatch):
    from tallyproof.plans import job as plans

    for name in ("cite", "evidence_totals"):
        monkeypatch.setattr(plans, name, lambda *_: pytest.fail("not asked for"))
    assert run(Job(group_by="phase"), studies).rows.count() == 4


def test_a_published_graph_is_drawn_once_more(studies, monkeypatch):
    """Nodes and edges that are not those of the records do not pass."""
    from dataclasses import replace

    from tallyproof.plans import job as plans

    honest, turns = plans._graph, []

    def damaged(*given):
        graph = honest(*given)
        turns.append(1)
        if len(turns) > 1:
            return graph
        extra = graph.nodes.limit(1).withColumn("id", F.lit("drug:invented"))
        evidence = graph.edge_evidence.where("entity_id <> 'NCT00000001'")
        return replace(graph, nodes=graph.nodes.unionByName(extra), edges=graph.edges.unionByName(graph.edges.limit(1)), edge_evidence=evidence)

    monkeypatch.setattr(plans, "_graph", damaged)
    found = run(Job(graph="drug_drug", max_citations=0), studies).violations.select("check").distinct().collect()
    assert {"published_node", "published_edge", "published_edge_repeated", "node_contributors"} <= {r.check for r in found}


def test_edges_come_without_keeping_the_records(spark, studies):
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = len(held())
    result = run(Job(graph="drug_drug"), studies)
    assert result.graph.edges.count() > 0 and len(held()) == before
    assert result.citations.count() > 0 and result.violations.count() == 0 and len(held()) > before
    result.release()
    assert len(held()) == before
