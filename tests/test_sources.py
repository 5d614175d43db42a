import contextlib
import json

import pytest
from pyspark.errors import StreamingQueryException
from conftest import drugs, record, values, write_pages
from pyspark.sql import functions as F

from tallyproof.operators import manifest
from tallyproof.operators.filters import empty_probe, filter_accounting, phases_in, status_in, status_not_in, year_between
from tallyproof.sources import pages as P
from tallyproof.sources import synonyms
from tallyproof.sources.results import read_result, write_result
from tallyproof.streaming.ingest import SOURCE_ORDER, ingest


def test_pages_in_source_order(spark, tmp_path):
    path = write_pages(tmp_path / "p", [record(3)], [record(1), record(2)], totalCount=3, dataTimestamp="2026-08-08")
    pages = P.read_pages(spark, path)
    studies = P.studies_of_pages(pages)
    assert values(studies.orderBy(*SOURCE_ORDER), "page_no", "pos", "entity_id") == [
        (0, 0, "NCT00000003"),
        (1, 0, "NCT00000001"),
        (1, 1, "NCT00000002"),
    ]
    assert values(P.data_as_of(pages), "data_as_of") == [("2026-08-08",)]
    facts = P.search_facts(pages).first()
    assert (facts.fetched, facts.total_matching) == (3, 3)
    assert P.malformed_pages(pages).count() == 0
    assert manifest.provenance(pages).count() == 2


def test_only_read_fields_are_scanned(spark, tmp_path, four):
    four.write.parquet(str(tmp_path / "t"))
    status = spark.read.parquet(str(tmp_path / "t")).select("protocolSection.statusModule.overallStatus")
    schema = status._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].strip()
    assert schema.startswith("struct<protocolSection:struct<statusModule:struct<overallStatus:string>>>")


@pytest.mark.parametrize(
    "body",
    [
        "[1, 2]",
        '"text"',
        "not json",
        '{"studies": 7}',
        '{"totalCount": "many", "studies": []}',
        '{"totalCount": true, "studies": []}',
        '{"nextPageToken": {"a": 1}}',
        '{"nextPageToken": 5}',
    ],
)
def test_malformed_pages_are_reported(spark, tmp_path, body):
    folder = tmp_path / "bad"
    write_pages(folder, [record(1)])
    (folder / "x.json").write_text(body)
    pages = P.read_pages(spark, str(folder))
    assert [r.source.rsplit("/", 1)[1] for r in P.malformed_pages(pages).collect()] == ["x.json"]
    assert values(P.studies_of_pages(pages), "entity_id") == [("NCT00000001",)]
    if "nextPageToken" not in body:
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            P.read_pages(spark, str(folder), strict=True).collect()


def test_admission(spark):
    ids = spark.createDataFrame([(i,) for i in ["NCT00000001", "BADID", "NCT1", "nct00000001", "NCT000000011", "", None]], "entity_id string")
    usable, refused = P.admit(ids, "entity_id")
    assert values(usable, "entity_id") == [("NCT00000001",)]
    assert refused.count() == 6
    assert P.admit(ids, "entity_id", "^BAD")[0].count() == 1


def test_first_writer_wins(spark):
    rows = [("a", 1, 0), ("a", 0, 5), ("a", 0, 2), ("b", 0, 9)]
    df = spark.createDataFrame(rows, "entity_id string, search_no int, pos int").repartition(3)
    assert sorted(values(P.first_writer(df, "entity_id", ["search_no", "pos"]), "entity_id", "search_no", "pos")) == [("a", 0, 2), ("b", 0, 9)]
    plan = P.first_writer(df, "entity_id", ["search_no", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_cap(spark):
    df = spark.range(100).select(F.col("id").alias("pos")).repartition(5)
    expected = list(range(7))
    assert sorted(v for (v,) in values(P.capped(df, ["pos"], 7), "pos")) == expected
    assert P.capped(df, ["pos"], 0).count() == 0


def test_cap_is_shared_by_distinct_ids(spark):
    ids = lambda *r: spark.createDataFrame([(i,) for i in range(*r)], "id int")
    searches = {"a": ids(0, 10), "b": ids(5, 100), "c": ids(0, 100)}
    rows, facts = P.split_cap(searches, "id", ["id"], 60)
    assert {k: (v["share"], v["fetched"], v["capped"]) for k, v in facts.items()} == {
        "a": (20, 10, False),
        "b": (25, 25, True),
        "c": (30, 30, True),
    }
    assert {r.series: r["count"] for r in rows.groupBy("series").count().collect()} == {"a": 10, "b": 25, "c": 30}
    rows, facts = P.split_cap({"a": ids(0, 10), "b": ids(0, 10), "c": ids(0, 9)}, "id", ["id"], 2)
    assert [f["share"] for f in facts.values()] == [0, 1, 1]


def test_fetch_totals(spark):
    rows = [(100, True, 100), (5, True, None), (3, False, None)]
    df = spark.createDataFrame(rows, "fetched bigint, capped boolean, total_matching bigint")
    total = lambda i: tuple(manifest.fetch_totals(df.where(f"fetched = {rows[i][0]}")).first())
    assert total(0) == (100, False)  # all of it was read, whatever stopped the reading
    assert total(1) == (None, True)
    assert total(2) == (None, False)
    assert tuple(manifest.fetch_totals(df).first()) == (100, True)


def test_empty_reasons():
    why = manifest.empty_reason
    assert why(0, 0, 50, True, True) == "NO_MATCHES_IN_FETCHED_SAMPLE"
    assert why(0, 0, 50, False, True) == "NO_MATCHING_TRIALS"
    assert why(0, 0, 0, True, True) == "NO_MATCHING_TRIALS"
    assert why(3, 0, 3, False, False) == "NO_CHARTABLE_DATA"
    assert why(3, 1, 3, False, False) is None


def test_filters(spark, studies_of):
    status = F.col("protocolSection.statusModule.overallStatus")
    year = F.substring("protocolSection.statusModule.startDateStruct.date", 1, 4).cast("int")
    studies = studies_of([record(1), record(2, status=None), record(3, status="COMPLETED", start=None), record(4, phases=["EARLY_PHASE1"])])
    count = lambda p: studies.where(p).count()
    assert count(status_in([" recruiting "], status)) == 2
    assert count(status_not_in(["Recruiting"], status)) == 2
    assert count(year_between(year, 2020, 2019)) == 0
    assert count(year_between(year, None, 2020)) == 3
    assert count(phases_in([0], F.col("protocolSection.designModule.phases"))) == 1
    with pytest.raises(ValueError):
        phases_in([3, 5], status)
    steps = {"status": status_not_in(["recruiting"], status), "year": year_between(year, 2000, None)}
    assert values(filter_accounting(studies, steps), "filter", "before", "after") == [("status", 4, 2), ("year", 2, 1)]
    assert tuple(empty_probe(studies, F.lit(True), status == "X").first()) == (0, 4)
    assert tuple(empty_probe(studies, F.lit(True), status == "COMPLETED").first()) == (1, None)


def test_synonym_payloads(spark, tmp_path):
    folder = tmp_path / "approx"
    folder.mkdir()
    one = {"rxcui": "1547550", "score": "14.2536", "rank": "1", "source": "X"}
    (folder / "a.json").write_text(json.dumps({"term": "keytruda", "approximateGroup": {"candidate": [one, {**one, "score": "3"}]}}))
    (folder / "b.json").write_text(json.dumps({"term": "unheard", "approximateGroup": {"inputTerm": None}}))
    found = synonyms.read_candidates(spark, str(folder))
    assert sorted(values(found, "name", "rxcui", "score", "rank")) == [("keytruda", "1547550", "14.2536", 0), ("keytruda", "1547550", "3", 1)]
    folder = tmp_path / "related"
    folder.mkdir()
    group = {"tty": "IN", "conceptProperties": [{"rxcui": "1547545", "name": "pembrolizumab"}]}
    (folder / "a.json").write_text(json.dumps({"concept": "1547550", "relatedGroup": {"conceptGroup": [group]}}))
    (folder / "b.json").write_text(json.dumps({"relatedGroup": {"rxcui": "7", "conceptGroup": [{"tty": "IN"}]}}))
    found = synonyms.read_ingredients(spark, str(folder))
    assert values(found, "rxcui", "ingredient_rxcui", "ingredient_name") == [("1547550", "1547545", "pembrolizumab")]


def test_results_keep_their_shape(spark, tmp_path, four):
    path = str(tmp_path / "out")
    write_result({"rows": four.select("entity_id"), "none": four.select("entity_id").where("false")}, path)
    found = read_result(spark, path, ["rows", "none"])
    assert found["rows"].count() == 4
    assert found["none"].count() == 0 and found["none"].columns == ["entity_id"]


def test_stream_keeps_the_first_arrival(spark, tmp_path):
    pages, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        query = ingest(spark, str(pages), table, state)
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(values(spark.read.parquet(f"{table}/studies"), "entity_id", "protocolSection.identificationModule.briefTitle"))

    write_pages(pages, [record(1, title="first"), record("BAD")], [record(1, title="again"), record(2, title="first")])
    expected = [("NCT00000001", "first"), ("NCT00000002", "first")]
    assert run() == expected
    write_pages(pages, [record(2, title="late"), record(3, title="new", interventions=drugs("A"))], searchNo=1)
    assert run() == [*expected, ("NCT00000003", "new")]
    assert run() == [*expected, ("NCT00000003", "new")]


def test_stream_keeps_what_it_does_not_store(spark, tmp_path):
    """Malformed pages, refused ids and series of studies that were stored before."""
    pages, table, state = tmp_path / "pages", str(tmp_path / "table"), str(tmp_path / "state")

    def run(**options):
        query = ingest(spark, str(pages), table, state, **options)
        with contextlib.suppress(StreamingQueryException):
            query.awaitTermination(120)
        return query.exception()

    def stored(name, *columns):
        return sorted(values(spark.read.parquet(f"{table}/{name}"), *columns), key=repr)

    write_pages(pages, [record(1), record("BAD"), record(2)], series="A")
    (pages / "broken.json").write_text("not json")
    (pages / "wrong.json").write_text('{"studies": "none"}')
    assert run() is None
    assert stored("refused", "entity_id", "page_no") == [("BAD", 0)]
    assert [s.rsplit("/", 1)[1] for (s,) in stored("malformed", "source")] == ["broken.json", "wrong.json"]
    write_pages(pages, [record(1), record("WORSE"), record(3)], series="B", searchNo=1)
    assert run() is None
    assert stored("studies", "entity_id") == [("NCT00000001",), ("NCT00000002",), ("NCT00000003",)]
    assert stored("refused", "entity_id") == [("BAD",), ("WORSE",)]
    assert stored("membership", "series", "entity_id") == [
        ("A", "NCT00000001"),
        ("A", "NCT00000002"),
        ("B", "NCT00000001"),
        ("B", "NCT00000003"),
    ]
    write_pages(pages, [record(4), record("WORST")], series="B", searchNo=2)
    assert "1 malformed pages or refused rows" in str(run(strict=True))
    assert ("NCT00000004",) not in stored("studies", "entity_id")
    assert run() is None  # the batch was not lost
    assert ("NCT00000004",) in stored("studies", "entity_id")


def test_a_batch_can_run_again(spark, tmp_path):
    from tallyproof.streaming.ingest import append_new

    folder, table = tmp_path / "p", str(tmp_path / "t")
    write_pages(folder, [record(1), record(2)], series="A")
    pages = P.read_pages(spark, str(folder))
    for batch in (0, 0, 1, 1):
        append_new(pages, table, batch)
    assert spark.read.parquet(f"{table}/studies").count() == 2
    assert spark.read.parquet(f"{table}/membership").count() == 2
    assert spark.read.parquet(f"{table}/ids").count() == 4
