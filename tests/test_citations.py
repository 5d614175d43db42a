import pytest
from conftest import record, values
from pyspark.sql import functions as F

from tallyproof.operators import citations
from tallyproof.operators.citations import cite, evidence_totals, quote, study_excerpt


def python_positions(n, limit):
    """The sample written out: positions half to even, both ends included."""
    if limit >= n:
        return list(range(n))
    if limit == 1:
        return [0]
    return sorted({round(i * (n - 1) / (limit - 1)) for i in range(limit)})


def evidence(spark, **sizes):
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "key string, entity_id bigint").repartition(5)


def cited(df):
    out = {}
    for key, ordinal, entity, total in values(df, "key", "ordinal", "entity_id", "total"):
        out.setdefault(key, []).append((ordinal, entity, total))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 20])
def test_positions(spark, limit):
    sizes = {"a": 373, "b": 6, "c": 4, "d": 97, "e": 1, "f": 20, "g": 3, "h": 2}
    expected = {
        k: [(i + 1, at, n) for i, at in enumerate(python_positions(n, limit))] for k, n in sizes.items()
    }
    assert cited(cite(evidence(spark, **sizes), ["key"], limit)) == expected


def test_373_of_3(spark):
    assert [e for _, e, _ in cited(cite(evidence(spark, a=373), ["key"], 3))["a"]] == [0, 186, 372]


def test_no_citations_but_totals(spark):
    rows = evidence(spark, a=5, b=2)
    assert cite(rows, ["key"], 0).count() == 0
    assert sorted(values(evidence_totals(rows, ["key"]), "key", "total")) == [("a", 5), ("b", 2)]


def test_one_datum_over_many_partitions(spark):
    rows = spark.range(50_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise(F.lit("hot")).alias("key"),
        F.col("id").alias("entity_id"),
    )
    found = cited(cite(rows, ["key"], 5))
    hot = [i for i in range(50_000) if i % 50]
    assert [e for _, e, _ in found["hot"]] == [hot[at] for at in python_positions(len(hot), 5)]
    assert len(found) == 1001 and all(len(v) == 1 for k, v in found.items() if k != "hot")


def test_null_and_several_datum_columns(spark):
    rows = spark.createDataFrame(
        [(None, "x", 1), (None, "x", 2), ("s", "x", 1), ("s", "y", 3)], "series string, key string, entity_id int"
    )
    found = sorted(values(cite(rows, ["series", "key"], 3), "series", "key", "ordinal", "entity_id", "total"), key=str)
    assert found == sorted(
        [(None, "x", 1, 1, 2), (None, "x", 2, 2, 2), ("s", "x", 1, 1, 1), ("s", "y", 1, 3, 1)], key=str
    )


def excerpts(four, dimension):
    return [r.e for r in four.select("entity_id", study_excerpt(dimension).alias("e")).orderBy("entity_id").collect()]


def test_excerpts(four):
    title = '"A study of something" — '
    assert excerpts(four, "phase") == [
        title + "designModule.phases: [PHASE3]",
        title + "designModule.phases: [PHASE1, PHASE2]",
        title + "designModule.phases: not reported",
        title + "designModule.phases: [NA]",
    ]
    assert excerpts(four, "country")[1] == title + "contactsLocationsModule.locations[].country: [Taiwan, United States]"
    assert excerpts(four, "status")[0] == title + "statusModule.overallStatus: [RECRUITING]"
    assert excerpts(four, "start_year")[3] == title + "statusModule.startDateStruct.date: not reported"
    assert excerpts(four, "enrollment_bucket")[0] == title + "designModule.enrollmentInfo.count: 100"
    assert excerpts(four, "drug")[1] == title + "armsInterventionsModule.interventions[].name: [Lenvatinib, Pembrolizumab]"
    assert excerpts(four, "sponsor_drug")[0] == (
        title + 'sponsorCollaboratorsModule.leadSponsor.name: "Acme Pharma"; '
        "armsInterventionsModule.interventions[].name: [Pembrolizumab]"
    )
    assert excerpts(four, "no such axis")[0] == '"A study of something"'


def test_drug_evidence_leaves_out_control_arms(studies_of):
    studies = studies_of(
        [record(1, interventions=[("DRUG", "Placebo for X"), ("DRUG", "B 5 mg"), ("DRUG", "a"), ("DRUG", "b"), ("DEVICE", "pump")])]
    )
    assert excerpts(studies, "drug")[0].endswith("interventions[].name: [a, B 5 mg]")


def test_quote(four):
    cites = cite(four.select(F.lit("all").alias("key"), "entity_id"), ["key"], 2)
    found = quote(cites, four, "entity_id", study_excerpt("status"))
    assert sorted(values(found, "entity_id", "url")) == [
        (i, f"https://clinicaltrials.gov/study/{i}") for i in ("NCT00000001", "NCT00000004")
    ]


def test_only_cited_records_are_quoted(spark):
    records = spark.range(100).withColumnRenamed("id", "rid")
    cited = cite(records.select(F.lit("a").alias("key"), F.col("rid").alias("entity_id")), ["key"], 2)
    excerpt = F.when(F.col("rid").isin(0, 99), F.lit("quoted")).otherwise(F.raise_error(F.lit("not cited")))
    assert citations.quote(cited, records, "rid", excerpt, "%s").count() == 2
    assert {r.excerpt for r in citations.quote(cited, records, "rid", excerpt, "%s").collect()} == {"quoted"}
