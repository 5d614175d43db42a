import pytest
from conftest import ID, four_records, record, values
from pyspark.sql import functions as F

from tallyproof.functions import text as X
from tallyproof.operators import measure
from tallyproof.operators.dimensions import DIMENSIONS, Dimension, register
from tallyproof.session import number_rows


def report(studies, name, series=None, **options):
    dimension = DIMENSIONS[name]
    members = measure.membership(studies, dimension, ID, series)
    return measure.bucket_counts(members, dimension, **options)


def in_order(rows, *columns):
    return values(rows.orderBy("position"), *columns)


def series_table(spark, **groups):
    rows = [(s, f"NCT{n:08d}") for s, ids in groups.items() for n in ids]
    return spark.createDataFrame(rows, "series string, entity_id string")


def test_by_phase(four):
    assert in_order(report(four, "phase"), "key", "value") == [
        ("Phase 1", 1),
        ("Phase 2", 1),
        ("Phase 3", 1),
        ("Not Applicable", 1),
        ("No phase data", 1),
    ]


def test_by_year_and_country(four):
    assert in_order(report(four, "start_year"), "key", "value") == [
        ("2020", 1),
        ("2021", 2),
        ("No start date", 1),
    ]
    assert in_order(report(four, "country", include_unknown=False, top_n=20), "key", "value") == [
        ("United States", 2),
        ("France", 1),
        ("Taiwan", 1),
    ]


@pytest.mark.parametrize("name", list(DIMENSIONS))
def test_every_dimension_accounts_for_every_study(four, name):
    dimension = DIMENSIONS[name]
    members = measure.membership(four, dimension, ID)
    total = measure.bucket_totals(members, dimension).first()
    assert total.matched == 4
    ids = {r.entity_id for r in members.collect()}
    assert len(ids) == 4
    summed = sum(v for (v,) in values(measure.bucket_counts(members, dimension), "value"))
    assert summed == 4 if not dimension.multi_valued else summed >= 4


def test_enrollment_bins(studies_of):
    sizes = [0, 9, 10, 49, 50, 99, 100, 499, 500, 999, 1000, -1, None]
    rows = report(studies_of([record(i + 1, enrollment=n) for i, n in enumerate(sizes)]), "enrollment_bucket")
    assert in_order(rows, "key", "value") == [
        ("0-9 participants", 2),
        ("10-49 participants", 2),
        ("50-99 participants", 2),
        ("100-499 participants", 2),
        ("500-999 participants", 2),
        ("1000+ participants", 1),
        ("No enrollment data", 2),
    ]


def test_series(spark, four):
    series = series_table(spark, Pembrolizumab=[1, 2], Nivolumab=[3, 99])
    rows = report(four, "phase", series)
    assert in_order(rows, "series", "key", "value") == [
        ("Pembrolizumab", "Phase 1", 1),
        ("Pembrolizumab", "Phase 2", 1),
        ("Pembrolizumab", "Phase 3", 1),
        ("Nivolumab", "No phase data", 1),
    ]


def test_study_in_two_series_counts_in_both_and_once_in_total(spark, four):
    series = series_table(spark, a=[1], b=[1])
    dimension = DIMENSIONS["phase"]
    members = measure.membership(four, dimension, ID, series)
    assert in_order(measure.bucket_counts(members, dimension), "series", "value") == [("a", 1), ("b", 1)]
    assert measure.bucket_totals(members, dimension).first().matched == 1


def test_empty_series_is_filled_after_all_others(spark, four):
    rows = report(four, "phase", series_table(spark, a=[1, 2], b=[4]))
    filled = measure.zero_fill_series(rows, ["a", "b", "none", "other"])
    found = in_order(filled, "series", "key", "value")
    assert found[:4] == in_order(rows, "series", "key", "value")
    keys = ["Phase 1", "Phase 2", "Phase 3", "Not Applicable"]
    assert found[4:] == [(s, k, 0) for s in ("none", "other") for k in keys]
    nothing = report(four, "phase", series_table(spark, a=[99]))
    assert measure.zero_fill_series(nothing, ["a"]).count() == 0


def test_top_n_and_totals(studies_of):
    studies = studies_of([record(i, sponsor=f"Sponsor {i:02d}") for i in range(1, 31)])
    dimension = DIMENSIONS["sponsor"]
    members = measure.membership(studies, dimension, ID)
    rows = measure.bucket_counts(members, dimension, top_n=15)
    assert [k for (k,) in in_order(rows, "key")] == [f"Sponsor {i:02d}" for i in range(1, 16)]
    for entities in (None, studies):
        total = measure.bucket_totals(members, dimension, 15, entities=entities).first()
        assert (total.total_categories, total.displayed_categories, total.omitted_categories) == (30, 15, 15)
        assert total.matched == 30 and total.unbucketed == 0 and not total.unknown_shown
    # Without a cap the positions come from the distributed sort, with the same result.
    assert in_order(measure.bucket_counts(members, dimension), "key")[:15] == in_order(rows, "key")


def test_key_spelled_like_the_unknown_label_merges_and_sorts_last(studies_of):
    studies = studies_of(
        [record(1, sponsor="No sponsor listed"), record(2, sponsor=""), record(3, sponsor=None), record(4, sponsor="Zeta")]
    )
    rows = report(studies, "sponsor", top_n=15)
    assert in_order(rows, "key", "value", "is_unknown") == [("Zeta", 1, False), ("No sponsor listed", 3, True)]
    dimension = DIMENSIONS["sponsor"]
    total = measure.bucket_totals(measure.membership(studies, dimension, ID), dimension, 15).first()
    assert total.unbucketed == 2 and total.unknown_shown


def test_blank_sponsor_is_a_key_but_empty_is_not(studies_of):
    rows = report(studies_of([record(1, sponsor="  "), record(2, sponsor="")]), "sponsor", top_n=15)
    assert in_order(rows, "key", "value") == [("  ", 1), ("No sponsor listed", 1)]


def test_unknown_keys_are_titled(studies_of):
    rows = report(studies_of([record(1, phases=["SOME_THING"], status="NOT_YET_RECRUITING")]), "phase")
    assert in_order(rows, "key") == [("Some Thing",)]
    assert in_order(report(studies_of([record(1, status="NOT_YET_RECRUITING")]), "status"), "key") == [
        ("Not Yet Recruiting",)
    ]


YEARS = [
    ([2018, 2021], None, None, [(2018, 1), (2019, 0), (2020, 0), (2021, 1)]),
    ([2021, 2022, 2023], 2020, 2024, [(2020, 0), (2021, 1), (2022, 1), (2023, 1), (2024, 0)]),
    ([2022], 2020, 2024, [(2020, 0), (2021, 0), (2022, 1), (2023, 0), (2024, 0)]),
    ([2022], None, None, [(2022, 1)]),
    ([2021, 2023], 2019, None, [(2019, 0), (2020, 0), (2021, 1), (2022, 0), (2023, 1)]),
    ([2021, 2023], 1000, 2024, [(2021, 1), (2023, 1)]),
    ([2021, 2023], 2024, 2020, [(2021, 1), (2023, 1)]),
    ([], 2020, 2024, []),
]


@pytest.mark.parametrize("observed, start, end, expected", YEARS)
def test_year_fill(studies_of, observed, start, end, expected):
    records = [record(i + 1, start=str(y)) for i, y in enumerate(observed)] + [record(50, start=None)]
    rows = report(studies_of(records), "start_year", include_unknown=False)
    filled = measure.zero_fill_years(rows, start, end, 120)
    assert in_order(filled, "key", "value") == [(str(y), n) for y, n in expected]


def test_year_fill_keeps_unknown_last_and_fills_each_series(spark, studies_of):
    studies = studies_of([record(1, start="2019"), record(2, start="2021"), record(3, start=None)])
    rows = report(studies, "start_year", series_table(spark, a=[1, 3], b=[2]))
    assert in_order(measure.zero_fill_years(rows), "key", "series", "value") == [
        ("2019", "a", 1),
        ("2019", "b", 0),
        ("2020", "a", 0),
        ("2020", "b", 0),
        ("2021", "a", 0),
        ("2021", "b", 1),
        ("No start date", "a", 1),
    ]


def test_result_does_not_depend_on_partitioning(four):
    expected = in_order(report(four, "country", top_n=20), "position", "key", "value")
    for n in (1, 7):
        assert in_order(report(four.repartition(n), "country", top_n=20), "position", "key", "value") == expected


def test_pairs_and_rows_agree(spark, four):
    dimension = DIMENSIONS["country"]
    pairs = four.select("entity_id", F.explode("protocolSection.contactsLocationsModule.locations.country").alias("key"))
    by_pairs = measure.membership_of_pairs(four.select("entity_id"), pairs.union(pairs), dimension)
    by_rows = measure.membership(four, dimension, ID)
    assert sorted(values(by_pairs, "key", "entity_id")) == sorted(values(by_rows, "key", "entity_id"))


def test_registered_dimension(four):
    register(Dimension("first_letter", "None", lambda: X.single(F.substring("protocolSection.sponsorCollaboratorsModule.leadSponsor.name", 1, 1))))
    try:
        assert in_order(report(four, "first_letter"), "key", "value") == [("A", 3), ("B", 1)]
    finally:
        del DIMENSIONS["first_letter"]


def test_user_function_as_dimension(four):
    @F.udf("array<string>")
    def initials(name):
        return [word[0] for word in name.split()] if name else None

    dimension = Dimension("initials", "None", lambda: initials("protocolSection.sponsorCollaboratorsModule.leadSponsor.name"), multi_valued=True)
    members = measure.membership(four, dimension, ID)
    assert sorted(values(measure.bucket_counts(members, dimension, 9), "key", "value")) == [("A", 3), ("B", 1), ("I", 1), ("P", 3)]


def test_number_rows_is_a_dense_total_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(9)
    found = values(number_rows(df, F.desc("v")), "position", "v")
    assert sorted(found) == [(i + 1, 999 - i) for i in range(1000)]


def test_wrong_types_read_as_unknown(studies_of):
    bad = four_records()
    bad[0]["protocolSection"]["designModule"]["phases"] = "PHASE3"
    bad[1]["protocolSection"]["sponsorCollaboratorsModule"] = {"leadSponsor": None}
    bad[2]["protocolSection"]["armsInterventionsModule"] = None
    bad[3]["protocolSection"]["designModule"]["enrollmentInfo"] = {"count": True}
    studies = studies_of(bad)
    assert ("No phase data", 2) in in_order(report(studies, "phase"), "key", "value")
    assert ("No sponsor listed", 1) in in_order(report(studies, "sponsor", top_n=15), "key", "value")
    assert ("No enrollment data", 1) in in_order(report(studies, "enrollment_bucket"), "key", "value")
