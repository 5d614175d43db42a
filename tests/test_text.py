import pytest
from pyspark.sql import functions as F

from tallyproof.functions import mentions as M
from tallyproof.functions import text as X
from tallyproof.functions.names import agent_labels
from tallyproof.operators import network


def apply(spark, function, inputs):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [r.v for r in rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def check(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_normalize_name(spark):
    check(
        spark,
        X.normalize_name,
        {
            "Pembrolizumab": "pembrolizumab",
            "Pembrolizumab 200 mg": "pembrolizumab",
            "Pembrolizumab (MK-3475)": "pembrolizumab",
            "pembrolizumab IV": "pembrolizumab",
            "Pembrolizumab 200mg IV infusion": "pembrolizumab",
            "Pembrolizumab 200 mg/kg": "pembrolizumab",
            "Drug 3 mg/kg/day": "drug",
            "Drug 5 mg/m2": "drug",
            "Vitamin D 1000 IU": "vitamin d",
            "Nab-paclitaxel 125 mg/m2": "nab-paclitaxel",
            "Carboplatin AUC 5": "carboplatin auc 5",
            "COVID 19 vaccine": "covid 19 vaccine",
            "Interleukin 2": "interleukin 2",
            "Aspirin  81 mg": "aspirin",
            "200 mg": "",
        },
    )


def test_control_names(spark):
    check(
        spark,
        X.is_control_name,
        {
            "placebo": True,
            "standard of care": True,
            "placebo for lenvatinib": True,
            "saline": True,
            "no intervention": True,
            "lenvatinib": False,
            "salinex": False,
        },
    )


def test_single_agent(spark):
    check(
        spark,
        X.is_single_agent,
        {
            "pembrolizumab and lenvatinib": False,
            "cisplatin/etoposide": False,
            "a + b": False,
            "mk-3475": False,
            "bms 936558": False,
            "placebo for pembrolizumab": False,
            "gemcitabine nab-paclitaxel": False,
            "ab": False,
            "pembrolizumab": True,
            "folic acid": True,
            "vitamin b12": True,
            "5-fu": True,
            "nab-paclitaxel": True,
            "pegylated liposomal doxorubicin": True,
        },
    )


def test_dates_scores_and_status_codes(spark):
    check(
        spark,
        X.leading_year,
        {"2024-08-22": "2024", "2024-08": "2024", " 2024": "2024", " 2024": "2024", "c. 2024": None, "": None, "202": None},
    )
    assert apply(spark, X.finite_score, ["14.25", "NaN", "inf", "-Infinity", "high", None]) == [
        14.25, None, None, None, None, None,
    ]
    check(spark, X.status_code, {" not yet recruiting ": "NOT_YET_RECRUITING", "\t": None, "": None, "Completed": "COMPLETED"})
    assert len(set(apply(spark, X.series_identity, ["Aspirin", " aspirin ", "ASPIRIN"]))) == 1


def test_title_and_rendering(spark):
    long = "x" * 159 + "   tail"
    row = spark.range(1).select(
        X.clip_title(F.lit("x" * 400), 160).alias("a"),
        X.clip_title(F.lit(long), 160).alias("b"),
        X.clip_title(F.lit(None).cast("string")).alias("c"),
        X.render_number("p", F.lit(0)).alias("zero"),
        X.render_number("p", F.lit(None).cast("int")).alias("no_number"),
        X.render_text("p", F.lit("")).alias("no_text"),
        X.render_list("p", F.array(F.lit("A"), F.lit("B"))).alias("list"),
        X.render_list("p", F.array().cast("array<string>")).alias("no_list"),
        X.excerpt(F.lit("T"), F.lit("e1"), F.lit("e2")).alias("both"),
        X.excerpt(F.lit(""), F.lit("e1")).alias("untitled"),
        X.excerpt(F.lit(None).cast("string")).alias("nothing"),
    ).first()
    assert row.a == "x" * 160 + "..."
    assert row.b == "x" * 159 + "..."
    assert row.c == ""
    assert row.zero == "p: 0"
    assert row.no_number == row.no_text == row.no_list == "p: not reported"
    assert row.list == "p: [A, B]"
    assert row.both == '"T" — e1; e2'
    assert row.untitled == "e1"
    assert row.nothing == "(no title in record)"


def test_phases(spark):
    check(
        spark,
        M.phase_mentions,
        {
            "phase 2 study of 3 drugs": [2],
            "phase-3": [3],
            "Phase-III": [3],
            "phase3": [3],
            "phases 1, 2 & 4": [1, 2, 4],
            "phase 1/2": [1, 2],
            "phase I to IV": [1, 4],
            "early phase 1": [0],
            "early phase 1 or phase 2": [0, 2],
            "in phase, 3 patients": [],
            "phase 5": [],
            "no mention": [],
        },
    )


def test_years(spark):
    check(spark, M.year_mentions, {"2015 and 1999, 200 mg, 2041, NCT20151234": [1999, 2015]})
    check(
        spark,
        lambda t: F.array(M.year_range(t)["start"], M.year_range(t)["end"]),
        {
            "from 2015 to 2020": [2015, 2020],
            "2020-2015": [2015, 2020],
            "between 2015 and 2020": [2015, 2020],
            "since 2015": [2015, None],
            "after 2015": [2016, None],
            "through 2020": [None, 2020],
            "before 2020": [None, 2019],
            "by 2020": [None, 2020],
            "sponsored by 2020": [None, None],
            "grouped by 2020 before 2019": [None, 2018],
            "after 2020 and before 2015": [2021, 2014],
            "in 2020": [None, None],
        },
    )


STATUS_CASES = [
    ("trials that are not recruiting", [], ["RECRUITING"]),
    ("trials that aren't recruiting", [], ["RECRUITING"]),
    ("non-recruiting studies", [], ["RECRUITING"]),
    ("no-longer-recruiting", [], ["RECRUITING"]),
    ("not currently recruiting", [], ["RECRUITING"]),
    ("active, not recruiting", ["ACTIVE_NOT_RECRUITING"], []),
    ("not yet recruiting", ["NOT_YET_RECRUITING"], []),
    ("not completed and recruiting", ["RECRUITING"], ["COMPLETED"]),
    ("recruiting and not recruiting", [], ["RECRUITING"]),
    ("halted recruiting", [], ["RECRUITING"]),
    ("paused recruiting trials", [], ["RECRUITING"]),
    ("excluding recruiting and completed", [], ["COMPLETED", "RECRUITING"]),
    ("neither recruiting nor completed", [], ["COMPLETED", "RECRUITING"]),
    ("excluding recruiting but completed", ["COMPLETED"], ["RECRUITING"]),
    ("stopped early", ["TERMINATED"], []),
    ("re-enrolling", [], []),
    ("unavailable or incomplete", [], []),
    ("closed to enrollment", ["ACTIVE_NOT_RECRUITING"], []),
    ("available for expanded access", ["AVAILABLE"], []),
    ("actively enrolling by invitation", ["ENROLLING_BY_INVITATION"], []),
    ("completed trials", ["COMPLETED"], []),
]


def test_statuses(spark):
    cases = {text: (wanted, excluded) for text, wanted, excluded in STATUS_CASES}
    found = apply(spark, M.status_mentions, list(cases))
    assert [(r.wanted, r.excluded) for r in found] == list(cases.values())


@pytest.mark.parametrize("n", [1, 50])
def test_status_of_long_texts_is_read_to_the_end(spark, n):
    found = apply(spark, M.status_mentions, ["word " * 2000 * n + "not recruiting"])
    assert found[0].excluded == ["RECRUITING"]


def test_a_negated_list_runs_as_far_as_its_items_go(spark):
    """Each status is excluded wherever in the list it stands."""
    names = "completed, terminated, recruiting, unknown status, upcoming, expanded access"
    codes = ["AVAILABLE", "COMPLETED", "ENROLLING_BY_INVITATION", "NOT_YET_RECRUITING", "RECRUITING", "TERMINATED", "UNKNOWN"]
    cases = {
        f"excluding {names} and enrolling by invitation trials": ([], codes),
        "excluding " + "completed, terminated, " * 3000 + "withdrawn trials": ([], ["COMPLETED", "TERMINATED", "WITHDRAWN"]),
        "neither " + "completed nor terminated nor " * 1000 + "withdrawn": ([], ["COMPLETED", "TERMINATED", "WITHDRAWN"]),
        "excluding suspended, withdrawn, halted and recruiting": ([], ["RECRUITING", "SUSPENDED", "TERMINATED", "WITHDRAWN"]),
        f"excluding {names}, but enrolling by invitation": (["ENROLLING_BY_INVITATION"], [c for c in codes if c[0] != "E"]),
    }
    found = apply(spark, M.status_mentions, list(cases))
    assert [(r.wanted, r.excluded) for r in found] == list(cases.values())


def test_axis_graph_and_population(spark):
    check(
        spark,
        M.axis_mention,
        {"trials by phase": "phase", "phase by country": None, "trend": "start_year", "nothing": None, "phases": "phase"},
    )
    check(
        spark,
        M.graph_kind_mention,
        {
            "network of sponsors and drugs": "sponsor_drug",
            "drugs studied together": "drug_drug",
            "sponsors and drugs studied together": None,
            "sponsored": None,
        },
    )
    check(
        spark,
        M.names_whole_registry,
        {"across all clinical trials": True, "All studies": True, "all-trans retinoic acid": False},
    )


def cleanings(df):
    """How often the plan of ``df`` cleans a name."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("mcg|mg|kg")


def test_a_quoted_list_cleans_its_names_once(spark):
    df = spark.createDataFrame([([("DRUG", "Bolt (x)"), ("DRUG", "bolt"), ("DRUG", "Anvil 5 mg")],)], "i array<struct<type:string,name:string>>")
    quoted = df.select(X.render_list("p", agent_labels(F.col("i"))).alias("q"))
    assert cleanings(quoted) == 1
    assert quoted.first().q == "p: [Anvil 5 mg, Bolt (x)]"


def test_agents_clean_their_names_once(spark):
    rows = spark.createDataFrame([("a", "Bolt 5 mg", 0), ("a", "Placebo", 1), ("b", "-", 0)], "entity_id string, name string, pos int")
    agents = network.agent_rows(rows)
    assert cleanings(agents) == 1
    assert [tuple(r) for r in agents.collect()] == [("a", "bolt", "Bolt 5 mg", 0)]


def test_plain_names(spark):
    names = {"Bolt12": "bolt12", "blue bolt": "blue bolt", "5mg": "", "iv": "", "blue iv": "blue", "ivs po": "ivs", "bolt 12": "bolt 12", "bolt ": "bolt", "bolt\n": "bolt", "a  b": "a b"}
    check(spark, X.normalize_name, names)


def test_status_far_into_a_long_text(spark):
    """What stands long before a phrase changes nothing unless a cue reaches it; few patterns read it."""
    prose = "many words of no use here, and not one of them counts; " * 20
    texts = {
        prose + "excluding recruiting": ([], ["RECRUITING"]),
        prose + "recruiting " + prose + "never completed": (["RECRUITING"], ["COMPLETED"]),
        "excluding " + "completed, " * 60 + "recruiting " + prose: ([], ["COMPLETED", "RECRUITING"]),
        "excluding " + "trials, " * 90 + "recruiting": ([], ["RECRUITING"]),
        "never" + " " * 900 + "really   recruiting": ([], ["RECRUITING"]),
        "never " + "x" * 900 + " recruiting": ([], ["RECRUITING"]),
        "never one two three four five six recruiting": (["RECRUITING"], []),
        prose + "pre-recruiting " + prose: ([], []),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", F.inline(F.array(M.status_mentions(F.col("t")))))
    assert [(r.wanted, r.excluded) for r in found.orderBy("i").collect()] == list(texts.values())
    # Each phrase has the patterns of its negations once, on a part of the text.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("closed\\ to\\ enrolment\\b") <= 6
