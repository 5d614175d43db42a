import json
from itertools import count

import pytest
from session import make_session

from tallyproof import schema as S
from tallyproof.sources.pages import first_writer, read_pages, studies_of_pages
from tallyproof.streaming.ingest import SOURCE_ORDER


@pytest.fixture(scope="session")
def spark():
    session = make_session("4", spark__sql__shuffle__partitions="3")
    yield session
    session.stop()


def record(
    number,
    title="A study of something",
    status="RECRUITING",
    start="2020-05-01",
    sponsor="Acme Pharma",
    sponsor_class="INDUSTRY",
    phases=None,
    interventions=None,
    countries=None,
    enrollment=100,
    conditions=None,
):
    """One study as a nested dict; None leaves the module out."""
    ident = number if isinstance(number, str) else f"NCT{number:08d}"
    section = {
        "identificationModule": {"nctId": ident, "briefTitle": title},
        "statusModule": {"overallStatus": status},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": sponsor, "class": sponsor_class}},
        "designModule": {},
    }
    if start is not None:
        section["statusModule"]["startDateStruct"] = {"date": start}
    if phases is not None:
        section["designModule"]["phases"] = phases
    if enrollment is not None:
        section["designModule"]["enrollmentInfo"] = {"count": enrollment}
    if interventions is not None:
        section["armsInterventionsModule"] = {
            "interventions": [{"type": t, "name": n} for t, n in interventions]
        }
    if countries is not None:
        section["contactsLocationsModule"] = {"locations": [{"country": c} for c in countries]}
    if conditions is not None:
        section["conditionsModule"] = {"conditions": conditions}
    return {"protocolSection": section}


def drugs(*names):
    return [("DRUG", n) for n in names]


def four_records():
    return [
        record(1, phases=["PHASE3"], interventions=drugs("Pembrolizumab"), countries=["United States"]),
        record(
            2,
            phases=["PHASE1", "PHASE2"],
            start="2021",
            interventions=drugs("Pembrolizumab", "Lenvatinib"),
            countries=["United States", "Taiwan", "United States"],
        ),
        record(
            3,
            start="2021-07",
            sponsor="Beta Institute",
            sponsor_class="OTHER",
            interventions=[("BIOLOGICAL", "Nivolumab")],
            countries=["France"],
        ),
        record(4, phases=["NA"], start=None, enrollment=None),
    ]


def write_pages(folder, *pages, **facts):
    """Write pages, each a list of records, as one search."""
    folder.mkdir(exist_ok=True)
    for number, studies in enumerate(pages):
        page = {"searchNo": 0, "pageNo": number, "studies": studies, **facts}
        (folder / f"page-{facts.get('searchNo', 0)}-{number}.json").write_text(json.dumps(page))
    return str(folder)


@pytest.fixture
def studies_of(spark, tmp_path):
    """Study table of a list of records, read from a landed page."""

    built = count()

    def build(records):
        pages = read_pages(spark, write_pages(tmp_path / f"pages-{next(built)}", records))
        return first_writer(studies_of_pages(pages), "entity_id", SOURCE_ORDER)

    return build


@pytest.fixture
def four(studies_of):
    return studies_of(four_records())


def values(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]


ID = S.ID_PATH
