"""Explicit schemas of the landed JSON. Never inferred: a missing, null or wrong-typed module
reads as NULL and the row is marked in ``_corrupt``."""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_TEXT = T.StringType()

STUDY = _struct(
    protocolSection=_struct(
        identificationModule=_struct(nctId=_TEXT, briefTitle=_TEXT),
        statusModule=_struct(overallStatus=_TEXT, startDateStruct=_struct(date=_TEXT)),
        sponsorCollaboratorsModule=_struct(leadSponsor=_struct(**{"name": _TEXT, "class": _TEXT})),
        designModule=_struct(
            phases=T.ArrayType(_TEXT), enrollmentInfo=_struct(count=T.LongType())
        ),
        armsInterventionsModule=_struct(
            interventions=T.ArrayType(_struct(type=_TEXT, name=_TEXT))
        ),
        contactsLocationsModule=_struct(locations=T.ArrayType(_struct(country=_TEXT))),
        conditionsModule=_struct(conditions=T.ArrayType(_TEXT)),
    )
)

CORRUPT = "_corrupt"

PAGE = T.StructType(
    [
        T.StructField("searchNo", T.IntegerType(), True),
        T.StructField("pageNo", T.IntegerType(), True),
        T.StructField("series", _TEXT, True),
        T.StructField("totalCount", T.LongType(), True),
        # As delivered, so that anything but a string can be told from one.
        T.StructField("nextPageToken", T.VariantType(), True),
        T.StructField("dataTimestamp", _TEXT, True),
        T.StructField("studies", T.ArrayType(STUDY), True),
        T.StructField(CORRUPT, _TEXT, True),
    ]
)

#: Response paths, relative to ``protocolSection``.
ID_PATH = "protocolSection.identificationModule.nctId"
TITLE_PATH = "protocolSection.identificationModule.briefTitle"
STATUS_PATH = "protocolSection.statusModule.overallStatus"
DATE_PATH = "protocolSection.statusModule.startDateStruct.date"
SPONSOR_PATH = "protocolSection.sponsorCollaboratorsModule.leadSponsor.name"
SPONSOR_CLASS_PATH = "protocolSection.sponsorCollaboratorsModule.leadSponsor.class"
PHASES_PATH = "protocolSection.designModule.phases"
ENROLLMENT_PATH = "protocolSection.designModule.enrollmentInfo.count"
INTERVENTIONS_PATH = "protocolSection.armsInterventionsModule.interventions"
LOCATIONS_PATH = "protocolSection.contactsLocationsModule.locations"
CONDITIONS_PATH = "protocolSection.conditionsModule.conditions"

#: Synonym tables.
CANDIDATES = T.StructType(
    [
        T.StructField("name", _TEXT),
        T.StructField("rxcui", _TEXT),
        T.StructField("score", _TEXT),
        T.StructField("rank", T.IntegerType()),
    ]
)
INGREDIENTS = T.StructType(
    [
        T.StructField("rxcui", _TEXT),
        T.StructField("ingredient_rxcui", _TEXT),
        T.StructField("ingredient_name", _TEXT),
    ]
)
CANDIDATE_PAYLOAD = T.StructType(
    [
        T.StructField("term", _TEXT),
        T.StructField(
            "approximateGroup",
            _struct(candidate=T.ArrayType(_struct(rxcui=_TEXT, score=_TEXT, rank=_TEXT, name=_TEXT))),
        ),
        T.StructField(CORRUPT, _TEXT, True),
    ]
)
INGREDIENT_PAYLOAD = T.StructType(
    [
        T.StructField("concept", _TEXT),
        T.StructField(
            "relatedGroup",
            _struct(
                rxcui=_TEXT,
                conceptGroup=T.ArrayType(
                    _struct(
                        tty=_TEXT, conceptProperties=T.ArrayType(_struct(rxcui=_TEXT, name=_TEXT))
                    )
                ),
            ),
        ),
        T.StructField(CORRUPT, _TEXT, True),
    ]
)
