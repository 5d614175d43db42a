"""Citations: an evenly spread sample of the entities behind each published number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.functions import text as X
from tallyproof.functions.names import agent_labels
from tallyproof.operators.selection import rows_at_ranks
from tallyproof.session import broadcast_if_small


def sample_positions(total: Column, limit: int) -> Column:
    """0-based positions to keep out of ``total``: both ends and evenly between, half to even."""
    if limit == 1:
        return F.array(F.lit(0).cast("bigint"))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(limit - 1)),
        lambda i: F.bround(i * (total - 1) / F.lit(limit - 1)).cast("bigint"),
    )
    return F.when(total > limit, F.array_distinct(spread)).otherwise(
        F.sequence(F.lit(0).cast("bigint"), total - 1)
    )


def cite(
    evidence: DataFrame, datum: list[str], limit: int = V.DEFAULT_CITATIONS, entities: DataFrame | None = None
) -> DataFrame:
    """``(datum..., ordinal, entity_id, total)``: at most ``limit`` entities per datum.

    ``evidence`` holds each ``(datum..., entity_id)`` once. How many entities each datum has in each
    range of ids tells in which ranges the sampled ranks lie (`rows_at_ranks`); only their rows are
    ranked, so a datum holding most of the data is never sorted whole. ``entities(entity_id)`` may be a
    smaller table with the same ids, for their least and greatest.
    """
    if limit <= 0:
        return evidence.select(
            *datum,
            F.lit(0).cast("bigint").alias("ordinal"),
            "entity_id",
            F.lit(0).cast("bigint").alias("total"),
        ).where(F.lit(False))
    found = rows_at_ranks(
        evidence.select(*datum, "entity_id"), datum, "entity_id", lambda total: sample_positions(total, limit), entities
    )
    return found.select(*datum, (F.col("nth") + 1).cast("bigint").alias("ordinal"), "entity_id", "total")


def evidence_totals(evidence: DataFrame, datum: list[str]) -> DataFrame:
    """Full number of contributors per datum, whatever is cited."""
    return evidence.groupBy(*datum).agg(F.count("*").alias("total"))


def study_fragment(dimension: str) -> Column:
    """``path: value`` as the record of a study states it."""
    paths = {
        "start_year": S.DATE_PATH,
        "status": S.STATUS_PATH,
        "sponsor": S.SPONSOR_PATH,
        "sponsor_class": S.SPONSOR_CLASS_PATH,
    }
    if dimension in paths:
        path = paths[dimension]
        value = F.col(path)
        shown = path.removeprefix("protocolSection.")
        # A status is quoted as a list of one, the others as plain text.
        return (
            X.render_list(shown, X.single(value))
            if dimension == "status"
            else X.render_text(shown, value)
        )
    if dimension == "phase":
        return X.render_list("designModule.phases", X.present(F.col(S.PHASES_PATH)))
    if dimension == "enrollment_bucket":
        return X.render_number("designModule.enrollmentInfo.count", F.col(S.ENROLLMENT_PATH))
    if dimension == "drug":
        return X.render_list(
            "armsInterventionsModule.interventions[].name",
            agent_labels(F.col(S.INTERVENTIONS_PATH)),
        )
    path, field = {
        "intervention_type": (S.INTERVENTIONS_PATH, "type"),
        "country": (S.LOCATIONS_PATH, "country"),
    }[dimension]
    values = F.array_sort(F.array_distinct(X.present(F.col(f"{path}.{field}"))))
    return X.render_list(f"{path.removeprefix('protocolSection.')}[].{field}", values)


#: Evidence with two endpoints quotes two fields.
COMPOSITE = {"sponsor_drug": ["sponsor", "drug"]}

_QUOTABLE = {
    "phase",
    "start_year",
    "status",
    "sponsor",
    "sponsor_class",
    "intervention_type",
    "country",
    "enrollment_bucket",
    "drug",
}


def study_excerpt(dimension: str, limit: int | None = None) -> Column:
    parts = [p for p in COMPOSITE.get(dimension, [dimension]) if p in _QUOTABLE]
    return X.excerpt(F.col(S.TITLE_PATH), *[study_fragment(p) for p in parts], limit=limit)


def of_cited(rows: DataFrame, cited: DataFrame) -> DataFrame:
    """``rows(entity_id, ...)`` of the entities of ``cited``, best a written table, when those are few; else all."""
    ids = cited.select("entity_id").distinct()
    few = broadcast_if_small(ids)
    return rows if few is ids else rows.join(few, "entity_id", "left_semi")


def quote(
    cited: DataFrame,
    records: DataFrame,
    id_col: str,
    excerpt: Column,
    url: str = V.STUDY_URL_FORMAT,
) -> DataFrame:
    """Add excerpt and link to cited rows. Records are cut to id and excerpt first, so that the
    join moves no record columns, and when few are cited, only those are quoted."""
    quoted = of_cited(records.select(F.col(id_col).alias("entity_id"), excerpt.alias("excerpt")), cited)
    return cited.join(quoted, "entity_id").withColumn("url", X.study_url(F.col("entity_id"), url))
