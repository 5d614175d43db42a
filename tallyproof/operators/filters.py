"""Predicates over entity rows, and the accounting of what each one removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V
from tallyproof.functions import text as X


def _clean(values) -> list[str]:
    return [v.strip() for v in values if v and v.strip()]


def scope(values: list[str], text: Column) -> Column | None:
    """Any of ``values`` as a word-bounded, case-insensitive part of a text column."""
    wanted = _clean(values)
    return X.any_word(text, wanted) if wanted else None


def scope_any(values: list[str], texts: Column) -> Column | None:
    """Any of ``values`` in any element of an array of texts."""
    wanted = _clean(values)
    if not wanted:
        return None
    return F.coalesce(F.exists(texts, lambda t: X.any_word(t, wanted)), F.lit(False))


def phases_in(numbers: list[int], phases: Column) -> Column:
    """Union of phases; 0 is Early Phase 1. A number outside 0-4 is an error, not no rows."""
    unknown = [n for n in numbers if n not in V.PHASE_CODES]
    if unknown or not numbers:
        raise ValueError(f"phases must be 0-4, got {numbers}")
    return F.arrays_overlap(
        phases, F.array(*[F.lit(V.PHASE_CODES[n]) for n in sorted(set(numbers))])
    )


def requested_codes(statuses: list[str]) -> list[str]:
    return sorted({s.upper().replace(" ", "_") for s in _clean(statuses)})


def status_in(statuses: list[str], status: Column) -> Column:
    """Requested statuses; rows without a status drop out."""
    return status.isin(requested_codes(statuses))


def status_not_in(statuses: list[str], status: Column) -> Column:
    """Excluded statuses; rows without a status stay."""
    return F.coalesce(~status.isin(requested_codes(statuses)), F.lit(True))


def effective_status_rows(requested: DataFrame, excluded: DataFrame) -> DataFrame:
    """Requested minus excluded, two ``(status)`` tables in any spelling: exclusion wins."""
    wanted = requested.select(X.status_code(F.col("status")).alias("status"))
    out = excluded.select(X.status_code(F.col("status")).alias("status"))
    return wanted.where("status is not null").distinct().join(out, "status", "left_anti")


def year_between(year: Column, start: int | None, end: int | None) -> Column:
    """Inclusive, either side open. Undated rows drop out, reversed bounds match nothing."""
    inside = year.isNotNull()
    if start is not None:
        inside = inside & (year >= start)
    if end is not None:
        inside = inside & (year <= end)
    return inside


def free_text(query: str, *texts: Column) -> Column:
    """All words of ``query`` contained in the texts, any case."""
    haystack = F.lower(F.concat_ws(" ", *texts))
    condition = F.lit(True)
    for word in query.lower().split():
        condition = condition & F.contains(haystack, F.lit(word))
    return condition


def filter_accounting(
    entities: DataFrame, steps: dict[str, Column], missing: dict[str, Column] | None = None
) -> DataFrame:
    """``(step, filter, before, after, missing)``: rows around each predicate, applied in order,
    in one pass. ``missing`` tells, for some predicates, which rows lack the value asked for."""
    passed = F.lit(True)
    measures = [F.count("*").alias("_0")]
    for i, (name, predicate) in enumerate(steps.items(), 1):
        lacking = (missing or {}).get(name, F.lit(False))
        measures.append(F.count_if(passed & lacking).alias(f"_missing_{i}"))
        passed = passed & F.coalesce(predicate, F.lit(False))
        measures.append(F.count_if(passed).alias(f"_{i}"))
    stages = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("step"),
                F.lit(name).alias("filter"),
                F.col(f"_{i - 1}").alias("before"),
                F.col(f"_{i}").alias("after"),
                F.col(f"_missing_{i}").alias("missing"),
            )
            for i, name in enumerate(steps, 1)
        ]
    )
    return entities.agg(*measures).select(F.inline(stages))


def empty_probe(entities: DataFrame, scope_filter: Column, predicate: Column) -> DataFrame:
    """Matches with the predicate, and without it when there are none: one row, one scan."""
    return entities.where(scope_filter).agg(
        F.count_if(predicate).alias("matched"), F.count("*").alias("_scoped")
    ).select("matched", F.when(F.col("matched") == 0, F.col("_scoped")).alias("unfiltered"))
