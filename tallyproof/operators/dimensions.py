"""Dimensions: how an entity row yields its bucket keys, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.functions import text as X


def identity(key: Column) -> Column:
    return key


def unordered(key: Column) -> Column:
    """Constant position: counts and labels decide the order."""
    return F.lit(0)


@dataclass(frozen=True)
class Dimension:
    """One axis. ``keys`` gives an ``array<string>`` over the entity row; ``display`` and
    ``order`` are applied to a bucket key."""

    name: str
    unknown_label: str
    keys: Callable[[], Column] | None = None
    display: Callable[[Column], Column] = identity
    order: Callable[[Column], Column] = unordered
    multi_valued: bool = False
    #: Whether the number of distinct keys is bounded by a vocabulary rather than by the data.
    closed: bool = False


def listed_order(values: list[str]) -> Callable[[Column], Column]:
    """Position in a fixed list; anything else after it."""

    def order(key: Column) -> Column:
        position = F.array_position(F.array(*[F.lit(v) for v in values]), key)
        return F.when(position > 0, position - 1).otherwise(F.lit(len(values)))

    return order


def bin_label(value: Column, bins: list[tuple[int, int | None, str]]) -> Column:
    """Label of the half-open bin holding ``value``; NULL outside all bins."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(bins):
        inside = value >= low if high is None else (value >= low) & (value < high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    return label


def year_order(key: Column) -> Column:
    return F.when(key.rlike("^[0-9]+$"), key.try_cast("int")).otherwise(F.lit(V.UNDATED_ORDER))


def _phase_label(key: Column) -> Column:
    return F.coalesce(F.try_element_at(X.literal_map(V.PHASE_LABELS), key), X.title_case(key))


def _distinct_field(path: str, field: str) -> Column:
    return F.array_sort(F.array_distinct(X.present(F.col(f"{path}.{field}"))))


DIMENSIONS = {
    d.name: d
    for d in [
        Dimension(
            "phase",
            "No phase data",
            lambda: X.present(F.col(S.PHASES_PATH)),
            _phase_label,
            listed_order(V.PHASE_ORDER),
            multi_valued=True,
            closed=True,
        ),
        Dimension(
            "start_year",
            "No start date",
            lambda: X.single(X.leading_year(F.col(S.DATE_PATH))),
            order=year_order,
            closed=True,
        ),
        Dimension(
            "status",
            "No status",
            lambda: X.single(F.col(S.STATUS_PATH)),
            X.title_case,
            closed=True,
        ),
        Dimension("sponsor", "No sponsor listed", lambda: X.single(F.col(S.SPONSOR_PATH))),
        Dimension(
            "sponsor_class",
            "No sponsor category",
            lambda: X.single(F.col(S.SPONSOR_CLASS_PATH)),
            X.title_case,
            closed=True,
        ),
        Dimension(
            "intervention_type",
            "No interventions listed",
            lambda: _distinct_field(S.INTERVENTIONS_PATH, "type"),
            X.title_case,
            multi_valued=True,
            closed=True,
        ),
        Dimension(
            "country",
            "No location listed",
            lambda: _distinct_field(S.LOCATIONS_PATH, "country"),
            multi_valued=True,
        ),
        Dimension(
            "enrollment_bucket",
            "No enrollment data",
            lambda: X.single(bin_label(F.col(S.ENROLLMENT_PATH), V.ENROLLMENT_BINS)),
            lambda key: F.concat(key, F.lit(" participants")),
            listed_order([label for _low, _high, label in V.ENROLLMENT_BINS]),
            closed=True,
        ),
    ]
}


def register(dimension: Dimension) -> Dimension:
    """Add a user-defined axis."""
    DIMENSIONS[dimension.name] = dimension
    return dimension
