"""Agent names of one study row, for quoting evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V
from tallyproof.functions.text import bind, is_control_name, normalize_name, strip


def is_agent(kind: Column, name: Column) -> Column:
    return kind.isin(V.DRUG_TYPES) & (F.coalesce(strip(name), F.lit("")) != "")


def agent_labels(interventions: Column) -> Column:
    """First surface form per normalised name, ordered by that name."""
    agents = F.filter(interventions, lambda i: is_agent(i["type"], i["name"]))
    keyed = F.array_sort(
        F.transform(
            agents,
            lambda i, nth: F.struct(
                normalize_name(i["name"]).alias("key"),
                nth.alias("nth"),
                strip(i["name"]).alias("label"),
            ),
        )
    )
    kept = F.filter(keyed, lambda e: (e["key"] != "") & ~is_control_name(e["key"]))

    def labels(named: Column) -> Column:
        # Sorted by key, so an element is the first of its key when the one before has another.
        firsts = F.filter(named, lambda e, at: ~F.get(named, at - 1)["key"].eqNullSafe(e["key"]))
        return F.transform(firsts, lambda e: e["label"])

    # Bound: else the names of a record would be cleaned again for each of them.
    return bind(kept, labels)
