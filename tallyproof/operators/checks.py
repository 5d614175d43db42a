"""Quality checks: re-derive every published number and return what disagrees.

Each check is a DataFrame of violations ``(check, datum, expected, actual)``. A result is accepted
when the union of them is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.functions.text import study_url
from tallyproof.operators.citations import of_cited
from tallyproof.operators.network import node_evidence
from tallyproof.session import one_row


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def _row(check: str, datum, expected, actual) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        _text(datum).alias("datum"),
        _text(expected).alias("expected"),
        _text(actual).alias("actual"),
    ]


def datum_text(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _compare(
    check: str, published: DataFrame, derived: DataFrame, keys: list[str], value: str
) -> DataFrame:
    """Full outer comparison of two ``(keys..., value)`` tables; NULL keys match."""
    ours = published.select(datum_text(keys).alias("_k"), F.col(value).alias("_actual"))
    truth = derived.select(datum_text(keys).alias("_k"), F.col(value).alias("_expected"))
    both = ours.join(truth, "_k", "full_outer")
    return both.where(~F.col("_expected").eqNullSafe(F.col("_actual"))).select(
        *_row(check, F.col("_k"), F.col("_expected"), F.col("_actual"))
    )


def contributors(evidence: DataFrame, keys: list[str], value: str) -> DataFrame:
    return evidence.select(*keys, "entity_id").distinct().groupBy(*keys).agg(
        F.count("*").alias(value)
    )


def value_is_contributors(rows: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """A published value is the number of distinct contributors; a zero row has none."""
    return _compare(
        "value_is_contributors",
        rows.where(F.col("value") != 0),
        contributors(evidence, keys, "value"),
        keys,
        "value",
    )


def rows_are_computed(published: DataFrame, computed: DataFrame, columns: list[str]) -> DataFrame:
    """Published rows are the computed rows, in the same order."""
    body = datum_text(columns)
    ours = published.select("position", body.alias("_actual"))
    truth = computed.select("position", body.alias("_expected"))
    both = ours.join(truth, "position", "full_outer")
    return both.where(~F.col("_expected").eqNullSafe(F.col("_actual"))).select(
        *_row("rows_are_computed", F.col("position"), F.col("_expected"), F.col("_actual"))
    )


def graph_counts(nodes: DataFrame, edges: DataFrame, edge_evidence: DataFrame) -> DataFrame:
    """Node sizes and edge weights are distinct contributors over the drawn edges."""
    by_node = contributors(node_evidence(edge_evidence), ["id"], "size")
    by_edge = contributors(edge_evidence, ["source", "target"], "weight")
    return _compare("node_size", nodes, by_node, ["id"], "size").unionByName(
        _compare("edge_weight", edges, by_edge, ["source", "target"], "weight")
    )


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("source", "target", F.explode(F.array("source", "target")).alias("id"))
    return ends.join(nodes.select("id"), "id", "left_anti").select(
        *_row("dangling_edge", datum_text(["source", "target"]), "a node", F.col("id"))
    )


def node_contributors(published: DataFrame, edge_evidence: DataFrame) -> DataFrame:
    """Entities claimed for a node ``(id, entity_id)`` are exactly those on its edges."""
    truth = node_evidence(edge_evidence)
    return _difference("node_contributors", published, truth, ["id", "entity_id"])


def _difference(
    check: str, published: DataFrame, computed: DataFrame, columns: list[str]
) -> DataFrame:
    """Both directions of a multiset difference. Counts and sums of two hashes of the rows tell whether
    there is any; only then are rows compared."""
    ours, truth = published.select(*columns), computed.select(*columns)
    datum = datum_text(columns)
    if multiset_fingerprint(ours) == multiset_fingerprint(truth):
        return ours.where(F.lit(False)).select(*_row(check, datum, "absent", "present"))
    extra = ours.exceptAll(truth).select(*_row(check, datum, "absent", "present"))
    missing = truth.exceptAll(ours).select(*_row(check, datum, "present", "absent"))
    return extra.unionByName(missing)


def multiset_fingerprint(rows: DataFrame) -> tuple:
    """The number of rows and the exact sums of two independent hashes of them: equal for equal rows in
    any order, repeated ones counted, from one pass without a shuffle of rows."""
    marked = [F.col(f"`{c}`").isNull() for c in rows.columns]  # a hash passes nulls over
    body = [F.col(f"`{c}`") for c in rows.columns]
    sums = [F.sum(F.xxhash64(F.lit(salt), *body, *marked).cast("decimal(20,0)")) for salt in ("one", "two")]
    return tuple(rows.agg(F.count("*"), *sums).first())


def published_graph(
    nodes: DataFrame, edges: DataFrame, computed_nodes: DataFrame, computed_edges: DataFrame
) -> DataFrame:
    """No node or edge repeated, missing, added or renumbered on the way out."""
    checks = []
    for check, ours, truth, keys, value in (
        ("published_node", nodes, computed_nodes, ["id"], "size"),
        ("published_edge", edges, computed_edges, ["source", "target"], "weight"),
    ):
        repeated = ours.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        checks.append(
            repeated.select(*_row(f"{check}_repeated", datum_text(keys), 1, F.col("_n")))
        )
        checks.append(_difference(check, ours, truth, [*keys, value]))
    return reduce(DataFrame.unionByName, checks)


def merge_claims(nodes: DataFrame) -> DataFrame:
    """A node ``(id, rxcui, merged_names)`` that claims a merge has an identity and two names."""
    claimed = F.coalesce("merged_names", F.lit(0))
    without_identity = nodes.where((claimed > 0) & F.col("rxcui").isNull()).select(
        *_row("merge_without_identity", F.col("id"), "identity", None)
    )
    too_few = nodes.where((claimed > 0) & (claimed < 2)).select(
        *_row("merge_of_one", F.col("id"), 2, claimed)
    )
    return without_identity.unionByName(too_few)


def citation_membership(
    cited: DataFrame, evidence: DataFrame, records: DataFrame, keys: list[str]
) -> DataFrame:
    """A cited entity is a known record and a contributor of that very datum."""
    datum = datum_text([*keys, "entity_id"])
    records, evidence = of_cited(records.select("entity_id"), cited), of_cited(evidence, cited)
    unknown = cited.join(records, "entity_id", "left_anti").select(
        *_row("cited_unknown_record", datum, "a record", F.col("entity_id"))
    )
    on = [*keys, "entity_id"]
    condition = reduce(
        lambda a, b: a & b, [F.col(f"c.{c}").eqNullSafe(F.col(f"e.{c}")) for c in on]
    )
    foreign = (
        cited.alias("c")
        .join(evidence.select(*on).alias("e"), condition, "left_anti")
        .select(*_row("cited_non_contributor", datum, "a contributor", F.col("entity_id")))
    )
    return unknown.unionByName(foreign)


def citation_totals(
    rows: DataFrame, cited: DataFrame, totals: DataFrame, evidence: DataFrame, keys: list[str], limit: int
) -> DataFrame:
    """Supporting ``totals(keys..., total)`` are exact, citations do not exceed them, a positive
    value is cited unless no citations were asked for, and none are given when none were asked
    for."""
    none = F.lit(None).cast("bigint")
    claimed = totals.select(*keys, F.col("total").alias("_claimed"), none.alias("_quoted"), F.lit(0).alias("_one"))
    given = cited.select(*keys, none.alias("_claimed"), F.col("total").alias("_quoted"), F.lit(1).alias("_one"))
    per_datum = claimed.unionByName(given).groupBy(*keys).agg(
        F.sum("_one").alias("_cited"),
        F.max("_claimed").alias("_listed"),
        F.max("_quoted").alias("_quoted"),
    )
    truth = contributors(evidence, keys, "_true")
    datum = datum_text(keys).alias("_k")
    joined = (
        rows.select(datum, F.col("value"))
        .join(per_datum.select(datum, "_cited", "_listed", "_quoted"), "_k", "full_outer")
        .join(truth.select(datum, "_true"), "_k", "left")
        .withColumn("_n", F.coalesce("_cited", F.lit(0)))
        # The total that a citation states, else the listed one; the two must not differ.
        .withColumn("_claimed", F.coalesce("_quoted", "_listed"))
    )
    listed_wrong = ~F.col("_listed").eqNullSafe(F.col("_true"))
    quoted_wrong = F.col("_quoted").isNotNull() & (F.col("_quoted") != F.col("_true"))
    k = F.col("_k")
    parts = [
        joined.where(listed_wrong | F.coalesce(quoted_wrong, F.lit(True))).select(
            *_row("supporting_total", k, F.col("_true"), F.col("_claimed"))
        ),
        joined.where(F.col("_n") > F.coalesce("_claimed", F.lit(0))).select(
            *_row("more_citations_than_total", k, F.col("_claimed"), F.col("_n"))
        ),
    ]
    if limit == 0:
        unwanted = joined.where(F.col("_n") > 0)
        parts.append(unwanted.select(*_row("unwanted_citations", k, 0, F.col("_n"))))
    else:
        bare = joined.where((F.coalesce("value", F.lit(0)) != 0) & (F.col("_n") == 0))
        parts.append(bare.select(*_row("uncited_value", k, "citations", 0)))
    return reduce(DataFrame.unionByName, parts)


def citation_texts(
    cited: DataFrame, expected: DataFrame, keys: list[str], url: str
) -> DataFrame:
    """Excerpts are not empty and equal the re-derived ``(entity_id, excerpt)``; links too."""
    datum = datum_text([*keys, "entity_id"])
    blank = cited.where(F.coalesce(F.trim("excerpt"), F.lit("")) == "").select(
        *_row("empty_excerpt", datum, "text", F.col("excerpt"))
    )
    truth = of_cited(expected.select("entity_id", F.col("excerpt").alias("_excerpt")), cited)
    both = cited.join(truth, "entity_id")
    quoted = both.where(~F.col("excerpt").eqNullSafe(F.col("_excerpt"))).select(
        *_row("excerpt", datum, F.col("_excerpt"), F.col("excerpt"))
    )
    link = study_url(F.col("entity_id"), url)
    linked = cited.where(~F.col("url").eqNullSafe(link)).select(
        *_row("link", datum, link, F.col("url"))
    )
    return blank.unionByName(quoted).unionByName(linked)


def not_empty(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """A result without rows needs a declared reason."""
    counted = rows.agg(F.count("*").alias("_rows"))
    reason = manifest.select(F.col("empty_reason").alias("_reason"))
    return one_row(counted, reason).where(
        (F.col("_rows") == 0) & F.col("_reason").isNull()
    ).select(*_row("not_empty", "result", "rows or a reason", 0))


def processed_count(manifest: DataFrame, records: DataFrame, provenance: DataFrame) -> DataFrame:
    """The manifest counts the records processed, and something was read."""
    truth = records.agg(F.count("*").alias("_true"))
    sources = provenance.agg(F.count("*").alias("_sources"))
    joined = one_row(manifest.select("processed"), truth, sources)
    wrong = joined.where(~F.col("processed").eqNullSafe(F.col("_true"))).select(
        *_row("processed_count", "manifest", F.col("_true"), F.col("processed"))
    )
    unsourced = joined.where(F.col("_sources") == 0).select(
        *_row("provenance", "manifest", "sources", 0)
    )
    return wrong.unionByName(unsourced)


def series_complete(rows: DataFrame, promised: DataFrame) -> DataFrame:
    """Every promised ``(series)`` has a row."""
    return promised.select("series").join(
        rows.select("series").distinct(), "series", "left_anti"
    ).select(*_row("series_complete", F.col("series"), "rows", "none"))


def violations(*checks: DataFrame) -> DataFrame:
    """All violations of the given checks."""
    return reduce(DataFrame.unionByName, checks)
