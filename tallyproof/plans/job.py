"""One typed request over a study table: rows or a graph, citations, manifest, checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.functions import text as X
from tallyproof.functions.text import series_identity_of
from tallyproof.operators import checks, filters, manifest, measure, network, synonyms
from tallyproof.operators.citations import cite, evidence_totals, quote, study_excerpt
from tallyproof.operators.dimensions import DIMENSIONS
from tallyproof.operators.series import series_where
from tallyproof.session import collected, delete_paths, durable, one_row
from tallyproof.sources.pages import capped, split_cap
from tallyproof.streaming.ingest import SOURCE_ORDER


@dataclass(frozen=True)
class Job:
    """What to compute. Lists are alternatives; different fields must all hold."""

    drugs: list[str] = field(default_factory=list)
    conditions: list[str] = field(default_factory=list)
    sponsors: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    phases: list[int] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    excluded_statuses: list[str] = field(default_factory=list)
    start_year: int | None = None
    end_year: int | None = None
    free_text: str | None = None
    group_by: str = "phase"
    time_series: bool = False
    #: Series: which scope field is compared, and its values. Other scope fields still hold.
    compare_kind: str | None = None
    compare: list[str] = field(default_factory=list)
    #: Series by label, each a scope of its own: ``{"label": {"drugs": [...], "countries": [...]}}``. Its
    #: fields stand in place of the job's; the job's other fields still hold.
    series: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    #: ``drug_drug`` or ``sponsor_drug`` for a graph instead of rows.
    graph: str | None = None
    max_citations: int = V.DEFAULT_CITATIONS
    max_studies: int | None = None
    #: Limits of what is reported; None reports everything.
    top_n: int | None = None
    max_nodes: int | None = None
    max_left: int | None = None
    max_right: int | None = None
    max_entities: int | None = None
    #: Names looked up for synonyms, the busiest first; None looks up all.
    max_lookups: int | None = None
    #: Edges of fewer entities are not drawn; by default 2 for agents, 1 for sponsors and agents.
    min_weight: int | None = None
    #: Characters of a title that an excerpt quotes; None quotes all of it.
    title_length: int | None = None

    def __post_init__(self):
        # A blank value is no value, rather than one that nothing matches.
        for name in (*_FIELDS, "statuses", "excluded_statuses", "compare"):
            object.__setattr__(self, name, _filled(getattr(self, name)))
        object.__setattr__(self, "free_text", next(iter(_filled([self.free_text or ""])), None))
        scopes = {label: {k: _filled(v) for k, v in scope.items()} for label, scope in self.series.items()}
        object.__setattr__(self, "series", scopes)
        if self.start_year is not None and self.end_year is not None and self.start_year > self.end_year:
            raise ValueError("start_year must not be after end_year")
        if self.series and self.compare:
            raise ValueError("give either compare or series")
        for label, scope in self.series.items():
            if not label.strip() or not set(scope) <= set(_FIELDS) or not any(scope.values()):
                raise ValueError(f"series {label!r} needs a label and values of {sorted(_FIELDS)}")
        if self.max_citations < 0:
            raise ValueError("max_citations must not be negative")
        if self.group_by not in DIMENSIONS:
            raise ValueError(f"unknown dimension {self.group_by!r}")
        if self.compare and self.compare_kind not in _SCOPES:
            raise ValueError(f"compare_kind must be one of {sorted(_SCOPES)}")

    @property
    def scopes(self) -> dict[str, dict[str, list[str]]]:
        """The fields that each series has of its own, by the first spelling of its label."""
        given = self.series or {label: {_SCOPES[self.compare_kind][0]: [label]} for label in self.compare}
        return {label: given[label] for label in different_series(list(given))}

    @property
    def asked_series(self) -> int:
        return len(self.series) or len(self.compare)

    @property
    def has_local_filter(self) -> bool:
        """Whether rows are dropped after the cap rather than before it."""
        return bool(
            self.excluded_statuses
            or self.start_year is not None
            or self.end_year is not None
        )


def _filled(values: list[str]) -> list[str]:
    """Values without blanks around and within, and without those that are nothing else."""
    return [v for v in (" ".join(value.split()) for value in values) if v]


@dataclass(frozen=True)
class Result:
    """Rows or a graph. Citations, totals, manifest, accounting and checks are computed when they are
    first asked for, so a caller who reads rows pays for rows."""

    rows: DataFrame | None
    graph: network.Graph | None = None
    merged_from: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)
    #: Paths of the tables that the result reads.
    made: list[str] = field(default_factory=list)
    _later: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    _known: dict[str, DataFrame] = field(default_factory=dict)

    def _table(self, name: str) -> DataFrame:
        if name not in self._known:
            made: list[str] = []
            with collected(made):
                self._known[name] = self._later[name]()
            self.made.extend(made)
        return self._known[name]

    @property
    def citations(self) -> DataFrame:
        return self._table("citations")

    @property
    def manifest(self) -> DataFrame:
        return self._table("manifest")

    @property
    def violations(self) -> DataFrame:
        return self._table("violations")

    @property
    def totals(self) -> DataFrame:
        """How many entities support each datum, whatever is cited."""
        return self._table("totals")

    @property
    def accounting(self) -> DataFrame | None:
        """What each filter after the cap dropped; None without one."""
        return self._table("accounting") if "accounting" in self._later else None

    def release(self) -> None:
        """Drop what was kept for reading the result more than once, and delete what was written.
        The result cannot be read after that."""
        delete_paths(self.made)
        for table in self.held:
            table.unpersist()
        if self.graph is not None:
            self.graph.release()

    def tables(self) -> dict[str, DataFrame]:
        out = {"citations": self.citations, "manifest": self.manifest, "totals": self.totals}
        if self.accounting is not None:
            out["accounting"] = self.accounting
        if self.graph is None:
            return {"rows": self.rows, **out}
        out |= {"nodes": self.graph.nodes, "edges": self.graph.edges}
        return out if self.merged_from is None else {**out, "merged_from": self.merged_from}


_SCOPES = {
    "drug": ("drugs", lambda v: filters.scope_any(v, F.col(f"{S.INTERVENTIONS_PATH}.name"))),
    "condition": ("conditions", lambda v: filters.scope_any(v, F.col(S.CONDITIONS_PATH))),
    "sponsor": ("sponsors", lambda v: filters.scope(v, F.col(S.SPONSOR_PATH))),
    "country": ("countries", lambda v: filters.scope_any(v, F.col(f"{S.LOCATIONS_PATH}.country"))),
}


#: The fields of a scope, and how each is tested.
_FIELDS = {name: build for name, build in _SCOPES.values()}


def scope_filter(job: Job) -> Column:
    """The population: all scope fields except those that series have of their own."""
    own = {name for scope in job.scopes.values() for name in scope}
    condition = _holds({name: getattr(job, name) for name in _FIELDS if name not in own})
    if job.free_text:
        names = F.array_join(F.col(f"{S.INTERVENTIONS_PATH}.name"), " ")
        condition = condition & filters.free_text(
            job.free_text, F.col(S.TITLE_PATH), names, F.col(S.SPONSOR_PATH)
        )
    return condition


def _holds(scope: dict[str, list[str]]) -> Column:
    """Whether a record has one of the values of every field that has values."""
    condition = F.lit(True)
    for name, values in scope.items():
        part = _FIELDS[name](values)
        if part is not None:
            condition = condition & F.coalesce(part, F.lit(False))
    return condition


def asked_filter(job: Job) -> Column:
    """Requested phases and statuses, which hold before the cap is applied."""
    condition = F.lit(True)
    if job.phases:
        wanted = filters.phases_in(job.phases, F.col(S.PHASES_PATH))
        condition = condition & F.coalesce(wanted, F.lit(False))
    if job.statuses:
        wanted = filters.status_in(job.statuses, F.col(S.STATUS_PATH))
        condition = condition & F.coalesce(wanted, F.lit(False))
    return condition


def _year() -> Column:
    return X.leading_year(F.col(S.DATE_PATH)).try_cast("int")


def predicates(job: Job) -> dict[str, Column]:
    """Named predicates after the cap, in the order they are accounted for."""
    steps = {}
    if job.excluded_statuses:
        steps["status_excluded"] = filters.status_not_in(
            job.excluded_statuses, F.col(S.STATUS_PATH)
        )
    if job.start_year is not None or job.end_year is not None:
        steps["year"] = filters.year_between(_year(), job.start_year, job.end_year)
    return steps


def different_series(labels: list[str]) -> list[str]:
    """The labels of different identity, in order; of equal ones the first spelling stays."""
    first: dict[str, str] = {}
    for label in labels:
        first.setdefault(series_identity_of(label), label)
    return list(first.values())


def _compared(job: Job, population: DataFrame) -> tuple[DataFrame, dict[str, dict]]:
    """``(series, entity_id)``, and with a cap the facts of sharing it over the series."""
    own = {name for scope in job.scopes.values() for name in scope}
    # A field that only other series have is the job's own here.
    tests = {label: _holds({name: scope.get(name) or getattr(job, name) for name in own}) for label, scope in job.scopes.items()}
    if job.max_studies is None:
        return series_where(population, S.ID_PATH, tests), {}
    searches = {
        label: population.where(test).select(F.col(S.ID_PATH).alias("entity_id"), *SOURCE_ORDER)
        for label, test in tests.items()
    }
    return split_cap(searches, "entity_id", SOURCE_ORDER, job.max_studies)


def run(
    job: Job,
    studies: DataFrame,
    candidates: DataFrame | None = None,
    ingredients: DataFrame | None = None,
    provenance: DataFrame | None = None,
    data_as_of: str | None = None,
) -> Result:
    """Compute ``job`` over ``studies``, one row per id (see ``first_writer``)."""
    made: list[str] = []
    with collected(made):
        result = _run(job, studies, candidates, ingredients, provenance, data_as_of)
    return replace(result, made=made)


def _run(
    job: Job,
    studies: DataFrame,
    candidates: DataFrame | None = None,
    ingredients: DataFrame | None = None,
    provenance: DataFrame | None = None,
    data_as_of: str | None = None,
) -> Result:
    scoped = studies.where(scope_filter(job))
    population = scoped.where(asked_filter(job))
    series, shares = None, {}
    if job.scopes:
        series, shares = _compared(job, population)
        # A comparison reads exactly the studies its series name.
        population = population.join(
            series.select(F.col("entity_id").alias("_id")).distinct(),
            F.col(S.ID_PATH) == F.col("_id"),
            "left_semi",
        )
    whole = population
    if job.max_studies is not None and not shares:
        population = capped(population, SOURCE_ORDER, job.max_studies)

    @cache
    def facts() -> dict:
        matching = fetched = whole.count()
        truncated = False
        if shares:
            truncated = any(f["capped"] for f in shares.values())
            matching = max(f["total_matching"] for f in shares.values())
        elif job.max_studies is not None:
            fetched = min(matching, job.max_studies)
            truncated = fetched < matching
        return {
            "fetched": fetched,
            "total_matching": matching,
            "truncated": truncated,
            "data_as_of": data_as_of,
            "cap": job.max_studies,
            "shares": {label: f["share"] for label, f in shares.items()},
            "unfiltered": scoped.count() if matching == 0 and (job.phases or job.statuses) else None,
        }

    steps = predicates(job)
    kept = F.lit(True)
    for step in steps.values():
        kept = kept & F.coalesce(step, F.lit(False))
    records = used_fields(job, population.where(kept))
    compute = _graph_result if job.graph else _rows_result
    result = compute(job, records, series, candidates, ingredients, provenance, facts)
    if steps:
        result._later["accounting"] = lambda: filters.filter_accounting(population, steps, {"year": _year().isNull()})
    return result


def used_fields(job: Job, studies: DataFrame) -> DataFrame:
    """The modules of a record that the job counts and quotes; the others are never kept."""
    modules = {"identificationModule"}
    if job.graph:
        modules |= {"armsInterventionsModule", "sponsorCollaboratorsModule"}
    else:
        modules.add(_MODULES[job.group_by])
    shape = studies.schema["protocolSection"].dataType
    section = F.struct(
        *[
            (F.col(f"protocolSection.{f.name}") if f.name in modules else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in shape.fields
        ]
    )
    return studies.select(section.alias("protocolSection"))


_MODULES = {
    "phase": "designModule",
    "enrollment_bucket": "designModule",
    "start_year": "statusModule",
    "status": "statusModule",
    "sponsor": "sponsorCollaboratorsModule",
    "sponsor_class": "sponsorCollaboratorsModule",
    "intervention_type": "armsInterventionsModule",
    "country": "contactsLocationsModule",
}


def _manifest(job: Job, records: DataFrame, totals: DataFrame, n_rows: int, facts: dict) -> DataFrame:
    processed = records.count()
    reason = manifest.empty_reason(
        processed, n_rows, facts["fetched"], facts["truncated"], job.has_local_filter
    )
    scoped = bool(job.drugs or job.conditions or job.sponsors or job.countries or job.scopes)
    literal = {
        "processed": F.lit(processed).cast("bigint"),
        "fetched": F.lit(facts["fetched"]).cast("bigint"),
        "total_matching": F.lit(facts["total_matching"]).cast("bigint"),
        "truncated": F.lit(facts["truncated"]),
        "cap": F.lit(facts["cap"]).cast("bigint"),
        "series_shares": (X.literal_map(facts["shares"]) if facts["shares"] else F.lit(None)).cast(
            "map<string,bigint>"
        ),
        "unscoped_sample": F.lit(facts["truncated"] and not scoped),
        "capped_before_filter": F.lit(facts["truncated"] and scoped and job.has_local_filter),
        "data_as_of": F.lit(facts["data_as_of"]).cast("string"),
        # What the scope alone would have matched, when the requested phases or statuses leave none.
        "unfiltered_matching": F.lit(facts["unfiltered"]).cast("bigint"),
        # Series that were asked for under another spelling of one before.
        "series_collapsed": F.lit(job.asked_series - len(job.scopes)).cast("bigint"),
        "empty_reason": F.lit(reason).cast("string"),
    }
    return totals.select(*[v.alias(k) for k, v in literal.items()], "*")


def _report(job: Job, records: DataFrame, series: DataFrame | None, members: DataFrame) -> DataFrame:
    """The rows of a report over a membership table."""
    dimension = DIMENSIONS[job.group_by]
    rows = measure.bucket_counts(members, dimension, job.top_n, not job.time_series)
    if job.scopes:
        rows = measure.zero_fill_series(rows, list(job.scopes))
    if job.time_series:
        rows = measure.zero_fill_years(rows, job.start_year, job.end_year)
    return rows


def _rows_result(job, records, series, _candidates, _ingredients, provenance, facts) -> Result:
    records = records.persist(StorageLevel.MEMORY_AND_DISK)
    dimension = DIMENSIONS[job.group_by]
    show_unknown = not job.time_series
    computed = measure.membership(records, dimension, S.ID_PATH, series)
    members = computed.persist(StorageLevel.MEMORY_AND_DISK)
    rows = _report(job, records, series, members).persist(StorageLevel.MEMORY_AND_DISK)
    published = rows.where(F.col("value") > 0).select(
        "position", F.coalesce("series", F.lit("")).alias("_s"), F.col("raw_key").alias("key")
    )
    shown = members if show_unknown else members.where(~F.col("is_unknown"))
    evidence = shown.withColumn("_s", F.coalesce("series", F.lit(""))).join(
        published, ["_s", "key"]
    ).select("position", "entity_id")
    excerpt = study_excerpt(dimension.name, job.title_length)
    ids = records.select(F.col(S.ID_PATH).alias("entity_id"))
    result = Result(rows, held=[records, members, rows])

    def citations() -> DataFrame:
        return durable(quote(cite(evidence, ["position"], job.max_citations, ids), records, S.ID_PATH, excerpt))

    def final() -> DataFrame:
        totals = measure.bucket_totals(members, dimension, job.top_n, show_unknown, records if series is None else None)
        return _manifest(job, records, totals, rows.count(), facts())

    def violations() -> DataFrame:
        found = [
            checks.value_is_contributors(rows, evidence, ["position"]),
            checks.rows_are_computed(
                rows, _report(job, records, series, computed), ["series", "raw_key", "key", "value"]
            ),
            checks.citation_membership(result.citations, evidence, ids, ["position"]),
            checks.citation_totals(rows, result.citations, result.totals, evidence, ["position"], job.max_citations),
            checks.citation_texts(
                result.citations,
                records.select(F.col(S.ID_PATH).alias("entity_id"), excerpt.alias("excerpt")),
                ["position"],
                V.STUDY_URL_FORMAT,
            ),
            checks.not_empty(rows, result.manifest),
        ]
        if provenance is not None:
            found.append(checks.processed_count(result.manifest, records, provenance))
        if job.scopes:
            promised = rows.sparkSession.createDataFrame([(s,) for s in job.scopes], "series string")
            if rows.where("value > 0").limit(1).count():
                found.append(checks.series_complete(rows, promised))
        return checks.violations(*found)

    result._later.update(
        citations=citations, manifest=final, totals=lambda: evidence_totals(evidence, ["position"]), violations=violations
    )
    return result


def _graph_result(job, records, _series, candidates, ingredients, provenance, facts) -> Result:
    crosswalk = forms = merged = None
    resolved = candidates is not None and ingredients is not None
    # A graph of names as they are reads the records once: they are kept for those who read more than that.
    once = job.graph == "drug_drug" and not resolved
    if not once:
        records = records.persist(StorageLevel.MEMORY_AND_DISK)
    if resolved:
        forms = durable(synonyms.study_surface_forms(records))
        pool = None
        if job.max_lookups is not None:
            agents = network.study_agents(records)
            pool = network.candidate_names(agents, job.max_lookups).withColumnRenamed("key", "name")
        crosswalk = durable(synonyms.resolve_names(forms, candidates, ingredients, pool=pool))
        merged = synonyms.merge_sources(forms, crosswalk)
    named = network.study_agents(records, crosswalk)
    held = [records]
    if once:
        graph = _graph(job, records, named)
        records.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        agents = named.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(agents)
        graph = _graph(job, records, agents)
    edge_data = graph.edge_evidence.select(
        F.lit("edge").alias("datum"), F.concat_ws("|", "source", "target").alias("name"), "entity_id"
    )
    kinds = graph.nodes.select("id", "kind")
    node_data = graph.node_evidence.join(kinds, "id").select(
        F.lit("node").alias("datum"), F.col("id").alias("name"), "entity_id", "kind"
    )
    datum = ["datum", "name"]
    excerpts = {"edge": "sponsor_drug" if job.graph == "sponsor_drug" else "drug", "drug": "drug", "sponsor": "sponsor"}
    quoted = {k: study_excerpt(d, job.title_length) for k, d in excerpts.items()}
    data = {"edge": edge_data, **{k: node_data.where(F.col("kind") == k).drop("kind") for k in ("drug", "sponsor")}}
    if job.graph != "sponsor_drug":
        del data["sponsor"]
    all_data = edge_data.unionByName(node_data.drop("kind"))
    drawn = graph.edges.select(
        F.lit("edge").alias("datum"), F.concat_ws("|", "source", "target").alias("name"), F.col("weight").alias("value")
    ).unionByName(graph.nodes.select(F.lit("node").alias("datum"), F.col("id").alias("name"), F.col("size").alias("value")))
    ids = records.select(F.col(S.ID_PATH).alias("entity_id"))
    result = Result(None, graph, merged, held=held)

    def citations() -> DataFrame:
        parts = [
            quote(cite(evidence, datum, job.max_citations, ids), records, S.ID_PATH, quoted[kind])
            for kind, evidence in data.items()
        ]
        return durable(reduce(DataFrame.unionByName, [p.withColumn("kind", F.lit(k)) for p, k in zip(parts, data)]))

    def final() -> DataFrame:
        totals = graph.totals
        if crosswalk is not None:
            names = forms.select("name").distinct()
            totals = one_row(totals, synonyms.resolution_totals(names, crosswalk))
        return _manifest(job, records, totals, graph.edges.count(), facts())

    def violations() -> DataFrame:
        cited = result._table("cited")
        found = []
        for kind in data:
            truth = records.select(F.col(S.ID_PATH).alias("entity_id"), quoted[kind].alias("excerpt"))
            found.append(checks.citation_texts(cited.where(F.col("kind") == kind), truth, datum, V.STUDY_URL_FORMAT))
        # The graph is drawn once more, from the records, and must be what is published.
        again = _graph(job, records, named)
        found += [
            checks.graph_counts(graph.nodes, graph.edges, graph.edge_evidence),
            checks.dangling_edges(graph.nodes, graph.edges),
            checks.node_contributors(graph.node_evidence, again.edge_evidence),
            checks.published_graph(graph.nodes, graph.edges, again.nodes, again.edges),
            checks.citation_membership(result.citations, all_data, ids, datum),
            checks.citation_totals(drawn, result.citations, result.totals, all_data, datum, job.max_citations),
            checks.not_empty(graph.edges, result.manifest),
        ]
        result.held.extend(again.held)
        result.made.extend(again.made)
        if merged is not None:
            claims = merged.select("key", F.col("sources").alias("merged_names")).distinct()
            key = F.substring_index(F.col("id"), ":", -2)
            found.append(
                checks.merge_claims(
                    graph.nodes.withColumn("key", key).join(claims, "key", "left").select("id", "rxcui", "merged_names")
                )
            )
        if provenance is not None:
            found.append(checks.processed_count(result.manifest, records, provenance))
        return checks.violations(*found)

    result._later.update(
        cited=citations, citations=lambda: result._table("cited").drop("kind"), manifest=final,
        totals=lambda: evidence_totals(all_data, datum), violations=violations,
    )
    return result


def _graph(job: Job, records: DataFrame, agents: DataFrame) -> network.Graph:
    if job.graph == "sponsor_drug":
        return network.bipartite(
            network.study_sponsors(records), agents, job.max_left, job.max_right, min_weight=job.min_weight or 1
        )
    weight = V.MIN_EDGE_WEIGHT if job.min_weight is None else job.min_weight
    return network.cooccurrence(agents, weight, job.max_nodes, job.max_entities)
