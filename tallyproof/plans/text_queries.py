"""Text tagging and grounding.

Phase, year and status words do not occur in the given texts, so sentences are written from the
columns of every row, in front of and behind the given text; the SQL states from the columns what
must be read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V
from tallyproof.functions import mentions as M
from tallyproof.functions import text as X
from tallyproof.operators import grounding
from tallyproof.plans import star
from tallyproof.plans.registry import query


def _joined(values):
    return F.array_join(values.cast("array<string>"), ",")


def _case(column: str, answers: dict[str, str]):
    """SQL text: what each value of ``column`` must give."""
    whens = " ".join(f"when '{k}' then {v}" for k, v in answers.items())
    return f"case {column} {whens} end"


_PHASE_TEXTS = {
    "1-URGENT": "phase 2 study of 3 drugs",
    "2-HIGH": "Phases I, III and 4",
    "3-MEDIUM": "early phase 1 and phase-II/III",
    "4-NOT SPECIFIED": "in phase, 3 patients",
    "5-LOW": "Phase1/2 or early-phase 1 after phase 4",
}


@query(
    "select o_orderkey, "
    + _case(
        "o_orderpriority",
        {
            "1-URGENT": "'2'",
            "2-HIGH": "'1,3,4'",
            "3-MEDIUM": "'0,2,3'",
            "4-NOT SPECIFIED": "''",
            "5-LOW": "'0,1,2,4'",
        },
    )
    + " as phases, "
    + _case(
        "o_orderpriority",
        {
            "1-URGENT": "'phase'",
            "2-HIGH": "'phase'",
            "3-MEDIUM": "'phase'",
            "4-NOT SPECIFIED": "'phase'",
            "5-LOW": "'phase'",
        },
    )
    + " as axis from orders"
)
def text_phases(spark, sf):
    text = X.literal_map(_PHASE_TEXTS)[F.col("o_orderpriority")]
    return star.table(spark, sf, "orders").select(
        "o_orderkey",
        _joined(M.phase_mentions(text)).alias("phases"),
        M.axis_mention(text).alias("axis"),
    )


@query(
    """
    with years as (select *, cast(year(o_orderdate) as integer) as y from orders)
    select o_orderkey,
      case o_orderpriority
        when '1-URGENT' then y when '2-HIGH' then y + 1 when '3-MEDIUM' then y - 2
        when '4-NOT SPECIFIED' then null else y + 3 end as first,
      case o_orderpriority
        when '1-URGENT' then y + 2 when '2-HIGH' then null when '3-MEDIUM' then y
        when '4-NOT SPECIFIED' then y else y - 1 end as last,
      case o_orderpriority
        when '1-URGENT' then y || ',' || (y + 2) when '3-MEDIUM' then (y - 2) || ',' || y
        when '5-LOW' then y || ',' || (y + 2) else cast(y as varchar) end as years
    from years
    """
)
def text_years(spark, sf):
    y = F.year("o_orderdate")

    def said(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", said("trials since ", y, " and up to ", y + 2))
        .when(priority == "2-HIGH", said("sponsored by ", y, " funds, after ", y))
        .when(priority == "3-MEDIUM", said("between ", y, " and ", y - 2, " by 1975"))
        .when(priority == "4-NOT SPECIFIED", said("to be finished by ", y, " 20500 mg"))
        .otherwise(said("later than ", y + 2, " but before ", y))
    )
    span = M.year_range(text)
    return star.table(spark, sf, "orders").select(
        "o_orderkey",
        span["start"].alias("first"),
        span["end"].alias("last"),
        _joined(M.year_mentions(text)).alias("years"),
    )


_STATUS_TEXTS = {
    "AUTOMOBILE": "not yet recruiting trials and studies that were completed",
    "BUILDING": "active, not recruiting; never enrolling by invitation",
    "FURNITURE": "excluding recruiting, completed or unknown status and terminated trials",
    "HOUSEHOLD": "halted recruiting, not completed and withdrawn",
    "MACHINERY": "re-enrolling or incomplete, no longer available; aren't finished",
}


@query(
    "select o_orderkey, "
    + _case(
        "c_mktsegment",
        {
            "AUTOMOBILE": "'COMPLETED,NOT_YET_RECRUITING'",
            "BUILDING": "'ACTIVE_NOT_RECRUITING'",
            "FURNITURE": "''",
            "HOUSEHOLD": "'WITHDRAWN'",
            "MACHINERY": "'NO_LONGER_AVAILABLE'",
        },
    )
    + " as wanted, "
    + _case(
        "c_mktsegment",
        {
            "AUTOMOBILE": "''",
            "BUILDING": "'ENROLLING_BY_INVITATION'",
            "FURNITURE": "'COMPLETED,RECRUITING,TERMINATED,UNKNOWN'",
            "HOUSEHOLD": "'COMPLETED,RECRUITING'",
            "MACHINERY": "'COMPLETED'",
        },
    )
    + " as excluded from orders join customer on o_custkey = c_custkey"
)
def text_status(spark, sf):
    orders = star.table(spark, sf, "orders").join(
        star.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    said = M.status_mentions(X.literal_map(_STATUS_TEXTS)[F.col("c_mktsegment")])
    # Generated from a one-element array, so that the tags are worked out once for both columns.
    return orders.select("o_orderkey", F.inline(F.array(said))).select(
        "o_orderkey", _joined(F.col("wanted")).alias("wanted"), _joined(F.col("excluded")).alias("excluded")
    )


@query(
    """
    select conv_id, turn, role,
      cast(turn % 4 + 1 as varchar) as phases,
      case role when 'assistant' then 'sponsor_drug' when 'user' then 'drug_drug' end as graph,
      cast(role = 'system' as integer) as whole_registry,
      cast(1980 + turn as varchar) as years
    from conversations where turn < 60
    union all
    select conv_id, turn, role, cast(turn % 4 + 1 as varchar),
      case role when 'assistant' then 'sponsor_drug' when 'user' then 'drug_drug' end,
      cast(role = 'system' as integer), '' from conversations where turn >= 60
    """
)
def text_conversations(spark, sf):
    """Tags of every whole turn with a sentence written behind it."""
    turn = F.col("turn")
    ending = (
        F.when(F.col("role") == "assistant", F.lit(" Which sponsors ran it?"))
        .when(F.col("role") == "user", F.lit(" Drugs studied together in combination."))
        .otherwise(F.lit(" Count all clinical trials."))
    )
    text = F.concat(
        F.col("text"),
        F.lit("\nPhase "),
        (turn % 4 + 1).cast("string"),
        F.lit(" in "),
        (turn + 1980).cast("string"),
        F.lit("."),
        ending,
    )
    return star.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        "role",
        _joined(M.phase_mentions(text)).alias("phases"),
        M.graph_kind_mention(text).alias("graph"),
        M.names_whole_registry(text).cast("int").alias("whole_registry"),
        _joined(M.year_mentions(text)).alias("years"),
    )


# --- whole documents with a sentence of each kind ----------------------------------------------


def _documents(spark, sf, sentences: list[str]):
    """Every whole document with one of the sentences behind it, by its id; ``(doc_id, text)``."""
    listed = F.array(*[F.lit(x) for x in sentences])
    sentence = F.get(listed, (F.col("doc_id") % len(sentences)).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nIn short: "), sentence)
    return star.table(spark, sf, "documents").select("doc_id", text.alias("text"))


def _tags_sql(columns: list[str], tags: list[tuple]) -> str:
    """SQL text: the tags of the sentence that each document has behind it."""

    def shown(value) -> str:
        return "null" if value is None else str(value) if isinstance(value, int) else f"'{value}'"

    rows = ", ".join(f"({i}, {', '.join(map(shown, row))})" for i, row in enumerate(tags))
    return (
        f"with said(nth, {', '.join(columns)}) as (values {rows}) "
        f"select doc_id, {', '.join(columns)} from documents join said on doc_id % {len(tags)} = nth"
    )


_STATUS_OF = {phrase: status for status, phrases in V.STATUS_VOCABULARY.items() for phrase in phrases}
#: More than a dozen items, all under one word that excludes them.
_LONG_LIST = [
    "completed", "terminated", "recruiting", "unknown status", "upcoming", "expanded access", "enrolling by invitation",
    "suspended", "no longer available", "closed to enrollment", "concluded", "finished", "on hold",
]


def _status_sentences() -> list[tuple[str, str, str]]:
    """Each phrase wanted, refused, at the end of a long list, and, when it is one word, as part of
    another: ``(sentence, wanted, excluded)``."""
    listed = {_STATUS_OF[p] for p in _LONG_LIST}
    found = []
    for phrase, status in _STATUS_OF.items():
        found.append((f"show {phrase} ones.", status, ""))
        found.append((f"never {phrase}.", "", status))
        every = ",".join(sorted({*listed, status}))
        found.append((f"excluding {', '.join(_LONG_LIST)} and {phrase} trials.", "", every))
        if phrase.isalpha():
            found.append((f"pre-{phrase} ones.", "", ""))
    for cue in V.NEGATION_CUES:
        # Only a cue of one word reaches over another word.
        glue, gap = "" if cue == "n't" else " ", " really" if cue.isalpha() else ""
        found.append((f"those that are{glue}{cue}{gap} completed but recruiting ones too.", "RECRUITING", "COMPLETED"))
    return found


_STATUS_SENTENCES = _status_sentences()


@query(_tags_sql(["wanted", "excluded"], [s[1:] for s in _STATUS_SENTENCES]))
def text_status_documents(spark, sf):
    """Every status phrase and every word that negates, read in whole documents."""
    documents = _documents(spark, sf, [s[0] for s in _STATUS_SENTENCES])
    return documents.select("doc_id", F.inline(F.array(M.status_mentions(F.col("text"))))).select(
        "doc_id", _joined(F.col("wanted")).alias("wanted"), _joined(F.col("excluded")).alias("excluded")
    )


def _axis_sentences() -> list[tuple[str, str | None, str | None]]:
    """Every word of an axis and of a graph kind, alone and with one of another: ``(sentence, axis, graph)``."""
    found = []
    axes, kinds = list(V.AXIS_WORDS.items()), list(V.GRAPH_KIND_WORDS.items())
    for number, (axis, words) in enumerate(axes):
        other = axes[(number + 1) % len(axes)][1][0]
        found += [(f"studies by {w}.", axis, None) for w in words]
        found += [(f"studies by {w} and {other}.", None, None) for w in words]
    for number, (kind, words) in enumerate(kinds):
        other = kinds[1 - number][1][0]
        axis = "sponsor" if kind == "sponsor_drug" else None
        found += [(f"names {w} of them.", axis, kind) for w in words]
        found += [(f"names {w}, {other}.", "sponsor", None) for w in words]
    return found


_AXIS_SENTENCES = _axis_sentences()


@query(_tags_sql(["axis", "graph"], [s[1:] for s in _AXIS_SENTENCES]))
def text_axis_documents(spark, sf):
    """Every word of the seven axes and the two kinds of graphs, read in whole documents."""
    text = F.col("text")
    return _documents(spark, sf, [s[0] for s in _AXIS_SENTENCES]).select(
        "doc_id", M.axis_mention(text).alias("axis"), M.graph_kind_mention(text).alias("graph")
    )


#: Sentence, first year, last year, and the years written.
_YEAR_SENTENCES = [
    *[(f"{cue} 1999.", 1999, None, "1999") for cue in ("since", "from", "starting", "starting in", "beginning in", "onwards from")],
    *[(f"{cue} 1999.", 2000, None, "1999") for cue in ("after", "later than")],
    *[(f"{cue} 1999.", None, 1999, "1999") for cue in ("until", "till", "through", "up to")],
    *[(f"{cue} 1999.", None, 1998, "1999") for cue in ("before", "prior to", "earlier than")],
    *[(f"done {verb} by 2011.", None, None, "2011") for verb in V.AGENT_VERBS],
    *[(f"{verb} by 2011.", None, 2011, "2011") for verb in ("finished", "recruited", "over")],
    *[(f"{a} {glue} {b}.", 1990, 2031, "1990,2031") for glue in ("-", "to", "and", "through", "until", "till") for a, b in ((1990, 2031), (2031, 1990))],
    ("since 2020 and before 2015.", 2020, 2014, "2015,2020"),
    ("a dose of 1979 mg, 2040 ml, 20100 units.", None, None, ""),
]


@query(_tags_sql(["first", "last", "years"], [s[1:] for s in _YEAR_SENTENCES]))
def text_year_documents(spark, sf):
    """Every cue of a range of years, and every verb whose "by" names no year, read in whole documents."""
    text = F.col("text")
    span = M.year_range(text)
    return _documents(spark, sf, [s[0] for s in _YEAR_SENTENCES]).select(
        "doc_id", span["start"].alias("first"), span["end"].alias("last"), _joined(M.year_mentions(text)).alias("years")
    )


def _phase_sentences() -> list[tuple[str, str]]:
    """Each number and each list of two and three, in digits and roman, with each separator."""
    roman = {n: r.upper() for r, n in V.ROMAN_PHASES.items()}
    found = [(f"phase {n} of 4 arms.", str(n)) for n in (1, 2, 3, 4)] + [(f"Phase-{roman[n]} only.", str(n)) for n in roman]
    for glue in ("/", ", ", " & ", " + ", "-", " or ", " and ", " to "):
        found += [(f"phases {a}{glue}{roman[b]}.", ",".join(map(str, sorted({a, b})))) for a in (1, 2, 3, 4) for b in roman]
        found.append((f"phase I{glue}2{glue}iii.", "1,2,3"))
    found += [(f"early{glue}phase 1 and phase 3.", "0,3") for glue in (" ", "-")]
    found.append(("in phase, 3 of them.", ""))
    return found


_PHASE_SENTENCES = _phase_sentences()


@query(_tags_sql(["phases"], [s[1:] for s in _PHASE_SENTENCES]))
def text_phase_documents(spark, sf):
    """Phases in digits and roman, with every separator, read in whole documents."""
    return _documents(spark, sf, [s[0] for s in _PHASE_SENTENCES]).select(
        "doc_id", _joined(M.phase_mentions(F.col("text"))).alias("phases")
    )


def _texts(spark, sf):
    documents = star.table(spark, sf, "documents")
    return documents.select(F.col("doc_id").alias("text_id"), "text")


def _passages(spark, sf):
    return star.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("candidate_id"), F.col("text").alias("candidate")
    )


_GROUNDED_SQL = """
hits as (
  select doc_id as text_id, item_id as candidate_id, lower(d.text) as t, lower(trim(b.text)) as c
  from documents d join benchmark b on contains(lower(d.text), lower(trim(b.text)))
),
found as (
  select text_id, candidate_id from hits
  where (strpos(t, c) = 1 or not regexp_matches(t[strpos(t, c) - 1], '[\\p{L}\\p{N}_]'))
    and (not regexp_matches(right(c, 1), '[\\p{L}\\p{N}_]')
         or not regexp_matches(t[strpos(t, c) + length(c)], '[\\p{L}\\p{N}_]'))
)
"""


@query(f"with {_GROUNDED_SQL} select * from found")
def text_grounding(spark, sf):
    return grounding.exact_matches(_texts(spark, sf), _passages(spark, sf))


@query(f"with {_GROUNDED_SQL} select * from found")
def text_grounding_shuffled(spark, sf):
    """The same as for names that are too many to broadcast."""
    return grounding.exact_matches(_texts(spark, sf), _passages(spark, sf), broadcast_bytes=0)


@query(
    f"""
    with {_GROUNDED_SQL}
    select item_id as candidate_id from benchmark
    where item_id not in (select candidate_id from found)
    """
)
def text_dropped(spark, sf):
    passages = _passages(spark, sf)
    matches = grounding.exact_matches(_texts(spark, sf), passages)
    return grounding.dropped(passages, matches).select("candidate_id")


@query(
    """
    select doc_id as text_id, item_id as candidate_id
    from documents join benchmark on item_id = doc_id % 40 where doc_id % 4 < 3
    """
)
def text_inflected(spark, sf):
    """Item names written into every document: as they are, in the plural, with one character
    changed, and with three changed, which is too little like the name."""
    digest = F.md5(F.concat(F.lit("item"), F.col("item_id").cast("string")).cast("binary"))
    name = F.concat(F.substring(digest, 1, 7), F.lit(" "), F.substring(digest, 8, 8))
    items = star.table(spark, sf, "benchmark").select("item_id", name.alias("name"))

    def changed(*places):
        text = F.col("name")
        for place in places:
            text = F.overlay(text, F.lit("q"), F.lit(place))
        return text

    written = (
        F.when(F.col("doc_id") % 4 == 0, F.col("name"))
        .when(F.col("doc_id") % 4 == 1, F.concat("name", F.lit("s")))
        .when(F.col("doc_id") % 4 == 2, changed(5))
        .otherwise(changed(3, 10, 14))
    )
    documents = star.table(spark, sf, "documents").join(items, F.col("doc_id") % 40 == F.col("item_id"), "left")
    texts = documents.select(
        F.col("doc_id").alias("text_id"),
        F.concat(F.col("text"), F.lit("\nSupplied "), F.coalesce(written, F.lit("")), F.lit(", in full.")).alias("text"),
    )
    candidates = items.select(F.col("item_id").alias("candidate_id"), F.col("name").alias("candidate"))
    return grounding.inflected_matches(texts, candidates)
