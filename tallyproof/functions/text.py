"""Text cleaning, partial dates, numbers and evidence rendering."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only U+0020."""
    ends = [F.substring(text, 1, 1), F.substring(text, -1, 1)]
    # Most texts begin and end with a printed ASCII character, and need no pattern.
    bare = ends[0].between("!", "~") & ends[1].between("!", "~")
    return F.when(bare, text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def title_case(text: Column) -> Column:
    """``OTHER_GOV`` -> ``Other Gov``."""
    return F.initcap(F.lower(F.replace(text, F.lit("_"), F.lit(" "))))


def series_identity(label: Column) -> Column:
    """Identity of a series: case and spacing do not matter."""
    return F.lower(strip(collapse_spaces(label)))


def series_identity_of(label: str) -> str:
    """:func:`series_identity` of a label at hand."""
    return " ".join(label.split()).lower()


def status_code(text: Column) -> Column:
    """Canonical spelling of a status; NULL when blank."""
    return F.nullif(F.replace(F.upper(strip(text)), F.lit(" "), F.lit("_")), F.lit(""))


def leading_year(partial_date: Column) -> Column:
    """Year of ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` as text; NULL when there is none."""
    return F.nullif(F.regexp_extract(partial_date, r"(?U)^\s*([0-9]{4})", 1), F.lit(""))


def finite_score(value: Column) -> Column:
    """Score as double; NULL when unparseable, NaN or infinite, so that it fails closed."""
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def present(values: Column) -> Column:
    """Array without null and empty elements."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def single(value: Column) -> Column:
    """Scalar text as an array of zero or one key."""
    return present(F.array(value))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_word(text: Column, words: list[str]) -> Column:
    """Whether one of ``words`` occurs in ``text`` between non-word characters, any case."""
    options = "|".join(re.escape(w) for w in words)
    return text.rlike(rf"(?iU)(?<!\w)(?:{options})(?!\w)")


# --- intervention names ----------------------------------------------------------------------


def normalize_name(name: Column) -> Column:
    """Comparison key of a free-text agent name."""
    text = low = F.lower(name)
    for pattern in (
        V.PARENTHETICAL_PATTERN,
        V.DOSAGE_PATTERN,
        V.ROUTE_PATTERN,
        V.PUNCTUATION_PATTERN,
    ):
        text = F.regexp_replace(text, pattern, " ")
    cleaned = F.regexp_replace(collapse_spaces(text), r"^[ \-+]+|[ \-+]+$", "")
    return F.when(low.rlike(V.PLAIN_NAME_PATTERN), low).otherwise(cleaned)


def is_control_name(key: Column) -> Column:
    """Whether a normalised name is a control arm rather than an agent."""
    tokens = F.array(*[F.lit(t) for t in V.CONTROL_TOKENS])
    within = reduce(lambda a, b: a | b, [F.contains(key, F.lit(t)) for t in V.CONTROL_TOKENS])
    return key.isin(V.CONTROL_NAMES) | (within & F.arrays_overlap(F.split(key, " "), tokens))


def is_single_agent(name: Column) -> Column:
    """Whether a cleaned name plausibly denotes exactly one agent."""
    text = F.lower(strip(name))
    tokens = F.split(text, r"(?U)[\s-]+")
    named = F.filter(
        tokens,
        lambda t: (t != "") & ~t.isin(V.QUALIFIER_TOKENS) & ~t.rlike(r"^\p{Nd}+$"),
    )
    return (
        (F.length(text) >= 3)
        & ~text.rlike(V.CONNECTIVE_PATTERN)
        & ~text.rlike(V.COMPARATOR_PATTERN)
        & ~text.rlike(V.RESEARCH_CODE_PATTERN)
        & (F.size(named) <= 1)
    )


# --- evidence --------------------------------------------------------------------------------


def clip_title(title: Column, limit: int | None = None) -> Column:
    """The title, or with a limit its first characters; null is empty."""
    if limit is None:
        return F.coalesce(title, F.lit(""))
    clipped = F.concat(
        F.regexp_replace(F.substring(title, 1, limit), r"(?U)\s+$", ""), F.lit("...")
    )
    return F.when(F.length(title) > limit, clipped).otherwise(F.coalesce(title, F.lit("")))


def render_text(path: str, value: Column) -> Column:
    shown = F.concat(F.lit(f'{path}: "'), value, F.lit('"'))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(f"{path}: not reported")).otherwise(shown)


def render_number(path: str, value: Column) -> Column:
    shown = F.concat(F.lit(f"{path}: "), value.cast("string"))
    return F.coalesce(shown, F.lit(f"{path}: not reported"))


def render_list(path: str, values: Column) -> Column:
    def shown(v: Column) -> Column:
        listed = F.concat(F.lit(f"{path}: ["), F.array_join(v, ", "), F.lit("]"))
        return F.when(F.coalesce(F.size(v), F.lit(0)) == 0, F.lit(f"{path}: not reported")).otherwise(listed)

    return bind(values, shown)


def excerpt(title: Column, *fragments: Column, limit: int | None = None) -> Column:
    """Quoted title, with ``limit`` clipped to so many characters, then the evidence fragments."""
    quoted = clip_title(title, limit)
    has_title = quoted != ""
    if not fragments:
        return F.when(has_title, F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(
            F.lit("(no title in record)")
        )
    rendered = F.concat_ws("; ", *fragments)
    return F.when(
        has_title, F.concat(F.lit('"'), quoted, F.lit('" — '), rendered)
    ).otherwise(rendered)


def study_url(entity_id: Column, template: str = V.STUDY_URL_FORMAT) -> Column:
    return F.format_string(template, entity_id)
