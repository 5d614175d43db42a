"""What a text says about phases, years, statuses, axes and graph kinds.

Each function turns a text column into a column, so a table of any number of texts is tagged in
one projection.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V
from tallyproof.functions.text import bind, literal_map


def phase_mentions(text: Column) -> Column:
    """Sorted distinct phase numbers; 0 is Early Phase 1."""
    rest = F.regexp_replace(text, V.EARLY_PHASE_PATTERN, " ")
    lists = F.regexp_extract_all(rest, F.lit(V.PHASE_LIST_PATTERN), F.lit(1))
    tokens = F.flatten(
        F.transform(
            lists, lambda run: F.regexp_extract_all(run, F.lit(V.PHASE_TOKEN_PATTERN), F.lit(1))
        )
    )
    numbers = literal_map({**{str(n): n for n in range(1, 5)}, **V.ROMAN_PHASES})
    named = F.transform(tokens, lambda token: numbers[F.lower(token)])
    early = F.when(text.rlike(V.EARLY_PHASE_PATTERN), F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_sort(F.array_distinct(F.concat(early, named)))


def year_mentions(text: Column) -> Column:
    """Sorted distinct years written in the text."""
    years = F.regexp_extract_all(text, F.lit(V.YEAR_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(years, lambda y: y.cast("int"))))


def _year(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def year_range(text: Column) -> Column:
    """``struct<start, end>``, inclusive, either side NULL when the text leaves it open.

    A span between two years has no direction and is ordered. Two one-sided cues that contradict
    each other are kept as written.
    """
    first, second = _year(text, V.YEAR_SPAN_PATTERN, 1), _year(text, V.YEAR_SPAN_PATTERN, 2)
    is_span = first.isNotNull()
    verb = F.lower(F.regexp_extract(text, V.YEAR_BY_PATTERN, 1))
    by = F.when(~verb.isin(V.AGENT_VERBS), _year(text, V.YEAR_BY_PATTERN, 2))
    start = F.coalesce(_year(text, V.YEAR_FROM_PATTERN), _year(text, V.YEAR_AFTER_PATTERN) + 1)
    end = F.coalesce(
        _year(text, V.YEAR_UNTIL_PATTERN), by, _year(text, V.YEAR_BEFORE_PATTERN) - 1
    )
    return F.struct(
        F.when(is_span, F.least(first, second)).otherwise(start).alias("start"),
        F.when(is_span, F.greatest(first, second)).otherwise(end).alias("end"),
    )


def _options(words) -> str:
    return "|".join(re.escape(w) for w in words)


_HYPHEN = "[" + re.escape(V.HYPHENS) + "]"
_GAP = rf"(?!(?:{_options(V.CLAUSE_WORDS)})\b)[^\s,;]+"
_SPACE = rf"(?:\s|{_HYPHEN})"


def _cue_pattern(cues: list[str]) -> tuple[str, str]:
    """Any of ``cues`` right before something, and a one-word cue one or two words before it."""
    forms = "|".join(re.escape(c).replace(r"\ ", f"{_SPACE}+") for c in cues)
    words = _options(c for c in cues if c.isalpha())
    return f"(?:{forms}){_SPACE}+", rf"(?<![\w'])(?:{words})((?:{_SPACE}+{_GAP}){{1,2}})\s+"


def _ahead(cues: list[str]) -> str:
    """The first letters of ``cues``, which most places of a text do not have, before any pattern of them."""
    return f"(?={_options(sorted({c[:2] for c in cues}))})"


_OTHER_CUES = [c for c in V.NEGATION_CUES if c not in V.LIST_CUES]
#: The words between cue and phrase are captured so that they survive the masking.
_NEGATED = _ahead(_OTHER_CUES) + "(?:{}|{})".format(*_cue_pattern(_OTHER_CUES))
#: Cues that govern a whole list reach over its other items, and stay for those.
_ITEM = _options(
    dict.fromkeys(
        V.LIST_FILLER
        + [word for word in V.LIST_COORDINATORS if word not in V.LIST_CUES]
        + [
            word
            for phrases in V.STATUS_VOCABULARY.values()
            for phrase in phrases
            for word in re.findall("[a-z]+", phrase)
            if word not in V.NEGATION_CUES or word == phrase
        ]
    )
)


def _listed(bounded: str) -> str:
    """``bounded`` under a list cue, however many items stand between. No item is given up again, so
    matching is linear and needs no stack; a list cue begins its own reach and is no item."""
    among = rf"(?:(?!\s*{bounded})(?:\s*[,;]|\s+(?:{_ITEM})-?(?=[\s,;])))*+"
    near, words = _cue_pattern(V.LIST_CUES)
    cues = "|".join(re.escape(c).replace(r"\ ", f"{_SPACE}+") for c in V.LIST_CUES)
    return f"{_ahead(V.LIST_CUES)}({near}|{words}|(?:{cues}){among}\\s*){bounded}"


#: Characters before a phrase in which words are looked for that no cue reaches over.
_NEAR = 400
#: Five words in a row that are no items of a list and have no list mark. A cue reaches over two words, or over
#: items, and is two words itself at most, so one that begins before them governs nothing behind them.
_UNREACHED = rf"(?U)\s[^\s,;]+(?:\s+(?!(?:{_ITEM})-?\s)[^\s,;]+(?=\s)){{5}}"


def _around(text: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Three parts that make up a text with ``phrase`` in it: all places of the phrase and all cues that can
    govern one are in the second, with what stands next to them."""
    ahead = F.substring_index(text, phrase, 1)
    reached = ~F.substring(ahead, -_NEAR, _NEAR).rlike(_UNREACHED)
    start = F.when(reached, F.lit(0)).otherwise(F.greatest(F.length(ahead) - _NEAR, F.lit(0)))
    behind = F.greatest(F.length(F.substring_index(text, phrase, -1)) - 2, F.lit(0))
    length = F.length(text)
    return F.left(text, start), F.substring(text, start + 1, length - behind - start), F.substring(text, length - behind + 1, behind)


def status_mentions(text: Column) -> Column:
    """``struct<wanted, excluded>`` of sorted status codes.

    Phrases are looked for longest first, and what has been matched is masked, so "not yet
    recruiting" is not also "recruiting". A negated mention is an exclusion, and an exclusion
    wins over a request for the same status.
    """
    phrases = [(p, s) for s, words in V.STATUS_VOCABULARY.items() for p in words]
    phrases.sort(key=lambda item: -len(item[0]))
    none = F.array().cast("array<string>")

    def note(phrase: str, status: str):
        """Note and mask the mentions of one phrase; texts without it pass unchanged."""
        bounded = rf"\b{re.escape(phrase)}\b"
        negated, listed = f"(?U){_NEGATED}{bounded}", f"(?U){_listed(bounded)}"
        plain = rf"(?U)(?={re.escape(phrase)})(?<!{_HYPHEN}){bounded}"
        mention = F.array(F.lit(status))

        def masked(state: Column, part: Column) -> Column:
            # What is masked is longer than what stands in its place, so a mention changes the text.
            unlisted = part["unlisted"]
            return F.struct(
                F.concat(part["before"], F.regexp_replace(unlisted, plain, " "), part["after"]).alias("rest"),
                F.concat(state["wanted"], F.when(unlisted.rlike(plain), mention).otherwise(none)).alias("wanted"),
                F.concat(state["excluded"], F.when(unlisted != part["near"], mention).otherwise(none)).alias("excluded"),
            )

        def apply(state: Column) -> Column:
            before, near, after = _around(state["rest"], phrase)
            unlisted = F.regexp_replace(F.regexp_replace(near, negated, " $1 "), listed, " $1 ")
            part = F.struct(before.alias("before"), near.alias("near"), after.alias("after"), unlisted.alias("unlisted"))
            # One binding within another, no more: the analyzer takes a turn for each of them.
            return F.when(F.contains(state["rest"], F.lit(phrase)), bind(part, lambda p: masked(state, p))).otherwise(state)

        return apply

    def codes(found: Column) -> Column:
        return F.array_sort(F.array_distinct(found))

    def mentions(low: Column) -> Column:
        state = F.struct(low.alias("rest"), none.alias("wanted"), none.alias("excluded"))
        for phrase, status in phrases:
            state = bind(state, note(phrase, status))
        found = bind(
            state,
            lambda s: F.struct(
                codes(F.array_except(s["wanted"], s["excluded"])).alias("wanted"),
                codes(s["excluded"]).alias("excluded"),
            ),
        )
        # Most texts name no status at all.
        any_phrase = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p, _ in phrases])
        return F.when(any_phrase, found).otherwise(F.struct(none.alias("wanted"), none.alias("excluded")))

    return bind(F.lower(text), mentions)


def _only_match(text: Column, words: dict[str, list[str]], end: str) -> Column:
    """The one entry whose words occur in the text; NULL for none or several."""
    low = F.lower(text)
    hits = F.array_compact(
        F.array(
            *[
                F.when(low.rlike(rf"(?U)\b(?:{_options(options)}){end}"), F.lit(name))
                for name, options in words.items()
            ]
        )
    )
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def axis_mention(text: Column) -> Column:
    return _only_match(text, V.AXIS_WORDS, r"\b")


def graph_kind_mention(text: Column) -> Column:
    return _only_match(text, V.GRAPH_KIND_WORDS, "")


def names_whole_registry(text: Column) -> Column:
    return text.rlike(V.WHOLE_REGISTRY_PATTERN)
