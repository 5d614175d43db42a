"""One registered query for each corpus operator, over its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm import (
    bpe_chunks,
    collocations,
    exact_dedup,
    license_scan,
    lm_score,
    mixing,
    quality_knn,
    quality_rules,
    simhash,
    token_count,
    token_file,
    warc,
    whitening,
)
from tallyproof.llm.registry import ORACLES, QUERIES, query  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _re2(pattern: str) -> str:
    """A pattern of the code as SQL has it."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern).replace("'", "''")


_RULES = quality_rules.Rules()
_QUALITY_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
words as (
  select doc_id, unnest(list) as word, generate_subscripts(list, 1) as place
  from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as list from texts)
),
windows as (
  select *, lead(word, 1) over w as second, lead(word, 2) over w as third from words
  window w as (partition by doc_id order by place)
),
found as (
  select *, third is not null and count(*) over (partition by doc_id, word, second, third) > 1 as again from windows
),
covered as (
  select doc_id, again or coalesce(lag(again, 1) over w, false) or coalesce(lag(again, 2) over w, false) as inside
  from found window w as (partition by doc_id order by place)
),
repeats as (
  select doc_id, count(*) as n_words, count(*) filter (where inside) as n_repeat_words from covered group by 1
),
lines as (
  select doc_id, unnest(list) as line, generate_subscripts(list, 1) as place
  from (select doc_id, string_split(text, chr(10)) as list from texts)
),
counted as (
  select doc_id, line, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as list,
         strlen(line) as bytes,
         strlen(line) - strlen(regexp_replace(line, '[#*$%&|<>{}~^\\]', '', 'g')) as symbols,
         strlen(line) - strlen(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as blanks,
         strlen(line) - strlen(replace(line, '!', '')) as marks,
         len(regexp_extract_all(line, '[A-Za-z]')) as ascii_letters, len(regexp_extract_all(line, '[A-Z]')) as ascii_capitals,
         len(regexp_extract_all(line, '\p{L}')) as all_letters, len(regexp_extract_all(line, '\p{Lu}')) as all_capitals,
         len(regexp_extract_all(line, '[|»›•·]'))
           + len([x for x in string_split_regex(line, '\s') if x = '>' or x = '/']) as separators
  from lines
),
normal as (
  select doc_id, len(list) as n,
         regexp_replace(translate(array_to_string(list, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as norm
  from counted where len(list) > 0
),
marks as (
  select doc_id, norm as mark from normal qualify row_number() over (partition by doc_id order by strlen(norm) desc, encode(norm)) = 1
),
hot as (
  select norm from (select distinct norm, mark from normal join marks using (doc_id) where n <= {words})
  group by norm having count(*) >= greatest({documents}, {share} * (select count(distinct mark) from marks))
),
sized as (
  select *, len(list) as n,
         regexp_replace(translate(array_to_string(list, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as norm,
         2 * ascii_letters < bytes and bytes > length(line) as foreign_letters from counted where len(list) > 0
),
judged as (
  select doc_id, place, line, n,
         separators >= greatest(3, 0.2 * n)
         or symbols > greatest(4, 0.1 * (bytes - blanks))
         or marks > greatest(3, 0.25 * n)
         or n > 3 and case when foreign_letters then all_letters >= 20 and all_capitals > 0.7 * all_letters
                           else ascii_letters >= 20 and ascii_capitals > 0.7 * ascii_letters end
         or n >= 20 and list_unique(list) < 0.2 * n
         or n >= 20 and not regexp_matches(line, '{punctuation}') and not regexp_matches(line, '{unmarked}')
         or n <= {words} and (regexp_matches(lower(line), '{boilerplate}') or norm in (from hot))
           as failed,
         row_number() over (partition by doc_id, line order by place) > 1 as dup
  from sized
),
lost as (
  select doc_id, sum(n) filter (where failed) as lost_words, count(*) filter (where failed) as failed_lines,
         count(*) filter (where dup) as n_dup_lines
  from judged group by 1
),
facts as (
  select doc_id, coalesce(n_words, 0) as n_words,
         length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         cast(coalesce(lost_words, 0) as bigint) as lost_words, coalesce(failed_lines, 0) as failed_lines
  from texts left join repeats using (doc_id) left join lost using (doc_id)
),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from facts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and lost_words <= 0.3 * n_words as kept, lost_words, failed_lines
from based
"""
for _name, _value in {
    "words": _RULES.boilerplate_words,
    "documents": _RULES.hot_documents,
    "share": _RULES.hot_share,
    "punctuation": _re2(quality_rules.PUNCTUATION.pattern),
    "unmarked": _re2(quality_rules.UNMARKED.pattern),
    "boilerplate": _re2(quality_rules.BOILERPLATE.pattern.decode()),
}.items():
    _QUALITY_SQL = _QUALITY_SQL.replace("{" + _name + "}", str(_value))


@query(_QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_k_id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query(
    """
    with documents_ as (
        select doc_id, length(coalesce(text, '')) as chars,
               regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as plain
        from documents
    ), ranked as (
        select doc_id, sha256(plain) as text_sha256, count(*) over (partition by plain) as group_size,
               first_value(doc_id) over (partition by plain order by chars desc, doc_id) as keep_id,
               row_number() over (partition by plain order by chars desc, doc_id) = 1 as kept
        from documents_
    )
    select doc_id, keep_id, group_size, kept, text_sha256 from ranked
    """
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_k_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query(
    """
    with docs as (
        select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
               md5(concat('42-', coalesce(cast(doc_id as varchar), 'null'), '-', md5(coalesce(text, '')))) as shuffled
        from documents
    ), sources as (
        select source, cast(sum(size) as bigint) as source_size,
               list_extract([5.0::double, 2.0::double, 1.0::double],
                            cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint)) as weight
        from docs group by source
    ), caps as (
        select *, cast(3 * source_size as double) as cap,
               row_number() over (order by 3 * source_size / weight, source nulls last) as place
        from sources
    ), rates as (
        -- the rate when the sources before this place are capped
        select place, cap, weight,
               ((select sum(source_size) from sources)
                - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (order by place rows between current row and unbounded following) as rate
        from caps
    ), fair as (
        select rate from rates where rate * weight <= cap order by place limit 1
    ), targets as (
        select source, source_size, least((select rate from fair) * weight, cap) as target from caps
    ), queued as (
        select docs.*, sum(size) over (partition by source order by shuffled) as upto from docs where size > 0
    ), packets as (
        select doc_id, source, size, shuffled, turn, (turn * source_size + upto) / target as finish
        from queued join targets using (source), range(3) as turns(turn)
        where target > 0 and turn < least(3, floor(target / source_size) + 1)
    ), sent as (
        select *, sum(size) over (order by finish, source nulls last, shuffled, turn) as used from packets
    ), takes as (
        select doc_id, cast(sum(size) as bigint) as taken from sent
        where used <= (select sum(source_size) from sources) group by doc_id
    )
    select doc_id, size, source_size, target, coalesce(taken, 0) as taken
    from docs join targets using (source) left join takes using (doc_id)
    """
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_k_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_count.counts(table(spark, sf_dir, "documents"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)


@query()
def op9_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(bpe_chunks.encode(table(spark, sf_dir, "documents"), decoded=True))


@query(
    """
    with payloads as (
        select page_id, coalesce(html, '') as payload,
               max(page_id) over (partition by coalesce(html, '')) as largest
        from pages
    ), typed as (
        select *, octet_length(encode(payload)) as size,
               case when octet_length(encode(payload)) >= 1000 and largest is distinct from page_id then largest end as refers_to
        from payloads
    )
    select page_id, size as payload_bytes, sha1(payload) as payload_digest,
           case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
    from typed
    """
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.archive(pages)
    return warc.summary(warc.read(archives, with_chunks=False), pages.schema["page_id"].dataType.simpleString())


@query()
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.read(token_file.write(table(spark, sf_dir, "documents")))


@query()
def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = quality_knn.remainder(F.col("doc_id"), 4) != 2
    voters = quality_knn.fit(docs, table(spark, sf_dir, "labels"), learn=learn)
    return quality_knn.score(docs, voters).select(
        "doc_id",
        (quality_knn.remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query()
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = lm_score.fit(docs, lambda ident: lm_score.remainder(ident, 5) != 1)
    return lm_score.score(docs, fitted).select(
        "doc_id",
        (lm_score.remainder(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    fitted = whitening.fit(rows)
    return whitening.whiten(rows, fitted).select(
        "vec_id",
        "component",
        F.lit(fitted.n).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened",
        "explained",
        F.lit(fitted.identity_error).alias("identity_error"),
    )


_TEMPLATE_ROWS = ", ".join(
    f"({number}, '{one.label}', {str(one.base).lower()}, '{one.text.replace(chr(39), chr(39) * 2)}')"
    for number, one in enumerate(license_scan.TEMPLATES)
)
_LICENSE_SQL = rf"""
with given(template, label, base, text) as (values {_TEMPLATE_ROWS}),
template_words as (
  select template, label, base, list, len(list) as size,
         case when len(list) >= {2 * license_scan.NOTICE_WORDS} then {license_scan.NOTICE_WORDS}
              else least(len(list), {license_scan.PHRASE_WORDS}) end as span
  from (select *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as list from given)
),
places as (
  select template, label, base, size, span, span < {license_scan.NOTICE_WORDS} as exact, place,
         list_aggregate(list[place + 1 : place + span], 'string_agg', ' ') as gram
  from (select *, unnest(range(0, size - span + 1)) as place from template_words)
),
texts as (
  select row_number() over () as line, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as list
  from documents
),
words as (select line, unnest(list) as word, generate_subscripts(list, 1) - 1 as pos from texts),
four as (
  select line, pos, word || ' ' || lead(word, 1) over w as two,
         word || ' ' || lead(word, 1) over w || ' ' || lead(word, 2) over w || ' ' || lead(word, 3) over w as four
  from words window w as (partition by line order by pos)
),
hits as (
  select f.line, f.pos, p.* from four f join places p on p.span = 2 and f.two = p.gram
  union all
  select f.line, f.pos, p.* from four f join places p on p.span = 4 and f.four = p.gram
),
diagonals as (
  select line, template, label, base, size, span, exact, pos - place as diagonal, list(place) as found, min(pos) as first, max(pos) as last
  from hits group by all
),
stepped as (
  select *, coalesce(diagonal - lag(diagonal) over (partition by line, template order by diagonal)
                     > case when exact then 0 else {license_scan.SHIFT} end, false) as step
  from diagonals
),
banded as (select *, sum(step::int) over (partition by line, template order by diagonal) as band from stepped),
spans as (
  select line, template, label, base, size, exact, band, min(first) as first, max(last) + span - 1 as last,
         len(list_distinct(flatten(list_transform(flatten(list(found)), lambda p: range(p, p + span))))) as covered
  from banded group by line, template, label, base, size, span, exact, band
),
kept as (
  select *, covered / size as score from spans
  where case when exact then covered = size
             else covered / size >= {license_scan.SHARE} and covered >= {license_scan.DENSITY} * (last - first + 1) end
),
of_text as (
  select line, count(*) filter (where base) as n_base, min(first) filter (where base) as first_word,
         max(first) filter (where base) as last_word, max(score) as score,
         string_agg(distinct label, ',' order by label) filter (where base) as base_labels,
         string_agg(distinct label, ',' order by label) as labels
  from kept group by line
)
select doc_id, len(list) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from texts left join of_text using (line)
"""


@query(_LICENSE_SQL)
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, spans = license_scan.scan(table(spark, sf_dir, "documents"))
    return license_scan.labels(texts, spans)


_COLLOCATION_SQL = r"""
with texts as (
  select row_number() over () as line, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
),
pieces as (
  select line, lang, unnest(list) as piece, generate_subscripts(list, 1) as number
  from (select line, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') as list from texts)
),
words as (
  select line, lang, number, unnest(list) as word, generate_subscripts(list, 1) as pos
  from (select line, lang, number, regexp_extract_all(piece, '[^\x20\x09]+') as list from pieces)
),
neighbours as (
  select lang, word as first, lead(word, 1) over w as second, lead(word, 2) over w as third
  from words window w as (partition by line, number order by pos)
),
one as (select lang, first as phrase, count(*)::hugeint as c from neighbours group by all),
two as (select lang, first, second, count(*)::hugeint as c from neighbours where second is not null group by all having count(*) >= 10),
three as (
  select lang, first, second, third, count(*)::hugeint as c from neighbours where third is not null group by all having count(*) >= 10
),
holding as (
  select lang, first, second, max(c) as c
  from (select lang, first, second, c from three union all select lang, second, third, c from three) group by lang, first, second
),
pairs as (
  select t.lang, t.first || ' ' || t.second as phrase, t.c as a, x.c as l, y.c as r, (1000000 * t.c * t.c) // (x.c * y.c) as score
  from two t join one x on x.lang = t.lang and x.phrase = t.first join one y on y.lang = t.lang and y.phrase = t.second
  left join holding h on h.lang = t.lang and h.first = t.first and h.second = t.second
  where h.c is null or 100 * h.c < 50 * t.c
),
triples as (
  select t.lang, t.first || ' ' || t.second || ' ' || t.third as phrase, t.c as a,
         x.c as l1, yz.c as r1, xy.c as l2, z.c as r2,
         (1000000 * t.c * t.c) // (x.c * yz.c) as s1, (1000000 * t.c * t.c) // (xy.c * z.c) as s2
  from three t join one x on x.lang = t.lang and x.phrase = t.first join one z on z.lang = t.lang and z.phrase = t.third
  join two xy on xy.lang = t.lang and xy.first = t.first and xy.second = t.second
  join two yz on yz.lang = t.lang and yz.first = t.second and yz.second = t.third
),
candidates as (
  select * from pairs
  union all
  select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from triples
),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from candidates
),
totals as (select lang, sum(c) as n from one group by lang)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""


@query(_COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
