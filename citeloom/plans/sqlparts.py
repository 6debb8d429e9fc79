"""Pieces of SQL that several oracles share."""

from citeloom.functions.columns import KEEP_TOKENS, STOP_TOKENS
from citeloom.functions.language import FUNCTION_WORDS, PROFILE

MARKERS = "('NA', 'couldnt find', 'cant read from scrapper out')"


def unmarked(c: str) -> str:
    return f"case when {c} not in {MARKERS} then {c} end"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def parse_date(c: str) -> str:
    y, m, d = (f"split_part({c}, '/', {i})" for i in (1, 2, 3))
    return (
        f"case len(string_split({c}, '/')) when 3 then try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as date) "
        f"when 2 then try_cast({y} || '-' || lpad({m}, 2, '0') || '-01' as date) when 1 then try_cast({c} || '-01-01' as date) end"
    )


def cited_number(c: str) -> str:
    return f"case when {c} = 'NA' then 0 else try_cast(nullif(split_part({c}, ' ', 3), '') as int) end"


def _values(rows: dict[str, str]) -> str:
    return ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(rows.items()))


def languages(table: str, column: str) -> str:
    """Tables that end in ``languages`` (text, lang): every different text of a column with its language, found by joins and votes."""
    other = {"el": "Greek", "ru": "Cyrillic", "ar": "Arabic", "hi": "Devanagari", "th": "Thai", "ko": "Hangul"}
    n = lambda *p: "len(regexp_extract_all(text, '[" + "".join(rf"\p{{{x}}}" for x in p) + "]'))"
    kana = ("Hiragana", "Katakana")
    each = " ".join(f"union all select text, {n(v)}, {i}, '{k}' from texts" for i, (k, v) in enumerate(other.items()))
    return rf"""texts as (select distinct {column} as text from {table} where {column} is not null),
lang_words as (select distinct nr, lang, unnest(string_split(ws, ' ')) as word from (values {_values(FUNCTION_WORDS)}) w(nr, lang, ws)),
spaced as (select text, trim(regexp_replace(replace(lower(text), chr(173), ''), '[^\p{{L}}\p{{M}}\p{{N}}¿¡]+', ' ', 'g')) as s from texts),
votes as (select text, nr, 2 * count(distinct word) as n from (select text, unnest(string_split(s, ' ')) as word from spaced) join lang_words using (word) group by text, nr
 union all select text, nr, len(regexp_extract_all(' ' || s || ' ', p)) from spaced, (values {_values(PROFILE)}) k(nr, lang, p)),
latin as (select text, nr, row_number() over (partition by text order by sum(n) desc, nr) as place from votes group by text, nr),
letters as (select text, {n('Latin')} as n, -1 as o, 'latin' as script from texts
 {each}
 union all select text, {n(*kana, 'Han')}, 9, case when {n(*kana)} > 0 then 'ja' else 'zh' end from texts),
script as (select text, script from (select *, row_number() over (partition by text order by n desc, o) as place from letters) where place = 1),
languages as (select text, case when script = 'latin' then (['{"', '".join(FUNCTION_WORDS)}'])[nr + 1] else script end as lang from script join latin using (text) where place = 1)"""


LANGUAGES = languages("papers_raw", "titleid")
_TEXT = ("title_main", "authors", "journal", "conference", "source", "book", "publisher", "vol", "issue", "pages", "scrap_auth_id", "urlid")
CLEAN = f"""{LANGUAGES},
first as (select *, row_number() over (partition by titleid order by _file, _pos) as rn from papers_raw where titleid is not null),
dated as (select row_id, titleid, {', '.join(f'{unmarked(c)} as {c}' for c in _TEXT)}, {cited_number('cited')} as cited_num,
 {unmarked('pubdate')} as pd from first where rn = 1 and titleid in (select text from languages where lang = 'en')),
rated as (select * exclude (pd), split_part(pd, '/', 1) as year, {parse_date('pd')} as date from dated),
clean as (select * from (select *, cited_num::double / nullif(date_diff('day', date, date '2021-03-20') / 365e0, 0) as cites_per_year from rated) where cites_per_year >= 0)"""
CLEAN_COLUMNS = "titleid, title_main, authors, journal, conference, source, book, publisher, vol, issue, pages, scrap_auth_id, urlid, row_id, cited_num, year, date, cites_per_year"

#: Predictions for the evaluation operators: a fixed distortion of the actual rates.
RESULTS = f"""{CLEAN}, results as (select row_id as index1, titleid, journal, authors, cites_per_year * (0.5e0 + ((row_id * 7919) % 1000) / 1000e0) as pred, cites_per_year as actual from clean)"""


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def good_token(t: str) -> str:
    number = rf"(regexp_full_match(trim(lower({t})), '[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?') or regexp_full_match(trim(lower({t})), '[+-]?(nan|inf|infinity)'))"
    symbols = r"'[%${}^/\\#*''_()+\-\[\]]'"
    return f"({t} in ({_quoted(KEEP_TOKENS)}) or ({t} not in ({_quoted(STOP_TOKENS)}) and not regexp_matches({t}, {symbols}) and len(regexp_extract_all({t}, '[0-9]')) <= 1 and not {number} and length({t}) >= 3))"


TITLE_TOKENS = f"tokens as (select row_id as doc_id, t as term from (select row_id, unnest(string_split(lower(titleid), ' ')) as t from papers_raw where titleid is not null) where {good_token('t')})"


def lemma_tables(tokens: str, name: str) -> str:
    """Tables that end in ``name`` (variant, lemma) of the terms of a table of tokens."""
    return f"""w_{name} as (select distinct term as w, left(term, 3) as p from {tokens} where length(term) >= 4), h_{name} as (select p, min(w) as lemma from w_{name} group by p),
{name} as (select w as variant, lemma from w_{name} join h_{name} using (p) where w <> lemma and length(w) >= length(lemma) and
 array_to_string(list_transform(list_filter(range(1, length(lemma) + 1), lambda i: lemma[i] <> w[i]), lambda i: w[i]), '') || substr(w, length(lemma) + 1) in ('s', 'ic', 'ics', 'ed'))"""


#: Per class precision, recall, F1 and support, and over all the accuracy and the means; of a table c (y, p).
METRICS = """k as (select unnest([0, 1]) as class), n as (select count(*) filter (y = p) / nullif(count(*), 0)::double as accuracy from c),
m as (select class, count(*) filter (where y = class and p = class) as tp, count(*) filter (where p = class) as np, count(*) filter (where y = class) as support from c, k group by class),
per as (select class, tp / nullif(np, 0)::double as precision, tp / nullif(support, 0)::double as recall, 2e0 * tp / nullif(np + support, 0) as f1, support from m),
macro as (select avg(coalesce(precision, 0)) as macro_precision, avg(coalesce(recall, 0)) as macro_recall, avg(coalesce(f1, 0)) as macro_f1 from per)
select class, precision, recall, f1, support, accuracy, macro_precision, macro_recall, macro_f1 from per, n, macro"""
