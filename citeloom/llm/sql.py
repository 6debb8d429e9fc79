"""SQL for the queries of this subpackage that SQL can express over whole tables."""

_TERMS = r"""
words as (select row_id, unnest(regexp_extract_all(lower(titleid), '[\p{L}\p{N}]+')) as term from papers_raw where titleid is not null),
total as (select count(titleid) as n from papers_raw)
"""
_MARK = "case when records < 20 then 'rare' when records > 0.1 * (select n from total) then 'common' end"

#: Rounds in which the least class goes from layouts to letters and back; chains of titles are shorter.
_ROUNDS = 8
_SPREAD = ", ".join(
    f"a{k} as (select m, min({'l' if k == 1 else 'c'}) as c from {'n' if k == 1 else f'n join b{k - 1} using (l)'} group by m), b{k} as (select l, min(c) as c from n join a{k} using (m) group by l)" for k in range(1, _ROUNDS + 1)
)

ORACLE = {
    "p1_found": rf"""with {_TERMS},
c as (select term, count(distinct row_id) as records from words group by term)
select term, mark from (select term, {_MARK} as mark from c) where mark is not null""",
    "p1_frequency": rf"""with {_TERMS},
c as (select 'word' as kind, term, count(*) as occurrences, count(distinct row_id) as records from words group by term
 union all select 'value', titleid, count(*), count(distinct row_id) from papers_raw where titleid is not null group by titleid)
select kind, term, occurrences, records, {_MARK} as mark from c""",
    "p5_found": r"""with recursive r as (select row_id, regexp_replace(lower(titleid), '[^\p{L}\p{N}]+', '', 'g') as l,
 list_sort(list_filter(list_transform(regexp_split_to_array(lower(titleid), '[|•;/]+'), lambda p: regexp_replace(p, '[^\p{L}\p{N}]+', '', 'g')), lambda p: p <> '')) as m
 from papers_raw where titleid is not null),
n as (select distinct l, m from r),
""" + _SPREAD + rf""",
k as (select row_id, min(row_id) over (partition by c) as row_id_a from r join b{_ROUNDS} using (l))
select row_id_a, row_id as row_id_b from k where row_id <> row_id_a""",
}
ORACLE["p5_classes"] = ORACLE["p5_found"].rsplit("select row_id_a,", 1)[0] + "select row_id_a as row_id, count(*) as copies from k group by row_id_a"
