"""DuckDB spellings of what SQL can say of the llm queries, over whole tables."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower(coalesce(text,'')), '[\\p{L}\\p{N}]+')"
_FOLD = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"

P2_FOUND = f"""with i as (select item_id, {_WORDS} as w from eval_items where text is not null), p as (select id, {_WORDS} as w from pieces where text is not null),
    gi as (select distinct item_id, unnest(list_transform(generate_series(1, len(w)-19), lambda k: array_to_string(w[k:k+19], ' '))) as g from i where len(w) >= 20),
    gp as (select distinct id, unnest(list_transform(generate_series(1, len(w)-19), lambda k: array_to_string(w[k:k+19], ' '))) as g from p where len(w) >= 20)
    select distinct item_id, id from gi join gp using (g)"""

P3_FOUND = """with w as (select id, unnest(generate_series(1, length(text)-199)) as s, text from pieces where length(text) >= 200), h as (select id, s, md5(text[s:s+199]) as h from w),
    m as (select h from h group by h having min(id) <> max(id)), c as (select id, s from h join m using (h)), o as (select id, s, coalesce(s - lag(s) over (partition by id order by s), 200) as gap from c)
    select id, sum(least(gap, 200))::bigint as shared_chars from o group by id"""

_FIELDS = ("source", "text", "title", "date", "path", "channel")
_LINES = (
    "(select line_id, " + ", ".join(f"coalesce(case when json_type(j, '$.{f}') = 'VARCHAR' then j->>'$.{f}' else (j->'$.{f}')::varchar end, '') as {f}" for f in _FIELDS)
    + " from (select line_id, json(line) as j from index_lines where json_valid(line)) where json_type(j) = 'OBJECT')"
)
_GROUPS = (
    f"with k as (select 'pieces' as tbl, id as key, {_FOLD('coalesce(source, chr(32))')} || '|' || {_FOLD('text')} as f from pieces where {_FOLD('coalesce(text, chr(32))')} <> '' "
    f"union all select 'index_lines', line_id, concat_ws('|', {', '.join(_FOLD(f) for f in _FIELDS)}) from {_LINES} where {_FOLD('text')} <> ''), "
    "g as (select tbl, f, min(key) as first_key, count(distinct key) as copies from k group by tbl, f)"
)
P6_FOUND = f"{_GROUPS} select distinct k.tbl as tbl, first_key, key as copy_key from k join g on k.tbl = g.tbl and k.f = g.f where key <> first_key"
P6_COUNTS = f"{_GROUPS} select tbl, first_key, copies from g"

P7_FOUND = f"""with p as (select id, {_WORDS} as w, {_FOLD("coalesce(text,'')")} as f from pieces), g as (select distinct id, unnest(list_transform(generate_series(1, len(w)-2), lambda k: array_to_string(w[k:k+2], ' '))) as g from p where len(w) >= 3),
    n as (select id, count(*) as n from g group by id), c as (select a.id as id_a, b.id as id_b, count(*) as shared from g a join g b on a.g = b.g and a.id < b.id group by 1, 2)
    select id_a, id_b from c join n x on x.id = id_a join n y on y.id = id_b where shared >= 0.6::double * (x.n + y.n - shared) union select a.id, b.id from p a join p b on a.f = b.f and a.f <> '' and a.id < b.id"""

P1_WRONG = """select id, word_count, n as words from (select id, word_count, len(regexp_extract_all(text, '[^\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}]+')) as n from pieces where text is not null)
    where coalesce(word_count, 0) <> 0 and word_count <> n"""

ORACLE = {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_incremental": P3_FOUND, "p6_found": P6_FOUND, "p6_counts": P6_COUNTS, "p7_found": P7_FOUND, "p1_wrong_counts": P1_WRONG}
