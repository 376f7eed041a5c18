"""Queries on identity, selection, style and duplicates, each over its whole tables, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, dedupe, rewrite, style
from corpusloom.plans import sqltext as S
from corpusloom.runtime import table
from corpusloom.schema import completed, lenient

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Pieces with derived fields, as the oracle says it.
DONE = (
    f"(select id, source, text, path, date, title, meta, pos, coalesce(year, try_cast(regexp_extract(date,'^([0-9]{{4}})',1) as int)) as year, "
    f"case when coalesce(word_count,0) <> 0 then word_count else {S.count(S.body('text'), S.NOT_WS + '+')} end as word_count from pieces)"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pieces", spread=True)


def done(spark: SparkSession, d: str) -> DataFrame:
    return completed(pieces(spark, d))


@query(
    f"""with p as (select coalesce(source,'doc') as s, coalesce(year::varchar,'undated') as y, coalesce(word_count,0) as w from {DONE})
    select 'source' as kind, s as value, count(*) as pieces, sum(w) as words from p group by s
    union all select 'year', y, count(*), sum(w) from p group by y union all select 'total', '', count(*), sum(w) from p"""
)
def corpus_summary(spark, d):
    return corpus.summary(done(spark, d))


SELECTED = "coalesce(word_count,0) >= 40 and year is not null and year <= 2022 and coalesce(source in ('linkedin_post','linkedin_article'), false)"


@query(f"select id, word_count, year from {DONE} where {SELECTED}")
def select_filter(spark, d):
    return corpus.select_pieces(done(spark, d), ["linkedin_post", "linkedin_article"], 40, 2022).select("id", "word_count", "year")


PIN = "select distinct meta['piece_id'] as id from pairs where meta['channel'] = 'comment'"
BAN = "select distinct meta['piece_id'] as id from pairs where meta['channel'] = 'article'"


@query(f"select id from {DONE} where id not in (select id from ({BAN}) where id is not null) and (id in (select id from ({PIN}) where id is not null) or ({SELECTED}))")
def force_include_select(spark, d):
    p = table(spark, d, "pairs").select(F.try_element_at("meta", F.lit("piece_id")).alias("id"), F.try_element_at("meta", F.lit("channel")).alias("c")).where("id is not null")
    out = corpus.select_pieces(done(spark, d), ["linkedin_post", "linkedin_article"], 40, 2022, False, p.where("c = 'comment'"), p.where("c = 'article'"))
    return out.select("id")


@query(f"select count(*) as selected, count(*) < 20 as blocked, count(*) >= 20 and count(*) < 50 as warned from {DONE} where {SELECTED}")
def selection_gate(spark, d):
    return corpus.size_gate(corpus.select_pieces(done(spark, d), ["linkedin_post", "linkedin_article"], 40, 2022))


@query("""select line_pos as pos, p.id as id from (select meta['piece_id'] as id, min(pos) as line_pos from pairs group by 1) s join pieces p on p.id = s.id""")
def selection_resolve(spark, d):
    sel = table(spark, d, "pairs").groupBy(F.try_element_at("meta", F.lit("piece_id")).alias("id")).agg(F.min("pos").alias("ord"))
    return corpus.resolve(sel, pieces(spark, d).select("id")).select(F.col("ord").alias("pos"), "id")


@query("""select id, pos from (select *, row_number() over (partition by id order by pos) as r from (select id, pos from pieces where pos % 2 = 1 union all select id, pos + 1000000000 from pieces))
    where r = 1 and id not in (select id from pieces where pos % 3 = 0)""")
def append_new_ids(spark, d):
    """Two batches of overlapping ids against an index: what an append adds."""
    p = pieces(spark, d).select("id", "pos")
    batch = p.where("pos % 2 = 1").unionByName(p.withColumn("pos", F.col("pos") + 1_000_000_000))
    return corpus.new_rows(p.where("pos % 3 = 0"), batch)


@query("select id, substr(sha256('pieces|' || coalesce(source,'') || '|' || substr(coalesce(text,''),1,200)),1,16) as stable from pieces")
def stable_ids(spark, d):
    return pieces(spark, d).select("id", T.stable_id(F.lit("pieces"), F.col("source"), F.substring("text", 1, 200)).alias("stable"))


@query("select distinct meta['piece_id'] as id from pairs where meta['piece_id'] in (select id from pieces)")
def leak_check(spark, d):
    return corpus.leaked(table(spark, d, "pairs").select(F.try_element_at("meta", F.lit("piece_id")).alias("id")), pieces(spark, d))


@query("select id from pieces where not exists (select 1 from pairs where meta['piece_id'] = pieces.id)")
def holdout_anti_join(spark, d):
    return pieces(spark, d).select("id").join(table(spark, d, "pairs").select(F.try_element_at("meta", F.lit("piece_id")).alias("id")), "id", "left_anti")


CLEAN = S.trim_all("regexp_replace(regexp_replace(coalesce(text,''), '\\r\\n|\\r', chr(10), 'g'), '\\n{3,}', chr(10)||chr(10), 'g')")


@query(f"select id, md5({CLEAN}) as clean from pieces")
def light_clean(spark, d):
    return pieces(spark, d).select("id", F.md5(corpus.light_clean(F.col("text"))).alias("clean"))


def _day_sql(c: str) -> str:
    s = S.trim_all(S.body(c))
    iso, us = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:\D.*)?$", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:\D.*)?$"
    dmy, mdy = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})(?:\D.*)?$", r"^([A-Za-z]{3})[a-z]* (\d{1,2}), (\d{4})(?:\D.*)?$"
    g = lambda p, i: f"regexp_extract({s}, {S.q(p)}, {i})"
    two = lambda x: f"lpad({x},2,'0')"
    mon = lambda x: f"lpad((list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({x})))::varchar,2,'0')"
    day = lambda y, m, dd: f"try_cast(concat_ws('-', {y}, {m}, {dd}) as date)"
    is_ = lambda p: f"regexp_matches({s}, {S.q(p)})"
    bare = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"
    return (
        f"case when {is_(iso)} then {day(g(iso, 1), two(g(iso, 2)), two(g(iso, 3)))} when {is_(us)} then {day(g(us, 3), two(g(us, 1)), two(g(us, 2)))} "
        f"when {is_(dmy)} then {day(g(dmy, 3), mon(g(dmy, 2)), two(g(dmy, 1)))} when {is_(mdy)} then {day(g(mdy, 3), mon(g(mdy, 1)), two(g(mdy, 2)))} "
        f"when {is_(bare)} then {day(g(bare, 1), S.q('01'), S.q('01'))} end"
    )


@query(f"select id, strftime({_day_sql('date')}, '%Y-%m-%d') as day from pieces")
def date_parse(spark, d):
    return pieces(spark, d).select("id", F.date_format(corpus.parse_day(F.col("date")), "yyyy-MM-dd").alias("day"))


def _export_sql() -> str:
    parts = []
    for tbl, source, raw, title, part in (
        ("li_shares", "linkedin_post", "ShareCommentary", "ShareLink", "ShareLink"), ("li_comments", "linkedin_comment", "Message", "''", '"Date"'),
        ("li_articles", "linkedin_article", "Content", "Title", "Title"),
    ):
        c = CLEAN.replace("coalesce(text,'')", f"coalesce({raw},'')")
        parts.append(
            f"""select substr(sha256('{source}|' || coalesce({part},'') || '|' || substr({c},1,200)),1,16) as id, '{source}' as source, strftime({_day_sql('"Date"')}, '%Y-%m-%d') as date,
            {S.count(c, S.NOT_WS + "+")} as word_count, coalesce({title},'') as title from {tbl} where {c} <> ''"""
        )
    return " union all ".join(parts)


@query(_export_sql())
def export_pieces(spark, d):
    t = [table(spark, d, n) for n in ("li_shares", "li_comments", "li_articles")]
    return corpus.export_pieces(*t).select("id", "source", "date", "word_count", "title")


@query("""select path, case when regexp_matches(lower(path),'email|\\.eml$') then 'email' when regexp_matches(lower(path),'note|obsidian') then 'note' else 'doc' end as guess
    from (select distinct path from pieces where path is not null)""")
def source_guess(spark, d):
    return pieces(spark, d).select("path").where("path is not null").distinct().select("path", corpus.guess_source(F.col("path")).alias("guess"))


@query(f"""with l as (select line_id, '{{"id":"' || line_id || '",' || substr(trim(line), 2) as j from index_lines), v as (select line_id, json(j) as j from l where json_valid(j)),
    p as (select line_id as id, coalesce(j->>'$.source', 'doc') as source, j->>'$.date' as date, coalesce(j->>'$.text', '') as text from v)
    select id, source, date, try_cast(regexp_extract(date,'^([0-9]{{4}})',1) as int) as year, {S.count('text', S.NOT_WS + '+')} as word_count from p""")
def index_scan(spark, d):
    """Index lines decoded leniently; broken lines drop out."""
    lines = table(spark, d, "index_lines").select(F.concat(F.lit('{"id":"'), "line_id", F.lit('",'), F.substring(F.trim("line"), F.lit(2), F.length("line"))).alias("line"))
    return lenient(lines, "line").select("id", "source", "date", "year", "word_count")


@query(
    f"""select id, {S.count(S.body('text'), S.NOT_WS + '+')} as t1, {S.count(S.body('text'), T.WORD)} as t2, len({S.guard_words('text')}) as t3,
    len(list_distinct({S.every("lower(coalesce(text,''))", "[a-z0-9']+")})) as t4, {S.count("lower(coalesce(text,''))", '[a-z0-9]+')} as t5 from pieces"""
)
def word_counts(spark, d):
    c = F.col("text")
    return pieces(spark, d).select(
        "id", T.word_count(c).alias("t1"), F.size(T.words(c)).alias("t2"), F.size(T.guard_words(c)).alias("t3"), F.size(T.word_set(c)).alias("t4"), F.size(T.plain_words(c)).alias("t5")
    )


@query(f"select id, len(s) as sentences, coalesce(list_sum(s),0)::bigint as words, {S.median_of('s')} as median from (select id, {S.sentence_words('text')} as s from pieces)")
def sentence_counts(spark, d):
    s = pieces(spark, d).select("id", T.sentence_words(F.col("text")).alias("s"))
    return s.select("id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0), lambda a, x: a + x).cast("bigint").alias("words"), T.median_of(F.col("s")).alias("median"))


@query(f"select id, len({S.lines('text')}) as lines, {S.short_line_ratio('text')} as short_ratio, len({S.paragraphs('text')}) as paragraphs from pieces")
def line_stats(spark, d):
    c = F.col("text")
    return pieces(spark, d).select("id", F.size(T.lines(c)).alias("lines"), T.short_line_ratio(c).alias("short_ratio"), F.size(T.paragraphs(c)).alias("paragraphs"))


@query(f"select id, {S.slop_score('text')} as slop, {S.scaffolding_count('text')} as scaffolding from pieces")
def slop_score(spark, d):
    return pieces(spark, d).select("id", T.slop_score(F.col("text")).alias("slop"), T.scaffolding_count(F.col("text")).alias("scaffolding"))


@query(f"select id, round({S.contraction_rate('text')}, 4) as rate from pieces")
def contraction_rate(spark, d):
    return pieces(spark, d).select("id", T.contraction_rate(F.col("text")).alias("rate"))


_B = "(select id, source, " + S.trim_all("coalesce(text,'')") + " as t from pieces)"
_STYLE = (
    f"select t, {S.count('t', T.WORD)} as words, round({S.median_of(S.sentence_words('t'))},2) as med, round({S.short_line_ratio('t')},4) as short, "
    f"round({S.contraction_rate('t')},4) as con, {S.count('t', '(?i)' + chr(92) + 'byou' + chr(92) + 'b')} as you, {S.count('t', chr(92) + 'bI' + chr(92) + 'b')} as i from {_B} where t <> ''"
)


@query(
    f"""select count(*) as pieces, coalesce(sum(words),0)::bigint as words, round(coalesce(median(med),0.0),2) as median_sentence_words, round(coalesce(median(short),0.0),4) as short_line_ratio,
    round(coalesce(median(con),0.0),4) as contraction_rate, coalesce(sum(you),0)::bigint as you_count, coalesce(sum(i),0)::bigint as i_count,
    round(coalesce(sum(you),0)*1000.0::double/greatest(coalesce(sum(words),0),1),2) as you_per_1k, round(coalesce(sum(i),0)*1000.0::double/greatest(coalesce(sum(words),0),1),2) as i_per_1k,
    coalesce(sum(you),0) > coalesce(sum(i),0) as you_gt_i from ({_STYLE})"""
)
def corpus_style_stats(spark, d):
    return style.corpus_stats(pieces(spark, d))


@query(
    f"""with n as (select unnest({S.sentence_words('t')}) as n from {_B} where t <> ''), l as (select list(n) as l from n)
    select {S.nearest_rank('l', 0.25)} as sentence_words_p25, {S.nearest_rank('l', 0.75)} as sentence_words_p75 from l"""
)
def sentence_length_spread(spark, d):
    return style.sentence_spread(pieces(spark, d))


@query(
    f"""select round(coalesce(avg((len({S.sentence_words('p')}) > 1)::int),0.0),4) as multi_sentence_paragraph_ratio
    from (select unnest(regexp_split_to_array(coalesce(text,''), '\\n+')) as p from pieces) where {S.trim_all('p')} <> ''"""
)
def multi_sentence_paragraph_ratio(spark, d):
    return style.multi_sentence_share(pieces(spark, d))


def _lengths(kind: str, where: str) -> str:
    return f"""with n as (select {S.count(S.body('text'), T.WORD)} as n, source, {S.trim_all(S.body('text'))} <> '' as f from pieces), l as (select list(n) as l from n where {where})
    select round(coalesce(list_aggregate(l,'median')::double,0.0),1) as median_{kind}_words, {S.nearest_rank('l', 0.75)} as {kind}_words_p75,
    {S.nearest_rank('l', 0.9)} as {kind}_words_p90, coalesce(len(l),0)::bigint as {kind}_length_samples from l"""


@query(_lengths("post", "case when exists (select 1 from n where source = 'linkedin_post' and n >= 80) then source = 'linkedin_post' and n >= 80 else f end"))
def post_length_stats(spark, d):
    return style.length_stats(pieces(spark, d), "post")


@query(_lengths("article", "source = 'linkedin_article' and n >= 150"))
def article_length_stats(spark, d):
    return style.length_stats(pieces(spark, d), "article")


@query("select * from " + ", ".join(f"({ORACLE[k]})" for k in ("corpus_style_stats", "post_length_stats", "article_length_stats", "sentence_length_spread", "multi_sentence_paragraph_ratio")))
def style_card(spark, d):
    return style.style_card(pieces(spark, d))


@query(f"""with c as ({ORACLE['style_card']}), v as (select nullif(median_article_words,0) as am, nullif(article_words_p75,0) as a75, nullif(article_words_p90,0) as a90, nullif(median_post_words,0) as pm,
    nullif(post_words_p75,0) as p75, nullif(post_words_p90,0) as p90 from c),
    a as (select *, coalesce(least(3000, greatest(600, round_even(coalesce(am,a75,a90),0)))::int, 1100) as aim, coalesce(a90,a75,am) as long from v),
    t as (select *, case when long is null then greatest(aim,1100) else least(3000, greatest(aim, round_even(long,0)::int)) end as target, least(8, greatest(2, round_even(aim/300::double,0)))::int as hint from a),
    p as (select *, coalesce(least(550, greatest(300, round_even(coalesce(p90,p75,pm),0)))::int, 500) as pt from t)
    select aim as article_aim, target as article_target, hint as section_hint, least(600, greatest(180, round_even(aim/hint::double,0)))::int as section_words, pt as post_target,
    least(pt, coalesce(least(550, greatest(300, round_even(coalesce(p75,p90,pm),0)))::int, 500)) as post_aim from p""")
def length_policy(spark, d):
    return style.length_policy(style.style_card(pieces(spark, d)))


@query(
    f"""with l as (select list_sort(list({S.count(S.body('output'), T.WORD)})) as l from pairs)
    select l[len(l)//2 + 1] as median, l[least(len(l)-1, (len(l)*9)//10) + 1] as p90, l[len(l)] as max from l"""
)
def pair_audit_quantiles(spark, d):
    return style.audit_quantiles(table(spark, d, "pairs").select(F.size(T.words(F.col("output"))).alias("n")), "n")


@query(f"""with a as {S.axes("pieces", "id", "text")}, s as (select id, words, names as proper_nouns, proper_per_1k, case source when 'linkedin_article' then 42.0::double when 'linkedin_post' then 20.0::double
    else (case when words < 500 then 20.0::double else 42.0::double end) end as floor from a join (select id, source from pieces) p using (id))
    select id, words, proper_nouns, proper_per_1k, floor, proper_per_1k >= floor as pass from s""")
def specificity_scorecard(spark, d):
    c = F.when(F.col("source") == "linkedin_article", "article").when(F.col("source") == "linkedin_post", "post")
    return pieces(spark, d).select("id", style.scorecard(F.col("text"), c).alias("s")).select("id", "s.*")


@query(
    """with g as (select sha256(text) as h, min(id) as keeper, count(*) as members from documents_like group by text having count(*) > 1) select * from g""".replace(
        "documents_like", "(select id, text from pieces where text is not null)"
    )
)
def same_text_groups(spark, d):
    """Groups of letter-for-letter equal texts."""
    g = pieces(spark, d).where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("members"))
    return g.where("members > 1")


KEYED = f"k as materialized (select id, source, date, title, meta, {S.duplicate_key('text')} as key from pieces), r as (select * from k where key <> '')"
_RANK = "coalesce(list_position(['linkedin_article','linkedin_post','linkedin_comment'], source), 4)"
_BEST = (
    f"row_number() over (partition by key order by {_RANK}, case when coalesce(date,'') <> '' then 0 else 1 end, -length(key), -length({S.trim_all(S.body('title'))}), -coalesce(cardinality(meta)::int, 0), id)"
)
GROUPED = f"with {KEYED}, o as (select *, {_BEST} as place, count(*) over (partition by key) as members from r)"


@query(f"{GROUPED} select sha256(key) as key_hash, id as keeper, members, 0::bigint as holdouts from o where place = 1 and members > 1")
def exact_dup_groups(spark, d):
    return dedupe.exact_groups(pieces(spark, d))


@query(f"{GROUPED} select p.id as id from pieces p left join o on o.id = p.id where coalesce(o.place, 1) = 1")
def dedupe_exact_keepers(spark, d):
    """What dedupe keeps when only equal keys count, as a near ratio of 1 asks for."""
    return dedupe.deduped(pieces(spark, d), near_ratio=1.0).select("id")


@query(
    f"""{GROUPED}, g as (select key, max(members) as members, min(coalesce(source,'')) <> max(coalesce(source,'')) as cross_source from o where members > 1 group by key),
    b as (select coalesce(source,'') as s, count(*) as n from o where place > 1 group by 1)
    select (select count(*) from g) as groups, (select count(*) from g) as exact_groups, 0::bigint as near_groups, (select coalesce(sum(members-1),0)::bigint from g) as dropped,
    (select count(*) from g where cross_source) as cross_source, (select map_from_entries(list((s, n) order by s)) from b) as dropped_by_source"""
)
def dedupe_exact_report(spark, d):
    return dedupe.report(pieces(spark, d), near_ratio=1.0)


@query()
def dedupe_keepers(spark, d):
    return dedupe.deduped(pieces(spark, d), near_ratio=dedupe.NEAR_RATIO).select("id")


@query()
def dedupe_report(spark, d):
    return dedupe.report(pieces(spark, d), near_ratio=dedupe.NEAR_RATIO)


@query()
def near_dup_links(spark, d):
    return dedupe.near_links(pieces(spark, d))


@query(f"with n as (select id, {S.normalized('text')} as c from pieces) select id, {S.count('c', S.NOT_WS + '+')} as words, md5(c) as clean from n")
def normalize_pages(spark, d):
    return rewrite.normalized(pieces(spark, d).select("id", "text"), "text", "clean").select("id", T.word_count(F.col("clean")).alias("words"), F.md5("clean").alias("clean"))


@query(f"""select article_id, md5(array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(coalesce("Content",''), '</?[a-zA-Z][^>]*>', chr(2), 'g'), '<', chr(2)||'<'||chr(2)), chr(2)), lambda s: {S.trim_all('s')}), lambda s: s <> ''), chr(10))) as text from li_articles""")
def html_ingest_text(spark, d):
    a = table(spark, d, "li_articles")
    return a.select("article_id", F.md5(rewrite.by_text(rewrite.html_lines, "string")(F.col("Content"))).alias("text"))


@query(f"""with t as (select id, {S.trim_all(S.body('text'))} as t from pieces), h as (select id, t, t[1:280] as h from t),
    c as (select *, length(h) - strpos(reverse(h), chr(10)||chr(10)) - 1 as two, length(h) - strpos(reverse(h), chr(10)) as one, length(h) - strpos(reverse(h), ' ') as gap from h)
    select id, case when length(t) <= 280 then t else {S.trim_all("t[1:(case when contains(h, chr(10)||chr(10)) and two >= 93 then two when contains(h, chr(10)) and one >= 93 then one when contains(h, ' ') and gap >= 93 then gap else 280 end)]")} || '…' end as cut from c""")
def truncate_at_break(spark, d):
    return pieces(spark, d).select("id", corpus.truncate_at(F.col("text"), 280).alias("cut"))


@query(f"""with t as (select id, {S.trim_all(S.body('text'))} as t from pieces)
    select id, case when {S.count('t', S.NOT_WS + '+')} <= 60 then t else regexp_extract(t, '^((?:{S.NOT_WS}+{S.WS}+){{59}}{S.NOT_WS}+)', 1) end as clip from t""")
def clip_words(spark, d):
    return pieces(spark, d).select("id", corpus.clip_words(F.col("text"), 60).alias("clip"))
