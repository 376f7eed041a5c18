"""Queries on finishing, drafting, training rows and evaluation runs, each over its whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import drafting, evaluate, finish, guards, retrieve, rewrite, style, training
from corpusloom.plans import sqltext as S
from corpusloom.plans.corpus_queries import ORACLE as CORPUS
from corpusloom.plans.draft_queries import ONE, _claimed, _granted, distinct_pairs
from corpusloom.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pieces", spread=True)


# finishing

_HINT = "(?i)\\b(?:leverage|synerg|delve|robust|moreover|furthermore|additionally|unlock(?:ing)?|nestled|testament|vibrant|in today''s|it is important to note)\\b"
_MARK = (
    "(?i)(?:here''s the thing|let''s be real|let me be clear|let''s be honest|\\bwth\\b|who''?s saying|ship the take|cut the fog|keep the spine|say something|make it count|or don''?t post|or stay quiet)"
)


def _classes(src: str, key: str, col: str) -> str:
    """(key, t, sloppy, in_voice, soulless)."""
    t = S.trim_all(S.body("x"))
    breaks, asks = "(length(t) - length(replace(t, chr(10), '')))", "len(regexp_extract_all(t, '\\?'))"
    return (
        f"(select {key}, t, sloppy, in_voice, t <> '' and not sloppy and not in_voice as soulless from (select {key}, t, sloppy, t <> '' and length(t) <= 1600 and (n >= 2 or {breaks} >= 2) and "
        f"(case when regexp_matches(t, '{_MARK}') then 2 else 0 end + case when {asks} > 0 and punchy then 2 when {asks} >= 3 and n >= 3 then 3 else 0 end + punchy::int "
        f"+ regexp_matches(t, '\\b(?:I''m|I''ve|I''d|don''t|doesn''t|isn''t|won''t|can''t)\\b')::int + (len(regexp_extract_all(t, '\\bI\\b')) >= 2)::int) >= 3 as in_voice "
        f"from (select {key}, t, len(regexp_extract_all(t, '{_HINT}')) >= 2 as sloppy, len(ps) as n, len(ps) >= 3 and list_sum(list_transform(ps, lambda p: length(p)))/greatest(len(ps),1)::double <= 140 as punchy "
        f"from (select {key}, t, {S.paragraphs('t')} as ps from (select {key}, {t} as t from (select {key}, {col} as x from {src}))))))"
    )


@query(f"select id, sloppy, in_voice, soulless from {_classes('pieces', 'id', 'text')}")
def draft_classes(spark, d):
    c = F.col("text")
    return pieces(spark, d).select("id", finish.sloppy(c).alias("sloppy"), finish.in_voice(c).alias("in_voice"), finish.soulless(c).alias("soulless"))


_OUT = (
    ("(?im)^(?:Here''s|Here is) what\\b[^:\\n]{0,160}\\blooked like:\\s*\\n?", ""), ("(?im)^(?:Here''s|Here is) the problem:\\s*", ""),
    ("(?im)^(?:Here''s|Here is) the part that should genuinely bother[^\\n]*\\n?", ""), ("(?i)[ \\t]*That''s the part worth\\b[^.!?\\n]*[.!]?", ""),
    ("(?i)\\bThat''s the part people\\b", "That''s what people"), ("([.!?])([A-Za-z])", "\\1 \\2"),
)


def strip_openers_sql(t: str) -> str:
    out = S.trim_all(S.body(t))
    for p, r in _OUT:
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda x: case when regexp_matches(x, '^[a-z]') then upper(x[1:1]) || x[2:] else x end), chr(10))"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10)||chr(10), 'g')"
    out = f"regexp_replace({out}, '[\\t\\v\\f\\x1c-\\x1f\\x{{85}}\\p{{Z}}]{{2,}}', ' ', 'g')"
    return S.trim_all(f"regexp_replace({out}, '[ \\t]+\\n', chr(10), 'g')")


FX_OPENERS = (
    ("fx1", "Here's what the release looked like:\nbig.  And red.\n\n\n\nthat's the part people miss.Really"), ("fx2", "Here is the problem: nobody reads.\nHere's the part that should genuinely bother you.\nStill here. That's the part worth keeping!"),
    ("fx3", "Here's what the commenter didn't see:\nthe boat."), ("fx4", None), ("fx5", "  "),
)
_FX = lambda rows: ", ".join("(" + ", ".join("null" if x is None else S.q(x) for x in r) + ")" for r in rows)


@query(f"select id, md5({strip_openers_sql('text')}) as stripped from (select id, text from pieces union all select * from (values {_FX(FX_OPENERS)}) v(id, text))")
def strip_openers(spark, d):
    rows = pieces(spark, d).select("id", "text").unionByName(spark.createDataFrame(FX_OPENERS, "id string, text string"))
    return rows.select("id", F.md5(finish.strip_openers(F.col("text"))).alias("stripped"))


_LONGW = lambda t: f"list_filter(list_distinct(regexp_extract_all(lower({S.body(t)}), '[a-z0-9'']+')), lambda w: length(w) > 2)"
_NEWW = (
    f"with m as materialized (select pos, {S.trim_all(S.body('input'))} as d, {S.trim_all(S.body('output'))} as r from {ONE}), s as materialized (select pos, d, r, {S.strip_tells('d')} as st from m), "
    f"u as materialized (select pos, d, r, {strip_openers_sql('st')} as c from s), k as materialized {_classes('m', 'pos', 'd')}, "
    f"w as (select pos, d, r, {_LONGW('d')} as dw, {_LONGW('r')} as rw, list_sort(list_filter({_LONGW('r')}, lambda x: not list_contains({_LONGW('d')}, x) and not list_contains({_LONGW('c')}, x))) as new from u)"
)
_SHARE = "(case when len(dw) = 0 then 1.0 else len(list_intersect(dw, rw))/len(dw)::double end)"
_CUT = "(length(r)/greatest(length(d),1)::double < 0.40 or (length(r)/greatest(length(d),1)::double < 0.55 and not regexp_matches(r, '[.!?''\"”’)]$')))"
_NOVEL = "(d <> '' and r <> '' and d <> r and (length(d) > 1600 or not (sloppy or soulless)) and (len(new) > 10 or (len(dw) > 0 and len(new)/greatest(len(dw),1)::double > 0.03)))"


@query(f"{_NEWW} select pos, len(new) as n, md5(array_to_string(new, ' ')) as words, {_NOVEL} as high from w join (select pos, sloppy, soulless from k) k using (pos)")
def introduced_words(spark, d):
    a, b = F.col("input"), F.col("output")
    rows = distinct_pairs(spark, d).select("pos", F.explode(F.array(F.struct(finish.new_words(a, b).alias("w"), finish.novelty_high(a, b).alias("high")))).alias("x"))
    return rows.select("pos", F.size("x.w").alias("n"), F.md5(F.array_join("x.w", " ")).alias("words"), "x.high")


@query(
    f"""{_NEWW}, g as (select *, case when d = '' then r when r = '' then d when d = r then d end as plain from w join (select pos, sloppy, soulless from k) k using (pos))
    select pos, md5(case when {_NOVEL} then d else r end) as novelty, md5(coalesce(plain, case when {_SHARE} < 0.5 then d else r end)) as substance, md5(coalesce(plain, case when {_CUT} then d else r end)) as truncation from g"""
)
def rewrite_guards(spark, d):
    a, b = F.col("input"), F.col("output")
    g = F.struct(F.md5(finish.novelty_guard(a, b)).alias("novelty"), F.md5(finish.substance_guard(a, b)).alias("substance"), F.md5(finish.truncation_guard(a, b)).alias("truncation"))
    return distinct_pairs(spark, d).select("pos", F.explode(F.array(g)).alias("g")).select("pos", "g.*")


@query(
    f"""{_NEWW} select pos, d <> '' and d = r as unchanged, d <> '' and (r = '' or {_CUT}) as likely_truncated, d <> '' and r <> '' and d <> r and {_SHARE} < 0.5 as substance_loss,
    round(case when d = '' then 1.0 else length(r)/greatest(length(d),1)::double end, 3) as length_ratio, len(new) as new_words, {_NOVEL} as novelty_high from w join (select pos, sloppy, soulless from k) k using (pos)"""
)
def rewrite_flags(spark, d):
    return distinct_pairs(spark, d).select("pos", F.explode(F.array(finish.quality_flags(F.col("input"), F.col("output")))).alias("m")).select("pos", "m.*")


@query()
def invention_flags(spark, d):
    return distinct_pairs(spark, d).select("pos", F.explode(F.array(finish.invention_flags(F.col("input"), F.col("output")))).alias("m")).select("pos", "m.*")


@query()
def similarity_guard(spark, d):
    return distinct_pairs(spark, d).select("pos", F.md5(finish.similarity_guard(F.col("input"), F.col("output"))).alias("kept"))


_SENT = f"list_filter(list_transform(string_split(regexp_replace(t, '([.!?]){S.SPACE}+', '\\1'||chr(1), 'g'), chr(1)), lambda s: {S.trim_all('s')}), lambda s: s <> '')"
_PACK = "list_reduce(ss, lambda acc, s: case when len(acc) > 0 and length(s) < 28 then acc[1:len(acc)-1] || [acc[len(acc)] || ' ' || s] else acc || [s] end, []::varchar[])"


@query(
    f"""with t as (select id, {S.trim_all(S.body('text'))} as t from pieces), s as (select id, t, {_SENT} as ss, list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.trim_all('x')}), lambda x: x <> '') as ls from t),
    p as (select *, {_PACK} as ps from s)
    select id, md5(case when t = '' or contains(t, chr(10)||chr(10)) then t when contains(t, chr(10)) and len(ls) >= 2 then array_to_string(ls, chr(10)||chr(10)) when len(ss) < 2 or len(ps) < 2 then t else array_to_string(ps, chr(10)||chr(10)) end) as paragraphs from p"""
)
def paragraphize(spark, d):
    return pieces(spark, d).select("id", F.md5(finish.paragraphize(F.col("text"))).alias("paragraphs"))


@query()
def finalize_rewrites(spark, d):
    """The whole chain over outputs as if a model had said them: wrapped in thinking and the prompt's headers."""
    raw = F.concat(F.lit("Steps first.</think>\n### Rewritten\n"), T.body(F.col("output")), F.lit("\n### Draft\nagain"))
    rows = distinct_pairs(spark, d).withColumn("raw", raw)
    return finish.finalized(rows, "input", "raw", "final", similarity=True, substance=True).select("pos", F.md5("final").alias("final"))


@query()
def restored_openers(spark, d):
    return distinct_pairs(spark, d).select("pos", F.md5(finish.restore_openers(F.col("input"), F.col("output"))).alias("restored"))


@query()
def collapsed_repeats(spark, d):
    return pieces(spark, d).select("id", F.md5(rewrite.by_text(finish.collapsed, "string")(F.col("text"))).alias("collapsed"))


# guards and facts


_NAMES = "names as (select pos, list_sort(list_filter(c, lambda x: not list_contains(g, x))) as names from (select pos, {c} as c, {g} as g from {src}))"


@query(f"with {_NAMES.format(c=_claimed('output'), g=_granted('input'), src=ONE)} select pos, names from names")
def names_beyond_brief(spark, d):
    """Names that outputs claim and inputs don't grant, by the fixed lists alone."""
    c = F.array_sort(F.array_except(guards.claimed_names(F.col("output")), guards.granted_names(F.col("input"))))
    return distinct_pairs(spark, d).select("pos", c.alias("names"))


_LOWW = "list_distinct(list_transform(regexp_extract_all(d, '(?:^|[^A-Za-z0-9''-])([a-z][a-z0-9''-]*[a-z0-9])(?:$|[^A-Za-z0-9''-])', 1), lambda w: lower(w)))"


@query(
    f"""with t as (select regexp_replace(coalesce(text,''), '([^A-Za-z0-9''-])', '\\1\\1', 'g') as d, coalesce(text,'') as x from pieces), l as (select unnest({_LOWW}) as word, 1 as low from t),
    c as (select unnest(list_distinct(list_transform(list_filter(generate_series(2, greatest(len(k),1)), lambda i: regexp_matches(k[i-1], '[a-z0-9,]$') and regexp_matches(k[i], '^[A-Z][a-z]')), lambda i: lower(regexp_extract(k[i], '^[A-Z][a-z][a-zA-Z0-9''-]*'))))) as word, 0 as low
    from (select string_split(x, ' ') as k from t)), n as (select word, sum(low) as low, count(*) as n from (select * from l union all select * from c) group by word)
    select word from n where low >= greatest(2, n - low)"""
)
def ordinary_words(spark, d):
    return guards.ordinary_words(pieces(spark, d), "text")


@query()
def invention_by_corpus(spark, d):
    """Inventions of outputs beside inputs, words that the corpus shows to be ordinary being no names."""
    return guards.invented_names(distinct_pairs(spark, d), "pos", "input", "output", guards.ordinary_words(pieces(spark, d), "text"))


@query()
def allowed_facts(spark, d):
    return distinct_pairs(spark, d).select("pos", guards.allowed_facts(F.col("input")).alias("f")).select("pos", "f.*")


@query()
def scrubbed_drafts(spark, d):
    return drafting.scrubbed(distinct_pairs(spark, d), "input", "output").select("pos", F.md5("output").alias("scrubbed"))


@query()
def parrot_redacted(spark, d):
    """Runs of eight words shared with evaluation texts or with their redacted forms."""
    e = table(spark, d, "eval_items").select("text")
    both = e.unionByName(e.select(rewrite.by_text(rewrite.masked, "string")(F.col("text")).alias("text")))
    return guards.parroted(distinct_pairs(spark, d), both, "pos", "output")


@query(
    f"""with t as (select pos, {S.guard_words('input')} as b, {S.guard_words('output')} as t, {S.trim_all(S.body('input'))} as x, {S.trim_all(S.body('output'))} as y from {ONE}),
    s as (select *, coalesce(list_sum(list_transform(list_distinct(b), lambda w: least(len(list_filter(b, lambda v: v = w)), len(list_filter(t, lambda v: v = w))))), 0)/greatest(len(t),1)::double as share from t)
    select pos, not (x = y or share > 0.25) as ok, case when x = y then 'verbatim' when share > 0.25 then 'too_close' end as reason, round(share, 4) as overlap from s"""
)
def brief_guard(spark, d):
    return distinct_pairs(spark, d).select("pos", F.explode(F.array(evaluate.brief_guard(F.col("input"), F.col("output")))).alias("g")).select("pos", "g.*")


# drafting


@query("select count(*) filter (source = 'linkedin_article') as corpus, count(*) filter (source = 'linkedin_article' and pos % 2 = 0) as indexed, least(count(*) filter (source = 'linkedin_article'), count(*) filter (source = 'linkedin_article' and pos % 2 = 0)) < 5 as blocked from pieces")
def article_floors(spark, d):
    p = pieces(spark, d)
    return drafting.article_floors(p, p.where("pos % 2 = 0"))


@query()
def article_exemplars(spark, d):
    return pieces(spark, d).where("source = 'linkedin_article'").select("id", F.md5(drafting.article_exemplar(F.col("text"))).alias("exemplar"))


_CASE = lambda t: (
    f"list_aggregate(list_transform([{{'t': {S.body(t)}}}], lambda z: array_to_string(list_transform(string_split(regexp_replace(regexp_replace(z.t, '^([A-Z][a-z])', chr(1)||'\\1'), '([.!?:;][ \\t\\n\\v\\f\\r]|\\n)([A-Z][a-z])', '\\1'||chr(1)||'\\2', 'g'), chr(1)), "
    "lambda s: case when regexp_matches(s, '^[A-Z][a-z]') and not list_contains(regexp_extract_all(z.t, '[a-z0-9,''’-][ \\t\\n\\v\\f\\r]([A-Z][a-z][a-zA-Z''’-]*)', 1), regexp_extract(s, '^[A-Z][a-z][a-zA-Z''’-]*')) then lower(s[1:1]) || s[2:] else s end), '')), 'min')"
)
FX_CASE = (("fx1", "Keep the test boring. We met Keep again: Nothing new\nBoats float. And Boats sink; So we Walk"), ("fx2", None), ("fx3", "a Bc. De"), ("fx4", "ABC first. Contoso grew, Contoso fell"))


@query(f"select id, {_CASE('text')} as cased from (values {_FX(FX_CASE)}) v(id, text)")
def sentence_case(spark, d):
    return spark.createDataFrame(FX_CASE, "id string, text string").select("id", drafting.sentence_case(F.col("text")).alias("cased"))


_OUTLINE = (
    "list_transform(list_filter(generate_series(1, len(a)), lambda i: list_position(a, a[i]) = i), lambda i: a[i])[1:8] as sections from (select pos, (case when top <> '' and len(bs) < 2 then [top] else [] end) || bs as a from "
    f"(select pos, {S.trim_all(S.body('input'))}[1:40] as top0, {S.trim_all('coalesce(input[1:40], chr(32))')} as top, list_filter(list_transform(regexp_split_to_array({S.body('output')}, '\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: {S.trim_all('regexp_replace(s, ' + S.q('^[ \\t\\n\\v\\f\\r]*[-*•][ \\t\\n\\v\\f\\r]+') + ', ' + S.q('') + ')')}), lambda s: s <> '') as bs from {ONE}))"
)


@query(f"select pos, len(sections) >= 2 as ok, len(sections) as n, md5(array_to_string(sections, chr(10))) as sections from (select pos, {_OUTLINE})")
def outlines(spark, d):
    """Outlines of topics (heads of inputs) with the lines of outputs as points."""
    o = drafting.outline(F.substring("input", 1, 40), F.col("output"))
    return distinct_pairs(spark, d).select("pos", F.explode(F.array(o)).alias("o")).select("pos", "o.ok", F.size("o.sections").alias("n"), F.md5(F.array_join("o.sections", "\n")).alias("sections"))


@query(
    """select b::int as base, w::int as brief_words, n::int as sections, case when w >= 80 then b else least(b, greatest(80, (greatest(80*n, round_even(w*2.5::double*n,0)::int) // n))) end::int as words
    from (select unnest([100,180,300,600]) as b), range(0, 121) r(w), range(1, 9) s(n)"""
)
def section_budget(spark, d):
    """Words a section may have, for all brief lengths up to 120 words and up to eight sections."""
    g = spark.range(0, 121).select(F.col("id").cast("int").alias("brief_words")).withColumn("sections", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("base", F.explode(F.array(*map(F.lit, (100, 180, 300, 600)))))
    return g.select("base", "brief_words", "sections", drafting.section_words(F.col("base"), F.col("brief_words"), F.col("sections")).alias("words"))


def briefs(spark: SparkSession, d: str) -> DataFrame:
    """(holdout_id, topic, points, source) mined from articles."""
    rows = pieces(spark, d).where("source = 'linkedin_article'").select("id", "text", rewrite.article_brief(F.col("text")).alias("b")).where("b.ok")
    return rows.select(F.col("id").alias("holdout_id"), F.col("b.topic").alias("topic"), F.array_join("b.points", "\n").alias("points"), F.col("text").alias("source"))


def _echo_section():
    """A stand-in for a model: says the section's claim, and invents a firm in every other."""

    def f(prompt: str) -> str:
        claim = prompt.split("Write this section only: ", 1)[1].split("\n", 1)[0]
        more = "" if "Leave out:" in prompt or len(claim) % 2 else " Fabrikam Works agreed in nine weeks."
        return f"it is so that {claim.lower()}, and that holds in most cases as we saw.{more}"

    return f


@query()
def article_drafts(spark, d):
    out = drafting.write_article(briefs(spark, d), _echo_section, 280)
    return evaluate.safe_receipt(out.drop("article"))


@query()
def retrieved_exemplars(spark, d):
    """For each evaluation item whose id is divisible by 100, the clipped texts of the five pieces most like it."""
    b = table(spark, d, "eval_items").where("item_id % 100 = 0").select(F.col("item_id").alias("holdout_id"), F.col("text").alias("brief"))
    index = pieces(spark, d).where("id is not null and text is not null").select("id", "text", retrieve.embedding(F.col("text")).alias("vector"))
    return drafting.retrieved(b, index).select("holdout_id", F.md5("exemplar").alias("exemplar"))


@query()
def article_cadence(spark, d):
    return style.article_cadence(pieces(spark, d))


@query()
def style_profile(spark, d):
    return style.style_profile(pieces(spark, d))


@query()
def post_directives(spark, d):
    return style.directives(style.style_profile(pieces(spark, d)))


@query()
def article_directives(spark, d):
    return style.directives(style.style_profile(pieces(spark, d)), "article")


# training rows


@query()
def writer_examples(spark, d):
    held = evaluate.carve(pieces(spark, d).where("source = 'linkedin_post'"), 24)
    return training.writer_rows(pieces(spark, d), held).select("id", "reason", F.md5("brief").alias("brief"), F.md5("target").alias("target"))


@query()
def writer_reasons(spark, d):
    return training.reasons(training.writer_rows(pieces(spark, d)))


@query()
def sft_build(spark, d):
    rows = training.build(pieces(spark, d))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("draft")).alias("longest_draft"), F.max(F.length("target")).alias("longest_target"))


@query(f"select pos, case when {S.trim_all(S.body('input'))} = '' or {S.trim_all(S.body('output'))} = '' then null else md5({S.trim_all(S.body('output'))}) end as target, case when {S.trim_all(S.body('input'))} = '' or {S.trim_all(S.body('output'))} = '' then null else 3 end as turns from {ONE}")
def translator_examples(spark, d):
    """Turns of every pair, at a length that takes the longest of them."""
    rows = distinct_pairs(spark, d).select("pos", training.translator_row(F.col("input"), F.col("output"), seq=65536).alias("m"))
    return rows.select("pos", F.when(F.col("m").isNotNull(), F.md5(F.element_at("m.content", 3))).alias("target"), F.when(F.col("m").isNotNull(), F.size("m")).alias("turns"))


@query(f"select pos, {S.trim_all(S.body('output'))} as anchor from {ONE} where {S.trim_all(S.body('output'))} <> '' order by pos limit 8")
def voice_anchors(spark, d):
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    chat = distinct_pairs(spark, d).select("pos", F.array(turn("user", F.col("input")), turn("assistant", F.col("output"))).alias("messages"))
    return training.anchors(chat, 8)


@query(
    """select n::int as examples, e::int as epochs, least(2000, greatest(50, greatest(n,1)*e))::int as steps, (case when n > 0 then list_transform(generate_series(0, (n-1)//50), lambda i: least(50, n - i*50)) else [] end)::int[] as chunks,
    greatest(0, greatest(n,1) - 60)::int as left_after_60 from range(0, 400, 7) r(n), range(1, 4) s(e)"""
)
def train_plan(spark, d):
    g = spark.range(0, 400, 7).select(F.col("id").cast("int").alias("examples"))
    one = lambda e: g.select(
        "examples", F.lit(e).alias("epochs"), training.step_count(F.col("examples"), e).alias("steps"), training.step_chunks(F.col("examples"), F.lit(50)).alias("chunks"),
        training.steps_left(F.lit(60), F.col("examples")).alias("left_after_60"),
    )
    return one(1).unionByName(one(2)).unionByName(one(3))


FX_LOG = (
    ("l1", "Iter 10: Train loss 2.1, Peak mem 9.50 GB"), ("l2", "Iter 20: Train loss nan, Peak mem 9.75 GB\nIter 21: Peak mem 10.25 GB"), ("l3", "loading"), ("l4", None), ("l5", "Peak memory: 7 GB"),
)


@query(
    f"""select id, try_cast(regexp_extract(line, '(?i)\\bIter\\s+(\\d+)\\b', 1) as int) as iteration, try_cast(list_last(regexp_extract_all(line, '(?i)Peak mem(?:ory)?[:\\s]+([0-9]+(?:\\.[0-9]+)?)\\s*GB', 1)) as double) as peak_gb,
    regexp_matches(coalesce(line,''), '(?i)\\bloss\\s+nan\\b') as nan_loss from (values {_FX(FX_LOG)}) v(id, line)"""
)
def train_log(spark, d):
    return spark.createDataFrame(FX_LOG, "id string, line string").select("id", training.log_facts(F.col("line")).alias("f")).select("id", "f.*")


@query("select m::bigint as memory, greatest(1000000000, least((m*0.4::double)::bigint, 16000000000, greatest(1000000000, (m*0.75::double*0.5::double)::bigint)))::bigint as cap from (select unnest([1000000000, 8000000000, 16000000000, 48000000000, 128000000000]) as m)")
def memory_cap(spark, d):
    m = spark.createDataFrame([(x * 10**9,) for x in (1, 8, 16, 48, 128)], "memory bigint")
    return m.select("memory", training.memory_cap(F.col("memory"), F.col("memory") * 0.75).alias("cap"))


# evaluation runs


def _held(spark: SparkSession, d: str, source: str) -> DataFrame:
    rows = pieces(spark, d).where(F.col("source") == source).select("id", "text")
    return rows.withColumn("exemplar", F.lit("A short line.\n\nThen a longer one that says why the plan was late."))


@query()
def post_holdout_eval(spark, d):
    """Two model-free arms over all posts: one hands back its brief's points as lines, the other as one block."""
    lines = lambda: lambda p: "\n\n".join(x.removeprefix("- ") + "." for x in p.split("Points: ", 1)[1].split("\n\nStyle", 1)[0].split("\n"))
    block = lambda: lambda p: p.split("Points: ", 1)[1].replace("\n", " ")
    return evaluate.safe_receipt(evaluate.run_arms(_held(spark, d, "linkedin_post"), lines, block))


@query()
def article_holdout_eval(spark, d):
    lines = lambda: lambda p: "\n\n".join(x.removeprefix("- ") + "." for x in p.split("Points: ", 1)[1].split("\n\nStyle", 1)[0].split("\n"))
    block = lambda: lambda p: p.split("Points: ", 1)[1].replace("\n", " ")
    arms = evaluate.run_arms(_held(spark, d, "linkedin_article"), lines, block, kind="article", most_words=3000)
    return evaluate.article_verdict(evaluate.tally(arms.select("holdout_id", "arm", "distance", "disqualified")))


FX_SWEEP = (("step_000050", "archive"), ("step_000100", "keep"), ("step_000150", "keep"), ("step_000200", "archive"))


@query(
    f"""with v as (select * from (values {_FX(FX_SWEEP)}) v(checkpoint, verdict)), f as (select min(checkpoint) as first from v where verdict = 'keep')
    select checkpoint, verdict, coalesce(checkpoint = first, false) as kept from v, f where first is null or checkpoint <= first"""
)
def checkpoint_sweep(spark, d):
    return evaluate.sweep(spark.createDataFrame(FX_SWEEP, "checkpoint string, verdict string"))


FX_TALLY = ((4, 4, 0, 0, 0, 0, 0), (3, 2, 1, 0, 0, 0, 0), (5, 0, 0, 5, 5, 5, 5), (20, 15, 5, 0, 3, 1, 0), (0, 0, 0, 0, 0, 0, 0), (8, 8, 0, 0, 0, 0, 0))


@query(
    f"""with t as (select * from (values {', '.join(map(str, FX_TALLY))}) v(items, wins, losses, ties, a_out, b_out, both_out)), n as (select *, row_number() over () as r from t),
    q as (select r, round(sum(exp(lgamma(m+1) - lgamma(k+1) - lgamma(m-k+1) - m*ln(2))),4) as p from (select r, wins+losses as m, unnest(generate_series(wins, wins+losses)) as k from n where wins+losses > 0) group by r),
    x as (select n.*, coalesce(p, 1.0) as p_value, items > 0 and both_out >= items as undecided from n left join q using (r)),
    y as (select *, list_filter([case when undecided then 'every_item_disqualified' end, case when wins <= losses then 'no_majority' end, case when p_value > 0.05 then 'not_beyond_chance' end, case when a_out > b_out then 'disqualified_more_often' end], lambda z: z is not null) as reasons from x)
    select items, wins, losses, ties, a_out, b_out, both_out, p_value, not undecided as distance_decided, reasons, case when len(reasons) = 0 then 'voice_supported' else 'not_supported' end as verdict from y"""
)
def article_verdict(spark, d):
    return evaluate.article_verdict(spark.createDataFrame(FX_TALLY, "items int, wins int, losses int, ties int, a_out int, b_out int, both_out int"))


@query()
def rewrite_comparison(spark, d):
    """The draft stripped by rule, and the author's text, each measured against the draft."""
    rows = distinct_pairs(spark, d).where("input is not null")
    return evaluate.safe_receipt(training.compared(rows, "pos", "input", {"stripped": rewrite.strip_tells(F.col("input")), "author": F.col("output")}))


@query(
    f"""select id, len(regexp_extract_all(regexp_replace(coalesce(text,''), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,}}(?:$|[^\\p{{L}}\\p{{N}}_])')) as acronyms from pieces where meta['lang'] = 'en'"""
)
def acronym_count_en(spark, d):
    rows = pieces(spark, d).where(F.try_element_at("meta", F.lit("lang")) == "en")
    return rows.select("id", T.count(T.body(F.col("text")), r"\b[A-Z]{2,}\b").alias("acronyms"))


_P = "coalesce(word_count,0) >= 40 and year is not null and year <= 2022 and coalesce(source in ('linkedin_post','linkedin_article'), false)"
_DONE = CORPUS["select_filter"].split(" from ", 1)[1].rsplit(" where ", 1)[0]


@query(f"select count(*) filter ({_P}) as pieces, coalesce(sum(word_count) filter ({_P}), 0)::bigint as words, count(*) filter (year is null) as undated_in_index, count(*) as index_total from {_DONE}")
def run_select_summary(spark, d):
    from corpusloom.operators import corpus
    from corpusloom.schema import completed

    return corpus.run_summary(completed(pieces(spark, d)), ["linkedin_post", "linkedin_article"], 40, 2022)


