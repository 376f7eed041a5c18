"""Queries on pairs, guards, retrieval, rewriting and evaluation, each over its whole tables, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate, guards, pairs, retrieve, rewrite, training
from corpusloom.plans import sqltext as S
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


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").select("pos", "input", "output", "meta")


def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row per pos: pairs that were delivered twice count once."""
    return pair_rows(spark, d).groupBy("pos").agg(F.min("input").alias("input"), F.min("output").alias("output"))


ONE = "(select pos, min(input) as input, min(output) as output from pairs group by pos)"
AX_IN, AX_OUT = S.axes(ONE, "pos", "input"), S.axes(ONE, "pos", "output")
#: Every row of pairs, numbered, with the axes of both sides.
_NUM = "(select *, row_number() over () as rn from pairs)"
_GET = lambda k: f"lower(trim(coalesce(meta['{k}'], '')))"
_KIND = lambda k: f"case when {_GET(k)} in ('article','articles','longform','long') then 'article' when {_GET(k)} in ('linkedin','post','posts','li','short') then 'post' end"
_PLACE = "concat_ws(' ', " + ", ".join(_GET(k) for k in ("id", "source_id", "path", "source_path", "file", "filename")) + ")"
_CHANNEL = (
    f"case when coalesce({_KIND('source_type')}, {_KIND('channel')}) is not null then coalesce({_KIND('source_type')}, {_KIND('channel')}) "
    f"when {_GET('section_role')} in ('opener','middle','closer') then 'article' when regexp_matches({_PLACE}, '(?:^|[/_.-])articles?(?:$|[/_.-])') then 'article' "
    f"when regexp_matches({_PLACE}, '(?:^|[/_.-])(?:linkedin|posts?|li)(?:$|[/_.-])') then 'post' when o.words >= 500 or (o.short <= 0.10 and o.med >= 12.0) then 'article' else 'post' end"
)
_SIDES = f"with n as materialized {_NUM}, i as materialized {S.axes('n', 'rn', 'input')}, o as materialized {S.axes('n', 'rn', 'output')}"
_GATED = (
    f"{_SIDES}, c as (select n.rn as rn, pos, input, output, {_CHANNEL} as channel from n join o using (rn)), g as (select pos, channel, list_filter(["
    f"case when {S.trim_all(S.body('input'))} = '' then 'empty_input' end, case when {S.trim_all(S.body('output'))} = '' then 'empty_output' end, case when i.proper_per_1k > 30.0 then 'max_input_proper_1k' end, "
    "case when channel = 'post' and o.short - i.short < 0.08 then 'min_frag_gap_ratio' end, case when i.you_gt_i then 'input_you_gt_i' end, "
    "case when i.med - o.med < 2.0 then 'min_median_sentence_gap' end], lambda x: x is not null) as failed from c join i using (rn) join o using (rn))"
)


def _known(n: int, src: str, col: str) -> str:
    t = S.guard_words(col)
    return f"(select distinct unnest(g) as gram from (select {S.grams('t', n)} as g from (select {t} as t from {src}) where len(t) >= {n}))"


@query(
    f"""select pos, gram from (select distinct pos, unnest({S.grams('t', 8)}) as gram from (select pos, {S.guard_words('output')} as t from {ONE}) where len(t) >= 8)
    where gram in (select gram from {_known(8, 'eval_items', 'text')})"""
)
def ngram8_parrot(spark, d):
    """Runs of eight words that the pairs' outputs share with any evaluation text."""
    return guards.parroted(distinct_pairs(spark, d), table(spark, d, "eval_items"), "pos", "output")


@query(
    f"""with t as (select pos, {S.guard_words('output')} as t from {ONE}), k as {_known(5, 'eval_items', 'text')},
    p as (select pos, t, unnest(generate_series(1, len(t)-4)) as i from t where len(t) >= 5),
    h as (select pos, i from p where array_to_string(t[i:i+4],' ') in (select gram from k)),
    c as (select distinct pos, i + o.o as q from h, (select unnest([0,1,2,3,4]) as o) o)
    select t.pos as pos, len(t) as tokens, coalesce(n,0)::int as covered from t left join (select pos, count(*) as n from c group by pos) c on c.pos = t.pos"""
)
def copied_token_ratio(spark, d):
    return guards.copied_ratio(distinct_pairs(spark, d), table(spark, d, "eval_items"), "pos", "output")


@query(f"""with t as (select pos, {S.guard_words('output')} as d, {S.guard_words('input')} as e, len({S.markers('output')}) > 0 as m from {ONE}),
    g as (select pos, d, m, case when len(e) >= 5 then {S.grams('e', 5)} else [] end as e5, case when len(e) >= 8 then {S.grams('e', 8)} else [] end as e8, case when len(d) >= 8 then {S.grams('d', 8)} else [] end as d8 from t),
    p as (select pos, e5, d, unnest(generate_series(1, len(d)-4)) as i from g where len(d) >= 5),
    c as (select distinct pos, i + o.o as q from p, (select unnest([0,1,2,3,4]) as o) o where list_contains(e5, array_to_string(d[i:i+4],' ')))
    select g.pos as pos, m or list_has_any(d8, e8) or (len(d) >= 40 and round(coalesce(n,0)/greatest(len(d),1)::double,4) >= 0.3) as rejected
    from g left join (select pos, count(*) as n from c group by pos) c on c.pos = g.pos""")
def parrot_reject(spark, d):
    return distinct_pairs(spark, d).select("pos", guards.parrot_reject(F.col("output"), F.col("input")).alias("rejected"))


@query(
    f"""with t as (select pos, {S.guard_words('output')} as t, {S.guard_words('input')} as b from {ONE}),
    g as (select pos, t, case when len(b) >= 5 then {S.grams('b', 5)} else [] end as g from t),
    p as (select pos, g, t, unnest(generate_series(1, len(t)-4)) as i from g where len(t) >= 5),
    c as (select distinct pos, i + o.o as q from p, (select unnest([0,1,2,3,4]) as o) o where list_contains(g, array_to_string(t[i:i+4],' ')))
    select t.pos as pos, len(t) >= 12 and round(coalesce(n,0)/greatest(len(t),1)::double,4) >= 0.6 as echo from t left join (select pos, count(*) as n from c group by pos) c on c.pos = t.pos"""
)
def brief_echo(spark, d):
    return distinct_pairs(spark, d).select("pos", guards.brief_echo(F.col("output"), F.col("input")).alias("echo"))


#: Drafts that show each mark, beside the pieces, none of which does.
FX_DRAFT = (
    ("fx1", "BRIEF: sell the boat\nIt floats."), ("fx2", "Ask [FIRST NAME] and <YOUR TEAM>."), ("fx3", "One.\n---\nTwo.\n====="), ("fx4", "Examples of it:\nWrite the post now"), ("fx5", "  brief :\n***"), ("fx6", "[ok] <b> -- no marks: 3 * 4"),
)


@query(
    f"""select id, {S.markers('text')} as markers from (select id, text from pieces union all select * from (values {', '.join(f"({S.q(a)}, {S.q(b)})" for a, b in FX_DRAFT)}) v(id, text))"""
)
def scaffold_markers(spark, d):
    """Of pieces and of a few drafts of our own."""
    rows = table(spark, d, "pieces", spread=True).select("id", "text").unionByName(spark.createDataFrame(FX_DRAFT, "id string, text string"))
    return rows.select("id", guards.scaffold_markers(F.col("text")).alias("markers"))


_CAPS = (
    "a an and as at but by for from here how i if in it its no not of on one or our so stop that the their these they this those to two three four five six seven eight nine ten we what when where why with you your"
)
_MORE = (
    " monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december q1 q2 q3 q4"
    " ai api apis arr b2b b2c ceo cfo coo cto crm csv cv eu faq gdp hr ip it kpi kpis llm llms mba ml mrr mvp nps ok okr okrs pdf pm pr qa r&d rag roi rfp saas sdk seo sla smb sms sql tam tl;dr tldr ui uk url us usa ux vc vp"
    " assistant brief briefs cadence constraint constraints entity examples filler lineation linkedin paragraph paragraphs response rhythm system topic user"
    " the a an and or but if when where what why how who this that these those then than for with from into onto over under after before because while although however therefore meanwhile also just only even still already here"
    " there was were are is be been being have has had do does did will would could should may might must can add most many some every each all none no not yes you your yours i we they he she it its our their"
)
_SPANS = lambda t: f"list_transform(regexp_extract_all({S.body(t)}, '\\b(?:[A-Z]{{2,}}|[A-Z](?:&[A-Z])+|[A-Z][a-z][a-zA-Z0-9''-]*(?:\\s+[A-Z][a-z][a-zA-Z0-9''-]*)*)\\b'), lambda s: regexp_replace(lower(regexp_replace(s, '\\s+', ' ', 'g')), '[''’]s$', ''))"
_LIST = lambda ws: f"string_split('{ws}', ' ')"


def _granted(t: str) -> str:
    kept = f"list_filter({_SPANS(t)}, lambda s: len(list_filter(string_split(s, ' '), lambda w: not list_contains({_LIST(_CAPS)}, w))) > 0)"
    return f"list_distinct({kept} || flatten(list_transform({kept}, lambda s: string_split(s, ' '))))"


def _claimed(t: str) -> str:
    # words of a span, each once, as array_except gives them
    bare = f"list_filter(list_transform({_SPANS(t)}, lambda s: list_filter(string_split(s, ' '), lambda w: not list_contains({_LIST(_CAPS + _MORE)}, w))), lambda w: len(w) > 0)"
    once = f"list_transform({bare}, lambda ws: list_transform(list_filter(generate_series(1, len(ws)), lambda i: list_position(ws, ws[i]) = i), lambda i: ws[i]))"
    return f"list_distinct(list_transform({once}, lambda w: array_to_string(w, ' ')) || flatten({once}))"


@query(f"select id, list_sort({_granted('text')}) as granted, list_sort({_claimed('text')}) as claimed from pieces")
def entity_keys(spark, d):
    return table(spark, d, "pieces", spread=True).select("id", F.array_sort(guards.granted_names(F.col("text"))).alias("granted"), F.array_sort(guards.claimed_names(F.col("text"))).alias("claimed"))


@query()
def evidence_numbers(spark, d):
    return table(spark, d, "pieces", spread=True).select("id", F.array_sort(guards.evidence_figures(F.col("text"))).alias("figures"))


@query()
def invention_check(spark, d):
    return distinct_pairs(spark, d).select("pos", guards.invented(F.col("input"), F.col("output")).alias("x")).select("pos", "x.*")


@query()
def entity_mask(spark, d):
    return table(spark, d, "pieces", spread=True).select("id", F.md5(rewrite.by_text(rewrite.masked, "string")(F.col("text"))).alias("masked"))


_W = lambda c: f"list_distinct({S.every(f'lower(coalesce({c},{chr(39)}{chr(39)}))', '[a-z0-9' + chr(39) + ']+')})"


@query(
    f"""select pos, len(d) as draft_words, len(list_intersect(d, r)) as shared from (select pos, {_W('input')} as d, {_W('output')} as r from {ONE})"""
)
def word_overlap(spark, d):
    a, b = T.word_set(F.col("input")), T.word_set(F.col("output"))
    return distinct_pairs(spark, d).select("pos", F.size(a).alias("draft_words"), F.size(F.array_intersect(a, b)).alias("shared"))


@query(
    f"""with m as (select pos, {S.count(S.body('output'), S.NOT_WS + '+')}/greatest({S.count(S.body('input'), S.NOT_WS + '+')},1)::double as q,
    len(list_intersect({_W('input')},{_W('output')}))/greatest(len({_W('input')}),1)::double as l, {S.scaffolding_count('input')} as a, {S.scaffolding_count('output')} as b from {ONE})
    select pos, round(q,4) as length_ratio, round(l,4) as lexical_overlap, q between 0.92 and 1.08 and l >= 0.92 as near_copy, a as scaffolding_before, b as scaffolding_after,
    not (q between 0.92 and 1.08 and l >= 0.92) and q >= 0.4 as pass from m"""
)
def longform_metrics(spark, d):
    return distinct_pairs(spark, d).select("pos", pairs.longform(F.col("input"), F.col("output")).alias("m")).select("pos", "m.*")


@query(f"{_SIDES} select pos, {_CHANNEL} as channel from n join o using (rn)")
def channel_inference(spark, d):
    return pairs.with_axes(pair_rows(spark, d)).select("pos", pairs.channel(F.col("meta"), F.col("o")).alias("channel"))


@query(f"{_GATED} select pos, channel, failed, len(failed) = 0 as pass from g")
def pair_gate(spark, d):
    return pairs.gate(pair_rows(spark, d))


@query(f"""{_GATED} select 'outcome' as kind, case when len(failed) = 0 then 'kept' else 'dropped' end as value, count(*) as n from g group by 2
    union all select 'channel', channel, count(*) from g group by 2 union all select 'reason', f, count(*) from (select unnest(failed) as f from g) group by 2""")
def pair_gate_report(spark, d):
    return pairs.gate_report(pairs.gate(pair_rows(spark, d)))


@query(f"""with a as materialized {AX_IN}, f as materialized {AX_OUT}, x as (select pos, list_filter([case when a.proper_per_1k - f.proper_per_1k > 8.0 then 'proper_delta' end,
    case when a.short - f.short > 0.12 then 'fragment_delta' end, case when a.you - f.you > 2 then 'you_delta' end, case when a.you_gt_i then 'author_you_gt_i' end], lambda x: x is not null) as failed
    from a join f using (pos)) select pos, failed, len(failed) = 0 as pass from x""")
def sterile_check(spark, d):
    return pairs.sterile(distinct_pairs(spark, d), "input", "output").select("pos", "failed", "pass")


@query(f"""with d as materialized (select pos, input, {S.strip_tells(S.body('input'))} as r from {ONE}), f as materialized {S.axes('d', 'pos', 'input')}, r as materialized {S.axes('d', 'pos', 'r')}, a as materialized {AX_OUT},
    x as (select pos, {S.trim_all(S.body('input'))} = {S.trim_all(S.body('d.r'))} as echo, abs(r.short-a.short) < abs(f.short-a.short) as fragment_moved, abs(r.proper_per_1k-a.proper_per_1k) < abs(f.proper_per_1k-a.proper_per_1k) as proper_moved,
    abs(r.med-a.med) < abs(f.med-a.med) as med_moved, r.short <= f.short and r.med >= f.med as still_release from d join f using (pos) join r using (pos) join a using (pos))
    select pos, echo, fragment_moved, proper_moved, still_release, not echo and not still_release and (fragment_moved or med_moved) as pass from x""")
def translator_score(spark, d):
    rows = distinct_pairs(spark, d).withColumn("rewrite", rewrite.strip_tells(F.col("input")))
    return pairs.translator(rows, "input", "output", "rewrite").select("pos", "echo", "fragment_moved", "proper_moved", "still_release", "pass")


@query("select pos, ['system','user','assistant'] as roles, md5(coalesce(output,'')) as target from pairs")
def chat_rows(spark, d):
    m = pairs.chat_rows(F.lit("Write in the author's voice."), T.body(F.col("input")), T.body(F.col("output")))
    return pair_rows(spark, d).withColumn("m", m).select("pos", F.col("m.role").alias("roles"), F.md5(F.element_at("m.content", 3)).alias("target"))


@query("select pos, least(4096, greatest(512, ceil(length(coalesce(input,''))/3.0)::int + 256)) as tokens from pairs")
def token_budget(spark, d):
    return pair_rows(spark, d).select("pos", pairs.token_budget(F.col("input")).alias("tokens"))


COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"select e.vec_id as vec_id, round({COS},6) as score from embeddings e, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) q order by {COS} desc, vec_id limit 10")
def embedding_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).head()["embedding"]
    return retrieve.top_k(e, q, 10, "vec_id", "embedding", retrieve.cosine).select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""select query, vec_id, rank from (select q.vec_id as query, e.vec_id as vec_id, row_number() over (partition by q.vec_id order by {COS} desc, e.vec_id) as rank
    from embeddings e, (select * from embeddings where vec_id % 100 = 0) q) where rank <= 5"""
)
def embedding_topk_per_query(spark, d):
    """Queries are the rows whose id is divisible by 100, against all rows."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding"))
    return retrieve.top_k_per_query(e, q, 5, "vec_id", "embedding").select("query", "vec_id", "rank")


@query()
def hash_embed_topk(spark, d):
    rows = table(spark, d, "pieces", spread=True).where("id is not null").select("id", retrieve.embedding(F.col("text")).alias("vector"))
    q = table(spark, d, "eval_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query"), retrieve.embedding(F.col("text")).alias("vector"))
    return retrieve.top_k_per_query(rows, q, 5).select("query", "id", "rank", F.round("score", 6).alias("score"))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """Two arms of each pair: the input as it is, and stripped of its tells, both measured against the output."""
    rows = distinct_pairs(spark, d).withColumn("b", rewrite.strip_tells(F.col("input")))
    x = F.explode(F.array(F.struct(T.axes(F.col("output")).alias("o"), T.axes(F.col("input")).alias("a"), T.axes(F.col("b")).alias("b"))))
    rows = rows.select("pos", F.col("input"), F.col("b").alias("bt"), x.alias("x"))
    one = lambda arm, t: rows.select(
        F.col("pos").alias("holdout_id"), F.lit(arm).alias("arm"), evaluate.axis_distance(F.col("x")[arm], F.col("x.o")).alias("distance"), (F.size(guards.scaffold_markers(F.col(t))) > 0).alias("disqualified")
    )
    return one("a", "input").unionByName(one("b", "bt"))


_STEP = "abs(o.short-{x}.short) + abs(o.med-{x}.med)/20.0::double + abs(o.proper_per_1k-{x}.proper_per_1k)/50.0::double + abs(o.you_per_1k-{x}.you_per_1k)/20.0::double + abs(o.i_per_1k-{x}.i_per_1k)/20.0::double"
_GAP = lambda x: f"round({_STEP.format(x=x)} + abs(o.you_gt_i::int-{x}.you_gt_i::int) + abs(ln(greatest({x}.words,1)/greatest(o.words,1)::double)), 4)"
_ARMS = (
    f"with s as materialized (select pos, input, {S.strip_tells(S.body('input'))} as bt from {ONE}), o as materialized {AX_OUT}, a as materialized {AX_IN}, b as materialized {S.axes('s', 'pos', 'bt')}, "
    f"arms as (select pos as holdout_id, 'a' as arm, {_GAP('a')} as distance, len({S.markers('input')}) > 0 as disqualified from s join o using (pos) join a using (pos) "
    f"union all select pos, 'b', {_GAP('b')}, len({S.markers('bt')}) > 0 from s join o using (pos) join b using (pos))"
)
_TALLY = (
    f"{_ARMS}, w as (select a.disqualified as ao, b.disqualified as bo, case when a.disqualified and b.disqualified then 'tie' when a.disqualified then 'right' when b.disqualified then 'left' "
    "when a.distance < b.distance - 0.05 then 'left' when b.distance < a.distance - 0.05 then 'right' else 'tie' end as winner from arms a join arms b on a.holdout_id = b.holdout_id and a.arm = 'a' and b.arm = 'b'), "
    "t as (select count(*) as items, count(*) filter (winner='left') as wins, count(*) filter (winner='right') as losses, count(*) filter (winner='tie') as ties, count(*) filter (ao) as a_out, count(*) filter (bo) as b_out, "
    "count(*) filter (ao and bo) as both_out from w)"
)
# ln of the binomial tail by its terms
_P = "(select round(coalesce(sum(exp(lgamma(n+1) - lgamma(k+1) - lgamma(n-k+1) - n*ln(2))),1.0),4) from (select wins+losses as n, unnest(generate_series(wins, wins+losses)) as k from t where wins+losses > 0))"


@query(f"{_ARMS} select holdout_id, arm, round(distance, 6) as distance from arms")
def axis_distance(spark, d):
    return arms(spark, d).select("holdout_id", "arm", F.round("distance", 6).alias("distance"))


@query(f"{_TALLY} select * from t")
def arm_tally(spark, d):
    return evaluate.tally(arms(spark, d))


@query(f"""{_TALLY}, p as (select *, {_P} as p_value from t), r as (select *, list_filter([case when wins <= losses then 'no_majority' end, case when p_value > 0.05 then 'not_beyond_chance' end,
    case when a_out > b_out then 'disqualified_more_often' end, case when items > 0 and both_out = items then 'all_disqualified' end], lambda x: x is not null) as reasons from p)
    select *, case when len(reasons) = 0 then 'keep' else 'archive' end as verdict from r""")
def ship_verdict(spark, d):
    return evaluate.verdict(evaluate.tally(arms(spark, d)))


_FACT = "(select n, w, list_sum(list_transform(generate_series(w, n), lambda k: factorial(n)::double/(factorial(k::int)::double*factorial((n-k)::int)::double))) / pow(2,n) as p from g where n > 0)"


@query(
    f"""with g as (select (n)::int as n, (w)::int as w from range(0,21) a(n), range(0,21) b(w) where w <= n)
    select w as wins, n-w as losses, round(p,4) as p_value from {_FACT} union all select 0, 0, 1.0"""
)
def sign_test(spark, d):
    """All counts of up to twenty decisive items."""
    g = spark.range(0, 21).select(F.col("id").cast("int").alias("n")).withColumn("wins", F.explode(F.sequence(F.lit(0), F.col("n"))))
    w, x = F.col("wins"), F.col("n") - F.col("wins")
    return g.select(w, x.alias("losses"), evaluate.sign_test(w, x).alias("p_value"))


@query("select n::int as pool, least(n, least(24, greatest(12, round_even(n*0.25,0))))::int as carve, greatest(0, least(least(5, greatest(4, round_even(n*0.3,0))), least(n, n-5)))::int as articles from range(0,401) r(n)")
def carve_size(spark, d):
    n = F.col("id").cast("int")
    return spark.range(0, 401).select(n.alias("pool"), evaluate.carve_size(n).alias("carve"), evaluate.article_carve_size(n, n).alias("articles"))


@query()
def carve_ids(spark, d):
    posts = table(spark, d, "pieces", spread=True).where("source = 'linkedin_post' and id is not null")
    return evaluate.carve(posts, 24)


_PARTS = S.paragraphs("text")
_KEPT = f"list_reduce({_PARTS}, lambda acc, p: case when len({S.guard_words('p')}) = 0 or len(list_filter(acc, lambda k: len(list_intersect(list_distinct({S.guard_words('k')}), list_distinct({S.guard_words('p')})))::double / len(list_distinct({S.guard_words('k')} || {S.guard_words('p')})) >= 0.8)) > 0 then acc else acc || [p] end, []::varchar[])"
_SUM = "list_sum(n[1:i])"


@query(
    f"""with k as (select id, {_KEPT} as kept from pieces), c as (select id, kept, list_transform(kept, lambda p: len({S.guard_words('p')})) as n from k),
    f as (select id, kept, list_min(list_filter(generate_series(2, greatest(len(kept), 1)), lambda i: {_SUM} > 120)) as stop from c)
    select id, md5(array_to_string(kept[1:coalesce(stop - 1, len(kept))], chr(10)||chr(10))) as trimmed from f"""
)
def trim_to_word_target(spark, d):
    trim = rewrite.by_text(lambda t: rewrite.trim_words(rewrite.drop_repeats(t), 120), "string")
    return table(spark, d, "pieces", spread=True).select("id", F.md5(trim(F.col("text"))).alias("trimmed"))


@query(f"select id, md5({S.strip_tells(S.body('text'))}) as stripped from pieces")
def strip_tells_full(spark, d):
    return table(spark, d, "pieces", spread=True).select("id", F.md5(rewrite.strip_tells(F.col("text"))).alias("stripped"))


@query()
def devoice_notes(spark, d):
    return table(spark, d, "pieces", spread=True).select("id", rewrite.by_text(rewrite.devoiced, "array<string>")(T.body(F.col("text"))).alias("notes")).select("id", F.size("notes").alias("clauses"), F.md5(F.array_join("notes", "\n")).alias("notes"))


@query()
def devoice_report(spark, d):
    """Per piece: share of its notes that is copied, and what the notes claim that the piece doesn't grant."""
    notes = rewrite.by_text(lambda t: "\n".join(rewrite.devoiced(t or "")), "string")
    rows = table(spark, d, "pieces", spread=True).select("id", "text", notes(F.col("text")).alias("notes"))
    copied = T.covered_ratio(T.guard_words(F.col("notes")), T.grams(T.guard_words(F.col("text")), 5), 5)
    return rows.select("id", copied.alias("copied"), guards.invented(F.col("text"), F.col("notes"))["passed"].alias("granted")).withColumn("pass", (F.col("copied") <= 0.35) & F.col("granted"))


@query()
def post_briefs(spark, d):
    rows = table(spark, d, "pieces", spread=True).where("source = 'linkedin_post'")
    return rows.select("id", rewrite.post_brief(F.col("text")).alias("b")).select("id", "b.ok", "b.reason", F.size("b.points").alias("points"), "b.overlap")


@query()
def article_briefs(spark, d):
    rows = table(spark, d, "pieces", spread=True).where("source = 'linkedin_article'")
    return rows.select("id", rewrite.article_brief(F.col("text")).alias("b")).select("id", "b.ok", "b.reason", F.size("b.points").alias("points"), "b.overlap")


@query()
def paragraph_windows(spark, d):
    w = rewrite.by_text(lambda t: rewrite.windows(t or ""), "array<string>")
    return table(spark, d, "pieces", spread=True).select("id", F.posexplode(w(F.col("text"))).alias("pos", "win")).select("id", "pos", F.length("win").alias("chars"))


@query()
def source_sections(spark, d):
    w = rewrite.by_text(lambda t: rewrite.source_sections(t or ""), "array<string>")
    return table(spark, d, "documents").select("doc_id", F.posexplode(w(F.col("text"))).alias("pos", "section")).select("doc_id", "pos", F.length("section").alias("chars"))


@query()
def sft_examples(spark, d):
    e = training.example_rows(table(spark, d, "pieces", spread=True))
    return e.select("id", "pos", "kind", F.md5("draft").alias("draft"), F.md5("target").alias("target"))


@query()
def write_receipts(spark, d):
    """The write path with a stub in place of a model: it hands back the style sample."""
    rows = distinct_pairs(spark, d).where("input is not null and output is not null").select(F.col("pos").alias("holdout_id"), F.col("input").alias("brief"), F.col("output").alias("exemplar"))
    out = evaluate.write_posts(rows.select("holdout_id", "brief"), rows.select("holdout_id", "exemplar"), lambda: lambda p: p.split("Style sample:\n", 1)[1].split("\n\nLeave out:")[0])
    return evaluate.safe_receipt(out)
