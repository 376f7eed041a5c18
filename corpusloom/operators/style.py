"""Corpus style: rates pooled over all words, medians of per-piece numbers, and nearest-rank percentiles.

Percentiles come from counts per value, so their cost follows the number of different values, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.rewrite import normalized

POST_WORDS, ARTICLE_WORDS, CADENCE_SAMPLES = 80, 150, 3
POST_CEILING, DEFAULT_POST, POST_FLOOR = 550, 500, 300
ARTICLE_AIM, ARTICLE_FLOOR, ARTICLE_CEILING = 1100, 600, 3000
SECTION_FLOOR, SECTION_CEILING, SECTION_TYPICAL, SECTION_HINTS = 180, 600, 300, (2, 8)


def filled(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(T.trim_all(T.body(F.col(text))) != "")


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row; zeros if no text has content."""
    a = filled(df, text).select(T.style_axes(F.col(text)).alias("a")).select("a.*")
    words, you, i = (F.coalesce(F.sum(x), F.lit(0)) for x in ("words", "you_count", "i_count"))
    med = lambda x, d: F.round(F.coalesce(F.percentile(x, F.lit(0.5)), F.lit(0.0)), d).alias(x)
    return a.agg(
        F.count(F.lit(1)).alias("pieces"), words.alias("words"), med("median_sentence_words", 2), med("short_line_ratio", 4), med("contraction_rate", 4),
        you.alias("you_count"), i.alias("i_count"), F.round(T.per_thousand(you, words), 2).alias("you_per_1k"),
        F.round(T.per_thousand(i, words), 2).alias("i_per_1k"), (you > i).alias("you_gt_i"),
    )


def nearest_ranks(values: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """One row of nearest-rank percentiles of a column, 0 if it is empty."""
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.orderBy(value)  # one row per different value
    ranked = counts.select(value, F.sum("__n").over(up).alias("upto"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("all"))
    pick = lambda f: F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("all") - 1)), F.col(value).cast("double")))
    return ranked.agg(*[F.coalesce(pick(f), F.lit(0.0)).alias(k) for k, f in fractions.items()])


def sentence_spread(df: DataFrame, text: str = "text") -> DataFrame:
    n = filled(df, text).select(F.explode(T.sentence_words(F.col(text))).alias("n"))
    return nearest_ranks(n, "n", {"sentence_words_p25": 0.25, "sentence_words_p75": 0.75})


def multi_sentence_share(df: DataFrame, text: str = "text") -> DataFrame:
    """Share of blocks between line breaks that hold more than one sentence."""
    p = df.select(F.explode(F.split(T.body(F.col(text)), "\n+")).alias("p")).where(T.trim_all(F.col("p")) != "")
    share = F.avg((F.size(T.sentence_words(F.col("p"))) > 1).cast("double"))
    return p.agg(F.round(F.coalesce(share, F.lit(0.0)), 4).alias("multi_sentence_paragraph_ratio"))


def length_stats(df: DataFrame, kind: str) -> DataFrame:
    """Word lengths of posts (all texts if no post qualifies) or of articles (zeros if none)."""
    n = F.size(T.words(F.col("text")))
    rows = df.select("source", n.alias("n"), (T.trim_all(T.body(F.col("text"))) != "").alias("filled"))
    if kind == "post":
        fit = (F.col("source") == "linkedin_post") & (F.col("n") >= POST_WORDS)
        rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).where("fit or filled").groupBy("fit", "n").agg(F.count(F.lit(1)).alias("k"))
        rows = rows.withColumn("any", F.max("fit").over(Window.partitionBy(F.lit(1)))).where("fit = any")  # one row per length
    else:
        rows = rows.where((F.col("source") == "linkedin_article") & (F.col("n") >= ARTICLE_WORDS)).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    up = Window.orderBy("n")
    ranked = rows.select("n", "k", F.sum("k").over(up).alias("upto"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("all"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("n")))
    rank = lambda f: F.coalesce(at(F.bround(F.lit(f) * (F.col("all") - 1))).cast("double"), F.lit(0.0))
    median = F.coalesce((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2, F.lit(0.0))
    return ranked.agg(
        F.round(median, 1).alias(f"median_{kind}_words"), rank(0.75).alias(f"{kind}_words_p75"), rank(0.9).alias(f"{kind}_words_p90"),
        F.coalesce(F.max("all"), F.lit(0)).alias(f"{kind}_length_samples"),
    )


def style_card(df: DataFrame) -> DataFrame:
    """All numbers of a corpus in one row: a join of one-row tables."""
    one = lambda d: d.withColumn("__k", F.lit(1))
    out = one(corpus_stats(df))
    for part in (length_stats(df, "post"), length_stats(df, "article"), sentence_spread(df), multi_sentence_share(df)):
        out = out.join(one(part), "__k")
    return out.drop("__k")


def article_cadence(df: DataFrame) -> DataFrame:
    """One row on the cleaned texts of articles: cadence numbers, null under CADENCE_SAMPLES texts."""
    rows = filled(normalized(df.where("source = 'linkedin_article'").select("text"), "text", "clean").select(F.col("clean").alias("text")))
    parts = corpus_stats(rows).crossJoin(sentence_spread(rows)).crossJoin(multi_sentence_share(rows))  # one row each
    enough = F.col("pieces") >= CADENCE_SAMPLES
    names = ("sentence_words_p25", "sentence_words_p75", "median_sentence_words", "short_line_ratio", "multi_sentence_paragraph_ratio", "you_count", "i_count", "you_gt_i", "contraction_rate")
    return parts.select(F.col("pieces").alias("article_cadence_samples"), *[F.when(enough, F.col(n)).alias("article_" + n) for n in names])


def style_profile(df: DataFrame) -> DataFrame:
    """The style card with the cadence of articles, in one row."""
    return style_card(df).crossJoin(article_cadence(df))  # one row each


#: Phrases that directives forbid.
BANNED = ("leverage", "synergy", "delve", "robust", "moreover", "furthermore", "unlock", "testament", "in today's world", "it is important to note")


def directives(profile: DataFrame, channel: str = "post", banned: tuple[str, ...] = BANNED) -> DataFrame:
    """(pos, directive): a profile's numbers as lines of a prompt; what a profile doesn't have stays unsaid.

    Articles use their own cadence if there are enough of them, and say nothing about total length.
    """
    article = F.lit(channel.strip().lower() == "article") & (F.coalesce("article_cadence_samples", F.lit(0)) >= CADENCE_SAMPLES)
    v = lambda k: F.when(article, F.col("article_" + k)).otherwise(F.col(k))
    low, high, med, short, multi = (F.coalesce(v(k).cast("double"), F.lit(0.0)) for k in ("sentence_words_p25", "sentence_words_p75", "median_sentence_words", "short_line_ratio", "multi_sentence_paragraph_ratio"))
    you, i, lead, con = F.coalesce(v("you_count"), F.lit(0)), F.coalesce(v("i_count"), F.lit(0)), F.coalesce(v("you_gt_i"), F.lit(False)), F.coalesce(v("contraction_rate"), F.lit(0.0))
    whole = lambda c: F.bround(c).cast("int").cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    prose = article & (multi >= 0.15)
    post = F.lit(channel.strip().lower() != "article") & (F.col("median_post_words") > 0)
    target = length_policy(profile).select("post_target")
    rows = profile.crossJoin(target)  # one row each
    lines = F.array(
        F.when((low > 0) & (high > low), say("Vary sentence length: most have ", whole(low), " to ", whole(high), " words.")).when(med > 0, say("Sentences have about ", whole(med), " words; vary them.")),
        F.when(prose, say("Write prose: ", whole(multi * 100), "% of paragraphs hold several sentences.")).when(short > 0, say("Use short lines: ", whole(short * 100), "% have eight words or fewer.")),
        F.when(prose & (short >= 0.55), say("Short lines are for emphasis only, though ", whole(short * 100), "% have eight words or fewer.")).when(~prose & (multi > 0), say("Not only single lines: ", whole(multi * 100), "% of paragraphs hold several sentences.")),
        F.when(post, say("Aim at ", whole(F.col("median_post_words")), " words and stop by ", F.col("post_target").cast("string"), ".")),
        F.when(article & (you > 0) & (i > 0), "Say I for experience and you for instructions.").when((you + i > 0) & lead, "Say you more often than I.").when(you + i > 0, "Say I more often than you."),
        F.when(con > 0.01, "Use contractions."), F.lit("Never use: " + ", ".join(banned[:12]) + ".") if banned else F.lit(None),
    )
    return rows.select(F.posexplode(F.array_compact(lines)).alias("pos", "directive"))


def audit_quantiles(values: DataFrame, value: str) -> DataFrame:
    """Another definition, for audits: the upper median, the value at int(0.9 n), the greatest; null if empty."""
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = counts.select(value, F.sum("__n").over(Window.orderBy(value)).alias("upto"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("all"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    all_ = F.col("all")
    return ranked.agg(
        at(F.floor(all_ / 2)).alias("median"), at(F.least(all_ - 1, F.floor(all_ * 9 / 10))).alias("p90"), F.max(value).alias("max"),
    )


def length_policy(card: DataFrame) -> DataFrame:
    """Aims and ceilings in words derived from a style card."""
    v = lambda x: F.when(F.col(x) > 0, F.col(x))
    clamp = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x)).cast("int")
    aim = F.coalesce(clamp(F.bround(F.coalesce(v("median_article_words"), v("article_words_p75"), v("article_words_p90"))), ARTICLE_FLOOR, ARTICLE_CEILING), F.lit(ARTICLE_AIM))
    long = F.coalesce(v("article_words_p90"), v("article_words_p75"), v("median_article_words"))
    target = F.when(long.isNull(), F.greatest(aim, F.lit(ARTICLE_AIM))).otherwise(F.least(F.lit(ARTICLE_CEILING), F.greatest(aim, F.bround(long).cast("int"))))
    hint = clamp(F.bround(aim / SECTION_TYPICAL), *SECTION_HINTS)
    section = clamp(F.bround(aim / hint), SECTION_FLOOR, SECTION_CEILING)
    post = lambda *ks: F.coalesce(clamp(F.bround(F.coalesce(*map(v, ks))), POST_FLOOR, POST_CEILING), F.lit(DEFAULT_POST))
    return card.select(
        aim.alias("article_aim"), target.alias("article_target"), hint.alias("section_hint"), section.alias("section_words"),
        post("post_words_p90", "post_words_p75", "median_post_words").alias("post_target"),
        F.least(post("post_words_p90", "post_words_p75", "median_post_words"), post("post_words_p75", "post_words_p90", "median_post_words")).alias("post_aim"),
    )


def scorecard(text: Column, channel: Column, proper_floor: float | None = None) -> Column:
    """Names per thousand words against the channel's floor or a given one; short texts without a channel count as posts."""
    t = T.trim_all(T.body(text))
    n, names = F.size(T.words(t)), F.size(T.name_spans(t))
    ch = F.lower(F.coalesce(channel, F.lit("")))
    floor = (
        F.when(ch.isin("linkedin", "post", "posts", "li", "short"), 20.0).when(ch.isin("article", "articles", "longform", "long"), 42.0)
        .when(n < 500, 20.0).otherwise(42.0)
    )
    floor = floor if proper_floor is None else F.lit(float(proper_floor))
    rate = F.round(T.per_thousand(names, n), 2)
    return F.struct(n.alias("words"), names.alias("proper_nouns"), rate.alias("proper_per_1k"), floor.alias("floor"), (rate >= floor).alias("pass"))
