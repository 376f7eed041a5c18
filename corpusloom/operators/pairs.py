"""Training pairs: channel, gate, flattener check, translator score, chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

MAX_PROPER, FRAGMENT_GAP, SENTENCE_GAP = 30.0, 0.08, 2.0
ARTICLE_WORDS, ARTICLE_SHORT, ARTICLE_SENTENCE = 500, 0.10, 12.0
ARTICLE_NAMES, POST_NAMES = ("article", "articles", "longform", "long"), ("linkedin", "post", "posts", "li", "short")
LOCATORS = ("id", "source_id", "path", "source_path", "file", "filename")


def channel(meta: Column, out: Column) -> Column:
    """post or article: explicit metadata, section role, locators, then the output's length and shape (out: axes)."""
    get = lambda k: F.lower(F.trim(F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit(""))))
    named = F.lit(None).cast("string")
    for k in ("channel", "source_type"):  # the latter wins
        named = F.when(get(k).isin(*ARTICLE_NAMES), "article").when(get(k).isin(*POST_NAMES), "post").otherwise(named)
    place = F.concat_ws(" ", *map(get, LOCATORS))
    return (
        F.when(named.isNotNull(), named).when(get("section_role").isin("opener", "middle", "closer"), "article")
        .when(place.rlike(r"(?:^|[/_.-])articles?(?:$|[/_.-])"), "article").when(place.rlike(r"(?:^|[/_.-])(?:linkedin|posts?|li)(?:$|[/_.-])"), "post")
        .when((out["words"] >= ARTICLE_WORDS) | ((out["short_line_ratio"] <= ARTICLE_SHORT) & (out["median_sentence_words"] >= ARTICLE_SENTENCE)), "article")
        .otherwise("post")
    )


def with_axes(df: DataFrame) -> DataFrame:
    """Add struct columns i and o; settled by a generator, so that later uses don't measure again."""
    return df.select("*", F.explode(F.array(F.struct(T.axes(F.col("input")).alias("i"), T.axes(F.col("output")).alias("o")))).alias("__x")).select(
        *df.columns, F.col("__x.i").alias("i"), F.col("__x.o").alias("o")
    )


def gate(df: DataFrame) -> DataFrame:
    """For pairs(pos, input, output, meta): (pos, channel, failed, pass), failed in the order of the checks."""
    i, o = F.col("i"), F.col("o")
    ch = channel(F.col("meta"), o)
    blank = lambda c: T.trim_all(T.body(F.col(c))) == ""
    checks = (
        ("empty_input", blank("input")), ("empty_output", blank("output")), ("max_input_proper_1k", i["proper_per_1k"] > MAX_PROPER),
        ("min_frag_gap_ratio", (F.col("channel") == "post") & (o["short_line_ratio"] - i["short_line_ratio"] < FRAGMENT_GAP)), ("input_you_gt_i", i["you_gt_i"]),
        ("min_median_sentence_gap", i["median_sentence_words"] - o["median_sentence_words"] < SENTENCE_GAP),
    )
    failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks]))
    out = with_axes(df).withColumn("channel", ch).withColumn("failed", failed)
    return out.select("pos", "channel", "failed", (F.size("failed") == 0).alias("pass"))


def gate_report(gated: DataFrame) -> DataFrame:
    """(kind, value, n): totals, channels and reasons."""
    row = lambda df, kind, v: df.groupBy(F.lit(kind).alias("kind"), v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col("pass"), "kept").otherwise("dropped")
    reasons = gated.select(F.explode("failed").alias("f"))
    return row(gated, "outcome", kept).unionByName(row(gated, "channel", F.col("channel"))).unionByName(row(reasons, "reason", F.col("f")))


def pair_texts(line: Column) -> tuple[Column, Column]:
    """Input and output of a JSON line under any of the four spellings."""
    get = lambda *ks: F.coalesce(*[F.get_json_object(line, "$." + k) for k in ks])
    return get("input", "not_you", "source", "prompt"), get("output", "author", "target", "completion")


def sterile(df: DataFrame, author: str, foreign: str) -> DataFrame:
    """Whether a flattened author text can be told from a flattened foreign one; failed checks as codes."""
    a, f = F.col("__x.a"), F.col("__x.f")
    rows = df.select("*", F.explode(F.array(F.struct(T.axes(F.col(author)).alias("a"), T.axes(F.col(foreign)).alias("f")))).alias("__x"))
    gap = lambda k: a[k] - f[k]
    checks = (
        ("proper_delta", gap("proper_per_1k") > 8.0), ("fragment_delta", gap("short_line_ratio") > 0.12), ("you_delta", gap("you_count") > 2), ("author_you_gt_i", a["you_gt_i"]),
    )
    failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks]))
    return rows.select(*df.columns, failed.alias("failed")).withColumn("pass", F.size("failed") == 0)


def translator(df: DataFrame, foreign: str, author: str, rewrite: str) -> DataFrame:
    """Whether a rewrite moved from a foreign text toward the author's band."""
    x = lambda k: F.col("__x")[k]
    rows = df.select("*", F.explode(F.array(F.struct(*[T.axes(F.col(c)).alias(k) for k, c in (("f", foreign), ("a", author), ("r", rewrite))]))).alias("__x"))
    echo = T.trim_all(T.body(F.col(foreign))) == T.trim_all(T.body(F.col(rewrite)))
    moved = lambda k: F.abs(x("r")[k] - x("a")[k]) < F.abs(x("f")[k] - x("a")[k])
    release = (x("r")["short_line_ratio"] <= x("f")["short_line_ratio"]) & (x("r")["median_sentence_words"] >= x("f")["median_sentence_words"])
    ok = ~echo & ~release & (moved("short_line_ratio") | moved("median_sentence_words"))
    return rows.select(*df.columns, echo.alias("echo"), moved("short_line_ratio").alias("fragment_moved"), moved("proper_per_1k").alias("proper_moved"), release.alias("still_release"), ok.alias("pass"))


def chat_rows(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def longform(draft: Column, rewrite: Column) -> Column:
    d, r = T.word_set(draft), T.word_set(rewrite)
    ratio = T.word_count(rewrite) / F.greatest(T.word_count(draft), F.lit(1))
    lexical = F.size(F.array_intersect(d, r)) / F.greatest(F.size(d), F.lit(1))
    near = ratio.between(0.92, 1.08) & (lexical >= 0.92)
    return F.struct(
        F.round(ratio, 4).alias("length_ratio"), F.round(lexical, 4).alias("lexical_overlap"), near.alias("near_copy"),
        T.scaffolding_count(draft).alias("scaffolding_before"), T.scaffolding_count(rewrite).alias("scaffolding_after"), (~near & (ratio >= 0.4)).alias("pass"),
    )


def token_budget(c: Column) -> Column:
    return F.least(F.lit(4096), F.greatest(F.lit(512), F.ceil(F.length(T.body(c)) / 3) + 256)).cast("int")
