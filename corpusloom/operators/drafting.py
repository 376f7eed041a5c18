"""Long drafts from briefs: exemplars, outlines, budgets, sections with repair, and the stitched article.

Text generation is an injected callable. Each attempt is a stage over all sections that need it, so guards run natively
between attempts. Null texts count as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, guards, retrieve, rewrite
from corpusloom.operators.evaluate import Generate, generated  # noqa: F401
from corpusloom.runtime import settled, written

#: Floors, budgets and factors.
MIN_ARTICLES, MIN_SECTIONS, MAX_SECTIONS = 5, 2, 8
EXEMPLAR_WORDS, HEADROOM, THIN_BRIEF, THIN_FLOOR, THIN_FACTOR = 60, 1.35, 80, 80, 2.5
BULLET = r"^\s*[-*•]\s+"
CHROME = re.compile(r"(?i)^(?:created on|published on|edited on)\b|^\d{4}-\d{2}-\d{2}$")


def article_floors(pieces: DataFrame, index: DataFrame | None = None, least: int = MIN_ARTICLES) -> DataFrame:
    """One row: articles in the corpus and in the index (null without one), and whether either is too few."""
    n = F.count_if(F.col("source") == "linkedin_article")
    out = pieces.agg(n.alias("corpus"))
    out = out.crossJoin(index.agg(n.alias("indexed"))) if index is not None else out.withColumn("indexed", F.lit(None).cast("bigint"))  # one row each
    return out.withColumn("blocked", (F.col("corpus") < least) | F.coalesce(F.col("indexed") < least, F.lit(False)))


def without_chrome(text: str | None) -> str:
    """An article without dates and marks of its export, its title once."""
    out: list[str] = []
    title = None
    for line in map(str.strip, rewrite.normalize_text(text).split("\n")):
        if not line:
            if out and out[-1]:
                out.append("")
        elif CHROME.search(line) or line.casefold() == title:
            continue
        else:
            title = title or line.casefold()
            out.append(line)
    return "\n".join(out).strip()


def article_exemplar(c: Column, words: int = EXEMPLAR_WORDS) -> Column:
    return corpus.clip_words(rewrite.by_text(without_chrome, "string")(c), words)


def sentence_case(c: Column) -> Column:
    """Words that open sentences or lines in lower case, unless they are also capitalized within one."""

    def lowered(t: Column) -> Column:
        names = F.regexp_extract_all(t, F.lit(r"(?<=[a-z0-9,'’\-]\s)([A-Z][a-z][a-zA-Z'’-]*)"), F.lit(1))
        parts = F.split(t, r"(?:(?<=\A)|(?<=[.!?:;]\s)|(?<=\n))(?=[A-Z][a-z])")
        first = lambda s: F.regexp_extract(s, r"^[A-Z][a-z][a-zA-Z'’-]*", 0)
        low = lambda s: F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
        opens = F.transform(parts, lambda s: F.when((first(s) == "") | F.array_contains(names, first(s)), s).otherwise(low(s)))
        return F.array_join(opens, "")

    return T.let(T.body(c), lowered)


def outline(topic: Column, points: Column) -> Column:
    """(ok, sections): a section for each bullet, the topic before them if there are too few; at most MAX_SECTIONS, not ok under MIN_SECTIONS."""
    top = T.trim_all(T.body(topic))
    bullets = F.filter(F.transform(F.split(T.body(points), T.LINE_END), lambda s: T.trim_all(F.regexp_replace(s, BULLET, ""))), lambda s: s != "")
    first = F.when((top != "") & (F.size(bullets) < MIN_SECTIONS), F.array(top)).otherwise(F.array().cast("array<string>"))
    return T.let(F.slice(F.array_distinct(F.concat(first, bullets)), 1, MAX_SECTIONS), lambda s: F.struct((F.size(s) >= MIN_SECTIONS).alias("ok"), s.alias("sections")))


def section_words(base: Column, brief_words: Column, sections: Column) -> Column:
    """The aim for a section, lowered if the brief is too thin for it."""
    n = F.greatest(sections, F.lit(1))
    total = F.greatest(THIN_FLOOR * n, F.bround(brief_words * F.lit(THIN_FACTOR) * n).cast("int"))
    thin = F.greatest(F.lit(THIN_FLOOR), F.floor(total / n).cast("int"))
    return F.when(brief_words >= THIN_BRIEF, F.greatest(base, F.lit(1))).otherwise(F.least(F.greatest(base, F.lit(1)), thin)).cast("int")


def trimmed_words(words: Column) -> Column:
    return F.bround(words * F.lit(HEADROOM)).cast("int")


def word_budget(topic: Column, points: Column, base: Column) -> Column:
    """What both arms of an article are held to: sections, words of each, where they are trimmed, ceiling, granted facts."""
    brief = F.concat(F.lit("Topic: "), T.body(topic), F.lit("\nPoints: "), T.body(points))
    n = F.size(outline(topic, points)["sections"])
    words = section_words(base, F.size(T.guard_words(brief)), n)
    return F.struct(
        n.alias("sections"), words.alias("section_words"), trimmed_words(words).alias("trim_words"), (words * n).alias("word_aim"), (trimmed_words(words) * n).alias("ceiling"),
        guards.allowed_facts(brief).alias("allowed"),
    )


def scrubbed(df: DataFrame, brief: str, draft: str, passes: int = 3) -> DataFrame:
    """df whose draft has lost the sentences that hold names or figures the brief doesn't grant; lines stay lines, empty if nothing is left."""
    b, d = F.col(brief), F.col(draft)
    parts = lambda line: F.filter(F.split(F.regexp_replace(line, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: T.trim_all(s) != "")
    df = settled(df, draft, T.body(d))
    for _ in range(passes):
        rows = settled(df, "__lines", F.transform(F.split(d, T.LINE_END), parts))
        # each sentence once, then whether the brief grants it
        rows = settled(rows, "__ok", F.transform("__lines", lambda ss: F.transform(ss, lambda s: guards.invented(b, sentence_case(s))["passed"])))
        kept = F.zip_with("__lines", "__ok", lambda ss, ok: T.trim_all(F.array_join(F.filter(F.zip_with(ss, ok, lambda s, k: F.when(k, s)), lambda s: s.isNotNull()), " ")))
        whole = guards.invented(b, sentence_case(d))["passed"]
        df = settled(rows, draft, F.when(whole, d).otherwise(F.array_join(kept, "\n"))).drop("__lines", "__ok")
    return settled(df, draft, rewrite.tidy(d))


def flags(brief: Column, draft: Column, exemplar: Column) -> Column:
    x = guards.invented(brief, sentence_case(draft))
    return F.struct(guards.parrot_reject(draft, exemplar).alias("parrot"), (~x["passed"]).alias("invented"), x["names"].alias("names"), x["figures"].alias("figures"))


def retrieved(briefs: DataFrame, index: DataFrame, k: int = 5, words: int = EXEMPLAR_WORDS) -> DataFrame:
    """(holdout_id, brief, exemplar): the k texts of index(id, text, vector) most like each brief, clipped, joined by blank lines in rank order."""
    asked = briefs.select(F.col("holdout_id").alias("query"), retrieve.embedding(F.col("brief")).alias("vector"))
    near = retrieve.top_k_per_query(index, asked, min(max(k, 0), 5)).join(index.select("id", corpus.clip_words(F.col("text"), words).alias("clip")), "id")
    near = near.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "clip"))), lambda x: x["clip"]).alias("clips"))  # k clips
    out = briefs.join(near, F.col("holdout_id") == F.col("query"), "left")
    return out.select("holdout_id", "brief", F.coalesce(F.array_join("clips", "\n\n"), F.lit("")).alias("exemplar"))


def write_article(briefs: DataFrame, make, base_words: int, exemplars: DataFrame | None = None) -> DataFrame:
    """(holdout_id, sections, clean, repaired, scrubbed, dropped, words, parrot, invented, article) for briefs(holdout_id, topic, points).

    Each section is drafted from its own point; one that parrots or invents is drafted again, shorter and with the
    offenders named; one that still invents loses the sentences that do; what is left empty is dropped. Invention is
    judged against the whole visible brief. An article without a section counts as invented. Briefs without an outline
    have no row.
    """
    brief = F.concat(F.lit("Topic: "), T.body(F.col("topic")), F.lit("\nPoints: "), T.body(F.col("points")))
    rows = briefs.select("holdout_id", "topic", brief.alias("brief"), outline(F.col("topic"), F.col("points")).alias("o")).where("o.ok")
    rows = rows.join(exemplars.select("holdout_id", "exemplar"), "holdout_id", "left") if exemplars is not None else rows.withColumn("exemplar", F.lit(""))
    n = F.size("o.sections")
    words = section_words(F.lit(base_words), F.size(T.guard_words(F.col("brief"))), n)
    rows = rows.select("holdout_id", "topic", "brief", F.coalesce("exemplar", F.lit("")).alias("exemplar"), words.alias("aim"), F.posexplode("o.sections").alias("pos", "section"))
    trim = lambda c, most: F.pandas_udf(lambda t, n: t.combine(n, lambda x, m: rewrite.trim_words(rewrite.drop_repeats(x), int(m)).strip()), "string")(c, most)
    ask = F.concat(F.lit("Topic: "), T.body(F.col("topic")), F.lit("\nWrite this section only: "), F.col("section"), F.lit("\nWords: "), F.col("aim"))

    def attempt(df: DataFrame, prompt: Column, most: Column, n: int) -> DataFrame:
        d = generated(df.withColumn("prompt", prompt), "prompt", "raw", make).withColumn("draft", trim(F.col("raw"), most)).drop("raw", "prompt")
        return written(d.withColumn("f", F.explode(F.array(flags(F.col("brief"), F.col("draft"), F.col("exemplar"))))), f"sections-{n}")

    good = ~F.col("f.parrot") & ~F.col("f.invented") & (F.col("draft") != "")
    one = attempt(rows, ask, trimmed_words(F.col("aim")), 1)
    half = F.greatest(F.lit(THIN_FLOOR), F.floor(F.col("aim") / 2)).cast("int")
    remove = F.concat(F.lit("\nLeave out: "), F.array_join(F.concat(F.col("f.names"), F.col("f.figures")), ", "), F.lit("\nAt most words: "), half)
    two = attempt(one.where(~good).withColumn("again", F.concat(ask, remove)).drop("draft").select("*").withColumn("old", F.col("f")).drop("f"), F.col("again"), half, 2)
    cut = scrubbed(two.where(~good & F.col("f.invented")).drop("f"), "brief", "draft")
    cut = written(cut.withColumn("f", F.explode(F.array(flags(F.col("brief"), F.col("draft"), F.col("exemplar"))))), "sections-3")
    cols = ("holdout_id", "pos", "brief", "exemplar", "draft", "status")
    parts = one.where(good).withColumn("status", F.lit("clean")).select(*cols)
    parts = parts.unionByName(two.where(good).withColumn("status", F.lit("repaired")).select(*cols)).unionByName(cut.where(good).withColumn("status", F.lit("scrubbed")).select(*cols))
    lost = rows.select("holdout_id", "pos", "brief", "exemplar").join(parts.select("holdout_id", "pos"), ["holdout_id", "pos"], "left_anti")
    parts = parts.unionByName(lost.withColumn("draft", F.lit("")).withColumn("status", F.lit("dropped")).select(*cols))
    by = parts.groupBy("holdout_id").agg(
        F.first("brief").alias("brief"), F.first("exemplar").alias("exemplar"), F.count(F.lit(1)).alias("sections"), *[F.count_if(F.col("status") == s).alias(s) for s in ("clean", "repaired", "scrubbed", "dropped")],
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "draft"))), lambda x: x["draft"]).alias("texts"),  # at most MAX_SECTIONS
    )
    stitch = F.pandas_udf(lambda s: s.map(lambda x: "\n\n".join(rewrite.drop_restated([y for y in x if y]))), "string")
    by = by.withColumn("article", stitch("texts")).withColumn("f", F.explode(F.array(flags(F.col("brief"), F.col("article"), F.col("exemplar")))))
    return by.select(
        "holdout_id", "sections", "clean", "repaired", "scrubbed", "dropped", F.size(T.words(F.col("article"))).alias("words"), F.col("f.parrot").alias("parrot"),
        (F.col("f.invented") | (F.col("article") == "")).alias("invented"), "article",
    )
