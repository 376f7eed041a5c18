"""Guards on drafts: copied runs of words, echoes of the brief, scaffold markers, and names or figures nobody granted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

PARROT, COVERAGE, COVERAGE_LIMIT, COVERAGE_TOKENS = 8, 5, 0.3, 40
ECHO_LIMIT, ECHO_TOKENS = 0.6, 12
#: Marks that only a prompt has.
MARKERS = {
    "placeholder": r"\[[A-Z][A-Z0-9_ /-]{2,}\]|<[A-Z][A-Z0-9_ /-]{2,}>", "examples_header": r"(?im)^\s*EXAMPLES\b.*:", "brief_header": r"(?im)^\s*BRIEF\s*:",
    "write_instruction": r"(?i)write the post now", "block_separator": r"(?m)^\s*(?:-{3,}|\*{3,}|={3,}|—{2,})\s*$",
}
#: Fixed value: spans that may be names.
ENTITY = r"\b(?:[A-Z]{2,}|[A-Z](?:&[A-Z])+|[A-Z][a-z][a-zA-Z0-9'-]*(?:\s+[A-Z][a-z][a-zA-Z0-9'-]*)*)\b"
#: Capitalized words that are no names, in exemplars.
PLAIN_CAPS = frozenset(
    "a an and as at but by for from here how i if in it its no not of on one or our so stop that the their these they this "
    "those to two three four five six seven eight nine ten we what when where why with you your".split()
)
#: Days, months and quarters; acronyms of no firm; words of our own prompts.
CALENDAR = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december q1 q2 q3 q4".split())
ACRONYMS = frozenset(
    "ai api apis arr b2b b2c ceo cfo coo cto crm csv cv eu faq gdp hr ip it kpi kpis llm llms mba ml mrr mvp nps ok okr okrs pdf pm pr qa r&d rag roi rfp saas sdk seo sla smb "
    "sms sql tam tl;dr tldr ui uk url us usa ux vc vp".split()
)
PROMPT_WORDS = frozenset("assistant brief briefs cadence constraint constraints entity examples filler lineation linkedin paragraph paragraphs response rhythm system topic user".split())
#: Words that are no names in drafts, whatever the corpus; ordinary_words() adds what a corpus shows to be ordinary.
ORDINARY = PLAIN_CAPS | CALENDAR | ACRONYMS | PROMPT_WORDS | T.COMMON_CAPS


def ordinary_words(df: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(word): words that at least so many texts write in lower case, and more texts than write them capitalized within a sentence.

    By this rule a word that only opens sentences is ordinary, and a name stays one. Counted over all texts.
    """
    words = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(T.body(F.col(text)), F.lit(p), F.lit(1)), F.lower))
    rows = df.select(words(r"(?<![A-Za-z0-9'-])([a-z][a-z0-9'-]*[a-z0-9])(?![A-Za-z0-9'-])").alias("low"), words(r"(?<=[a-z0-9,] )([A-Z][a-z][a-zA-Z0-9'-]*)").alias("cap"))
    both = F.concat(F.transform("low", lambda w: F.struct(w.alias("word"), F.lit(1).alias("low"))), F.transform("cap", lambda w: F.struct(w.alias("word"), F.lit(0).alias("low"))))
    n = rows.select(F.explode(both).alias("x")).groupBy("x.word").agg(F.sum("x.low").alias("low"), F.count(F.lit(1)).alias("all"))
    return n.where(F.col("low") >= F.greatest(F.lit(least), F.col("all") - F.col("low"))).select("word")


def scaffold_markers(draft: Column) -> Column:
    return F.array_compact(F.array(*[F.when(T.body(draft).rlike(p), F.lit(k)) for k, p in sorted(MARKERS.items())]))


def gram_rows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram) of each text, distinct."""
    g = df.select(key, F.array_distinct(T.grams(T.guard_words(F.col(text)), n)).alias("g"))
    # the outer form keeps the optimizer from adding a filter that computes the grams again
    return g.select(key, F.explode_outer("g").alias("gram")).where("gram is not null")


def known_grams(df: DataFrame, text: str, n: int) -> DataFrame:
    g = df.select(T.grams(T.guard_words(F.col(text)), n).alias("g"))
    return g.select(F.explode_outer("g").alias("gram")).where("gram is not null").distinct()


def parroted(drafts: DataFrame, exemplars: DataFrame, key: str, text: str, n: int = PARROT, by: str = "text") -> DataFrame:
    """(key, gram) of runs of n words that a draft shares with any exemplar: a semi-join on grams, so neither side is collected."""
    return gram_rows(drafts, key, text, n).join(known_grams(exemplars, by, n), "gram", "left_semi")


def copied_ratio(drafts: DataFrame, exemplars: DataFrame, key: str, text: str, n: int = COVERAGE, by: str = "text") -> DataFrame:
    """(key, tokens, covered) for each draft: tokens inside runs of n words that any exemplar has.

    Runs are matched by a join on their hash and text; covered places are counted as a union of intervals.
    """
    t = drafts.select(key, T.guard_words(F.col(text)).alias("t"))
    places = t.select(key, T.grams(F.col("t"), n).alias("g")).select(key, F.posexplode_outer("g").alias("p", "gram")).where("gram is not null")
    hits = places.join(known_grams(exemplars, by, n), "gram", "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("p")).alias("ps"))
    # sorted starts: each adds what the one before doesn't cover
    pairs = F.zip_with("ps", F.concat(F.array(F.lit(None).cast("int")), F.slice("ps", F.lit(1), F.greatest(F.size("ps") - 1, F.lit(0)))), lambda x, y: F.least(F.lit(n), F.coalesce(x - y, F.lit(n))))
    covered = F.aggregate(pairs, F.lit(0), lambda a, x: a + x)
    return t.select(key, F.size("t").alias("tokens")).join(hits.select(key, covered.alias("covered")), key, "left").select(key, "tokens", F.coalesce("covered", F.lit(0)).alias("covered"))


def parrot_reject(draft: Column, exemplar: Column) -> Column:
    """For a draft beside its own exemplar: a scaffold marker, a shared run of eight, or 30 % coverage of a draft of 40 words."""

    def copies(x: Column) -> Column:
        eight = F.coalesce(F.arrays_overlap(T.grams(x["d"], PARROT), T.grams(x["e"], PARROT)), F.lit(False))
        return eight | ((F.size(x["d"]) >= COVERAGE_TOKENS) & (T.covered_ratio(x["d"], T.grams(x["e"], COVERAGE), COVERAGE) >= COVERAGE_LIMIT))

    both = F.struct(T.guard_words(draft).alias("d"), T.guard_words(exemplar).alias("e"))
    return (F.size(scaffold_markers(draft)) > 0) | T.let(both, copies)


def brief_echo(draft: Column, brief: Column) -> Column:
    reference = T.grams(T.guard_words(brief), COVERAGE)
    return T.let(T.guard_words(draft), lambda d: (F.size(d) >= ECHO_TOKENS) & (T.covered_ratio(d, reference, COVERAGE) >= ECHO_LIMIT))


def _spans(c: Column) -> Column:
    spans = F.regexp_extract_all(T.body(c), F.lit(ENTITY), F.lit(0))
    return F.transform(spans, lambda s: F.regexp_replace(F.lower(F.regexp_replace(s, r"\s+", " ")), "['’]s$", ""))


def _in(words: frozenset) -> Column:
    return F.array(*map(F.lit, sorted(words)))


def granted_names(c: Column) -> Column:
    """Names a text grants: every span with an unfamiliar word, and each of its words."""
    kept = F.filter(_spans(c), lambda s: F.exists(F.split(s, " "), lambda w: ~F.array_contains(_in(PLAIN_CAPS), w)))
    return F.array_distinct(F.concat(kept, F.flatten(F.transform(kept, lambda s: F.split(s, " ")))))


def claimed_names(c: Column) -> Column:
    """Names a draft claims: spans without their ordinary words, and each word that is left."""
    bare = F.transform(_spans(c), lambda s: F.array_except(F.split(s, " "), _in(ORDINARY)))
    bare = F.filter(bare, lambda w: F.size(w) > 0)
    return F.array_distinct(F.concat(F.transform(bare, lambda w: F.array_join(w, " ")), F.flatten(bare)))


#: Units that make a number evidence, labels that don't.
UNITS = (
    r"(?:years?|yrs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|quarters?|times?|passengers?|pax|flights?|seconds?|tickets?|bookings?|"
    r"rebookings?|seats?|cases?|invoices?|accounts?|records?|exceptions?|channels?|travelers?|travellers?)\b"
)
LABELS = (
    r"(?i)\b(?:categor(?:y|ies)|cat\.?)\s*\d+(?:\s*(?:/|and|&)\s*\d+)?|\b(?:rule|version|schema|v\.?)\s*[-/]?\s*\d+\b|"
    r"\bT\+\d+(?:\s*(?:to|/|-)\s*T\+\d+)?\b|\bposition\s+\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
)
NUMERALS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand hundreds thousands"
).split()
VALUES = [*map(str, range(21)), "30", "40", "50", "60", "70", "80", "90", "100", "1000", "100s", "1000s"]
GLUE = r"(?!and\b|or\b|but\b|the\b|a\b|an\b|to\b|for\b|in\b|on\b|at\b|by\b)"
FIGURE = (
    r"(?i)(?:€|\$|£)\s?\d+(?:[.,]\d+)?(?:\s*(?:m|bn|k|million|billion))?|\b\d+(?:[.,]\d+)?%|"
    rf"\b\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?\+?\s*-?\s*{UNITS}|\b\d+(?:[.,]\d+)?\+?\s*-?\s*{UNITS}|"
    rf"(?:\ba\s+)?(?:{'|'.join(NUMERALS)})(?:\s+(?:of|{GLUE}[A-Za-z]+)){{0,3}}\s+{UNITS}"
)


def evidence_figures(c: Column) -> Column:
    """Distinct figures that can be checked, numerals as digits, adjectives between value and unit left out."""
    masked = F.regexp_replace(T.body(c), LABELS, " ")
    value = F.create_map(*[F.lit(x) for kv in zip(NUMERALS, VALUES) for x in kv])
    numeral = rf"^(?:a )?({'|'.join(sorted(NUMERALS, key=len, reverse=True))})\b"

    def key(s: Column) -> Column:
        s = F.regexp_replace(F.replace(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), F.lit(",")), r"\+$", "")
        first = F.regexp_extract(s, numeral, 1)
        s = F.when(first == "", s).otherwise(F.concat(F.try_element_at(value, first), F.regexp_replace(s, numeral, "")))
        return F.regexp_replace(s, r"(\d+%?)\s+(?:[a-z]+\s+){1,3}", "$1 ")

    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(FIGURE), F.lit(0)), key))


def invented(brief: Column, draft: Column) -> Column:
    """Names and figures of the draft that the brief doesn't grant."""
    names = F.array_sort(F.array_except(claimed_names(draft), granted_names(brief)))
    figures = F.array_sort(F.array_except(evidence_figures(draft), evidence_figures(brief)))
    return F.struct(names.alias("names"), figures.alias("figures"), ((F.size(names) == 0) & (F.size(figures) == 0)).alias("passed"))


def invented_names(rows: DataFrame, key: str, brief: str, draft: str, ordinary: DataFrame) -> DataFrame:
    """(key, names): what drafts claim and briefs don't grant, words of ordinary(word) being no names. One row for every row.

    Vocabulary of any size: claimed words meet it in a join, spans are put together again from the words that are left.
    """
    base = F.array(*map(F.lit, sorted(ORDINARY)))
    spans = rows.select(key, F.posexplode(_spans(F.col(draft))).alias("span", "s")).select(key, "span", F.posexplode(F.split("s", " ")).alias("at", "word"))
    left = spans.where(~F.array_contains(base, F.col("word"))).join(ordinary, "word", "left_anti")
    left = left.groupBy(key, "span").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("w"))
    claims = left.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array(F.array_join("w", " ")), F.col("w"))))).alias("claimed"))
    out = rows.select(key, granted_names(F.col(brief)).alias("granted")).join(claims, key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, F.array_sort(F.array_except(F.coalesce("claimed", none), "granted")).alias("names"))


def allowed_facts(brief: Column) -> Column:
    """What a brief grants, sorted: names and figures."""
    return F.struct(F.array_sort(granted_names(brief)).alias("entities"), F.array_sort(evidence_figures(brief)).alias("numbers"))
