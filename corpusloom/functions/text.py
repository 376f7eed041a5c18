"""Text primitives as Column expressions: tokens, sentences, lines, paragraphs and counts.

White space is Unicode's and the information separators, as in Python. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: The same characters one by one, for trimming without a regular expression.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[A-Za-z0-9']+"
WORD_ONE_APOSTROPHE = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?"
SHORT_LINE = 8

#: Patterns of generic phrasing; the score is how many of them occur.
SLOP = (
    r"\bleverage\b", r"\bsynerg", r"\bdelve\b", r"\brobust\b", r"\bin today's (?:fast-paced\s+)?(?:digital\s+)?world\b",
    r"\bit is important to note\b", r"\bmoreover\b", r"\bfurthermore\b", r"\bunlock\b", r"\btestament to\b",
)
#: Openers that lead nowhere.
SCAFFOLDING = (
    r"(?i)here's the problem:", r"(?i)here's the part that should genuinely bother",
    r"(?i)here's what\b[^\n]{0,160}\blooked like:", r"(?i)that's the part worth\b",
)
#: Contractions with a straight apostrophe.
CONTRACTION = (
    r"(?i)\b(?:I'm|I've|I'd|I'll|you're|you've|you'd|you'll|we're|we've|we'd|we'll|they're|they've|they'd|they'll|it's|that's|"
    r"what's|who's|there's|here's|isn't|aren't|wasn't|weren't|don't|doesn't|didn't|can't|couldn't|won't|wouldn't|shouldn't|"
    r"haven't|hasn't|hadn't|mustn't)\b"
)
#: Words that are no names though capitalized.
COMMON_CAPS = frozenset(
    "the a an and or but if when where what why how who this that these those then than for with from into onto over under "
    "after before because while although however therefore meanwhile also just only even still already here there was were "
    "are is be been being have has had do does did will would could should may might must can add most many some every each "
    "all none no not yes you your yours i we they he she it its our their".split()
)


def body(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside a lambda, an expression from outside is computed again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def words_by_space(c: Column) -> Column:
    """Runs of non-white-space."""
    return F.regexp_extract_all(body(c), F.lit(NOT_WS + "+"), F.lit(0))


def words(c: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(body(c), F.lit(WORD), F.lit(0))


def guard_words(c: Column) -> Column:
    """Runs with at most one inner apostrophe, lower-cased, the curly apostrophe made straight."""
    return F.regexp_extract_all(F.replace(F.lower(body(c)), F.lit("’"), F.lit("'")), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(body(c)), F.lit("[a-z0-9']+"), F.lit(0)))


def plain_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(body(c)), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(c: Column) -> Column:
    return count(body(c), NOT_WS + "+")


def sentence_words(c: Column) -> Column:
    """Words of each sentence; a line without a terminal is one, and sentences without words are dropped."""
    marked = F.regexp_replace(trim_all(body(c)), rf"([.!?…]){WS}+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+"), lambda s: count(s, WORD)), lambda n: n > 0)


def sentences(c: Column) -> Column:
    """Sentences by terminal and space, or by line, trimmed, without empty ones."""
    marked = F.regexp_replace(body(c), rf"([.!?]){WS}+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+"), trim_all), lambda s: s != "")


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(trim_all(body(c)), LINE_END), trim_all), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines."""
    return F.filter(F.transform(F.split(trim_all(body(c)), rf"\n{WS}*\n"), trim_all), lambda s: s != "")


def short_line_ratio(c: Column) -> Column:
    share = lambda ls: F.size(F.filter(ls, lambda s: count(s, WORD) <= SHORT_LINE)) / F.greatest(F.size(ls), F.lit(1))
    return let(lines(c), share)


def median_of(a: Column) -> Column:
    """Exact median of an array of numbers; 0 if empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        at = lambda i: F.try_element_at(s, F.greatest(i, F.lit(1)).cast("int")).cast("double")
        return F.when(n == 0, 0.0).otherwise((at(F.floor((n + 1) / F.lit(2))) + at(F.floor(n / F.lit(2)) + 1)) / 2)

    return let(F.sort_array(a), middle)


def nearest_rank(a: Column, fraction: float) -> Column:
    """Value at the half-even rounded place fraction * (n - 1); 0 if empty."""
    place = lambda n: F.greatest(F.bround(F.lit(fraction) * (n - 1)) + 1, F.lit(1)).cast("int")
    return let(F.sort_array(a), lambda s: F.when(F.size(s) == 0, 0.0).otherwise(F.try_element_at(s, place(F.size(s))).cast("double")))


def slop_score(c: Column) -> Column:
    low = F.lower(body(c))
    return sum((low.rlike(p).cast("int") for p in SLOP[1:]), low.rlike(SLOP[0]).cast("int"))


def scaffolding_count(c: Column) -> Column:
    return sum((body(c).rlike(p).cast("int") for p in SCAFFOLDING[1:]), body(c).rlike(SCAFFOLDING[0]).cast("int"))


def name_spans(c: Column) -> Column:
    """Proxies of proper nouns: acronyms, letters joined by &, title-case runs, capitalized words within a sentence.

    The four kinds overlap on purpose: their occurrences add up.
    """
    every = lambda p, g=0: F.regexp_extract_all(body(c), F.lit(p), F.lit(g))
    inner = F.filter(
        every(r"(?<=[a-z0-9,;:\"'”’)\]])" + WS + r"+([A-Z][a-zA-Z0-9'-]+)\b", 1),
        lambda w: ~((w == F.upper(w)) | F.array_contains(F.array(*map(F.lit, sorted(COMMON_CAPS))), F.lower(w))),
    )
    return F.concat(every(r"\b[A-Z]{2,}\b"), every(r"\b[A-Z](?:&[A-Z])+\b"), every(r"\b[A-Z][a-z]+(?:" + WS + r"+[A-Z][a-z]+)+\b"), inner)


def per_thousand(n: Column, of: Column) -> Column:
    return n * 1000.0 / F.greatest(of, F.lit(1))


def axes(c: Column) -> Column:
    """The axes of the pair gate as one struct."""
    t = trim_all(body(c))
    n, names, you, i = count(t, WORD), F.size(name_spans(t)), count(t, r"(?i)\byou\b"), count(t, r"\bI\b")
    return F.struct(
        n.alias("words"), names.alias("proper_nouns"), F.round(per_thousand(names, n), 2).alias("proper_per_1k"),
        F.round(median_of(sentence_words(t)), 2).alias("median_sentence_words"), F.round(short_line_ratio(t), 4).alias("short_line_ratio"),
        you.alias("you_count"), i.alias("i_count"), F.round(per_thousand(you, n), 2).alias("you_per_1k"),
        F.round(per_thousand(i, n), 2).alias("i_per_1k"), (you > i).alias("you_gt_i"),
    )


def contraction_rate(c: Column) -> Column:
    n = count(body(c), WORD)
    return F.when(n == 0, 0.0).otherwise(F.round(count(body(c), CONTRACTION) / n, 4))


def style_axes(c: Column) -> Column:
    t = trim_all(body(c))
    n, you, i = count(t, WORD), count(t, r"(?i)\byou\b"), count(t, r"\bI\b")
    return F.struct(
        n.alias("words"), F.round(median_of(sentence_words(t)), 2).alias("median_sentence_words"),
        F.round(short_line_ratio(t), 4).alias("short_line_ratio"), contraction_rate(t).alias("contraction_rate"),
        you.alias("you_count"), i.alias("i_count"), F.round(per_thousand(you, n), 2).alias("you_per_1k"),
        F.round(per_thousand(i, n), 2).alias("i_per_1k"), (you > i).alias("you_gt_i"),
    )


def grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces; none if there are fewer."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def runs(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
        out = F.transform(at, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
        return F.when(F.size(t) >= n, out).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def covered_ratio(tokens: Column, reference: Column, n: int) -> Column:
    """Share of tokens inside a run of n that the reference's grams hold, rounded to 4 digits."""

    def share(x: Column) -> Column:
        size, ref = F.size(x["t"]), x["r"]
        hit = F.transform(grams(x["t"], n), lambda g: F.array_contains(ref, g))
        # starts since which a token is covered: n after a hit, one less with each token
        step = lambda a, h: F.struct(F.when(h, F.lit(n)).otherwise(F.greatest(a["left"] - 1, F.lit(0))).alias("left"), (a["sum"] + F.when(h | (a["left"] > 1), 1).otherwise(0)).alias("sum"))
        end = F.aggregate(hit, F.struct(F.lit(0).alias("left"), F.lit(0).alias("sum")), step)
        total = let(end, lambda e: e["sum"] + F.greatest(e["left"] - 1, F.lit(0)))
        return F.when((size < n) | (F.size(ref) == 0), 0.0).otherwise(F.round(total / F.greatest(size, F.lit(1)), 4))

    return let(F.struct(tokens.alias("t"), reference.alias("r")), share)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[body(p) for p in parts]), 256), 1, 16)
