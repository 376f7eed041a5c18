"""Identity, cleaning, selection and summaries of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.runtime import checked_broadcast

#: Names and lengths of the fields that make ids.
ID_TEXT, ID_FILE_TEXT = 200, 120
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def light_clean(c: Column) -> Column:
    """Line ends made LF, three or more of them made two, ends trimmed."""
    lf = F.regexp_replace(T.body(c), "\r\n|\r", "\n")
    return T.trim_all(F.regexp_replace(lf, "\n{3,}", "\n\n"))


def parse_day(c: Column) -> Column:
    """The day of a date string: ISO, year first with slashes, US month first, named months, else a bare year's first day.

    An impossible day is null, without falling back to its year.
    """
    s = T.trim_all(T.body(c))
    g = lambda p, i: F.regexp_extract(s, p, i)
    iso, us = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:\D.*)?$", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:\D.*)?$"
    dmy, mdy = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})(?:\D.*)?$", r"^([A-Za-z]{3})[a-z]* (\d{1,2}), (\d{4})(?:\D.*)?$"
    bare = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"
    month = lambda m: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(m)).cast("string"), 2, "0")
    two = lambda x: F.lpad(x, 2, "0")
    day = lambda y, m, d: F.concat_ws("-", y, m, d).try_cast("date")
    return (
        F.when(s.rlike(iso), day(g(iso, 1), two(g(iso, 2)), two(g(iso, 3))))
        .when(s.rlike(us), day(g(us, 3), two(g(us, 1)), two(g(us, 2))))
        .when(s.rlike(dmy), day(g(dmy, 3), month(g(dmy, 2)), two(g(dmy, 1))))
        .when(s.rlike(mdy), day(g(mdy, 3), month(g(mdy, 1)), two(g(mdy, 2))))
        .when(s.rlike(bare), day(g(bare, 1), F.lit("01"), F.lit("01")))
    )


def first_filled(*cols: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.when(T.trim_all(c) != "", T.trim_all(c)) for c in cols])


def guess_source(path: Column, hint: Column | None = None) -> Column:
    """A hint if given; else email, note or doc by the parts of the path."""
    low = F.lower(path)
    guess = F.when(low.rlike(r"email|\.eml$"), "email").when(low.rlike("note|obsidian"), "note").otherwise("doc")
    return F.coalesce(hint, guess) if hint is not None else guess


def export_pieces(shares: DataFrame, comments: DataFrame, articles: DataFrame) -> DataFrame:
    """Pieces of a network export: blank texts dropped, ids from their parts, dates parsed."""
    kinds = (
        (shares, "linkedin_post", F.col("ShareCommentary"), F.col("ShareLink"), F.col("ShareLink")),
        (comments, "linkedin_comment", F.col("Message"), F.lit(""), F.col("Date")),
        (articles, "linkedin_article", F.col("Content"), F.col("Title"), F.col("Title")),
    )
    out = None
    for df, source, raw, title, part in kinds:
        clean = light_clean(raw)
        day = parse_day(F.col("Date"))
        one = df.select(
            T.stable_id(F.lit(source), part, F.substring(clean, 1, ID_TEXT)).alias("id"), F.lit(source).alias("source"), clean.alias("text"),
            F.date_format(day, "yyyy-MM-dd").alias("date"), F.year(day).alias("year"), T.word_count(clean).alias("word_count"),
            T.body(title).alias("title"),
        ).where("text <> ''")
        out = one if out is None else out.unionByName(one)
    return out


def new_rows(index: DataFrame, batch: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Rows of batch to append: the first per key within the batch whose key isn't in the index.

    The first is found by a partial aggregate, so a key may repeat in any share of the rows.
    """
    firsts = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
    return firsts.join(index.select(key).distinct(), key, "left_anti").select(*batch.columns)


def select_pieces(
    df: DataFrame,
    sources: list[str] | None = None,
    min_words: int = 40,
    through_year: int | None = None,
    include_undated: bool = False,
    include_ids: DataFrame | None = None,
    exclude_ids: DataFrame | None = None,
) -> DataFrame:
    """Selection: exclude beats all; include bypasses source, length and date; then source, length, date. Id tables hold one column id."""
    ids = lambda d, n: checked_broadcast(d.select("id").distinct().withColumn(n, F.lit(True)))
    out = df
    if exclude_ids is not None:
        out = out.join(checked_broadcast(exclude_ids.select("id").distinct()), "id", "left_anti")
    forced = F.lit(False)
    if include_ids is not None:
        out = out.join(ids(include_ids, "__in"), "id", "left")
        forced = F.coalesce("__in", F.lit(False))
    dated = F.when(F.col("year").isNull(), F.lit(include_undated)).otherwise(F.lit(True) if through_year is None else F.col("year") <= through_year)
    fits = (F.coalesce("word_count", F.lit(0)) >= min_words) & dated
    if sources is not None:
        fits = fits & F.coalesce(F.col("source").isin(*sources), F.lit(False))
    return out.where(forced | fits).select(*df.columns)


def summary(df: DataFrame) -> DataFrame:
    """Pieces and words by source, by year and in total, in one pass; undated pieces count under `undated`."""
    year = F.coalesce(F.col("year").cast("string"), F.lit("undated"))
    rows = df.select(F.coalesce("source", F.lit("doc")).alias("source"), year.alias("year"), F.coalesce("word_count", F.lit(0)).alias("w"))
    by = rows.groupingSets([[F.col("source")], [F.col("year")], []], F.col("source"), F.col("year")).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("pieces"), F.sum("w").alias("words")
    )
    kind = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "year").otherwise("total")
    return by.select(kind.alias("kind"), F.coalesce("source", "year", F.lit("")).alias("value"), "pieces", "words")


def run_summary(df: DataFrame, sources: list[str], min_words: int = 40, through_year: int | None = None, include_undated: bool = False) -> DataFrame:
    """One row on a selection and the index it is from: pieces and words selected, undated pieces, all pieces; in one pass."""
    dated = F.when(F.col("year").isNull(), F.lit(include_undated)).otherwise(F.lit(True) if through_year is None else F.col("year") <= through_year)
    fits = (F.coalesce("word_count", F.lit(0)) >= min_words) & dated & F.coalesce(F.col("source").isin(*sources), F.lit(False))
    return df.agg(
        F.count_if(fits).alias("pieces"), F.coalesce(F.sum(F.when(fits, F.col("word_count"))), F.lit(0)).cast("bigint").alias("words"),
        F.count_if(F.col("year").isNull()).alias("undated_in_index"), F.count(F.lit(1)).alias("index_total"),
    )


def size_gate(df: DataFrame, block: int = 20, warn: int = 50) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("selected"), (n < block).alias("blocked"), ((n >= block) & (n < warn)).alias("warned"))


def resolve(selection: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces of selection(ord, id) in its order; ids without a piece are skipped."""
    return selection.join(pieces, "id").orderBy("ord")


def leaked(wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    return wanted.select("id").distinct().join(indexed.select("id"), "id", "left_semi")


def truncate_at(c: Column, budget: int) -> Column:
    """Cut at the last paragraph, line or word break within the budget if that keeps a third of it; an ellipsis marks the cut."""
    t = T.trim_all(T.body(c))
    head = F.substring(t, 1, budget)
    last = lambda sep: F.length(head) - F.locate(sep, F.reverse(head)) - (len(sep) - 1)
    at = lambda sep: F.when(F.locate(sep, F.reverse(head)) > 0, last(sep)).otherwise(F.lit(-1))
    third = budget // 3
    cut = F.when(at("\n\n") >= third, at("\n\n")).when(at("\n") >= third, at("\n")).when(at(" ") >= third, at(" ")).otherwise(F.lit(budget))
    return F.when(F.length(t) <= budget, t).otherwise(F.concat(T.trim_all(F.substring(t, F.lit(1), cut)), F.lit("…")))


def clip_words(c: Column, n: int) -> Column:
    """The first n words by white space, line breaks kept."""
    t = T.trim_all(T.body(c))
    return F.when(T.word_count(t) <= n, t).otherwise(F.regexp_extract(t, rf"^((?:{T.NOT_WS}+{T.WS}+){{{n - 1}}}{T.NOT_WS}+)", 1))


def numbered(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """A gapless order over a small table."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
