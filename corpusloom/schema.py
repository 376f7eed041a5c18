"""The data model: one row per piece of writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

PIECE = "id string, source string, text string, path string, date string, year int, word_count int, title string, meta map<string,string>"


def year_of(date: Column) -> Column:
    return F.regexp_extract(date, "^([0-9]{4})", 1).try_cast("int")


def completed(df: DataFrame) -> DataFrame:
    """Derived fields of a piece: word_count where it is 0 or null, year where it is null."""
    n = F.when(F.coalesce("word_count", F.lit(0)) != 0, F.col("word_count")).otherwise(T.word_count(F.col("text")))
    return df.withColumns({"word_count": n, "year": F.coalesce("year", year_of(F.col("date")))})


def lenient(df: DataFrame, line: str) -> DataFrame:
    """Pieces from JSON lines: missing source is doc, missing text is empty; blank and broken lines are dropped, a missing id fails."""
    p = F.from_json(F.col(line), PIECE)
    rows = df.where(F.trim(line) != "").select(p.alias("p"), F.try_parse_json(F.col(line)).alias("v")).where("v is not null")
    rows = rows.select("p.*")
    ident = F.when(F.col("id").isNull(), F.raise_error("a piece has no id")).otherwise(F.col("id"))
    return completed(rows.withColumns({"id": ident, "source": F.coalesce("source", F.lit("doc")), "text": T.body(F.col("text"))}))
