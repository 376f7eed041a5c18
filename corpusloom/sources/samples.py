"""Named sources of our own for trials: drafts with and without slop, a holdout pair, a demo corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRAFTS = (
    ("slop_ledger", "Moreover, it is important to note that we leverage robust synergies in today's fast-paced digital world. Furthermore, the ledger is a testament to our approach."),
    ("slop_harbor", "Furthermore, unlocking value requires us to delve into the harbor plan. Moreover, robust teams leverage it."),
    ("clean_ledger", "We closed the ledger on Friday.\n\nNobody asked. I asked myself why.\n\nBecause the old one was wrong by 45%."),
    ("clean_harbor", "The harbor plan has 3 pages. I'd cut two. You don't need them."),
)
HOLDOUTS = (
    ("foreign", "Contoso announces that its new scheduling suite is available to customers in twelve countries as of this quarter, following an extended period of careful preparation."),
    ("author", "New scheduling. Twelve countries.\n\nIt took us too long. I know.\n\nYou can use it today."),
)
DEMO = tuple(
    (f"demo-{year}", "demo", f"In {year} the {what} moved to one page. " * 6 + f"I kept the second page for {who}.", f"{year}-0{year % 8 + 1}-11", year)
    for year, what, who in ((2020, "garden plan", "Marta"), (2021, "ledger", "the board"), (2022, "memo", "nobody"), (2023, "survey", "Omar"), (2024, "archive", "you"))
)


def drafts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DRAFTS, "name string, text string")


def holdout_pair(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLDOUTS, "name string, text string")


def demo_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO, "id string, source string, text string, date string, year int")
