"""Queries over the stamps of the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.timestamps import normalize_stamps
from corpusloom.runtime import near_small, table

STAMPED = (("pieces", "id", "date"), ("li_shares", "share_id", "Date"), ("li_comments", "comment_id", "Date"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_key, stamp, date_order, home_zone) of every stamp of the three tables, delivered twice or not."""
    out = None
    for name, key, col in STAMPED:
        one = table(spark, sf_dir, name).select(
            F.lit(name).alias("tbl"), F.col(key).cast("string").alias("rec_key"), F.col(col).alias("stamp"), "profile_id"
        )
        out = one if out is None else out.unionByName(one)
    profiles = table(spark, sf_dir, "profiles").select("profile_id", "date_order", "home_zone")
    # one row per profile, whatever comes in
    profiles = profiles.groupBy("profile_id").agg(F.min("date_order").alias("date_order"), F.min("home_zone").alias("home_zone"))
    return near_small(out.where(F.col("stamp").isNotNull()), profiles, ["profile_id"], how="left", spread="rec_key")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize_stamps(stamped(spark, sf_dir), "stamp", "date_order", "home_zone")
    return rows.where(F.col("norm").isNotNull()).select("tbl", "rec_key", "norm").distinct()


def p5_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, how many stamps came out as a day, as a moment, or not at all."""
    rows = normalize_stamps(stamped(spark, sf_dir), "stamp", "date_order", "home_zone")
    kind = F.when(F.col("norm").isNull(), "none").when(F.length("norm") == 10, "day").otherwise("moment")
    return rows.groupBy("tbl", kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p5_found": p5_found, "p5_notations": p5_notations}
ORACLE: dict[str, str] = {}
