"""Duplicate pieces: exact by a cleaned key across everything, near ones within equal source and date, one keeper a group.

near_ratio=None, or one of 1 or more, groups by exact keys only; else groups are what exact keys and near links reach together.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.components import components
from corpusloom.functions import text as T
from corpusloom.operators.rewrite import normalized
from corpusloom.runtime import checked_broadcast, near_small, salted_join, written

NEAR_RATIO = 0.99
PRIORITY = ("linkedin_article", "linkedin_post", "linkedin_comment")


def with_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `key`: the cleaned text with white space collapsed and case folded (ß is ss); empty for blank texts."""
    clean = normalized(df, text, "__clean")
    key = F.lower(F.upper(T.trim_all(F.regexp_replace(F.col("__clean"), rf"{T.WS}+", " "))))
    return clean.withColumn("key", key).drop("__clean")


def keeper_order(holdout: Column) -> Column:
    """What makes a piece the keeper, least first: holdout, source, date, longer key, longer title, more metadata, id."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source")), F.lit(0).cast("bigint")), F.lit(len(PRIORITY) + 1))
    return F.struct(
        F.when(holdout, 0).otherwise(1).alias("h"), rank.alias("s"), F.when(F.coalesce("date", F.lit("")) != "", 0).otherwise(1).alias("d"),
        (-F.length("key")).alias("k"), (-F.length(T.trim_all(T.body(F.col("title"))))).alias("t"),
        (-F.coalesce(F.size("meta"), F.lit(0))).alias("m"), F.col("id").alias("id"),
    )


def _keyed(df: DataFrame, near_ratio: float | None) -> DataFrame:
    """Pieces that can have duplicates, with key_hash and root: the smallest key hash that near links reach from their own."""
    rows = with_key(df).where("key <> ''").withColumn("key_hash", F.sha2("key", 256))
    if near_ratio is None or near_ratio >= 1:
        return rows.withColumn("root", F.col("key_hash"))
    links = _near_rows(rows, near_ratio).select(F.sha2("left_key", 256).alias("a"), F.sha2("right_key", 256).alias("b"))
    roots = components(links).withColumnRenamed("node", "key_hash")
    return salted_join(rows, roots, ["key_hash"], how="left", spread="id").withColumn("root", F.coalesce("root", "key_hash"))


def _grouped(rows: DataFrame, holdouts: DataFrame | None) -> DataFrame:
    """(root, keeper, members, holdouts, exact, cross_source) of each group of several pieces.

    The keeper is a minimum, found by partial aggregates: no group is gathered, whatever its share of all rows.
    """
    if holdouts is not None:
        rows = rows.join(checked_broadcast(holdouts.select("id").distinct().withColumn("__h", F.lit(True))), "id", "left")
    else:
        rows = rows.withColumn("__h", F.lit(False))
    held, source = F.coalesce("__h", F.lit(False)), F.coalesce("source", F.lit(""))
    g = rows.groupBy("root").agg(
        F.min(keeper_order(held)).alias("k"), F.count(F.lit(1)).alias("members"), F.count_if(held).alias("holdouts"),
        (F.min("key_hash") == F.max("key_hash")).alias("exact"), (F.min(source) != F.max(source)).alias("cross_source"),
    )
    return g.where("members > 1").select("root", F.col("k.id").alias("keeper"), "members", "holdouts", "exact", "cross_source")


def exact_groups(df: DataFrame, holdouts: DataFrame | None = None) -> DataFrame:
    """(key_hash, keeper, members, holdouts) of each key that several pieces have."""
    return _grouped(_keyed(df, None), holdouts).select(F.col("root").alias("key_hash"), "keeper", "members", "holdouts")


def _dropped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    bad = F.when(F.col("holdouts") > 1, F.raise_error(F.concat(F.lit("two holdouts share a text, beside "), F.col("keeper")))).otherwise(F.col("keeper"))
    # a hot group's rows are spread, its one group row is repeated
    return salted_join(rows.select("id", "source", "root"), groups.select("root", bad.alias("keeper")), ["root"], spread="id").where("id <> keeper")


def dropped(df: DataFrame, holdouts: DataFrame | None = None, near_ratio: float | None = None) -> DataFrame:
    """(id, source, keeper) of the pieces that dedupe drops; fails if that would drop a holdout."""
    rows = _keyed(df, near_ratio)
    return _dropped(rows, _grouped(rows, holdouts)).select("id", "source", "keeper")


def deduped(df: DataFrame, holdouts: DataFrame | None = None, near_ratio: float | None = None) -> DataFrame:
    return df.join(dropped(df, holdouts, near_ratio).select("id"), "id", "left_anti")


def report(df: DataFrame, near_ratio: float | None = None) -> DataFrame:
    """One row: groups, exact and near ones, pieces dropped, also by source, groups across sources."""
    rows = _keyed(df, near_ratio)
    groups = written(_grouped(rows, None), "groups")
    by = _dropped(rows, groups).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    by = by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("dropped_by_source"))
    n = F.count(F.lit(1)).alias("groups"), F.count_if("exact").alias("exact_groups"), F.count_if(~F.col("exact")).alias("near_groups")
    sums = groups.agg(*n, F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("dropped"), F.count_if("cross_source").alias("cross_source"))
    return sums.crossJoin(by)


def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of character sequences by the standard library's matcher with its defaults, which depends on positions."""

    def one(a, b):
        m = SequenceMatcher(None, a, b)
        return 0.0 if m.real_quick_ratio() < 0.5 or m.quick_ratio() < 0.5 else m.ratio()

    return pd.Series([one(a, b) for a, b in zip(left, right)])


def near_links(df: DataFrame, ratio: float = NEAR_RATIO) -> DataFrame:
    """(left, right, ratio) of pieces of equal source and date whose keys are at least as similar as ratio, left being the lower id.

    Equal keys of a bucket stand for one another: the ratio depends on which text comes first, so two keys have a row for
    each order in which their pieces' ids occur, not one for each pair of pieces.
    """
    return _near_rows(with_key(df).where("key <> ''"), ratio).select("left", "right", "ratio")


#: Rows of one bucket beyond which its comparisons are dealt out to several tasks.
SHARE = 2048


def _near_rows(keyed: DataFrame, ratio: float) -> DataFrame:
    """(left, right, left_key, right_key, ratio).

    Within a bucket of source and date only lengths that the ratio allows can meet: rows are cut into bands of length of
    the ratio's width, so a row meets its own and the next band. A profile of character counts, cut to 25 classes, is
    compared natively before the matcher runs. Keys stay out of that join and are fetched for what is left. A large
    bucket (a hot source, or texts without a date) is split by a hash; each part meets the whole bucket.
    """
    rows = keyed.select("id", "key", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("date", F.lit("")).alias("d"))
    rows = rows.groupBy("s", "d", "key").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    step = max(1e-6, 2 / ratio - 2)
    rows = rows.withColumn("n", F.length("key")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 + step))))
    bag = F.array(*[F.length("key") - F.length(F.translate("key", c, "")) for c in "etaoinshrdlcumwfgypbvk .,"])
    rows = written(rows.withColumn("bag", bag).withColumn("h", F.sha2("key", 256)), "near-keys")
    place = ["s", "d", "band"]
    sizes = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts"))
    b = near_small(rows.drop("key"), sizes, place, spread="id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    cols = ("id", "last", "h", "n", "bag")
    a = rows.select("s", "d", F.explode(F.array("band", F.col("band") + 1)).alias("band"), *[F.col(c).alias("a_" + c) for c in cols], F.col("band").alias("a_band"))
    a = near_small(a, sizes, place, spread="a_id").withColumn("part", F.pmod(F.xxhash64("a_id"), F.col("parts")).cast("int")).drop("parts")
    j = a.join(b, [*place, "part"]).where((F.col("a_band") < F.col("band")) | (F.col("a_id") < F.col("id")))
    low = F.least("a_n", "n")
    shared = F.aggregate(F.zip_with("a_bag", "bag", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    total = F.col("a_n") + F.col("n")
    j = j.where((2.0 * low / total >= ratio) & ((total - shared) / total >= ratio))
    side = lambda left, right, lk, rk: F.struct(F.col(left).alias("left"), F.col(right).alias("right"), F.col(lk).alias("left_h"), F.col(rk).alias("right_h"))
    orders = F.array(side("a_id", "last", "a_h", "h"), side("id", "a_last", "h", "a_h"))
    j = j.select(F.explode(F.filter(orders, lambda x: x["left"] < x["right"])).alias("x"), "a_id", "id")
    # beside the lowest id of one key stands the lowest id of the other if that is higher, else its highest
    other = F.when(F.col("x.left") == F.least("a_id", "id"), F.greatest("a_id", "id")).otherwise(F.col("x.right"))
    j = written(j.select("x.left", other.alias("right"), "x.left_h", "x.right_h"), "near-pairs")
    keys = rows.select("h", "key").join(j.select(F.col("left_h").alias("h")).union(j.select("right_h")).distinct(), "h", "left_semi").dropDuplicates(["h"])
    for c in ("left", "right"):
        j = j.join(keys.select(F.col("h").alias(f"{c}_h"), F.col("key").alias(f"{c}_key")), f"{c}_h")
    j = j.select("left", "right", "left_key", "right_key")
    return j.withColumn("ratio", F.pandas_udf(sequence_ratio, "double")("left_key", "right_key")).where(F.col("ratio") >= ratio)
