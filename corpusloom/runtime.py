"""Session helpers: tables, lineage cuts in the shared folder, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if a count shows that it has at most so many rows.
BROADCAST_ROWS = 50_000
#: A hot key's rows spread over so many tasks; the other side is repeated as often, so it must be the smaller one.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table. spread: one that comes in fewer splits than there are cores is dealt out to all of them, for costly work per row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Set here only where the session has none and runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder once and read from there.

    An executor that is lost takes nothing with it that later stages need.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table written by an operator."""
    return os.path.join(shared_dir(spark), f"corpusloom-{name}-{uuid.uuid4().hex}")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked of the file system that the path names."""
    fs, p = file_system(spark, path)
    return fs.exists(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut, but columnar and compressed: smaller on disk, and later reads prune columns."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generator stands between it and whatever uses it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def checked_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A broadcast hint if the side has at most max_rows rows; else one for a merge, so that Spark shuffles whatever it takes the side's size for.

    The bound is BROADCAST_ROWS, or the session's spark.corpusloom.broadcastRows.
    """
    return F.broadcast(df) if _is_small(df, max_rows) else df.hint("merge")


def _is_small(df: DataFrame, max_rows: int | None) -> bool:
    most = int(df.sparkSession.conf.get("spark.corpusloom.broadcastRows", str(BROADCAST_ROWS))) if max_rows is None else max_rows
    return df.limit(most + 1).count() <= most


def near_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", spread: str | None = None) -> DataFrame:
    """Join with a side that is broadcast if it is small, else repeated for big's salts: no key of big is one task either way.

    What is repeated is merged: Spark's estimate of its size doesn't know of the repetition, and may broadcast it.
    """
    return big.join(F.broadcast(small), keys, how) if _is_small(small, None) else salted_join(big, small.hint("merge"), keys, how, spread)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", spread: str | None = None) -> DataFrame:
    """Join on keys where one key may hold a third of big's rows: its rows are spread by spread, small is repeated."""
    salt = F.pmod(F.xxhash64(F.col(spread) if spread else F.rand(7)), F.lit(SALTS)).cast("int")
    left = big.withColumn("__salt", salt)
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
