"""Sinks: overwrite by swap, append of new ids, vector index with manifest, kept pairs, receipts."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus, dedupe, retrieve
from corpusloom.operators.evaluate import safe_receipt
from corpusloom.operators.rewrite import normalized
from corpusloom.runtime import file_system, path_exists, written

MANIFEST = {"schema_version": 2, "dims": retrieve.DIMS, "embedder": "token-hash-256", "cleaner": "normalize-text"}


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = file_system(spark, old)
    if not fs.rename(p, file_system(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def recovered(spark: SparkSession, path: str) -> str:
    """path, put back from its latest backup if a crash came between the two renames of swap()."""
    if not path_exists(spark, path):
        fs, p = file_system(spark, path)
        names = sorted(x.getPath().getName() for x in fs.globStatus(file_system(spark, f"{path}.*.bak")[1]) or ())
        if names:
            _rename(spark, f"{path.rsplit('/', 1)[0]}/{names[-1]}", path)
    return path


def swap(df: DataFrame, path: str, fmt: str = "json", backup: bool = False) -> None:
    """Write beside path, then put it in place, so that df may read path itself. Any file system.

    The old copy is renamed, the new one is renamed into its place, and only then the old one is deleted: at every
    moment one of them is whole, and recovered() finds it.
    """
    spark = df.sparkSession
    mark = f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
    staged, old = f"{path}.{mark}.staged", f"{path}.{mark}.bak"
    df.write.mode("overwrite").format(fmt).save(staged)
    had = path_exists(spark, path)
    if had:
        _rename(spark, path, old)
    _rename(spark, staged, path)
    if had and not backup:
        fs, p = file_system(spark, old)
        fs.delete(p, True)


def append_new(index_path: str, batch: DataFrame, fmt: str = "parquet") -> int:
    """Append the first row of each id that the index lacks; how many that were. A missing index is empty, any other failure is one."""
    spark = batch.sparkSession
    known = spark.read.format(fmt).load(index_path) if path_exists(spark, index_path) else batch.limit(0)
    fresh = written(corpus.new_rows(known, batch), "fresh")
    fresh.write.mode("append").format(fmt).save(index_path)
    return fresh.count()


def register(spark: SparkSession, registry: str, kind: str, source: str) -> int:
    """Note a source, once for each kind and path; how many were new."""
    return append_new(registry, spark.createDataFrame([(f"{kind}|{source}", kind, source, 0)], "id string, kind string, source string, pos int"))


def run_ingest(spark: SparkSession, index: str, registry: str, batches: dict[tuple[str, str], DataFrame]) -> tuple[int, int]:
    """Append batches, named by (kind, source), to an index: (rows added, rows that came). Each source is registered."""
    added = came = 0
    for (kind, source), rows in batches.items():
        register(spark, registry, kind, source)
        rows = written(rows.withColumn("pos", F.monotonically_increasing_id()), "batch")
        came += rows.count()
        added += append_new(index, rows)
    return added, came


def apply_dedupe(spark: SparkSession, index: str, near_ratio: float = dedupe.NEAR_RATIO, holdouts: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """Rewrite an index without its duplicates and keep a backup; the report of what was dropped. A ratio of 1 or more means equal keys only."""
    df = spark.read.format(fmt).load(index)
    told = written(dedupe.report(df, near_ratio), "report")
    swap(dedupe.deduped(df, holdouts, near_ratio), index, fmt, backup=True)
    return told


def write_artifacts(drafts: DataFrame, path: str) -> None:
    """Prompts and drafts as they are, by arm; for local eyes only, receipts never hold them."""
    drafts.write.mode("overwrite").partitionBy("arm").json(path)


def write_record(df: DataFrame, path: str) -> None:
    """A selection, profile, carve or verdict: few rows in one JSON file."""
    swap(df.coalesce(1), path)


def build_vector_index(pieces: DataFrame, path: str, holdouts: DataFrame | None = None) -> None:
    """Rows sorted by id; holdouts and texts empty after cleaning stay out; the manifest is written last."""
    rows = pieces if holdouts is None else pieces.join(holdouts.select("id"), "id", "left_anti")
    rows = normalized(rows, "text", "clean").where("clean <> ''")
    rows = rows.withColumn("vector", retrieve.embedding(F.col("clean"))).drop("clean").orderBy("id")
    swap(rows, path, "parquet")
    swap(pieces.sparkSession.createDataFrame([tuple(MANIFEST.values())], "schema_version int, dims int, embedder string, cleaner string").coalesce(1), f"{path}.manifest")


def load_vector_index(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.schema("schema_version int, dims int, embedder string, cleaner string").json(recovered(spark, f"{path}.manifest")).first().asDict()
    if got != MANIFEST:
        raise ValueError("the index was built by another version")
    return spark.read.parquet(recovered(spark, path))


def write_kept(pairs: DataFrame, gated: DataFrame, path: str) -> None:
    """The original lines of the pairs that passed."""
    pairs.join(gated.where("pass").select("pos"), "pos", "left_semi").orderBy("pos").select("raw").write.mode("overwrite").text(path)


def write_receipt(df: DataFrame, path: str) -> None:
    safe_receipt(df).coalesce(1).write.mode("overwrite").json(path)
