"""Sources combined to target shares of all tokens by Poisson replication.

Each document is used as often as a Poisson distribution says whose uniform number is a hash of seed and document, so
the draw doesn't depend on partitions or retries. The distribution is cut at the source's cap; its rate is solved so
that the mean after the cut gives the source its share. Uses are exploded and sorted by another hash, which shuffles
them over the whole collection.

Total size: all tokens there are, or less if a source can't give its share of that within SAFE of its cap.

Defined cases: sources without a target, and null sources, are used 0 times and reported with target 0; sources without
documents are reported with 0 tokens; empty documents may be used but add nothing; a cap of 0 or less means no use.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import checked_broadcast

#: Share of a source's capped tokens that is planned for, so that the rate stays finite and the share can be met.
SAFE = 0.9
SEED = 20240117


def cut_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson variable that is cut at cap."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + cap * max(0.0, 1 - below)


def solve_rate(mean: float, cap: int) -> float:
    if mean <= 0 or cap < 1:
        return 0.0
    lo, hi = 0.0, 1.0
    while cut_mean(hi, cap) < mean and hi < 500:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, cap) < mean else (lo, mid)
    return hi


def thresholds(rate: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0, 1, ..., cap - 1 uses; a uniform number beyond k of them gives k uses."""
    out, p, total = [], math.exp(-rate), 0.0
    for k in range(max(cap, 0)):
        total += p
        out.append(min(total, 1.0) if rate > 0 else 1.0)
        p *= rate / (k + 1)
    return out


def plan(available: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, list[float]]]:
    """For each source with a target (rate, thresholds)."""
    size = float(sum(available.values())) if total is None else float(total)
    if total is None:
        for s, share, cap in targets:
            if share > 0 and available.get(s, 0) > 0 and cap > 0:
                size = min(size, SAFE * cap * available[s] / share)
    out = {}
    for s, share, cap in targets:
        have = available.get(s, 0)
        rate = solve_rate(min(share * size / have, SAFE * cap) if have else 0.0, cap)
        out[s] = (rate, thresholds(rate, cap))
    return out


def uses(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = SEED, total: float | None = None) -> DataFrame:
    """(key, source, n_tokens, uses) for sizes(key, source, n_tokens), targets(source, target_share, max_repeats).

    sizes is read twice, so it should be a written table. Only sums per targeted source reach the driver.
    """
    spark = sizes.sparkSession
    goal = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    have = goal.join(sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")), "source", "left").where(F.col("source").isNotNull())
    rows = have.collect()  # one row per target
    made = plan({r["source"]: int(r["n"] or 0) for r in rows}, [(r["source"], r["share"] or 0.0, r["cap"] or 0) for r in rows], total)
    steps = spark.createDataFrame([(s, t) for s, (_, t) in made.items()], "source string, steps array<double>")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    n = F.size(F.filter("steps", lambda t: t <= u))
    out = sizes.join(checked_broadcast(steps), "source", "left")
    return out.select(key, "source", "n_tokens", F.when(F.col("steps").isNull(), 0).otherwise(n).alias("uses"))


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target share, documents, tokens there are, tokens used, share reached, most uses of one document."""
    goal = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    by = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("n_tokens").alias("tokens"),
        F.sum(F.col("n_tokens").cast("bigint") * F.col("uses")).alias("used_tokens"),
        F.max("uses").alias("most_uses"),
    )
    by = by.withColumn("total", F.sum("used_tokens").over(Window.partitionBy(F.lit(1))))  # one row per source
    joined = by.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        F.coalesce("b.source", "g.source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("documents"),
        zero("tokens"), zero("used_tokens"), zero("most_uses"),
        F.when(F.col("total") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("total")).otherwise(0.0).alias("share"),
    )


def mixture(used: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(key, source, copy, n_tokens, place) in global random order: each document as often as it is used."""
    rows = used.where("uses > 0").select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))
    return rows.withColumn("place", F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy"))).orderBy("place", key, "copy")
