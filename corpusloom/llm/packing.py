"""Documents into sequences of fixed capacity: shortest-pack-first over the histogram of lengths.

Only the histogram, which has at most as many rows as the capacity, reaches the driver. Lengths are placed longest
first; each goes into the emptiest kind of pack it fits into, many packs of a kind at a time, so the work depends on
the capacity and not on the number of documents. Patterns come back to documents by rank: documents of one length are
ranked within salted cells whose offsets are summed; the number of cells grows with the number of documents of that
length, so one length may hold any share of all documents. Equal lengths of a pattern share one slot, so there are at
most a few slots a pattern and the table of slots, whose size depends on the capacity alone, is broadcast.

Defined cases: a document longer than the capacity is split into full sequences and a rest, no other is split; a
document without tokens needs no sequence and gets sequence null; repeated rows are packed each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import near_small, written

CAPACITY = 1024
#: Chunks of one length that are ranked in one task.
CELL = 50_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, lengths in one of them), for lengths of 1..capacity."""
    kinds: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]  # by free space
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        free = capacity - 1  # a pack with this much free space holds something already
        placed: list[tuple[int, int, tuple[int, ...]]] = []
        while left:
            while free >= length and not kinds[free]:
                free -= 1
            if free < length:
                # no open pack takes it: new packs, as many of the length in each as fit
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    placed.append((capacity - per * length, full, (length,) * per))
                if rest:
                    placed.append((capacity - rest * length, 1, (length,) * rest))
                break
            count, lengths = kinds[free].pop()
            used = min(count, left)
            if count > used:
                kinds[free].append((count - used, lengths))
            placed.append((free - length, used, (*lengths, length)))
            left -= used
            # packs just filled are open to the same length again
            f, n, x = placed.pop()
            kinds[f].append((n, x))
            free = max(free, f)
        for f, n, x in placed:
            kinds[f].append((n, x))
    return [p for k in kinds for p in k]


def chunks(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, chunk, n_tokens): full sequences first, then the rest."""
    n = F.col("n_tokens")
    parts = F.greatest(F.ceil(n / F.lit(capacity)), F.lit(1)).cast("int")
    out = sizes.select(F.col(key), n.alias("all"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("chunk"))
    return out.select(key, "chunk", F.least(F.col("all") - F.col("chunk") * capacity, F.lit(capacity)).alias("n_tokens"))


SLOTS = "n_tokens int, lo bigint, hi bigint, first bigint, each bigint, at int"


def slot_rows(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple]:
    """SLOTS of each pattern, one for each different length: ranks lo to hi go into the sequences from `first` on, `each` to one, from `at` on."""
    rows, start, taken = [], 0, {}
    for count, lengths in patterns:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            each, lo = lengths.count(x), taken.get(x, 0)
            rows.append((x, lo, lo + count * each, start, each, at))
            taken[x] = lo + count * each
            at += each * x
        start += count
    return rows


def packed(sizes: DataFrame, key: str, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """(key, chunk, n_tokens, sequence, at) for sizes(key, n_tokens): the sequence of each chunk and where in it it begins."""
    spark = sizes.sparkSession
    parts = written(chunks(sizes.select(key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), key, capacity), "chunks")
    histogram = {r[0]: r[1] for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}  # at most capacity + 1 rows
    salts = F.create_map(*[F.lit(x) for n, k in histogram.items() if k > cell for x in (n, -(-k // cell))]).cast("map<int,int>")
    salt = F.pmod(F.xxhash64(key, "chunk"), F.coalesce(F.try_element_at(salts, F.col("n_tokens")), F.lit(1))).cast("int")
    parts = parts.withColumn("salt", salt)
    cells = parts.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row per cell
    cells = written(cells.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "cells")
    slots = spark.createDataFrame(slot_rows(pack_histogram({x: n for x, n in histogram.items() if x > 0}, capacity)), SLOTS)
    rank = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(key, "chunk")) - 1
    ranked = near_small(parts.withColumn("own", rank), cells, ["n_tokens", "salt"], spread=key)
    ranked = ranked.select(key, "chunk", "n_tokens", (F.col("before") + F.col("own")).alias("rank"))
    s, r = F.broadcast(slots).alias("s"), ranked.alias("r")
    on = (F.col("r.n_tokens") == F.col("s.n_tokens")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    place = F.col("rank") - F.col("lo")
    sequence = F.col("first") + F.floor(place / F.col("each"))
    at = (F.col("at") + F.pmod(place, F.col("each")) * F.col("r.n_tokens")).cast("int")
    return r.join(s, on, "left").select(key, "chunk", "r.n_tokens", sequence.cast("bigint").alias("sequence"), at.alias("at"))


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, documents' chunks, tokens, and the share of room used."""
    used = placed.where(F.col("sequence").isNotNull())
    one = used.agg(
        F.max("sequence").alias("last"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")
    )
    sequences = F.coalesce(F.col("last") + 1, F.lit(0))
    return one.select(
        sequences.alias("sequences"), "chunks", "tokens", F.when(sequences > 0, F.col("tokens") / (sequences * capacity)).alias("fill")
    )
