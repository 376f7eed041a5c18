"""Texts that share most of their runs of words.

Similarity is the share of common runs of `run` consecutive words among all runs of two texts, each run counted once.

1. Texts with the same sequence of words form one class; everything below works on one row per class.
2. Each class gets minima of its runs under independent hash functions. Three minima make the key of a bucket; two
   bits of each minimum make a signature of 128 bits whose Hamming distance estimates the similarity.
3. Within a bucket, signatures sorted by population count are compared exactly, tile against tile, by exclusive-or
   and bit counts; tile pairs whose population counts differ beyond the radius are skipped.
   A bucket of more than HOT classes is cut into blocks by population count and hash, and every pair of blocks that may
   hold a pair is a unit of work of its own, so no bucket is one task.
4. What lies within the radius is compared run by run, so the result holds no false pair.

All-pairs tiling over the whole collection would be quadratic, hence the buckets. With 25 buckets per class a pair at
similarity 0.6 is missed with probability 0.23 %, one at 0.65 with 0.03 %, one at 0.8 with 5e-9.

Defined cases: null and empty texts and texts of fewer than `run` words have no runs and match nothing; repeated ids
count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.components import components
from corpusloom.llm.codepoints import BASE_1, BASE_2, U64, Codes, Words, mix, powers
from corpusloom.llm.formatdup import format_copies
from corpusloom.llm.frames import map_batches, partitions, record, salted_join
from corpusloom.runtime import checked_broadcast, written

#: Buckets per class and minima per bucket; signature bits come from the first 64 minima.
BUCKETS, PER_BUCKET, SIGNED = 25, 3, 64
#: Rows of a tile; classes above which a bucket is dealt out in blocks; rows of a block.
TILE, HOT, BLOCK = 512, 16_384, 8_192


def radius(threshold: float) -> int:
    """Hamming radius: mean distance at the threshold plus four standard deviations of the estimate."""
    miss = 1 - threshold
    return int(np.ceil(SIGNED * miss + 4 * np.sqrt(SIGNED * (1.5 * miss - miss * miss))))


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, BUCKETS * PER_BUCKET + 1, dtype=U64) * BASE_1) | U64(1)


def class_keys(w: Words) -> np.ndarray:
    """A hash of each text's word sequence; 0 for texts without words."""
    n = np.diff(w.first)
    out = np.zeros(len(n), U64)
    if len(w.hash):
        place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
        some = n > 0
        out[some] = mix(np.add.reduceat(w.hash * powers(BASE_2, int(n.max()) + 1)[place], w.first[:-1][some]) + n[some].astype(U64))
    return out


def sketches(texts: list, run: int):
    """(class key, bucket keys, signature words) of the texts that have runs, and which those are."""
    c = Codes(texts)
    w = Words(c)
    h, at = w.grams(run)
    text = np.repeat(np.arange(c.n), np.diff(w.first))[at]
    has = np.unique(text)
    begin = np.searchsorted(text, has)
    minima = np.empty((BUCKETS * PER_BUCKET, len(has)), U64)
    for q, m in enumerate(_multipliers()):
        x = h * m
        x ^= x >> U64(29)
        minima[q] = np.minimum.reduceat(x, begin) if len(h) else 0
    minima = mix(minima)
    keys = np.zeros((BUCKETS, len(has)), U64)
    for r in range(PER_BUCKET):
        keys = mix(keys * BASE_2 + minima[r::PER_BUCKET])
    bit = U64(1) << np.arange(SIGNED, dtype=U64)[:, None]
    low = np.bitwise_or.reduce(np.where(minima[:SIGNED] & U64(1), bit, U64(0)), axis=0) if len(has) else np.empty(0, U64)
    high = np.bitwise_or.reduce(np.where(minima[:SIGNED] & U64(2), bit, U64(0)), axis=0) if len(has) else np.empty(0, U64)
    return class_keys(w)[has], keys, low, high, has


def _tiles(low: np.ndarray, high: np.ndarray, cls: np.ndarray, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket within the radius. Rows are sorted by population count, then tile meets tile."""
    pop = (np.bitwise_count(low) + np.bitwise_count(high)).astype(np.int32)
    order = np.argsort(pop, kind="stable")
    low, high, cls, pop = low[order], high[order], cls[order], pop[order]
    for a in range(0, len(cls), TILE):
        b = slice(a, a + TILE)
        for c in range(a, len(cls), TILE):
            if pop[c] - pop[min(a + TILE, len(cls)) - 1] > far:
                break  # the rest is farther still
            d = slice(c, c + TILE)
            gap = np.bitwise_count(low[b, None] ^ low[None, d]) + np.bitwise_count(high[b, None] ^ high[None, d])
            i, j = np.nonzero(gap <= far)
            if a == c:
                up = i < j
                i, j = i[up], j[up]
            yield cls[b][i], cls[d][j]


def _small_buckets(start, size, low, high, cls, far):
    """All buckets of up to 32 rows at once: row i meets row i + k of its bucket, for each k."""
    left = np.repeat(size, size) - 1 - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    k = 1
    while True:
        at, left = at[left >= k], left[left >= k]
        if not len(at):
            return
        gap = np.bitwise_count(low[at] ^ low[at + k]) + np.bitwise_count(high[at] ^ high[at + k])
        ok = gap <= far
        yield cls[at[ok]], cls[at[ok] + k]
        k += 1


def _unique_pairs(found: list) -> np.ndarray:
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
    return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)


def _one_per_class(key, cls, low, high):
    """Rows sorted by key with each class once: copies of a class come from several partitions."""
    order = np.lexsort((cls, key))
    key, cls, low, high = key[order], cls[order], low[order], high[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    return key[new], cls[new], low[new], high[new]


FOUND = "a bigint, b bigint, bucket bigint, low bigint, high bigint"


def _pairs_record(both: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(both), pa.int64())
    return record(a=both[:, 0], b=both[:, 1], bucket=none, low=none, high=none)


def _rows_record(bucket, cls, low, high) -> pa.RecordBatch:
    return record(a=cls, b=pa.nulls(len(cls), pa.int64()), bucket=bucket, low=low.view(np.int64), high=high.view(np.int64))


def bucket_pairs(far: int, hot: int = HOT):
    """mapInArrow over rows sorted by bucket, giving FOUND: candidate pairs (a, b), and the rows (a, bucket, low, high) of buckets above hot.

    A bucket that spans batches is put together first; one that grows above hot is handed on as it comes.
    """

    def pairs(key, cls, low, high):
        key, cls, low, high = _one_per_class(key, cls, low, high)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        small = (size > 1) & (size <= 32)
        found = list(_small_buckets(start[small], size[small], low, high, cls, far)) if small.any() else []
        for s, n in zip(start[size > 32], size[size > 32]):
            if n <= hot:
                found += _tiles(low[s : s + n], high[s : s + n], cls[s : s + n], far)
            else:
                yield _rows_record(key[s : s + n], cls[s : s + n], low[s : s + n], high[s : s + n])
        yield _pairs_record(_unique_pairs(found))

    def run(batches):
        held: list[list[np.ndarray]] = []
        streaming = None  # the bucket whose rows are handed on
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[2:] = [c.view(U64) for c in cols[2:]]  # bits of a negative number would be those of its absolute value
            if not len(cols[0]):
                continue
            if streaming is not None:
                cut = int(np.searchsorted(cols[0], streaming, "right"))
                yield _rows_record(*[c[:cut] for c in cols])
                cols = [c[cut:] for c in cols]
                if not len(cols[0]):
                    continue
                streaming = None
            if cols[0][-1] != cols[0][0] or (held and held[-1][0][-1] != cols[0][0]):
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
                held.append([c[:cut] for c in cols])
                yield from pairs(*map(np.concatenate, zip(*held)))
                held = [[c[cut:] for c in cols]]
            else:
                held.append(cols)
            if sum(len(h[0]) for h in held) > 4 * hot:
                rest = _one_per_class(*map(np.concatenate, zip(*held)))
                held = [list(rest)]
                if len(rest[0]) > hot:
                    streaming = int(rest[0][0])
                    yield _rows_record(*rest)
                    held = []
        if held:
            yield from pairs(*map(np.concatenate, zip(*held)))

    return run


def block_pairs(far: int):
    """mapInArrow over (work, cls, low, high, side) sorted by work: pairs of the two blocks of a unit of work, or within its one block."""

    def meet(work, cls, low, high, side):
        order = np.argsort(work, kind="stable")
        work, cls, low, high, side = work[order], cls[order], low[order], high[order], side[order]
        found = []
        cuts = np.flatnonzero(np.concatenate(([True], work[1:] != work[:-1], [True])))
        for s, e in zip(cuts[:-1], cuts[1:]):
            if side[s:e].max() == 0:
                found += _tiles(low[s:e], high[s:e], cls[s:e], far)
                continue
            l, r = (np.flatnonzero(side[s:e] == k) + s for k in (1, 2))
            for i in range(0, len(l), TILE):
                for j in range(0, len(r), TILE):
                    x, y = l[i : i + TILE], r[j : j + TILE]
                    gap = np.bitwise_count(low[x, None] ^ low[None, y]) + np.bitwise_count(high[x, None] ^ high[None, y])
                    p, q = np.nonzero(gap <= far)
                    found.append((cls[x][p], cls[y][q]))
        return _pairs_record(_unique_pairs(found))

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols[2:4] = [c.view(U64) for c in cols[2:4]]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held.append([c[:cut] for c in cols])
            if cut or (len(held) > 1 and len(held[-2][0]) and held[-2][0][-1] != cols[0][0]):
                yield meet(*map(np.concatenate, zip(*held)))
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield meet(*map(np.concatenate, zip(*held)))

    return run


def _split_buckets(rows: DataFrame, far: int, block: int = BLOCK) -> DataFrame:
    """FOUND for rows(bucket, cls, low, high) of buckets that are too large for one task."""
    rows = rows.distinct().withColumn("pop", (F.bit_count("low") + F.bit_count("high")).cast("int"))
    rows = written(rows, "hot-bucket-rows")
    sizes = rows.groupBy("bucket", "pop").agg(F.count(F.lit(1)).alias("n"))  # at most 129 rows a bucket
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).select("bucket", "pop", "parts"), "hot-bucket-sizes")
    blocks = sizes.select("bucket", "pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    a, b = blocks.select("bucket", F.col("pop").alias("pop1"), F.col("part").alias("part1")), blocks.select("bucket", F.col("pop").alias("pop2"), F.col("part").alias("part2"))
    near = (F.col("pop2") - F.col("pop1")).between(0, far) & ((F.col("pop1") < F.col("pop2")) | (F.col("part1") <= F.col("part2")))
    work = a.join(b, "bucket").where(near).withColumn("work", F.xxhash64("bucket", "pop1", "part1", "pop2", "part2"))
    work = written(work, "hot-bucket-work")
    same = (F.col("pop1") == F.col("pop2")) & (F.col("part1") == F.col("part2"))
    left = work.select("bucket", F.col("pop1").alias("pop"), F.col("part1").alias("part"), "work", F.when(same, 0).otherwise(1).alias("side"))
    right = work.where(~same).select("bucket", F.col("pop2").alias("pop"), F.col("part2").alias("part"), "work", F.lit(2).alias("side"))
    placed = rows.join(checked_broadcast(sizes), ["bucket", "pop"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = placed.join(checked_broadcast(left.unionByName(right)), ["bucket", "pop", "part"]).select("work", "cls", "low", "high", "side")
    return dealt.repartition("work").sortWithinPartitions("work").mapInArrow(block_pairs(far), FOUND)


def classes(df: DataFrame, run: int) -> DataFrame:
    """(id, cls) of every text that has a run of words."""

    def make():
        def f(b: pa.RecordBatch):
            w = Words(Codes(b.column(1).to_pylist()))
            ok = np.diff(w.first) >= run
            return record(id=b.column(0).filter(pa.array(ok)), cls=class_keys(w)[ok].view(np.int64))

        return f

    return map_batches(df, make, "id string, cls bigint")


def _postings(df: DataFrame, run: int) -> DataFrame:
    """(bucket, cls, low, high): one row per class and bucket and partition."""

    def make():
        seen: set[int] = set()  # of this partition only: a class with a third of all rows is sent once from each

        def f(b: pa.RecordBatch):
            cls, keys, low, high, _ = sketches(b.column(0).to_pylist(), run)
            fresh = np.array([not (x in seen or seen.add(x)) for x in cls.tolist()], bool)
            cls, keys, low, high = cls[fresh], keys[:, fresh], low[fresh], high[fresh]
            i64 = lambda x: x.view(np.int64)
            return record(
                bucket=i64(np.ascontiguousarray(keys).ravel()), cls=i64(np.tile(cls, BUCKETS)), low=i64(np.tile(low, BUCKETS)), high=i64(np.tile(high, BUCKETS))
            )

        return f

    return map_batches(df.select("text"), make, "bucket bigint, cls bigint, low bigint, high bigint")


def _runs(df: DataFrame, run: int) -> DataFrame:
    """(cls, runs): the distinct runs of each text as sorted 64-bit hashes in one binary value."""

    def make():
        def f(b: pa.RecordBatch):
            c = Codes(b.column(1).to_pylist())
            w = Words(c)
            h, at = w.grams(run)
            text = np.repeat(np.arange(c.n), np.diff(w.first))[at]
            first = np.searchsorted(text, np.arange(c.n + 1))
            sets = [np.unique(h[first[i] : first[i + 1]]).tobytes() for i in range(c.n)]
            return record(cls=b.column(0), runs=pa.array(sets, pa.binary()))

        return f

    return map_batches(df, make, "cls bigint, runs binary")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def make():
        def f(b: pa.RecordBatch):
            both = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            share = np.empty(b.num_rows)
            for i, (x, y) in enumerate(both):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both_n = len(x) + len(y) - len(np.union1d(x, y))
                share[i] = both_n / (len(x) + len(y) - both_n)
            ok = pa.array(share >= threshold)
            return record(a=b.column(0).filter(ok), b=b.column(1).filter(ok), similarity=pa.array(share).filter(ok))

        return f

    return map_batches(pairs, make, "a bigint, b bigint, similarity double")


def _candidates(df: DataFrame, threshold: float, run: int, hot: int, block: int, rows: int) -> DataFrame:
    """(a, b) with a < b of classes within the radius in a bucket."""
    far = radius(threshold)
    near = _postings(df, run).repartition(partitions(df, rows * BUCKETS, 32), "bucket").sortWithinPartitions("bucket")
    found = written(near.mapInArrow(bucket_pairs(far, hot), FOUND), "bucket-pairs")
    pairs = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select("bucket", F.col("a").alias("cls"), "low", "high")
    if large.limit(1).count():
        pairs = pairs.unionByName(_split_buckets(large, far, block).select("a", "b"))
    return written(pairs.distinct(), "candidates")


def similar(df: DataFrame, threshold: float = 0.8, run: int = 5, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For df(id, text): members(id, cls) and links(a, b, similarity) between classes with a < b."""
    df = df.select(F.col("id").cast("string").alias("id"), "text").where(F.col("id").isNotNull())
    members = written(classes(df, run).distinct(), "classes")
    cand = _candidates(df, threshold, run, hot, block, members.count())
    wanted = cand.select(F.col("a").alias("cls")).union(cand.select("b")).distinct()
    one = members.join(checked_broadcast(wanted), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
    texts = df.join(checked_broadcast(one), "id").dropDuplicates(["cls"]).select("cls", "text")
    runs = written(_runs(texts, run), "runs")
    left = cand.join(runs.select(F.col("cls").alias("a"), F.col("runs").alias("x")), "a")
    both = left.join(runs.select(F.col("cls").alias("b"), F.col("runs").alias("y")), "b").select("a", "b", "x", "y")
    return members, _verified(both, threshold)


#: Members of one class beyond which its pairs are dealt out to several tasks.
SHARE = 4096


def similar_ids(members: DataFrame, links: DataFrame, share: int = SHARE) -> DataFrame:
    """All pairs (id_a, id_b) with id_a < id_b: within each class and across each link.

    This spells out every pair, which is what some results are defined as; groups() gives one row per text instead.
    Members of a large class are split by a hash; each part meets the whole class, repeated once per part.
    """
    size = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / share).cast("int"))
    many = members.join(size.where("n > 1").select("cls", "parts"), "cls")
    split = lambda d: d.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    whole = lambda d: d.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    p, q = split(many).select("cls", "part", F.col("id").alias("id_a")), whole(many).select("cls", "part", F.col("id").alias("id_b"))
    within = p.join(q, ["cls", "part"]).where("id_a < id_b").select("id_a", "id_b")
    # one row per link and pair of parts of its classes, then the members of either part
    own = split(members.join(size.select("cls", "parts"), "cls"))
    side = lambda c, x: own.select(F.col("cls").alias(c), F.col("part").alias("part_" + c), F.col("id").alias(x))
    dealt = links.select("a", "b")
    for c in "ab":
        dealt = whole(dealt.join(size.select(F.col("cls").alias(c), "parts"), c)).withColumnRenamed("part", "part_" + c).drop("parts")
    across = dealt.join(side("a", "x"), ["a", "part_a"]).join(side("b", "y"), ["b", "part_b"])
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return within.unionByName(across)


def word_classes(df: DataFrame) -> DataFrame:
    """(id, cls) of every row: the key of the text's word sequence; a text without words is a class of its own."""

    def make():
        def f(b: pa.RecordBatch):
            w = Words(Codes(b.column(1).to_pylist()))
            return record(id=b.column(0), cls=pa.array(class_keys(w).view(np.int64), mask=np.diff(w.first) == 0))

        return f

    own = map_batches(df.select(F.col("id").cast("string").alias("id"), "text").where(F.col("id").isNotNull()), make, "id string, cls bigint")
    return own.select("id", F.coalesce("cls", F.xxhash64("id")).alias("cls"))


def folded_copies(df: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all texts of df(id, text) that agree in their letters and digits, whatever their words and length."""
    one = df.select("id", F.lit("").alias("none"), "text")
    copies = format_copies(one, "id", ["none", "text"], "record")
    group = copies.select("first_key", F.col("copy_key").alias("id")).union(copies.select("first_key", "first_key")).distinct()
    both = group.alias("p").join(group.alias("q"), "first_key").where("p.id < q.id")
    return both.select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, grp, links): the smallest class key reachable over links, however long the chain, and the links of the text's own class."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    n = edges.groupBy(F.col("a").alias("cls")).agg(F.count(F.lit(1)).alias("links"))
    known = components(links).select(F.col("node").alias("cls"), F.col("root").alias("lab")).join(n, "cls")
    out = salted_join(members, known, ["cls"], how="left", spread="id")
    return out.select("id", F.coalesce("lab", "cls").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
