"""Long stretches that stand letter for letter in more than one record.

The index is log-structured. Of each window of the length sought, the least hash of the half-length windows inside is
its anchor; neighbours mostly have the same, so a text keeps one row per stretch of windows with the same anchor, about
one in fifty characters. Equal windows have equal anchors. The anchors of a batch form a run: a table bucketed and
sorted by hash, written once and never changed. A new batch is merge-joined with the runs before it, bucket by bucket
without another shuffle; compaction merges the buckets of all runs, again without one. Beside each run stand the
classes of its records (a hash of each whole text), and a manifest names the runs, so an index can be opened again.

Anchors that a text of the batch shares with another text say where a shared stretch can lie. There, and only there,
the windows of the full length are hashed anew (another base) and grouped; a window counts if two different texts have
it, one of them in the batch. Of older texts only those that meet the batch are read. Groups are told apart by their
smallest and largest text key, never spelled out as pairs. Windows of anchors that more than HOT texts have are told
apart by partial aggregates and a salted join, the others by a sort within tasks. Texts that are equal as a whole form
one class and meet in no window. No side of a join is broadcast on Spark's estimate of its size: a side that grows with
the records is counted first, or merged.

Equality rests on two 64-bit hashes of different bases (anchor and window), not on the text.

Defined cases: null and short texts share nothing; equal texts under different ids share every character if they are
long enough; repeated rows of one id count once; a stretch that repeats within one record only isn't shared.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import BASE_1, BASE_2, MIX_1, U64, Codes, mix, powers
from corpusloom.llm.frames import map_batches, partitions, record
from corpusloom.runtime import checked_broadcast, near_small, path_exists, shared_path, written

LENGTH = 200
#: An anchor of more rows than this is hot: its windows aren't gathered by value in one task.
HOT = 20_000
RUN = "hash bigint, cls bigint, pos int, number int"
CLASSES = "id string, cls bigint, n bigint"


def window_hashes(codes: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A hash of each k code points in a row, from one prefix sum: base is odd, so it has an inverse modulo 2^64."""
    n = len(codes)
    if n < k:
        return np.empty(0, U64)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(mix(codes.astype(U64)) * powers(base, n + 1)[:n], out=prefix[1:])
    inverse = U64(pow(int(base), -1, 1 << 64))
    return mix((prefix[k:] - prefix[:-k]) * powers(inverse, n + 1)[: n - k + 1])


def slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each width neighbours, by doubling."""
    done, cur = 1, x
    while done * 2 <= width:
        cur = f(cur[:-done], cur[done:])
        done *= 2
    return f(cur[: len(x) - width + 1], cur[width - done :]) if done < width else cur


def anchors(c: Codes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, number) for each stretch of windows of a batch whose least half-length window has this hash.

    Every window of the full length belongs to one stretch, and equal windows belong to stretches of equal hash,
    whatever stands around them.
    """
    k = length // 2
    wide = length - k + 1
    n = len(c.codes)
    if n < length:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = slide(window_hashes(c.codes, k, BASE_1), wide, np.minimum)
    end = np.repeat(c.start[1:], np.diff(c.start))
    inside = np.arange(len(low)) + length <= end[: len(low)]
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    heads = c.start[:-1][c.start[:-1] < len(low)]
    new[heads] = inside[heads]
    first = np.flatnonzero(new)
    before = np.concatenate(([0], np.cumsum(inside)))
    return low[first], first, np.diff(np.append(before[first], before[-1]))


def text_keys(c: Codes) -> np.ndarray:
    """A hash of each whole text as stored."""
    n = np.diff(c.start)
    out = np.zeros(c.n, U64)
    if len(c.codes):
        some = n > 0
        place = np.arange(len(c.codes)) - np.repeat(c.start[:-1], n)
        term = mix(c.codes.astype(U64)) * powers(BASE_2, int(n.max()) + 1)[place]
        out[some] = mix(np.add.reduceat(term, c.start[:-1][some]) + n[some].astype(U64) * MIX_1)
    return out


def _anchor_rows(length: int):
    def make():
        seen: set[int] = set()  # of this partition only; equal texts give the same anchors

        def f(b: pa.RecordBatch):
            c = Codes(b.column(0).to_pylist())
            cls = text_keys(c).view(np.int64)
            h, at, number = anchors(c, length)
            of = np.searchsorted(c.start, at, "right") - 1
            fresh = np.array([not (x in seen or seen.add(x)) for x in cls.tolist()], bool)
            keep = fresh[of]
            pos = (at - c.start[of])[keep].astype(np.int32)
            return record(hash=h[keep].view(np.int64), cls=cls[of[keep]], pos=pos, number=number[keep].astype(np.int32))

        return f

    return make


def _classes(df: DataFrame) -> DataFrame:
    """(id, cls, n): the key and length of each whole text."""

    def make():
        def f(b: pa.RecordBatch):
            c = Codes(b.column(1).to_pylist())
            return record(id=b.column(0), cls=text_keys(c).view(np.int64), n=np.diff(c.start))

        return f

    return map_batches(df, make, CLASSES).distinct()


def records(df: DataFrame, length: int) -> DataFrame:
    """(id, text) of the records that can share anything."""
    return df.select(F.col("id").cast("string").alias("id"), "text").where(F.col("id").isNotNull() & (F.length("text") >= length))


class FingerprintIndex:
    """Sorted immutable runs of anchors in a folder that all executors share. An index that stands at path is opened."""

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = LENGTH, buckets: int | None = None):
        self.spark, self.path, self.state, self.runs = spark, path or shared_path(spark, "index"), 0, []
        self.length, self.buckets = length, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if path and path_exists(spark, f"{path}/states"):
            last = spark.read.json(f"{path}/states/*").orderBy(F.col("state").desc()).first()  # one row per change
            self.state, self.length, self.buckets, self.runs = last["state"], last["length"], last["buckets"], list(last["runs"])
            for r in self.runs:
                spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {r} (hash bigint, cls bigint, pos int, number int) USING parquet "
                    f"CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs/{r}'"
                )

    def _commit(self, runs: list[str]) -> None:
        """The manifest of a new state; what it doesn't name isn't there."""
        self.state, self.runs = self.state + 1, runs
        row = [(self.state, self.length, self.buckets, runs)]
        rows = self.spark.createDataFrame(row, "state int, length int, buckets int, runs array<string>")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/states/{self.state:09}")

    def _write(self, rows: DataFrame) -> str:
        name = f"corpusloom_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.path}/runs/{name}")
        writer.option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def classes(self, runs: list[str] | None = None) -> DataFrame:
        """(id, cls, n) of the records of these runs, or of all."""
        parts = [f"{self.path}/classes/{r}" for r in (self.runs if runs is None else runs)]
        return self.spark.read.schema(CLASSES).parquet(*parts)

    def append(self, batch: DataFrame) -> str:
        """Write the anchors and classes of batch(id, text) as a new run and give its name."""
        batch = records(batch, self.length)
        anchors_ = map_batches(batch.select("text"), _anchor_rows(self.length), RUN)
        name = self._write(anchors_.repartition(self.buckets, "hash"))
        _classes(batch).write.option("compression", "zstd").parquet(f"{self.path}/classes/{name}")
        self._commit([*self.runs, name])
        return name

    def shared_with(self, name: str) -> DataFrame:
        """Anchors (cls, pos, number, n) of run `name` and those before it that a text of run `name` shares with another; n rows of all these runs have the anchor."""
        lo, hi, n = F.min("cls"), F.max("cls"), F.count(F.lit(1))
        met = self.run(name).groupBy("hash").agg(lo.alias("own_lo"), hi.alias("own_hi"), n.alias("n")).withColumns({"lo": F.col("own_lo"), "hi": F.col("own_hi")})
        older = self.runs[: self.runs.index(name)]
        for o in older:
            theirs = self.run(o).groupBy("hash").agg(lo.alias("lo2"), hi.alias("hi2"), n.alias("n2"))
            met = met.join(theirs.hint("merge"), "hash", "left").select(
                "hash", "own_lo", "own_hi", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")
            )
        met = written(met.where("lo <> hi"), "met")
        out = None
        for r in (*older, name):
            other = F.expr("lo <> cls or hi <> cls" if r == name else "own_lo <> cls or own_hi <> cls")
            got = self.run(r).join(checked_broadcast(met), "hash").where(other).select("cls", "pos", "number", "n")
            out = got if out is None else out.unionByName(got)
        return out

    def compact(self) -> str:
        """Merge all runs into one, bucket by bucket; a class that several runs hold stays once. Old runs stay on disk for readers that have them open."""
        rows = None
        for r in self.runs:
            rows = self.run(r) if rows is None else rows.unionByName(self.run(r))
        name = self._write(rows.dropDuplicates(["hash", "cls", "pos"]))
        self.classes().distinct().write.option("compression", "zstd").parquet(f"{self.path}/classes/{name}")
        self._commit([name])
        return name


def _window_rows(length: int):
    def make():
        def f(b: pa.RecordBatch):
            c = Codes(b.column(1).to_pylist())
            cls = b.column(0).to_numpy(zero_copy_only=False)
            fresh = b.column(3).to_numpy(zero_copy_only=False)
            at = b.column(2)
            flat = at.flatten()
            of = np.repeat(np.arange(c.n), np.diff(at.offsets.to_numpy()))
            pos = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + c.start[of]
            number = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            h = window_hashes(c.codes, length, BASE_2)
            start = np.repeat(pos, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            text = np.repeat(of, number)
            return record(win=h[start].view(np.int64), cls=cls[text], at=(start - c.start[text]).astype(np.int32), fresh=fresh[text])

        return f

    return make


def _meeting(batches):
    """Rows sorted by window hash: those whose window two different texts have, one of them fresh, as (cls, at)."""

    def meet(win, cls, at, fresh):
        order = np.argsort(win, kind="stable")
        win, cls, at, fresh = win[order], cls[order], at[order], fresh[order]
        first = np.flatnonzero(np.concatenate(([True], win[1:] != win[:-1])))
        size = np.diff(np.append(first, len(win)))
        met = (np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)) & np.logical_or.reduceat(fresh, first)
        ok = np.repeat(met, size)
        return record(cls=cls[ok], at=at[ok])

    held: list = []
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not len(cols[0]):
            continue
        if cols[0][-1] != cols[0][0] or (held and held[-1][0][-1] != cols[0][0]):
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held.append([c[:cut] for c in cols])
            parts = list(map(np.concatenate, zip(*held)))
            if len(parts[0]):
                yield meet(*parts)
            held = [[c[cut:] for c in cols]]
        else:
            held.append(cols)
    if held:
        yield meet(*map(np.concatenate, zip(*held)))


def _hot_meeting(windows: DataFrame) -> DataFrame:
    """The same by minima and maxima from partial aggregates and a salted join, for windows that any share of all texts may have."""
    windows = written(windows, "hot-windows")
    met = windows.groupBy("win").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.max("fresh").alias("any"))
    return near_small(windows, written(met.where("any and lo <> hi").select("win"), "hot-met"), ["win"], spread="cls").select("cls", "at")


def _stretches(length: int):
    """For (cls, starts) the stretches under the union of the windows."""

    def make():
        def f(b: pa.RecordBatch):
            cls, begin, end = [], [], []
            for c, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.unique(np.array(starts, np.int64))
                new = np.flatnonzero(np.concatenate(([True], np.diff(s) > length)))
                begin.append(s[new])
                end.append(s[np.append(new[1:], len(s)) - 1] + length)
                cls += [c] * len(new)
            return record(cls=pa.array(cls, pa.int64()), begin=np.concatenate(begin or [np.empty(0, np.int64)]), end=np.concatenate(end or [np.empty(0, np.int64)]))

        return f

    return make


def batch_stretches(corpus: DataFrame, index: FingerprintIndex, name: str, hot: int = HOT) -> DataFrame:
    """(cls, begin, end): what records of run `name` share with other records of it or of runs before it, in the texts of both.

    corpus(id, text) must hold the records of these runs; of the older ones only texts that meet the run are used.
    """
    runs = index.runs[: index.runs.index(name) + 1]
    members, own = index.classes(runs), index.classes([name]).select("cls").distinct().hint("merge")
    anchor = F.struct("pos", "number")
    spots = index.shared_with(name).groupBy("cls").agg(
        F.collect_set(F.when(F.col("n") <= hot, anchor)).alias("cold"), F.collect_set(F.when(F.col("n") > hot, anchor)).alias("hot")
    )
    spots = written(spots.join(own.withColumn("fresh", F.lit(True)), "cls", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))), "spots")
    one = members.join(checked_broadcast(spots.select("cls")), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
    # only narrow rows are broadcast; the lists of spots meet their texts in a shuffle of those texts alone
    texts = records(corpus, index.length).join(checked_broadcast(one), "id").dropDuplicates(["cls"]).join(spots.hint("merge"), "cls")
    windows = lambda kind: map_batches(
        texts.where(F.size(kind) > 0).select("cls", "text", kind, "fresh"), _window_rows(index.length), "win bigint, cls bigint, at int, fresh boolean"
    )
    number = F.aggregate("cold", F.lit(0).cast("bigint"), lambda a, x: a + x["number"])
    rows = spots.agg(F.coalesce(F.sum(number), F.lit(0))).head()[0]  # windows to come
    met = windows("cold").repartition(partitions(spots, rows, 24), "win").sortWithinPartitions("win").mapInArrow(_meeting, "cls bigint, at int")
    if spots.where(F.size("hot") > 0).limit(1).count():
        met = met.unionByName(_hot_meeting(windows("hot")))
    parts = map_batches(met.groupBy("cls").agg(F.collect_list("at").alias("s")), _stretches(index.length), "cls bigint, begin bigint, end bigint")
    copies = members.groupBy("cls").agg((F.min("id") != F.max("id")).alias("many"), F.max("n").alias("n")).where("many").join(own, "cls", "left_semi")
    return written(parts.unionByName(copies.select("cls", F.lit(0).cast("bigint").alias("begin"), F.col("n").alias("end"))), "stretches")


def covered(stretches: DataFrame) -> DataFrame:
    """(cls, shared_chars): characters under the stretches of each class, each once."""
    spans = F.sort_array(F.collect_list(F.struct("begin", "end")))
    step = lambda a, x: F.struct(
        F.greatest(a["at"], x["end"]).alias("at"), (a["sum"] + F.greatest(x["end"] - F.greatest(a["at"], x["begin"]), F.lit(0))).alias("sum")
    )
    zero = F.lit(0).cast("bigint")
    total = F.aggregate("s", F.struct(zero.alias("at"), zero.alias("sum")), step)["sum"]
    return stretches.groupBy("cls").agg(spans.alias("s")).select("cls", total.alias("shared_chars"))


def shared_by_id(index: FingerprintIndex, stretches: DataFrame) -> DataFrame:
    """(id, shared_chars) of every record of the index that has stretches."""
    best = written(covered(stretches), "shared")
    return near_small(index.classes().select("id", "cls").distinct(), best, ["cls"], spread="id").select("id", "shared_chars")


def shared_chars(corpus: DataFrame, index: FingerprintIndex, name: str) -> DataFrame:
    """(id, shared_chars) of what records of run `name` share with other records, on both sides."""
    return shared_by_id(index, batch_stretches(corpus, index, name))
