"""Records that differ only in white space, case, punctuation or field order.

Each record's code points pass through a skip-and-fold table into two rolling polynomial hashes. Rows of one hash are
then verified against the group's first row by a comparison that skips what the table skips. Both work on a batch at a
time: its folded code points stand in one array while it is hashed or compared, so no canonical text is made, stored or
sent, but the comparison is one of arrays rather than a walk with two pointers. Groups are counted by partial
aggregates, so a group may hold any share of all rows.

Defined cases: null fields count as empty; records whose text has no letter or digit are no cases; a line that isn't
a JSON object is no case; the first key of a group is its smallest; a key that repeats counts once.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import BASE_1, BASE_2, MIX_1, U64, Codes, fold, mix, powers
from corpusloom.llm.frames import map_batches, record, salted_join
from corpusloom.runtime import checked_broadcast, written

LINE_FIELDS = ("source", "text", "title", "date", "path", "channel")


def folded_hashes(c: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's folded code points, and how many there are."""
    k = fold(c.codes)
    at = np.flatnonzero(k)
    first = np.searchsorted(at, c.start)
    n = np.diff(first)
    one, two = np.zeros(c.n, U64), np.zeros(c.n, U64)
    if len(at):
        v = k[at].astype(U64)
        place = np.arange(len(at)) - np.repeat(first[:-1], n)
        some = n > 0
        longest = int(n.max()) + 1
        one[some] = np.add.reduceat(v * powers(BASE_1, longest)[place], first[:-1][some])
        two[some] = np.add.reduceat(mix(v) * powers(BASE_2, longest)[place], first[:-1][some])
    return mix(one + n.astype(U64)), mix(two + n.astype(U64) * MIX_1), n


def same_folded(a: list, b: list) -> np.ndarray:
    """Whether a[i] and b[i] agree in everything but what the fold table skips."""
    ca, cb = Codes(a), Codes(b)
    ka, kb = fold(ca.codes), fold(cb.codes)
    pa_, pb_ = np.flatnonzero(ka), np.flatnonzero(kb)
    fa, fb = np.searchsorted(pa_, ca.start), np.searchsorted(pb_, cb.start)
    na, nb = np.diff(fa), np.diff(fb)
    same = na == nb
    keep_a, keep_b = pa_[np.repeat(same, na)], pb_[np.repeat(same, nb)]
    bad = np.flatnonzero(ka[keep_a] != kb[keep_b])
    if len(bad):
        owner = np.repeat(np.flatnonzero(same), na[same])
        same[owner[bad]] = False
    return same


def _fields(kind: str, values: list) -> list[list]:
    """The fields of each record, or None for what is no case."""
    if kind == "record":
        return [list(v) for v in values]
    out = []
    for (line,) in values:
        try:
            o = json.loads(line) if line else None
        except (ValueError, RecursionError):
            o = None
        if not isinstance(o, dict):
            out.append(None)
            continue
        out.append([x if isinstance(x := o.get(f), str) else "" if x is None else json.dumps(x, sort_keys=True) for f in LINE_FIELDS])
    return out


def _hashed(kind: str, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = _fields(kind, rows)
    width = 2 if kind == "record" else len(LINE_FIELDS)
    one = two = np.zeros(len(got), U64)
    case = np.array([g is not None for g in got], bool)
    for f in range(width):
        a, b, n = folded_hashes(Codes([g[f] if g else "" for g in got]))
        one, two = mix(one * BASE_2 + a), mix(two * BASE_1 + b)
        if f == 1:  # the text
            case &= n > 0
    return one, two, case


def _same_records(kind: str, a: list, b: list) -> np.ndarray:
    fa, fb = _fields(kind, a), _fields(kind, b)
    ok = np.ones(len(a), bool)
    for f in range(2 if kind == "record" else len(LINE_FIELDS)):
        ok &= same_folded([x[f] if x else "" for x in fa], [x[f] if x else "" for x in fb])
    return ok


def _canonical_digest(kind: str, rows: list) -> list[str]:
    import hashlib

    out = []
    for g in _fields(kind, rows):
        h = hashlib.sha256()
        for x in g or ():
            k = fold(Codes([x]).codes)
            h.update(k[k != 0].tobytes() + b"\xff\xff\xff\xff")
        out.append(h.hexdigest())
    return out


def format_copies(df: DataFrame, key: str, fields: list[str], kind: str) -> DataFrame:
    """(first_key, copy_key) of each copy. kind: `record` compares two fields, the second being the text; `line` JSON objects."""
    rows = df.select(F.col(key).cast("string").alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    rows = rows.where(F.col("key").isNotNull())
    width = len(fields)

    def make():
        def f(b: pa.RecordBatch):
            one, two, case = _hashed(kind, list(zip(*[b.column(i + 1).to_pylist() for i in range(width)])))
            return record(key=b.column(0).filter(pa.array(case)), h1=one[case].view(np.int64), h2=two[case].view(np.int64))

        return f

    hashed = written(map_batches(rows, make, "key string, h1 bigint, h2 bigint"), "fold-hashes")
    groups = hashed.groupBy("h1", "h2").agg(F.min("key").alias("first_key"), F.max("key").alias("last"))
    groups = groups.where(F.col("first_key") != F.col("last")).drop("last")
    pairs = salted_join(hashed, groups, ["h1", "h2"], spread="key").where(F.col("key") != F.col("first_key"))
    pairs = written(pairs.select("first_key", F.col("key").alias("copy_key")).distinct(), "fold-pairs")
    wanted = pairs.select(F.col("copy_key").alias("key")).union(pairs.select("first_key")).distinct()
    texts = rows.join(checked_broadcast(wanted), "key").dropDuplicates(["key"])
    cols = [f"f{i}" for i in range(width)]
    firsts = texts.join(pairs.select(F.col("first_key").alias("key")).distinct(), "key", "left_semi")
    firsts = firsts.select(F.col("key").alias("first_key"), *[F.col(c).alias("o" + c) for c in cols])
    both = texts.select(F.col("key").alias("copy_key"), *cols).join(pairs, "copy_key")
    both = salted_join(both, firsts, ["first_key"], spread="copy_key").select("first_key", "copy_key", *cols, *["o" + c for c in cols])

    def check():
        def f(b: pa.RecordBatch):
            own = list(zip(*[b.column(2 + i).to_pylist() for i in range(width)]))
            other = list(zip(*[b.column(2 + width + i).to_pylist() for i in range(width)]))
            ok = _same_records(kind, other, own)
            digest = [None if o else d for o, d in zip(ok, _canonical_digest(kind, own))] if not ok.all() else [None] * len(ok)
            return record(first_key=b.column(0), copy_key=b.column(1), digest=pa.array(digest, pa.string()))

        return f

    checked = map_batches(both, check, "first_key string, copy_key string, digest string")
    checked = written(checked, "fold-checked")
    good = checked.where(F.col("digest").isNull()).select("first_key", "copy_key")
    # rows that only share the hash form groups of their own, by a digest of what the table keeps
    rest = checked.where(F.col("digest").isNotNull())
    own = rest.groupBy("digest").agg(F.min("copy_key").alias("first_key"))
    rest = salted_join(rest.select("digest", "copy_key"), own, ["digest"], spread="copy_key").where("first_key <> copy_key")
    return good.unionByName(rest.select("first_key", "copy_key"))


def cases(df: DataFrame, key: str, fields: list[str], kind: str) -> DataFrame:
    """(key) of the records that can have copies, each once."""
    width = len(fields)
    rows = df.select(F.col(key).cast("string").alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).where(F.col("key").isNotNull())

    def make():
        def f(b: pa.RecordBatch):
            case = _hashed(kind, list(zip(*[b.column(i + 1).to_pylist() for i in range(width)])))[2]
            return record(key=b.column(0).filter(pa.array(case)))

        return f

    return map_batches(rows, make, "key string").distinct()


def collapsed(keys: DataFrame, copies: DataFrame) -> DataFrame:
    """(first_key, copies): one row per record of cases(), itself counted; copies is 1 where nothing else captured it."""
    n = copies.groupBy("first_key").agg((F.count(F.lit(1)) + 1).alias("copies"))
    firsts = keys.join(copies.select(F.col("copy_key").alias("key")), "key", "left_anti").withColumnRenamed("key", "first_key")
    return firsts.join(n, "first_key", "left").select("first_key", F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))
