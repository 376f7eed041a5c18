"""Evaluation passages inside corpus texts.

The n-grams of all evaluation items are hashed into one sorted array, which is broadcast; the windows of the corpus are
looked up in it batch by batch, so the corpus is read once and never shuffled. Every hit is verified word by word.
The array's size is checked: items beyond the bound are taken in further blocks, each of which scans the corpus.

Defined cases: null or empty texts and items of fewer than n words give no hit; repeated items all count; an item's
words are maximal runs of letters or digits, lower-cased, so punctuation, markup and case between them don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import Codes, Words, fold
from corpusloom.llm.frames import map_batches, record
from corpusloom.runtime import checked_broadcast, written

N_WORDS = 20
#: Characters of evaluation text per broadcast block; its n-gram arrays take about four bytes for each.
BLOCK_CHARS = 20_000_000
SPANS = "id string, item_id bigint, begin int, end int"


def _folded(c: Codes, b: int, e: int) -> bytes:
    """The words of a stretch as folded code points with single gaps."""
    k = fold(c.codes[b:e])
    on = k != 0
    gap = np.zeros(len(k), bool)
    gap[1:] = on[:-1] & ~on[1:]
    return k[on | gap].tobytes().rstrip(b"\0")


class GramTable:
    """Hashes of all n-grams of a block of items, sorted, each with its item and place."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        c = Codes(texts)
        w = Words(c)
        h, at = w.grams(n)
        order = np.argsort(h, kind="stable")
        self.n, self.ids = n, np.array(ids, np.int64)
        self.hash, self.at = h[order], at[order]
        item = np.repeat(np.arange(c.n), np.diff(w.first))
        self.item = item[self.at] if len(h) else np.empty(0, np.int64)
        self.codes, self.begin, self.end = c, w.begin, w.end

    def passage(self, k: int) -> bytes:
        j = self.at[k]
        return _folded(self.codes, self.begin[j], self.end[j + self.n - 1])


def leaks_in(table: GramTable, ids: list, texts: list) -> tuple[list, list, list, list]:
    """(id, item_id, begin, end) of each maximal verified stretch of an item's words in each text."""
    c = Codes(texts)
    w = Words(c)
    h, at = w.grams(table.n)
    lo = np.searchsorted(table.hash, h, "left")
    hit = np.flatnonzero((lo < len(table.hash)) & (table.hash[np.minimum(lo, max(len(table.hash) - 1, 0))] == h)) if len(table.hash) else []
    text = np.repeat(np.arange(c.n), np.diff(w.first))
    runs: dict[tuple[int, int], list[list[int]]] = {}
    for i in hit:
        j = int(at[i])
        own = None
        k = int(lo[i])
        while k < len(table.hash) and table.hash[k] == h[i]:
            own = own or _folded(c, w.begin[j], w.end[j + table.n - 1])
            if table.passage(k) == own:
                spans = runs.setdefault((int(text[j]), int(table.item[k])), [])
                if spans and j <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], j)
                else:
                    spans.append([j, j])
            k += 1
    out: tuple[list, list, list, list] = ([], [], [], [])
    for (t, item), spans in runs.items():
        for a, b in spans:
            out[0].append(ids[t])
            out[1].append(int(table.ids[item]))
            out[2].append(int(w.begin[a] - c.start[t]))
            out[3].append(int(w.end[b + table.n - 1] - c.start[t]))
    return out


def _blocks(items: DataFrame) -> Iterator[list]:
    """Blocks of about BLOCK_CHARS characters, each given away when it is full: the driver holds one, and the corpus never comes here."""
    block, size = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r[1])
    yield block


def leaked_spans(corpus: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(id, item_id, begin, end) for corpus(id, text) and items(item_id, text); code points, end exclusive."""
    spark = corpus.sparkSession
    items = items.select(F.col("item_id").cast("bigint"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    corpus = corpus.select(F.col("id").cast("string").alias("id"), "text").where(F.length("text") >= 2 * n - 1)
    out = None
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(GramTable([r[0] for r in block], [r[1] for r in block], n))

        def make(sent=sent):
            table = sent.value

            def f(b: pa.RecordBatch):
                ids, item, begin, end = leaks_in(table, b.column(0).to_pylist(), b.column(1).to_pylist())
                return record(
                    id=pa.array(ids, pa.string()), item_id=pa.array(item, pa.int64()), begin=pa.array(begin, pa.int32()), end=pa.array(end, pa.int32())
                )

            return f

        found = map_batches(corpus, make, SPANS)
        out = found if out is None else out.unionByName(found)
    return out


def without_spans(corpus: DataFrame, spans: DataFrame) -> DataFrame:
    """corpus(id, text) with leaked stretches cut out: (id, text, removed_chars). Texts without a leak stay as they are."""
    merged = spans.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("s"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    step = lambda a, x: F.struct(
        F.greatest(a["at"], x["end"]).alias("at"),
        F.concat(a["kept"], F.substring(F.col("text"), a["at"] + 1, F.greatest(x["begin"] - a["at"], F.lit(0)))).alias("kept"),
    )
    done = F.aggregate("s", start, step)
    j = corpus.select("id", "text").join(checked_broadcast(written(merged, "leaks")), "id", "left")
    text = F.when(F.col("s").isNull(), F.col("text")).otherwise(
        F.concat(done["kept"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    )
    return j.select("id", text.alias("clean"), (F.length("text") - F.length(text)).alias("removed_chars"))
