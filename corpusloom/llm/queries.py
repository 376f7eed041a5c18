"""Queries of the subpackage; each reads its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import formatdup, leak, mixing, neardup, packing, pii, quality, spans, tokens, truncation
from corpusloom.llm.sql import ORACLE  # noqa: F401 - read by the entry
from corpusloom.runtime import table, written


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pieces", spread=True).select("id", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.findings(table(spark, sf_dir, "pieces", spread=True)).distinct()


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "pieces"), "id", "text", ("word_count",)).drop("is_text")


def p1_wrong_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word counts that don't hold, beside the counts that do."""
    rows = quality.measured(table(spark, sf_dir, "pieces", spread=True), "id", "text", ("word_count",))
    return rows.where("word_count <> 0 and word_count <> words").select("id", "word_count", F.col("words").cast("bigint").alias("words"))


def p2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_spans(_pieces(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_spans(spark, sf_dir).select("item_id", "id").distinct()


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each concerned piece with the leaked passages cut out."""
    done = leak.without_spans(_pieces(spark, sf_dir), p2_spans(spark, sf_dir))
    return done.where("removed_chars > 0")


def _in_batches(pieces: DataFrame, batches: int, compact_at: int | None = None) -> DataFrame:
    """(id, shared_chars) from an index fed batch by batch: what each batch shares with itself and all before it, put together."""
    index = spans.FingerprintIndex(pieces.sparkSession)
    got = None
    for i in range(batches):
        if i == compact_at:
            index.compact()
        name = index.append(pieces.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i))
        new = spans.batch_stretches(pieces, index, name)
        got = new if got is None else got.unionByName(new)
    return spans.shared_by_id(index, got)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records come in two batches; the second is merge-joined with the run of the first."""
    return _in_batches(_pieces(spark, sf_dir), 2)


def p3_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from three batches with a compaction before the last."""
    return _in_batches(_pieces(spark, sf_dir), 3, compact_at=2)


def p3_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last of three batches shares with anything: records that it has no part in aren't listed."""
    pieces = _pieces(spark, sf_dir)
    index = spans.FingerprintIndex(spark)
    names = [index.append(pieces.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i)) for i in range(3)]
    return spans.shared_chars(pieces, index, names[-1])


def _people(spark: SparkSession, sf_dir: str):
    """(table, keys, texts, model) of the tables with free text."""
    pieces, comments = (table(spark, sf_dir, t, spread=True) for t in ("pieces", "li_comments"))
    model = pii.fit(table(spark, sf_dir, "given_names"), [pieces.select("text"), comments.select("Message")])
    yield "pieces", pieces.select(F.col("id").alias("rec_key"), "text"), model
    yield "li_comments", comments.select(F.col("comment_id").cast("string").alias("rec_key"), F.col("Message").alias("text")), model


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [pii.found(df, "rec_key", "text", m).select(F.lit(n).alias("tbl"), "rec_key", "kind") for n, df, m in _people(spark, sf_dir)]
    return parts[0].unionByName(parts[1]).where(F.col("rec_key").isNotNull()).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of its personal items."""
    parts = [pii.redacted(df, "rec_key", "text", m).withColumn("tbl", F.lit(n)) for n, df, m in _people(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


RECORDS = (("pieces", "id", ["source", "text"], "record"), ("index_lines", "line_id", ["line"], "line"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, fields, kind in RECORDS:
        one = formatdup.format_copies(table(spark, sf_dir, name), key, fields, kind)
        one = one.select(F.lit(name).alias("tbl"), "first_key", "copy_key")
        out = one if out is None else out.unionByName(one)
    return out


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that is a case, with the number of its captures."""
    out = None
    for name, *how in RECORDS:
        df = table(spark, sf_dir, name)
        one = formatdup.collapsed(formatdup.cases(df, *how), formatdup.format_copies(df, *how)).select(F.lit(name).alias("tbl"), "first_key", "copies")
        out = one if out is None else out.unionByName(one)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(spark, sf_dir)
    members, links = neardup.similar(pieces, threshold=0.6, run=3)
    return neardup.similar_ids(members, links).unionByName(neardup.folded_copies(pieces)).distinct()


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates at five words and 0.8: one row per piece with its group and its number of links."""
    pieces = _pieces(spark, sf_dir)
    links = neardup.similar(pieces)[1]
    return neardup.groups(neardup.word_classes(pieces).distinct(), links)


def p8_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of each document, or of each part of one above the capacity."""
    sizes = tokens.token_counts(table(spark, sf_dir, "documents", spread=True), "doc_id", "text")
    return packing.packed(sizes, "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_sequences(spark, sf_dir))


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(tokens.token_counts(table(spark, sf_dir, "documents", spread=True), "doc_id", "text", ("source",)), "sizes")
    return mixing.uses(sizes, table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_uses(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(p9_uses(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents", spread=True), "doc_id", "text").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, those cut off, their share, and how many of these have a longer copy."""
    docs = table(spark, sf_dir, "documents", spread=True)
    cut = truncation.truncated(docs, "doc_id", "text")
    n = F.count(F.lit(1))
    by = docs.select("doc_id", "source").join(cut, "doc_id", "left").groupBy("source").agg(
        n.alias("documents"), F.count("reason").alias("cut_off"), F.count_if("longer_copy").alias("longer_copies")
    )
    return by.withColumn("rate", F.col("cut_off") / F.col("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_statistics, p1_wrong_counts, p2_found, p2_spans, p2_clean, p3_found, p3_incremental, p3_last_batch, p4_found, p4_redacted, p6_found, p6_counts, p7_found, p7_groups, p8_sequences, p8_fill, p9_uses, p9_shares, p9_mixture, p10_found, p10_rates)}
