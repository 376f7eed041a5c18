"""Command line: python -m corpusloom COMMAND. Results are JSON lines; gates speak through the exit code, bad arguments are 2."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus, dedupe, finish, pairs, style
from corpusloom.operators.drafting import article_floors
from corpusloom.schema import completed
from corpusloom.sources import readers, samples, writers


def _show(df: DataFrame) -> None:
    for r in df.toJSON().toLocalIterator():
        print(r)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c.add_argument(a, **k) for c in (sub.add_parser(name),) for a, k in args]
    index, text, ratio = ("index", {}), ("text", {}), ("--near-ratio", {"type": float, "default": dedupe.NEAR_RATIO})
    add("ingest", index, ("--export", {}), ("--documents", {}))
    add("dedupe-index", index, ratio, ("--apply", {"action": "store_true"}))
    add("select", index, ("--min-words", {"type": int, "default": 40}), ("--through-year", {"type": int}), ("--out", {}))
    add("build-style-profile", index, ("--out", {}))
    add("style-directives", index, ("--channel", {"default": "post"}))
    add("status", index)
    add("scorecard", text, ("--channel", {}))
    add("classify", text)
    add("pair-gate", ("pairs", {}), ("--kept", {}))
    add("sterile-check", ("author", {}), ("foreign", {}))
    add("demo")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    pieces = lambda: completed(spark.read.parquet(a.index))
    if a.command == "ingest":
        batches = {("export", a.export): readers.read_export(spark, a.export)} if a.export else {}
        batches |= {("documents", a.documents): readers.read_documents(spark, a.documents)} if a.documents else {}
        added, came = writers.run_ingest(spark, a.index, f"{a.index}.sources", batches)
        print(f'{{"added":{added},"rows":{came}}}')
    elif a.command == "dedupe-index":
        _show(writers.apply_dedupe(spark, a.index, a.near_ratio) if a.apply else dedupe.report(spark.read.parquet(a.index), a.near_ratio))
    elif a.command == "select":
        got = corpus.select_pieces(pieces(), min_words=a.min_words, through_year=a.through_year)
        if a.out:
            writers.swap(got.select("id"), a.out)  # written before the gate speaks
        gate = corpus.size_gate(got)
        _show(gate)
        return 2 if gate.head()["blocked"] else 0
    elif a.command in ("build-style-profile", "style-directives"):
        card = style.style_profile(pieces())
        if a.command == "style-directives":
            card = style.directives(card, a.channel)
        elif a.out:
            writers.write_record(card, a.out)
        _show(card)
    elif a.command == "status":
        _show(corpus.summary(pieces()))
        _show(article_floors(pieces()))
    elif a.command in ("scorecard", "classify"):
        c = F.lit(a.text)
        row = style.scorecard(c, F.lit(a.channel)) if a.command == "scorecard" else F.struct(finish.sloppy(c).alias("sloppy"), finish.in_voice(c).alias("in_voice"), finish.soulless(c).alias("soulless"))
        got = spark.range(1).select(row.alias("s")).select("s.*")
        _show(got)
        return 0 if a.command == "classify" or got.head()["pass"] else 1
    elif a.command == "pair-gate":
        rows = readers.read_pairs(spark, a.pairs)
        gated = pairs.gate(rows.withColumn("meta", F.from_json("raw", "map<string,string>")))
        _show(pairs.gate_report(gated))
        if a.kept:
            writers.write_kept(rows, gated, a.kept)
        return 1 if gated.where("not pass").limit(1).count() else 0
    elif a.command == "sterile-check":
        rows = spark.createDataFrame([(a.author, a.foreign)], "author string, foreign string")
        got = pairs.sterile(rows, "author", "foreign").select("failed", "pass")
        _show(got)
        return 0 if got.head()["pass"] else 1
    elif a.command == "demo":
        _show(corpus.summary(completed(samples.demo_corpus(spark).withColumn("word_count", F.lit(0)))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
