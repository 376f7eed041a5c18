"""Scans: index files, network exports, local documents, pair files, zips."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, pairs, rewrite
from corpusloom.runtime import file_system, path_exists, shared_dir
from corpusloom.schema import PIECE, lenient

SUFFIXES = ("txt", "md", "markdown", "rst", "eml", "html", "htm", "org", "text")
#: Columns an export may spell a field with; an exact name wins over one that only contains it.
ALIASES = {
    "ShareCommentary": ("sharecommentary", "commentary", "text", "content"), "Message": ("message", "comment", "text", "content"), "Date": ("date", "published", "created"),
    "ShareLink": ("sharelink", "url", "link"), "Title": ("title", "headline", "name"), "Content": ("content", "body", "text", "article"),
}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of a JSON-lines file; none if there is no file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], PIECE)
    return lenient(spark.read.text(path), "value")


def resolve_columns(names: list[str], fields: list[str]) -> list[Column]:
    """For each field the first filled among its columns: exact names first, then names that contain one."""
    low = {n: n.strip().lower() for n in names}
    out = []
    for f in fields:
        want = ALIASES[f]
        hit = [n for a in want for n in names if low[n] == a] + [n for a in want for n in names if a in low[n] and low[n] != a]
        cols = [F.col(f"`{n}`") for n in dict.fromkeys(hit)]
        out.append((corpus.first_filled(*cols) if cols else F.lit(None).cast("string")).alias(f))
    return out


def sniff(raw: bytes) -> tuple[str, str]:
    """Encoding and separator of a file: UTF-8 if all of it is, else Latin-1; the commonest separator of its first line."""
    try:
        head, enc = raw.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        head, enc = raw.decode("latin-1"), "latin1"
    head = head.split("\n", 1)[0]
    return enc, max(",\t;", key=head.count)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file of any file system; its bytes are looked at where they are read, not on the driver."""
    look = F.pandas_udf(lambda s: pd.DataFrame([sniff(bytes(x)) for x in s], columns=["enc", "sep"]), "struct<enc:string,sep:string>")
    enc, sep = spark.read.format("binaryFile").load(path).select(look("content").alias("x")).select("x.*").first()
    return spark.read.options(header=True, multiLine=True, sep=sep, encoding=enc, quote='"', escape='"', mode="PERMISSIVE").csv(path)


def export_kind(path: str) -> str | None:
    """share before comment before article, by the stem or the folder."""
    p = PurePosixPath(path)
    stem = p.stem.lower()
    for k in ("share", "comment", "article"):
        if k in stem or (k == "article" and p.parent.name.lower().startswith("article")):
            return k
    return None


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of a network export folder or zip, of any file system."""
    root = unzipped(spark, folder) if folder.endswith(".zip") else folder
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path").orderBy("path").collect()
    need = {"share": ["ShareCommentary", "Date", "ShareLink"], "comment": ["Message", "Date"], "article": ["Title", "Content", "Date"]}
    got: dict[str, DataFrame] = {}
    for (f,) in files:  # a few files, their names only
        if k := export_kind(f):
            t = read_table(spark, f)
            t = t.select(*resolve_columns(t.columns, need[k]))
            got[k] = got[k].unionByName(t) if k in got else t
    empty = lambda k: spark.createDataFrame([], ", ".join(f"{c} string" for c in need[k]))
    return corpus.export_pieces(*[got.get(k) if k in got else empty(k) for k in need])


def unzipped(spark: SparkSession, path: str, cache: str | None = None) -> str:
    """Unpack once into the shared folder, under a name made of path and time of change; a marker shows that it is whole.

    Members that leave the folder fail. A zip of up to 2 GB, the most that one value may hold.
    """
    raw = spark.read.format("binaryFile").load(path)
    changed = raw.select(F.col("modificationTime").cast("string")).first()[0]
    out = f"{cache or shared_dir(spark) + '/unpacked'}/{hashlib.sha256(f'{path}|{changed}'.encode()).hexdigest()[:16]}"
    if not path_exists(spark, f"{out}/.done"):
        with zipfile.ZipFile(io.BytesIO(bytes(raw.select("content").first()[0]))) as z:
            for m in z.namelist():
                if m.startswith("/") or ".." in m.split("/"):
                    raise ValueError(f"{m} leaves the folder")
            for m in [*z.namelist(), None]:
                if m is None or not m.endswith("/"):
                    fs, p = file_system(spark, f"{out}/{m or '.done'}")
                    stream = fs.create(p, True)
                    stream.write(bytearray(z.read(m) if m else b""))
                    stream.close()
    return out


def read_documents(spark: SparkSession, path: str, recursive: bool = True, hint: str | None = None) -> DataFrame:
    """Pieces of local files, one each; a single file is read whatever its suffix."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    fs, p = file_system(spark, path)
    if not (fs.exists(p) and fs.getFileStatus(p).isFile()):
        reader = reader.option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}")
    raw = reader.format("binaryFile").load(path)
    where = F.col("path")
    text = F.decode("content", "utf-8")
    stem = F.regexp_extract(where, r"([^/]+?)(?:\.[^./]*)?$", 1)
    suffix = F.lower(F.regexp_extract(where, r"\.([^./]+)$", 1))
    body = F.when(suffix == "eml", F.when(text.contains("\n\n"), F.regexp_replace(text, r"(?s)^.*?\n\n", "")).otherwise(text)).otherwise(text)
    rows = raw.select(where.alias("path"), stem.alias("title"), suffix.alias("suffix"), body.alias("raw"), F.date_format("modificationTime", "yyyy-MM-dd").alias("changed"))
    page = F.col("suffix").isin("html", "htm")
    rows = rows.where(~page).withColumn("t", F.col("raw")).unionByName(rows.where(page).withColumn("t", rewrite.by_text(rewrite.html_lines, "string")(F.col("raw"))))
    first = F.slice(F.split("raw", "\n"), 1, 5)
    dates = F.filter(F.transform(first, lambda s: corpus.parse_day(F.regexp_replace(s, "(?i)^date:\\s*", ""))), lambda d: d.isNotNull())
    day = F.coalesce(corpus.parse_day(F.regexp_extract("title", r"((?:19|20)\d{2}(?:-\d{2}-\d{2})?)", 1)), F.try_element_at(dates, F.lit(1)), F.col("changed").cast("date"))
    clean = corpus.light_clean(F.col("t"))
    return rows.select(
        T.stable_id(F.lit("local"), F.col("path"), F.substring(clean, 1, corpus.ID_FILE_TEXT)).alias("id"),
        corpus.guess_source(F.col("path"), F.lit(hint) if hint else None).alias("source"), clean.alias("text"), "path", F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.year(day).alias("year"), T.word_count(clean).alias("word_count"), "title", F.create_map().cast("map<string,string>").alias("meta"),
    ).where("text <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw) of every line of a text file from 0 on, read in splits: a number is its place in the split and the lines before the split."""
    rows = spark.read.text(path).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("own"), F.col("value").alias("raw"))
    sizes = {r[0]: r[1] for r in rows.groupBy("part").agg(F.count(F.lit(1))).collect()}  # one row per split
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    start = F.get(F.array(*map(F.lit, before or [0])).cast("array<bigint>"), F.col("part"))
    return rows.select((start + F.col("own").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"), "raw")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pos, input, output, raw) of a pair file; a line that is no object, or holds no pair, fails with its number."""
    lines = numbered_lines(spark, path).where(F.trim("raw") != "")
    i, o = pairs.pair_texts(F.col("raw"))
    line = (F.col("pos") + 1).cast("string")
    kind = F.schema_of_variant(F.try_parse_json("raw"))
    none = F.raise_error(F.concat(F.lit("no object in line "), line))
    bad = F.raise_error(F.concat(F.lit("no pair in line "), line))
    first = F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), none).when(i.isNull() | o.isNull(), bad).otherwise(i)
    return lines.select("pos", first.alias("input"), o.alias("output"), "raw")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a holdout file: a bare list, or a list under holdout_ids or ids."""
    v = spark.read.text(path, wholetext=True)
    ids = F.coalesce(*[F.from_json(x, "array<string>") for x in (F.get_json_object("value", "$.holdout_ids"), F.get_json_object("value", "$.ids"), F.col("value"))])
    return v.select(F.explode(ids).alias("id"))


def iter_index(spark: SparkSession, path: str) -> Iterator[Row]:
    """Pieces of an index file one by one; the driver holds one partition at a time."""
    return read_index(spark, path).toLocalIterator()


def read_draft(spark: SparkSession, text: str | None = None, path: str | None = None) -> str:
    """A draft given as text or as a file; exactly one of the two."""
    if (text is None) == (path is None):
        raise ValueError("give a text or a file")
    return text if path is None else spark.read.text(path, wholetext=True).first()[0]
