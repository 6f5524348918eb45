"""Readers of raw transcripts into one sentence table: explicit schemas, aliases of columns, files read where they lie."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import cut

SPEECH = "text string, date string, speaker string, country string, source_file string, source_speech_id string, source_dataset string, source_dataset_type string"


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, exclude_countries: Sequence[str] = ()) -> DataFrame:
    """Column-pruned scan with the country filter pushed down; rows with a null country go with the filter."""
    df = spark.read.parquet(path)
    if exclude_countries:
        df = df.filter(~F.col("country").isin(*exclude_countries))
    return df.select(*columns) if columns else df


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file with header, everything as text. A file is split over tasks; ``multi_line`` allows line breaks within fields, but makes each file one task:
    large files of that kind should come as many."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, enforceSchema=False)
    return df.limit(limit) if limit else df


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a CSV file, quoted ones too."""
    first = spark.read.text(path).first()
    return [h.strip() for h in next(csv.reader([first.value.lstrip("\ufeff")], delimiter=sep))] if first else []


def row_index(df: DataFrame, out: str = "row_seq") -> DataFrame:
    """Rows with their 0-based place in the order they were read: numbered within their partition, shifted by the counts of those before."""
    d = df.withColumn("__m", F.monotonically_increasing_id())
    d = cut(d.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m"))
    counts = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # as many rows as partitions
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(counts.select("__p", before.alias("__b"))), "__p").withColumn(out, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Canonical columns by the first alias present, whatever its case; an error names what is missing."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, options in aliases.items():
        hit = next((have[o.lower()] for o in (name, *options) if o.lower() in have), None)
        if hit is None:
            raise ValueError(f"no column for {name} among {df.columns}")
        out.append(F.col(f"`{hit}`").alias(name))
    return df.select(*out)


def with_columns_or_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


_TEI = "{http://www.tei-c.org/ns/1.0}"


def tei(spark: SparkSession, path: str, dataset_type: str = "tei") -> DataFrame:
    """Utterances of TEI transcripts below ``path``: mixed content in order, speaker and id from attributes, date from two places; bad files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    root = ElementTree.fromstring(content)
                except ElementTree.ParseError:
                    continue
                when = next((e.get("when") for q in (f".//{_TEI}setting/{_TEI}date", f".//{_TEI}date") for e in root.findall(q) if e.get("when")), None)
                m = re.search(r"ParlaMint-([A-Z]{2})", p)
                country = m.group(1) if m else None
                for u in root.iter(f"{_TEI}u"):
                    t = " ".join("".join(u.itertext()).split())
                    if t:
                        rows.append((t, when, (u.get("who") or "").lstrip("#"), country, p.rsplit("/", 1)[-1], u.get("{http://www.w3.org/XML/1998/namespace}id") or "", f"TEI-{country}", dataset_type))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPEECH.split(", ")])

    return files.mapInPandas(parse, SPEECH)


def tei_names(spark: SparkSession, path: str) -> DataFrame:
    """``who, name`` of the person lists below ``path`` (forename surname); folders of samples are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*listPerson*.xml").load(path).filter(~F.contains("path", F.lit("Samples"))).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    root = ElementTree.fromstring(content)
                except ElementTree.ParseError:
                    continue
                for p in root.iter(f"{_TEI}person"):
                    parts = [" ".join(e.text.split()) for tag in ("forename", "surname") for e in p.iter(f"{_TEI}{tag}") if e.text]
                    rows.append((p.get("{http://www.w3.org/XML/1998/namespace}id"), " ".join(parts)))
            yield pd.DataFrame(rows, columns=["who", "name"])

    return files.mapInPandas(parse, "who string, name string").filter("who IS NOT NULL").dropDuplicates(["who"])


def speech_csv(df: DataFrame, text: str, country: str, dataset: str, year_below: int | None = None, year_from: int | None = None, speech_id: Sequence[str] = ("speechnumber",), speaker: str = "speaker", date: str = "date") -> DataFrame:
    """Rows of a speech CSV with text; years in [from, below); the id is the first that isn't missing ('' , NA, nan), else the row's place in the file."""
    y = X.year_of(F.col(date))
    df = row_index(df, "__row")
    d = df.filter(X.text_or_null(F.col(text)).isNotNull())
    if year_below is not None:
        d = d.filter(y < year_below)
    if year_from is not None:
        d = d.filter(y >= year_from)
    ids = [F.when(~F.col(c).isin("", "NA", "nan"), F.col(c)) for c in speech_id if c in df.columns]
    sid = F.coalesce(*ids, F.col("__row").cast("string"))
    return d.select(F.col(text).alias("text"), F.col(date).alias("date"), F.coalesce(speaker, F.lit("")).alias("speaker"), F.lit(country).alias("country"), F.lit(dataset + ".csv").alias("source_file"), sid.alias("source_speech_id"), F.lit(dataset).alias("source_dataset"), F.lit("speech-csv").alias("source_dataset_type"))


def piped(spark: SparkSession, speeches: str, descriptions: str, before_year: int | None = None) -> DataFrame:
    """Pipe-delimited speech files and their descriptions (paths or globs) joined on speech_id: only the first delimiter of a speech line counts, dates are YYYYMMDD, chambers H and S."""
    s = spark.read.text(speeches).select(F.split("value", r"\|", 2).alias("p"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("f")).select("f", F.col("p")[0].alias("speech_id"), X.strip_controls(F.col("p")[1]).alias("text")).filter("speech_id <> 'speech_id' AND text IS NOT NULL")
    d = csv_strings(spark, descriptions, header(spark, descriptions, "|"), sep="|")
    d = d.filter(F.col("chamber").isin("H", "S")).withColumn("d", F.try_to_timestamp(F.col("date"), F.lit("yyyyMMdd")).cast("date"))
    if before_year:
        d = d.filter(F.year("d") < before_year)
    full = F.trim(F.concat_ws(" ", X.text_or_null(F.col("first_name")), X.text_or_null(F.col("last_name"))))
    return s.join(d, "speech_id").select("text", F.col("d").cast("string").alias("date"), F.when(full != "", full).otherwise(F.col("speaker")).alias("speaker"), F.lit("US").alias("country"), F.col("f").alias("source_file"), F.col("speech_id").alias("source_speech_id"), F.lit("daily-US").alias("source_dataset"), F.lit("piped").alias("source_dataset_type"))


RECORD = "header struct<year string, month string, day string>, id string, content array<struct<kind string, text string, speaker string, itemno int>>"


def record_json(spark: SparkSession, path: str, year_from: int = 1994, skip: str = "PgE") -> DataFrame:
    """Speech items of nested JSON records; files named like ``skip`` are left out."""
    j = spark.read.schema(RECORD).option("multiLine", "true").json(path).withColumn("f", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).filter(~F.contains("f", F.lit(skip)))
    j = j.filter(F.col("header.year").try_cast("int") >= year_from).select("f", "id", F.try_to_timestamp(F.concat_ws(" ", "header.year", "header.month", "header.day"), F.lit("yyyy MMMM d")).cast("date").cast("string").alias("date"), F.posexplode("content").alias("n", "c")).filter("c.kind = 'speech'")
    who = F.when(F.lower(F.trim("c.speaker")).isin("none", "null"), "").otherwise(F.coalesce("c.speaker", F.lit("")))
    return j.select(F.col("c.text").alias("text"), "date", who.alias("speaker"), F.lit("US").alias("country"), F.col("f").alias("source_file"), F.concat(F.col("id"), F.lit("-item"), F.coalesce(F.col("c.itemno"), F.col("n")).cast("string")).alias("source_speech_id"), F.lit("record-US").alias("source_dataset"), F.lit("record-json").alias("source_dataset_type"))


def jdbc(spark: SparkSession, url: str, table: str, date: str, bounds: Sequence[tuple[str, str]], fetch: int = 10_000, **options: str) -> DataFrame:
    """A database table in parallel: one predicate per [from, to) of its date column, server-side cursor."""
    preds = [f"{date} >= '{a}' AND {date} < '{b}'" for a, b in bounds]
    return spark.read.jdbc(url, table, predicates=preds, properties={"fetchsize": str(fetch), **options})


def sentence_table(speeches: DataFrame) -> DataFrame:
    """One row per sentence of three words or more, numbered from 0 within its speech after short ones are dropped."""
    s = speeches.select(*[c for c in speeches.columns if c != "text"], F.posexplode(X.sentences(F.col("text"))).alias("sentence_idx", "sentence"))
    return s.select("sentence", "sentence_idx", "date", "speaker", "country", "source_file", "source_speech_id", "source_dataset", "source_dataset_type")


def before_cutoffs(df: DataFrame, cutoffs: DataFrame, dataset: str = "source_dataset", date: str = "date") -> DataFrame:
    """Rows before their dataset's cutoff year, where another corpus takes over; datasets without cutoff stay whole."""
    c = cutoffs.select(F.col(dataset).alias("__d"), "cutoff_year")
    return df.join(c, F.col(dataset) == F.col("__d"), "left").filter(F.col("cutoff_year").isNull() | (X.year_of(F.col(date)) < F.col("cutoff_year"))).drop("__d", "cutoff_year")
