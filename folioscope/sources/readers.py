"""Sources with fixed schemas at the border. All reading goes through Spark, whatever the store."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a model file that name its kind and size.
HEADER = 64
GOLD_FIELDS = ("id", "dosya_adi", "gercek_baslik", "gercek_ozet", "gercek_yazarlar", "gercek_anahtar_kelimeler", "gercek_yil", "gercek_dergi", "gercek_doi", "gercek_baslik_en", "gercek_ozet_en", "gercek_anahtar_kelimeler_en", "durum")
GOLD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in GOLD_FIELDS])
API_SCHEMA = (
    "hits struct<hits: array<struct<_id: string, _source: struct<id: string, orderTitle: string, publicationYear: string, doi: string, pdf: string, journal: struct<name: string>,"
    " abstracts: array<struct<language: string, title: string, abstract: string, keywords: array<string>>>, authors: array<struct<name: string, inPublicationName: string>>, references: array<struct<context: string>>>>>>"
)
SCORE_SCHEMA = "titles array<string>, title string, abstracts array<string>, abstract string, authors array<string>, year string, journal string, doi string, found boolean"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, filled: str | None = None) -> DataFrame:
    """A metadata table; columns and the filter on a non-empty field reach the scan."""
    df = spark.read.parquet(path)
    if filled:
        df = df.filter(F.col(filled).isNotNull() & (F.col(filled) != ""))
    return df.select(*columns) if columns else df


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def align_schema(df: DataFrame, schema: T.StructType = GOLD_SCHEMA) -> DataFrame:
    """The schema's columns in order, empty strings where an older producer lacks one."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(f.name).cast(f.dataType), F.lit("")) if f.name in have else F.lit("")).alias(f.name) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header; a byte order mark, empty strings and None are handled."""
    df = spark.read.schema(schema).option("enforceSchema", True).csv(path, header=True, encoding="UTF-8", nullValue="", multiLine=True)
    clean = {c: F.nullif(F.regexp_replace(c, "^﻿", ""), F.lit("None")) for c, kind in df.dtypes if kind == "string"}
    return df.withColumns(clean)


def read_json_documents(spark: SparkSession, path: str, schema: str = SCORE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def gold_alternatives(df: DataFrame) -> DataFrame:
    """Older records with one title or abstract, and newer ones with lists, in one shape."""

    def lists(many: str, one: str) -> Column:
        filled = F.filter(F.coalesce(F.col(many), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
        return F.when(F.size(filled) > 0, filled).otherwise(F.filter(F.array(one), lambda x: x.isNotNull() & (F.trim(x) != "")))

    return df.withColumns({"titles": lists("titles", "title"), "abstracts": lists("abstracts", "abstract")}).drop("title", "abstract")


def read_embedded_json(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The value of ``const name = ...;`` in a script."""
    text = spark.read.text(path, wholetext=True)
    value = F.regexp_extract("value", rf"(?s)const\s+{name}\s*=\s*(.*?);\s*$", 1)
    return text.select(F.from_json(value, schema).alias("data"))


def read_markup(spark: SparkSession, path: str, pattern: str = r"(\d+)") -> DataFrame:
    """id (from the file's name) and text of each markup file."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_name", pattern, 1).alias("id"), F.col("value").alias("text"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; comments and blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter((F.col("id") != "") & ~F.col("id").startswith("#"))


def read_features(spark: SparkSession, path: str, least: int = 12) -> DataFrame:
    """Token and features of a whitespace-separated feature file."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts.alias("f")).filter(F.size("f") >= least).select(F.col("f")[0].alias("token"), F.col("f").alias("features"))


@F.arrow_udf(T.BinaryType())
def first_bytes(paths: pa.Array) -> pa.Array:
    """The first HEADER bytes of files, and no more of them; of any store that pyarrow's file systems reach."""
    out = []
    for path in paths.to_pylist():
        local = path.startswith("file:")
        store, place = (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if local else fs.FileSystem.from_uri(quote(path, safe=":/"))
        with store.open_input_file(place) as f:
            out.append(f.read(HEADER))
    return pa.array(out, pa.binary())


def read_model_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, kind and count of model files, from their first bytes. Spark lists the files and deals them out; contents are not loaded."""
    files = spark.read.format("binaryFile").load(path).select("path")
    head = F.decode(first_bytes("path"), "ISO-8859-1")
    return files.select("path", head.alias("head")).select("path", F.regexp_extract("head", r"^#mdl#(\d+)#", 1).alias("kind"), F.regexp_extract("head", r"^#mdl#\d+#(\d+)", 1).alias("count"))


def cut_pdf(content: Column) -> Column:
    """Bytes from %PDF- to the last %%EOF; the same when applied again."""
    text = F.decode(content, "ISO-8859-1")
    cut = F.regexp_extract(text, r"(?s)(%PDF-.*%%EOF)", 1)
    return F.when(cut == "", content).otherwise(F.encode(cut, "ISO-8859-1"))


def api_record(df: DataFrame, column: str = "value") -> DataFrame:
    """Nested records to flat metadata rows: values by language, first filled title, completeness."""
    s = F.try_element_at(F.from_json(column, API_SCHEMA)["hits"]["hits"], F.lit(1))["_source"]
    rows = df.select(s.alias("s"))

    def language(code: str) -> Column:
        return F.try_element_at(F.filter("s.abstracts", lambda a: a["language"] == code), F.lit(1))

    tr, en = language("TUR"), language("ENG")
    title = F.coalesce(F.nullif(tr["title"], F.lit("")), F.nullif(F.col("s.orderTitle"), F.lit("")), en["title"])
    authors = F.array_join(F.transform("s.authors", lambda a: F.coalesce(a["name"], a["inPublicationName"])), ", ")
    flat = rows.select(
        F.col("s.id").alias("id"), F.concat(F.lit("makale_"), F.col("s.id"), F.lit(".pdf")).alias("dosya_adi"), title.alias("gercek_baslik"), tr["abstract"].alias("gercek_ozet"), authors.alias("gercek_yazarlar"),
        F.array_join(tr["keywords"], ", ").alias("gercek_anahtar_kelimeler"), F.col("s.publicationYear").alias("gercek_yil"), F.col("s.journal.name").alias("gercek_dergi"), F.col("s.doi").alias("gercek_doi"),
        en["title"].alias("gercek_baslik_en"), en["abstract"].alias("gercek_ozet_en"), F.array_join(en["keywords"], ", ").alias("gercek_anahtar_kelimeler_en"),
    )
    from folioscope.functions.rules import completeness

    filled = flat.withColumns({c: F.coalesce(c, F.lit("")) for c in flat.columns})
    return filled.withColumn("durum", completeness(baslik=F.col("gercek_baslik"), ozet=F.col("gercek_ozet"), yazar=F.col("gercek_yazarlar")))


def broken_markup(markup: Column) -> Column:
    """The markup, if it is not well-formed; else null."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    return F.from_xml(markup, "corrupt string", options)["corrupt"]


def article_record(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Journal article markup to a flat row. A row whose markup is broken keeps it in ``corrupt`` and has no fields."""
    x = F.when(broken_markup(F.col(column)).isNull(), F.col(column))

    def one(path):
        return F.trim(F.regexp_replace(F.xpath_string(x, F.lit(path)), r"\s+", " "))

    names = F.zip_with(F.xpath(x, F.lit("//contrib[@contrib-type='author']/name/given-names/text()")), F.xpath(x, F.lit("//contrib[@contrib-type='author']/name/surname/text()")), lambda g, s: F.concat_ws(" ", g, s))
    return df.select(key, one("//article-meta//article-title").alias("title"), one("//article-meta//abstract").alias("abstract"), names.alias("authors"), F.xpath(x, F.lit("//kwd/text()")).alias("keywords"), one("//pub-date/year").alias("year"), one("//journal-title").alias("journal"), one("//article-id[@pub-id-type='doi']").alias("doi"), broken_markup(F.col(column)).alias("corrupt"))


def header_record(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Parser output to title, abstract, names and keywords; title lists come from titleStmt only."""
    from folioscope.functions.normalize import drop_title_names, strip_all_tags

    head = F.regexp_extract(column, r"(?s)^(.*?)(</teiHeader>|$)", 1)
    stmt = F.regexp_extract(head, r"(?s)<titleStmt[^>]*>(.*?)</titleStmt>", 1)
    main = F.regexp_extract(stmt, r'(?s)<title[^>]*type="main"[^>]*>(.*?)</title>', 1)
    title = F.when(main != "", main).otherwise(F.regexp_extract(stmt, r"(?s)<title[^>]*>(.*?)</title>", 1))
    names = F.transform(F.regexp_extract_all(head, F.lit(r"(?s)<persName[^>]*>(.*?)</persName>"), F.lit(1)), strip_all_tags)
    terms = F.transform(F.regexp_extract_all(head, F.lit(r"(?s)<term[^>]*>(.*?)</term>"), F.lit(1)), strip_all_tags)
    kept = drop_title_names(names)
    return df.select(key, strip_all_tags(title).alias("title"), strip_all_tags(F.regexp_extract(head, r"(?s)<abstract[^>]*>(.*?)</abstract>", 1)).alias("abstract"), F.array_join(kept, "; ").alias("authors"), F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit("")).alias("first_author"), F.array_join(terms, "; ").alias("keywords"))


def bibliography(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """One row per reference entry: its text, title, journal, year, surnames."""
    from folioscope.functions.normalize import strip_all_tags

    entry = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<biblStruct[^>]*>(.*?)</biblStruct>"), F.lit(1)))
    rows = df.select(key, F.monotonically_increasing_id().alias("_r"), entry.alias("x"))

    def part(pattern):
        return strip_all_tags(F.regexp_extract("x", pattern, 1))

    return rows.select(key, strip_all_tags(F.col("x")).alias("entry"), part(r'(?s)<title[^>]*level="a"[^>]*>(.*?)</title>').alias("title"), part(r'(?s)<title[^>]*level="j"[^>]*>(.*?)</title>').alias("journal"), F.regexp_extract("x", r'when="(\d{4})', 1).alias("year"), F.transform(F.regexp_extract_all("x", F.lit(r"(?s)<surname[^>]*>(.*?)</surname>"), F.lit(1)), strip_all_tags).alias("surnames"))


def decision(value: Column) -> Column:
    """A decision that is written as "dogru", as "atla" or as ["duzeltildi", new]: struct(status, value)."""
    pair = F.from_json(value, "array<string>")
    word = F.regexp_replace(value, '^"|"$', "")
    return F.struct(F.when(value.startswith("["), pair[0]).otherwise(word).alias("status"), F.when(value.startswith("["), pair[1]).alias("value"))


def cover_text(markup: Column) -> Column:
    """Readable text of a front part: line breaks, entities, no blank lines."""
    from folioscope.functions.normalize import unescape_markup

    front = F.regexp_extract(markup, r"(?s)<front[^>]*>(.*?)</front>", 1)
    text = unescape_markup(F.regexp_replace(F.regexp_replace(front, r"<lb\s*/>", "\n"), "<[^>]*>", ""))
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: F.trim(l) != ""), "\n")


class RecordSource(DataSource):
    """Records fetched page by page. One partition per (query, page); offline, a page is a JSON file in a folder of any
    store that pyarrow's file systems reach, so executors need no local copy.

    Options: path (folder or URI with <query>_<page>.json), queries (comma-separated), pages (how many at most). A
    query ends at its first missing page; a missing page before one that exists is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "query string, page int, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RecordReader(self.options)


class _Page(InputPartition):
    def __init__(self, query: str, page: int):
        self.query, self.page = query, page


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.queries = [q for q in options.get("queries", "").split(",") if q]
        self.pages = int(options.get("pages", "1"))

    def partitions(self):
        return [_Page(q, p) for q in self.queries for p in range(self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        there = lambda page: store.get_file_info(f"{root}/{partition.query}_{page}.json").type == fs.FileType.File
        if not there(partition.page):
            if any(map(there, range(partition.page + 1, self.pages))):
                raise FileNotFoundError(f"page {partition.page} of query {partition.query} is missing, but a later one is there")
            return
        with store.open_input_stream(f"{root}/{partition.query}_{partition.page}.json") as f:
            for r in json.loads(f.read().decode("utf-8")):
                yield partition.query, partition.page, json.dumps(r, ensure_ascii=False)


def lookup(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of a table by key: all lookups of a job as one join. A key that the table lacks gives nulls."""
    return wanted.select(key).distinct().join(table, key, "left")


def list_store(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and time of the objects under a path, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
