"""Readers of the input tables and of raw document formats."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions.text import unescaped_entities


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows for work that costs far more than moving them: a table in fewer splits than there are cores is dealt to all.

    A large table has more splits than that and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share.

    A local session without that setting gets a temporary folder; a cluster an
    error, since its executors would write into folders of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="folio-")
    return f"{folder.rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows, written in the shared folder and read back, so that what they cost is paid once."""
    path = staging_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str, categories: list[str] | None = None) -> DataFrame:
    """Records of a JSON-lines file; blank and malformed lines are dropped, and records outside the categories."""
    return in_categories(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), categories)


def parsed_lines(lines: DataFrame, schema: str, categories: list[str] | None = None) -> DataFrame:
    """The same from a column `value` of lines; a malformed line has no field at all."""
    rows = lines.where(tx.strip(F.col("value")) != "").select(F.from_json("value", schema).alias("row")).select("row.*")
    return in_categories(rows.dropna("all"), categories)


def in_categories(rows: DataFrame, categories: list[str] | None) -> DataFrame:
    if categories is None:
        return rows
    return rows.where(F.arrays_overlap(F.split("categories", " "), F.array(*map(F.lit, categories))))


#: The record that every literature source is brought to.
PAPER = "source string, title string, abstract string, year int, venue string, doi string, arxiv_id string, url string, authors array<string>"


def is_pdf(content: Column) -> Column:
    """Whether bytes begin as a PDF does; pages of an error in its place do not."""
    return F.coalesce(F.startswith(content, F.lit("%PDF").cast("binary")), F.lit(False))


def blank_to_null(value: Column) -> Column:
    return F.nullif(tx.strip(value), F.lit(""))


def scholarly_hits(spark: SparkSession, path: str) -> DataFrame:
    """Search hits of a JSON API, one object a line, as PAPER."""
    return parsed_hits(spark.read.text(path))


def parsed_hits(lines: DataFrame) -> DataFrame:
    """The same from a column `value` of lines; lines that are no object, or have no title, are left out."""
    schema = "title string, abstract string, year int, venue string, url string, externalIds struct<DOI:string,ArXiv:string>, authors array<struct<name:string>>"
    hits = lines.select(F.from_json("value", schema).alias("hit")).where("hit.title IS NOT NULL").select("hit.*")
    return hits.select(
        F.lit("semantic_scholar").alias("source"), "title", "abstract", "year", blank_to_null(F.col("venue")).alias("venue"),
        F.col("externalIds.DOI").alias("doi"), F.col("externalIds.ArXiv").alias("arxiv_id"), "url", F.col("authors.name").alias("authors"),
    )


def author_names(names: Column) -> Column:
    """Names of a comma-separated list, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(names, ","), tx.strip), lambda x: x != "")


def web_hits(lines: DataFrame) -> DataFrame:
    """Answers of a web search, one JSON object with a list of results a row, as PAPER, in the order of the answer's places."""
    schema = "results array<struct<title:string,url:string,publishedDate:string,author:string,text:string>>"
    hits = lines.select(F.explode(F.from_json("value", schema)["results"]).alias("hit")).select("hit.*").where("title IS NOT NULL AND url IS NOT NULL")
    none = F.lit(None).cast("string")
    return hits.select(
        F.lit("web").alias("source"), tx.strip(F.col("title")).alias("title"), F.col("text").alias("abstract"), year_of(F.col("publishedDate")).alias("year"), none.alias("venue"),
        none.alias("doi"), none.alias("arxiv_id"), "url", F.coalesce(author_names(F.col("author")), F.array().cast("array<string>")).alias("authors"),
    )


def xml_body(document: Column) -> Column:
    """Text of an article's <body> as Markdown: titles as headings, paragraphs apart, other marks left out; null without a body."""
    body = F.regexp_extract(document, r"(?s)<body[^>]*>(.*?)</body>", 1)
    marked = F.regexp_replace(F.regexp_replace(body, r"(?s)<title[^>]*>(.*?)</title>", "\n\n## $1\n\n"), r"</?(p|sec|list|list-item|table|fig)\b[^>]*>", "\n\n")
    plain = unescaped_entities(F.regexp_replace(marked, r"<[^>]*>", ""))
    parts = F.filter(F.transform(F.split(plain, "\n{2,}"), tx.squeeze), lambda x: x != "")
    return F.nullif(F.array_join(parts, "\n\n"), F.lit(""))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds (one file a row), as PAPER."""
    return parsed_entries(spark.read.text(path, wholetext=True))


def parsed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of the feeds in the column `value`, entities read; an entry's id loses its version."""
    entry = feeds.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("entry"))
    field = lambda name: F.nullif(tx.squeeze(unescaped_entities(F.regexp_extract("entry", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1))), F.lit(""))
    number = F.split_part(F.split_part(field("id"), F.lit("/abs/"), F.lit(2)), F.lit("v"), F.lit(1))
    return entry.select(
        F.lit("arxiv").alias("source"), field("title").alias("title"), field("summary").alias("abstract"),
        F.substring(field("published"), 1, 4).try_cast("int").alias("year"), F.lit(None).cast("string").alias("venue"), field("arxiv:doi").alias("doi"),
        number.alias("arxiv_id"), field("id").alias("url"), F.transform(F.regexp_extract_all("entry", F.lit(r"(?s)<name>(.*?)</name>"), 1), lambda x: tx.squeeze(unescaped_entities(x))).alias("authors"),
    )


def year_of(date: Column) -> Column:
    """Year of a full date, a month or a year; null if it is none of them."""
    return F.when(date.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}.*)?)?$"), F.substring(date, 1, 4).try_cast("int"))


def inverted_index(words: Column) -> Column:
    """map<word, positions> of an array of words, made where the array lies: sorted by word, each run of a word is cut out."""

    def runs(s: Column) -> Column:
        new = lambda x, i: (i == 0) | (F.get(s, i - 1)["word"] != x["word"])
        starts = F.filter(F.transform(s, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
        return tx.let(starts, lambda at: F.transform(at, lambda b, k: run(s, b, F.coalesce(F.get(at, k + 1), F.size(s)))))

    def run(s: Column, begin: Column, end: Column) -> Column:
        return F.struct(F.get(s, begin)["word"].alias("word"), F.transform(F.slice(s, begin + 1, end - begin), lambda x: x["at"]).alias("places"))

    return F.map_from_entries(tx.let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))), runs))


def rebuilt_text(index: Column) -> Column:
    """Text of an inverted index, map<word, positions>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["word"]), " ")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded text files: path, text, status (`ocr_required` under 50 characters)."""
    return scanned(spark.read.format("binaryFile").load(path))


def scanned(raw: DataFrame) -> DataFrame:
    """The same from rows (path, content)."""
    body = F.decode("content", "UTF-8")
    return raw.select("path", body.alias("text"), F.when(F.length(tx.strip(body)) < 50, "ocr_required").otherwise("completed").alias("status"))


def search(papers: DataFrame, words: list[str], limit: int = 25, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """PAPER rows that hold every word in title or abstract, within the years, newest first; the limit is the caller's page."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    for word in words:
        papers = papers.where(text.contains(word.lower()))
    if year_from is not None:
        papers = papers.where(F.col("year") >= year_from)
    if year_to is not None:
        papers = papers.where(F.col("year") <= year_to)
    return papers.orderBy(F.col("year").desc_nulls_last(), "title", "url").limit(limit)


def strongest_id(papers: DataFrame) -> Column:
    """arXiv number, else DOI, else the title without regard to case and blanks around it."""
    return F.coalesce(blank_to_null(papers["arxiv_id"]), blank_to_null(papers["doi"]), F.lower(tx.strip(papers["title"])))


class Source(NamedTuple):
    """A place to search: its name, and how its papers (PAPER) are read.  `rows` reads lazily, so a search's filters reach the scan."""

    name: str
    rows: Callable[[SparkSession], DataFrame]

    def search(self, spark: SparkSession, words: list[str], limit: int = 25, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        return search(self.rows(spark), words, limit, year_from, year_to)


def search_all(spark: SparkSession, sources: list[Source], words: list[str], limit: int = 25, each: int = 25) -> DataFrame:
    """Hits of several sources, a source only as far as those before it left room: place, then the order within the source."""
    marked = [s.search(spark, words, each).withColumn("place", F.lit(k)) for k, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, marked)  # at most `each` rows of each source
    return every.orderBy("place", F.col("year").desc_nulls_last(), "title", "url").limit(limit)


def fan_out(results: list[DataFrame]) -> DataFrame:
    """Rows of several sources, each paper once: that of the source named first."""
    every = None
    for place, rows in enumerate(results):
        marked = rows.withColumn("_place", F.lit(place))
        every = marked if every is None else every.unionByName(marked)
    keyed = every.withColumn("_key", strongest_id(every))
    columns = [c for c in every.columns if c != "_place"]
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*columns), F.struct("_place", "title", "url")).alias("_row"), F.count(F.lit(1)).alias("matches"))
    return first.select("_row.*", "matches")
