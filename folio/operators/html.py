"""Web pages as Markdown, and the authors that a page names.

A page is read as a row for each tag and text.  What is open at a row (elements
that are not shown, the main part, lists) is known from running sums over the
page's rows, so no page is parsed by a program of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as tx

#: Elements whose content is not shown.
HIDDEN = ("figure", "math")
#: Class of the part that is preferred to the whole body.
MAIN = "ltx_page_main"
BLOCKS = ("p", "div", "section", "article", "blockquote", "table", "tr", "nav", "header", "footer", "main", "pre", "dl", "dd", "dt")
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
#: Characters of html in a partition: about 100 MB of a task's memory in sorts.
PART_CHARS = 4_000_000
_TOKEN = r"<[^>]*>|[^<]+"


def _rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, token, tag, closes, text: tags and texts of a page in their order, without scripts, styles and comments."""
    plain = reduce(lambda c, p: F.regexp_replace(c, p, ""), (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script[^>]*>", r"(?is)<style\b[^>]*>.*?</style[^>]*>"), F.coalesce(F.col(html), F.lit("")))
    rows = pages.select(key, F.posexplode_outer(F.regexp_extract_all(plain, F.lit(_TOKEN), 0)).alias("at", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    return rows.select(key, "at", "token", F.when(F.col("token").startswith("<"), tag).alias("tag"), F.col("token").startswith("</").alias("closes"))


def _dealt(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Pages in partitions of about PART_CHARS, before they become rows: what a task sorts does not grow with the table.

    All windows are over the pages' key or more, so this is the only shuffle.
    """
    chars = pages.agg(F.sum(F.length(html).cast("long"))).first()[0] or 0
    least = pages.sparkSession.sparkContext.defaultParallelism
    return pages.select(key, html).repartition(max(least, -(-chars // PART_CHARS)), key)


def markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, markdown: the main part of each page, or else its body, as Markdown; null of a page with neither.

    Headings get number signs, lists stars or numbers and two blanks for each
    list around them, links and pictures their targets, and bold, italic and
    code their marks where an end tag follows.  Other tags part blocks or go.
    White space is one blank, blocks are parted by one blank line.
    """
    order = Window.partitionBy(key).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = _rows(_dealt(pages, key, html), key, html)
    step = lambda on: F.when(on, F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)

    # the part that is shown
    is_main = (F.col("tag") == "div") & ~F.col("closes") & F.col("token").rlike(rf"(?i)class\s*=\s*[\"'](?:[^\"']*\s)?{MAIN}[\s\"']")
    rows = rows.withColumn("divs", F.sum(step(F.col("tag") == "div")).over(so_far))
    page = Window.partitionBy(key)
    rows = rows.withColumn("main", F.min(F.when(is_main, F.struct("at", "divs"))).over(page)).withColumn("body", F.min(F.when((F.col("tag") == "body") & ~F.col("closes"), F.col("at"))).over(page))
    begin = F.coalesce("main.at", "body")
    after = F.col("at") > begin
    rows = rows.withColumn("begin", begin)
    ended = F.when(F.col("main").isNotNull(), F.col("divs") < F.col("main.divs")).otherwise((F.col("tag") == "body") & F.col("closes"))
    rows = rows.withColumn("end", F.min(F.when(after & ended, F.col("at"))).over(page)).where((F.col("at") > F.col("begin")) & (F.isnull("end") | (F.col("at") < F.col("end"))) | F.isnull("begin") | (F.col("at") == F.col("begin")))
    rows = rows.withColumn("hidden", F.sum(step(F.col("tag").isin(*HIDDEN) & ~F.col("token").endswith("/>"))).over(so_far))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("hidden").over(so_far)))
    shown = F.col("at").isNotNull() & (F.col("hidden") == F.col("low")) & ~F.coalesce(F.col("tag").isin(*HIDDEN), F.lit(False)) & (F.col("at") > F.col("begin"))

    # lists: their depth, and the last one opened at it
    lists = F.col("tag").isin("ul", "ol")
    rows = rows.withColumn("depth", F.greatest(F.sum(step(lists)).over(so_far), F.lit(0)))
    level = Window.partitionBy(key, "depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("list", F.last(F.when(lists & ~F.col("closes"), F.struct("at", "tag")), ignorenulls=True).over(level))
    item = (F.col("tag") == "li") & ~F.col("closes")
    rows = rows.withColumn("nth", F.sum(item.cast("int")).over(Window.partitionBy(key, "depth", "list").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))

    # links and marks: an end belongs to the last begin of its kind
    target = F.when((F.col("tag") == "a") & ~F.col("closes"), F.regexp_extract("token", r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1))
    rows = rows.withColumn("href", F.last(target, ignorenulls=True).over(so_far))
    kind = Window.partitionBy(key, "tag").orderBy("at")
    paired = F.when(F.col("closes"), ~F.lag("closes").over(kind)).otherwise(F.lead("closes").over(kind))
    rows = rows.withColumn("paired", F.coalesce(paired, F.lit(False)))

    indent = F.repeat(F.lit("\x01"), F.greatest(F.col("depth") - 1, F.lit(0)))
    number = F.when(F.col("list.tag") == "ol", F.concat(F.col("nth").cast("string"), F.lit(". "))).otherwise(F.lit("* "))
    piece = (
        F.when(~shown, "")
        .when(F.isnull("tag"), tx.unescaped_entities(F.regexp_replace("token", rf"{tx.SPACE}+", " ")))
        .when(F.col("tag").rlike("^h[1-6]$"), F.when(F.col("closes"), "\n\n").otherwise(F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "))))
        .when(item, F.concat(F.lit("\n"), indent, number))
        .when(lists, F.when(F.col("depth") + F.col("closes").cast("int") > 1, "").otherwise("\n\n"))
        .when(F.col("tag") == "br", "\n")
        .when(F.col("tag") == "a", F.when(F.coalesce(F.col("href"), F.lit("")) == "", "").when(~F.col("paired"), "").when(F.col("closes"), F.concat(F.lit("]("), "href", F.lit(")"))).otherwise("["))
        .when(F.col("tag") == "img", F.concat(F.lit("!["), F.regexp_extract("token", r"(?i)\balt\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("]("), F.regexp_extract("token", r"(?i)\bsrc\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(")")))
        .when(F.col("tag").isin(*MARKS) & F.col("paired"), reduce(lambda c, m: c.when(F.col("tag") == m, F.lit(MARKS[m])), MARKS, F.when(F.lit(False), "")))
        .when(F.col("tag").isin(*BLOCKS), "\n\n")
        .otherwise("")
    )
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"), F.max("begin").alias("begin"))
    text = F.array_join(F.col("pieces.piece"), "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return whole.select(key, F.when(F.col("begin").isNotNull(), F.replace(tx.strip(text), F.lit("\x01"), F.lit("  "))).alias("markdown"))


def authors(html: Column) -> Column:
    """Names of a page's authors, in their order: those of its meta tags, else of the links in its list of authors."""
    named = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s+name=\"citation_author\"\s+content=\"([^\"]+)\""), 1)
    listed = F.regexp_extract(html, r"(?is)<div[^>]+class=\"authors\"[^>]*>(.*?)</div>", 1)
    linked = F.filter(F.transform(F.regexp_extract_all(listed, F.lit(r"(?i)<a[^>]*>([^<]+)</a>"), 1), tx.strip), lambda x: x != "")
    return F.when(F.size(named) > 0, F.transform(named, tx.unescaped_entities)).otherwise(linked)
