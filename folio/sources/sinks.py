"""Writers: CSV, Markdown, long format, refresh by key, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(frame: DataFrame, name: str) -> Column:
    """A column as text: structures as JSON."""
    kind = frame.schema[name].dataType.simpleString()
    return F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(name).cast("string")


def csv_lines(frame: DataFrame) -> DataFrame:
    """line: each row as CSV, quoted where it must be."""
    return frame.select(F.to_csv(F.struct(*(cell(frame, c).alias(c) for c in frame.columns))).alias("line"))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.select(*(cell(frame, c).alias(c) for c in frame.columns)).write.option("header", True).csv(path)


def markdown_rows(frame: DataFrame, order: list[str]) -> DataFrame:
    """A Markdown table, one line a row: place, line."""
    texts = [F.coalesce(F.replace(cell(frame, c), F.lit("|"), F.lit("\\|")), F.lit("")) for c in frame.columns]
    body = frame.select(*(F.col(c).alias(f"_{c}") for c in order), F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |")).alias("line"))
    head = [f"| {' | '.join(frame.columns)} |", f"| {' | '.join('---' for _ in frame.columns)} |"]
    top = frame.sparkSession.range(2).select(F.col("id").alias("place"), F.element_at(F.array(*map(F.lit, head)), F.col("id").cast("int") + 1).alias("line"))
    rows = body.orderBy(*(f"_{c}" for c in order)).select(F.monotonically_increasing_id().alias("n"), "line")
    return top.unionByName(rows.select((F.col("n") + 2).alias("place"), "line"))


def write_markdown(frame: DataFrame, path: str, order: list[str]) -> None:
    markdown_rows(frame, order).orderBy("place").select("line").write.text(path)


def refresh(frame: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions of the keys that the frame holds; others stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def refreshed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What refresh() leaves: the old rows of other keys, and all new rows.  Spark broadcasts the new keys if they are few."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def filled(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Like upserted, but a value that old has stays; new fills nulls alone."""
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    return both.select(*keys, *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in rest))


def append(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def long_markdown(rows: DataFrame, section: str, label: str, value: str) -> DataFrame:
    """section, body: a Markdown part for each section of (section, label, value) rows, labels in order."""
    line = F.concat(F.lit("- "), F.col(label), F.lit(": "), F.col(value).cast("string"))
    grouped = rows.groupBy(section).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), line.alias("line")))).alias("x"))
    return grouped.select(section, F.concat(F.lit("## "), F.col(section), F.lit("\n\n"), F.array_join(F.col("x.line"), "\n")).alias("body"))


def report_markdown(paragraphs: DataFrame, report: str, place: str, heading: str, text: str) -> DataFrame:
    """report, body: paragraphs in order, a heading above the first of each run of one heading."""
    x = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(heading).alias("h"), F.col(text).alias("t"))))
    grouped = paragraphs.groupBy(report).agg(x.alias("x"))

    def part(row: Column, k: Column) -> Column:
        new = (k == 0) | (F.get(F.col("x.h"), k - 1) != row["h"])
        return F.when(new, F.concat(F.lit("### "), row["h"], F.lit("\n\n"), row["t"])).otherwise(row["t"])

    return grouped.select(report, F.array_join(F.transform("x", part), "\n\n").alias("body"))
