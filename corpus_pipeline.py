"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

All stages but the last return rows of their input, with its columns.  Decisions
are about rows: each row has a key of its own (its file and place there; rows of
another source are written first), so rows without a doc_id and rows that share
one are judged each by their own text.  A null text counts as an empty one.  Columns besides doc_id and text
are carried along, whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import anti, scratch, shared_folder, small_batches, table, written
from folio.llm.decon import contamination
from folio.llm.exact import exact_groups
from folio.llm.near import near_groups
from folio.llm.pack import pack
from folio.llm.quality import quality_scores

#: Names of the row key, and of what it is made of, within a stage.
ROW, FILE, PLACE = "folio_row_key", "folio_file", "folio_place"
#: Most file names that are sent to every executor.
BROADCAST_FILES = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a row key that is the same whenever the table is read: number of the file, and the row's place in it."""
    small_batches(docs.sparkSession)
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:  # no scan of files
        return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "stage")
    names = placed.select(FILE).distinct()
    numbers = written(names.select(FILE, F.row_number().over(Window.orderBy(FILE)).cast("long").alias("folio_file_number")), "files")  # one row a file
    known = F.broadcast(numbers) if numbers.count() <= BROADCAST_FILES else numbers
    key = F.shiftleft("folio_file_number", 40) + F.col(PLACE)
    return placed.join(known, FILE).withColumn(ROW, key).drop(FILE, PLACE, "folio_file_number")


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    return anti(keyed, rows.select(ROW), ROW).drop(ROW)


def _order() -> Column:
    """Rows in the order of doc_id, those without one last, and of their keys where they share one."""
    return F.struct(F.isnull("doc_id").alias("none"), "doc_id", ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of low quality go.

    An empty text is scored like any other.  Without labels of both classes
    nothing is rejected.
    """
    keyed = _keyed(docs)
    scores = quality_scores(keyed, table(spark, sf_dir, "labels"), carry=(ROW,))
    return _without(keyed, scores.where("predicted = 0"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest doc_id stays, of rows that share it the first; empty texts are equal."""
    keyed = _keyed(docs)
    groups = exact_groups(keyed.select(_order().alias("doc_id"), "text"))
    return _without(keyed, groups.where("not kept").select(F.col("doc_id")[ROW].alias(ROW)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row of the smallest doc_id stays; texts without words are in no group and stay."""
    keyed = _keyed(docs)
    found = near_groups(keyed.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    placed = written(found.join(keyed.select(ROW, "doc_id"), ROW), "placed")
    first = placed.groupBy("component_id").agg(F.min(_order()).alias("first")).select(F.col("first")[ROW].alias(ROW))
    return _without(keyed, placed.join(first, ROW, "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; texts without words stay."""
    keyed = _keyed(docs)
    hit = contamination(keyed.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    return _without(keyed, hit.select(F.col("doc_id").alias(ROW)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, neighbours on the curve side by side; an empty text is its end token alone."""
    small_batches(spark)
    return pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The classifier, near dedup and packing cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces.  Stages' results stay in the shared folder as pipeline-*, what they wrote on the way goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
