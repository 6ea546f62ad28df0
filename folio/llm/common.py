"""Shared folder, written tables and bounded broadcasts for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most ids that are sent to every executor; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
#: A key with so many rows is hot; at most BROADCAST_KEYS hot keys are sent to every executor.
HOT_ROWS, BROADCAST_KEYS = 1_000, 500_000
#: Most partitions of a shuffle: each map task keeps the sizes of all of them, and the driver those of all tasks.
MOST_PARTITIONS = 20_000
#: Rows of an Arrow batch.
BATCH_ROWS = 500

_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session (tests) gets a temporary one, and a
    cluster an error: executors would write into folders of their own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and (known := context._jsc.sc().getCheckpointDir()).isDefined():
        folder = known.get()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="folio-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes with the scratch() it was made in."""
    path = f"{shared_folder(spark)}/folio-{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were written inside, so results must have been written elsewhere by its end."""
    _open.append([])
    try:
        yield
    finally:
        for name in _open.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here, so a lost executor costs one table scan."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Python gets texts in batches of few rows, since one text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, size: int, each: int) -> int:
    """Partitions for `size` bytes of data: what the session has set at least, and more while one would have over `each`
    bytes, MOST_PARTITIONS at most; beyond that partitions grow, and what uses them takes its groups one by one."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), MOST_PARTITIONS))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with whole numbers for doc_id, and a table (number, doc_id) in the order of doc_id; None where they are numbers."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return docs.withColumn("doc_id", F.col("doc_id").cast("long")), None
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy("doc_id")
    ids = written(ids.select(F.monotonically_increasing_id().alias("number"), "doc_id"), "numbers")
    return docs.join(ids, "doc_id", "left").drop("doc_id").withColumnRenamed("number", "doc_id"), ids


def named(rows: DataFrame, ids: DataFrame | None, *columns: str) -> DataFrame:
    """rows with the ids of numbered() in these columns again."""
    for c in columns if ids is not None else ():
        own = [F.col("doc_id").alias(c) if x == c else F.col(f"`numbered {x}`").alias(x) for x in rows.columns]
        rows = rows.select(*(F.col(x).alias(f"numbered {x}") for x in rows.columns)).join(ids, F.col(f"`numbered {c}`") == F.col("number"), "left").select(own)
    return rows


def sized(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """A one-column table, written so that it can be counted cheaply, and broadcast if it has at most `bound` rows."""
    ids = written(ids, "ids")
    return F.broadcast(ids) if ids.count() <= bound else ids


def semi(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is in the one-column table ids: broadcast if it is provably small, else a shuffled join."""
    return rows.join(sized(ids), column, "left_semi")


def anti(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is not in ids; rows with a null stay."""
    return rows.join(sized(ids), column, "left_anti")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, size: str, hot_rows: int = HOT_ROWS, few: int = 0) -> DataFrame:
    """rows, left joined with groups: a written table with one row for each key and the number of its rows in `size`.

    A key may hold any share of the rows.  Hot keys are broadcast: their number
    is bounded, since the bound on a key's rows grows with all rows once there
    are too many.  Rows of hot keys are spread by `spread` in the shuffle, where
    they meet nothing; all other keys have few rows each.

    Up to `few` groups are all broadcast: where rows hold texts, it should not
    be left to a race of stages whether they are shuffled.
    """
    total, largest, many = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0)), F.count(F.lit(1))).first()
    if many <= few:
        return rows.join(F.broadcast(groups), keys, "left")
    bound = max(hot_rows, -(-total // BROADCAST_KEYS))
    hot = groups.where(F.col(size) >= bound)
    values = [c for c in groups.columns if c not in keys]
    if largest < bound:
        return rows.join(groups, keys, "left")
    known = rows.join(F.broadcast(hot.withColumnsRenamed({v: f"hot {v}" for v in values})), keys, "left")
    salt = F.when(F.col(f"hot {size}").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    rest = groups.where(F.col(size) < bound).withColumn("hot salt", F.lit(0).cast("long"))
    joined = known.withColumn("hot salt", salt.cast("long")).join(rest, [*keys, "hot salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"hot {v}"), F.col(v)).alias(v) for v in values))
