"""Connected components of a link table: union-find inside partitions, then star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import written

MAX_ROUNDS = 60
#: Links that one task may join: about 150 MB of union-find.  Beyond it, rounds of star contraction.
ONE_TASK_LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # what is held stays bounded; later rounds join the parts
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame, left: str, right: str, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """node, component (its smallest reachable node) for every node that has a link; links: two long columns."""
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = written(edges.mapInArrow(_forest, "a long, b long"), "forest")
    if edges.count() <= one_task:
        stars = written(edges.coalesce(1).mapInArrow(_forest, "a long, b long"), "stars")
        return _named(stars)
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        edges = written(small.toDF("a", "b"), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return _named(edges)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
