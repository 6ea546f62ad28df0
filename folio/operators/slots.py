"""Slots for models: the caller gives the function, Spark deals the batches; without an answer a default holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(rows: DataFrame, batch: str, key: str, value: str, model: Callable[[int, list], list[str]], default: str = "medium") -> DataFrame:
    """key, score: rows of one batch are asked together, in the order of their keys.

    The model gets a batch's number and values and answers with a list of
    scores; where that is too short or no score, a row gets the default.  Rows
    of a batch are few; batches are dealt over all tasks.
    """
    known = ("high", "medium", "low")
    kind = rows.schema[key].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keys, scores = [], []
            for number, ids, values in zip(frame[batch], frame["keys"], frame["values"], strict=True):
                answer = list(model(int(number), list(values)))
                keys += list(ids)
                scores += [answer[i] if i < len(answer) and answer[i] in known else default for i in range(len(ids))]
            yield pd.DataFrame({key: keys, "score": scores})

    item = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    packed = rows.groupBy(batch).agg(item.alias("items")).select(batch, F.col("items.k").alias("keys"), F.col("items.v").alias("values"))
    return packed.mapInPandas(ask, f"{key} {kind}, score string")


def renewed(rows: DataFrame, key: str, model: str, vector: str, target: str, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """key, model, vector: vectors of other models than `target` are made anew from the column `text`, in batches; the rest stay.

    Rows whose embedding fails (a null) keep their old vector and model, so a later run takes them up again.
    """
    done = rows.where(F.col(model) == target).select(key, model, vector)
    stale = rows.where(F.coalesce(F.col(model) != target, F.lit(True)))
    made = F.pandas_udf(embed, "array<float>")
    fresh = stale.withColumn("_new", made(F.col("text")))
    again = fresh.select(key, F.when(F.col("_new").isNull(), F.col(model)).otherwise(F.lit(target)).alias(model), F.coalesce("_new", vector).alias(vector))
    return done.unionByName(again)
