"""Extraction by several engines: the best text of two tiers, and the repair of weak pages.

An engine is a name and a function from a column of raw content to a column of
text.  The second tier is asked only where the first one's best text is under
the bar: the first tier is written, and its weak rows alone go on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.sources.tables import staged


class Engine(NamedTuple):
    name: str
    extract: Callable[[Column], Column]


_TRIED = "array<struct<engine:string,score:double>>"


def score(text: Column) -> Column:
    """Quality of a text to six digits, 0 of none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.round(tx.quality(text), 6))


def _better(best: Column, one: Column) -> Column:
    """one, if it scores more than best: the engine that comes first wins ties."""
    return F.when(one["score"] > best["score"], one).otherwise(best)


def _tier(rows: DataFrame, key: str, raw: str, engines: list[Engine]) -> DataFrame:
    """key, raw, best, tried after these engines; best and tried of rows that have them are what they begin with."""
    named = rows.select(key, raw, *(c for c in ("best", "tried") if c in rows.columns), *(e.extract(F.col(raw)).alias(f"text {i}") for i, e in enumerate(engines)))
    scored = named.select("*", *(score(F.col(f"text {i}")).alias(f"score {i}") for i in range(len(engines))))
    one = lambda i: F.struct(F.lit(engines[i].name).alias("engine"), F.col(f"text {i}").alias("text"), F.col(f"score {i}").alias("score"))
    none = F.struct(F.lit("").alias("engine"), F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("score"))
    best = F.col("best") if "best" in rows.columns else none
    tried = F.col("tried") if "tried" in rows.columns else F.array().cast(_TRIED)
    new = F.array(*(F.struct(F.lit(e.name).alias("engine"), F.col(f"score {i}").alias("score")) for i, e in enumerate(engines)))
    return scored.select(key, raw, reduce(_better, map(one, range(len(engines))), best).alias("best"), F.concat(tried, new.cast(_TRIED)).alias("tried"))


def routed(rows: DataFrame, key: str, raw: str, fast: list[Engine], slow: list[Engine], least: float = 0.6) -> DataFrame:
    """key, engine, text, score, fell_back, tried: the text of the highest score that an engine makes of `raw`.

    slow engines see the rows alone whose best score is under `least`; their
    text must score more than what is there.  fell_back: no engine reached the
    bar.  tried: all engines that ran, in order, with their scores.
    """
    first = staged(_tier(rows, key, raw, fast), "tier")
    weak = F.col("best.score") < least
    whole = first.where(~weak)
    if slow:
        whole = whole.union(_tier(first.where(weak), key, raw, slow))
    else:
        whole = first
    return whole.select(key, "best.engine", "best.text", "best.score", weak.alias("fell_back"), "tried")


def repaired(pages: DataFrame, key: str, page: str, fast: str, slow: str, least: float = 0.45, share: float = 0.5) -> DataFrame:
    """key, n_pages, weak_pages, whole, text, fast_score, score of each document, from a row for each page.

    fast, slow: a page's text by either tier, null where it made none.  A page
    is weak if its fast text scores under `least`.  If `share` of a document's
    pages or more are weak, all its pages are taken from the slow tier, else the
    weak ones that it has.  Scores of the whole text are computed anew.
    """
    own = pages.select(key, F.struct(F.col(page).alias("page"), F.col(fast).alias("fast"), F.col(slow).alias("slow"), (score(F.col(fast)) < least).alias("weak")).alias("p"))
    documents = own.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("pages"))
    weak = F.filter("pages", lambda p: p["weak"])
    marked = documents.select(key, "pages", F.size("pages").alias("n_pages"), F.transform(weak, lambda p: p["page"]).alias("weak_pages"))
    marked = marked.withColumn("whole", (F.size("weak_pages") > 0) & (F.size("weak_pages") >= share * F.col("n_pages")))
    full = lambda t: F.coalesce(F.length(t), F.lit(0)) > 0
    taken = lambda p: F.when(F.col("whole") | (p["weak"] & full(p["slow"])), p["slow"]).otherwise(p["fast"])
    joined = lambda f: F.array_join(F.filter(F.transform("pages", f), full), "\n\n")
    texts = marked.select(key, "n_pages", "weak_pages", "whole", joined(lambda p: p["fast"]).alias("before"), joined(taken).alias("text"))
    return texts.select(key, "n_pages", "weak_pages", "whole", "text", score(F.col("before")).alias("fast_score"), score(F.col("text")).alias("score"))
