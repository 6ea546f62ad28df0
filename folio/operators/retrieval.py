"""Retrieval: hybrid scores, keyword fallback, several queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx
from folio.operators.dedup import top_per_group


def nearest(chunks: DataFrame, vector: list[float], k: int, key: str) -> DataFrame:
    """The k chunks of largest cosine similarity; an exact scan that keeps k rows of each task."""
    query = F.array(*map(F.lit, vector))
    scored = chunks.withColumn("similarity", F.greatest(F.lit(0.0), F.round(vx.cosine(F.col("embedding"), query), 6)))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def keyword(chunks: DataFrame, words: list[str]) -> DataFrame:
    own = F.array(*map(F.lit, sorted(set(words))))
    return chunks.withColumn("keyword", F.round(vx.keyword_score(own, tx.tokens(F.col("chunk_text"))), 6))


def hybrid(chunks: DataFrame, vectors: DataFrame | None, vector: list[float], words: list[str], top: int, key: str = "chunk_id", widen: int = 3, most: int = 200, least: float = 0.0) -> DataFrame:
    """Nearest chunks, over-fetched, then scored by keywords, similarity and content type.

    chunks: key, chunk_text, content_type.  vectors: key, embedding.  Vectors are
    ranked by themselves, among the keys of chunks, and the few that are left
    (at most `most` rows) are sent to the scan of the texts, so no text is
    shuffled.  A zero or empty vector falls back to keywords alone.
    """
    if any(vector):
        own = vectors.where("embedding IS NOT NULL").join(chunks.select(key), key, "left_semi")
        best = nearest(own, vector, min(widen * top, most), key).select(key, "similarity")
        found = keyword(chunks.join(F.broadcast(best), key), words)
    else:
        found = keyword(chunks, words).withColumn("similarity", F.lit(0.0))
    score = F.round(vx.blended(F.col("keyword"), F.col("similarity"), F.col("content_type")), 6)
    return found.withColumn("score", score).where(F.col("score") > least).orderBy(F.desc("score"), key).limit(top)


def merged(scored: DataFrame, key: str, query: str, each: int, top: int) -> DataFrame:
    """The best chunks of several queries: `each` of every query, every chunk once, `top` in all."""
    best = top_per_group(scored, [query], [F.desc("score"), F.col(key)], each)
    once = best.groupBy(key).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_queries"))
    return once.orderBy(F.desc("score"), key).limit(top)


def expanded(words: list[str], concepts: list[str], most: int = 8) -> list[str]:
    """Query words and those of ranked concept labels that are not among them yet."""
    out, seen = list(words), {w.lower() for w in words}
    for label in concepts:
        if label.lower() not in seen and len(out) < len(words) + most:
            out.append(label)
            seen.add(label.lower())
    return out


def expanded_queries(queries: DataFrame, concepts: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, query: each query (key, query) with its best-ranked concepts (key, label, rank) that are none of its words."""
    new = concepts.join(queries, key).where(~F.array_contains(F.split(F.lower("query"), " "), F.lower("label")))
    best = top_per_group(new.dropDuplicates([key, "label"]), [key], [F.desc("rank"), F.col("label")], most)
    added = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "label"))).alias("x"))
    return queries.join(added, key, "left").select(key, F.concat_ws(" ", "query", F.array_join(F.col("x.label"), " ")).alias("query"))


def reranked(rows: DataFrame, score: Column | None = None, least: float = 0.05) -> DataFrame:
    """Rows by a reranker's score; without one they keep their order."""
    return rows if score is None else rows.withColumn("rerank", score).where(F.col("rerank") >= least)
