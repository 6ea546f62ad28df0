"""Queries over vectors, keywords and both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx
from folio.operators import retrieval as rx
from folio.plans.registry import query
from folio.sources.tables import spread, table

WORDS = ["the", "of", "and", "this"]
_KIND = "CASE doc_id % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'results' WHEN 2 THEN 'limitation' WHEN 3 THEN 'abstract' ELSE 'narrative' END"
_BOOST = "CASE doc_id % 5 WHEN 0 THEN 0.08 WHEN 1 THEN 0.12 WHEN 2 THEN 0.16 WHEN 3 THEN 0.08 ELSE 0.0 END"
_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*'))"


def _duck_keyword(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"coalesce(round(CASE WHEN len({_TOKENS}) > 0 THEN len(list_intersect({_TOKENS}, [{listed}])) / sqrt({float(len(words))} * len({_TOKENS})) END, 6), 0)"


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.expr(_KIND).alias("content_type"), "source")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    """The embedding of one row, which stands for the query's."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


_SIM = "greatest(0, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6))"


@query(f"SELECT e.vec_id AS vec_id, {_SIM} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, e.vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return rx.nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20, "vec_id").select("vec_id", "similarity")


@query(f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
f AS (SELECT doc_id, text, {_SIM} AS similarity FROM documents JOIN embeddings e ON doc_id = vec_id, q ORDER BY similarity DESC, doc_id LIMIT 90)
SELECT doc_id AS chunk_id, {_duck_keyword(WORDS)} AS keyword, similarity, round({_duck_keyword(WORDS)} * 0.45 + similarity * 0.55 + {_BOOST}, 6) AS score FROM f ORDER BY score DESC, chunk_id LIMIT 30""")
def hybrid_retrieval(spark, sf_dir):
    """Flagship: the thirty best chunks for a query vector and its words."""
    return rx.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), query_vector(spark, sf_dir), WORDS, 30).select("chunk_id", "keyword", "similarity", "score")


@query(f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
f AS (SELECT doc_id, text, {_SIM} AS similarity FROM documents JOIN embeddings e ON doc_id = vec_id, q WHERE source = 'src1' ORDER BY similarity DESC, doc_id LIMIT 10)
SELECT doc_id AS chunk_id, round({_duck_keyword(WORDS)} * 0.45 + similarity * 0.55 + {_BOOST}, 6) AS score FROM f ORDER BY score DESC, chunk_id LIMIT 5""")
def paper_retrieval(spark, sf_dir):
    own = chunks(spark, sf_dir).where("source = 'src1'")
    return rx.hybrid(own, vectors(spark, sf_dir), query_vector(spark, sf_dir), WORDS, 5, widen=2).select("chunk_id", "score")


@query(f"SELECT doc_id AS chunk_id, round({_duck_keyword(WORDS)} * 0.45 + {_BOOST}, 6) AS score FROM documents WHERE round({_duck_keyword(WORDS)} * 0.45 + {_BOOST}, 6) > 0 ORDER BY score DESC, chunk_id LIMIT 20")
def keyword_retrieval(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.expr(_KIND).alias("content_type"), F.lit(None).cast("array<float>").alias("embedding"))
    return rx.hybrid(rows, None, [], WORDS, 20).select("chunk_id", "score")


ANGLES = {"method": ["the", "method"], "result": ["of", "and"], "limit": ["la", "die"], "future": ["this", "was"]}


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS query, doc_id, {_duck_keyword(v)} AS score FROM documents" for k, v in ANGLES.items()) + """),
b AS (SELECT query, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 15)
SELECT doc_id AS chunk_id, max(score) AS score, count(*) AS n_queries FROM b GROUP BY doc_id ORDER BY score DESC, chunk_id LIMIT 50""")
def multi_query_merge(spark, sf_dir):
    """Queries against all documents: the token set of a document is made once."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("chunk_id"), tx.tokens(F.col("text")).alias("tokens"))
    score = lambda words: F.round(vx.keyword_score(F.array(*map(F.lit, words)), F.col("tokens")), 6)
    scored = d.select("chunk_id", F.explode(F.array(*(F.struct(F.lit(k).alias("query"), score(v).alias("score")) for k, v in ANGLES.items()))).alias("x"))
    return rx.merged(scored.select("chunk_id", "x.query", "x.score").where("score > 0"), "chunk_id", "query", 15, 50)


_OVERRIDE = "CASE WHEN toxic = 1 THEN 'low' WHEN lang <> 'en' AND quality = 1 THEN 'medium' WHEN quality = 0 AND n_chars > 1500 THEN 'medium' WHEN quality = 1 THEN 'high' ELSE 'low' END"


@query(f"SELECT doc_id, {_OVERRIDE} AS score FROM documents JOIN labels USING (doc_id)")
def screening_override(spark, sf_dir):
    """Scores after the guard rails: off topic is low, method alone at most medium, several matches lift low."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rules = ((F.col("toxic") == 1, "low"), ((F.col("lang") != "en") & (F.col("quality") == 1), "medium"), ((F.col("quality") == 0) & (F.col("n_chars") > 1500), "medium"), (F.col("quality") == 1, "high"))
    return rows.select("doc_id", reduce(lambda c, r: c.when(*r), rules, F.when(F.lit(False), "")).otherwise("low").alias("score"))


@query("""SELECT source, coalesce(CASE WHEN source IN ('src0', 'src1') THEN min_by(doc_id, doc_id) FILTER (lang = 'en') ELSE min_by(doc_id, doc_id) FILTER (lang <> 'en') END, min(doc_id)) AS variant FROM documents GROUP BY source""")
def assign_variants(spark, sf_dir):
    """Academic sources get the first English variant of a query, others the first in another language, else the first."""
    d = table(spark, sf_dir, "documents")
    english, other = F.min(F.when(F.col("lang") == "en", F.col("doc_id"))), F.min(F.when(F.col("lang") != "en", F.col("doc_id")))
    g = d.groupBy("source").agg(english.alias("e"), other.alias("o"), F.min("doc_id").alias("first"))
    return g.select("source", F.coalesce(F.when(F.col("source").isin("src0", "src1"), F.col("e")).otherwise(F.col("o")), F.col("first")).alias("variant"))
