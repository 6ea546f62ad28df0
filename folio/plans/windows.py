"""Queries over ordered groups: dedup, top n, numbering, budgets, replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import dedup
from folio.plans.registry import query
from folio.sources.tables import table

_KEY = "coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE sha256(text) END, ''), lower(trim(text)))"


def _keyed(spark, sf_dir):
    strong = F.nullif(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.sha2("text", 256)), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(strong, F.lower(F.trim("text"))).alias("key"))


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) = 1")
def dedup_strongest_id(spark, sf_dir):
    return dedup.by_digest(_keyed(spark, sf_dir), "key", "doc_id").select("doc_id", "source")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS matches FROM documents GROUP BY {_KEY}")
def dedup_match_counts(spark, sf_dir):
    return dedup.by_digest(_keyed(spark, sf_dir), "key", "doc_id").select("doc_id", "matches")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(left(lower(text), 100))")
def dedup_title_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.substring(F.lower("text"), 1, 100)).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(text, 80)")
def dedup_title_prefix_case(spark, sf_dir):
    """The variant with a key of 80 characters as they are: a title's beginning is the key."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_CONF = "CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'medium' ELSE 'low' END"


@query(f"""WITH e AS (SELECT event_id, user_id, floor(value / 20)::INT AS other, {_CONF} AS confidence FROM events)
SELECT event_id, user_id, other, confidence FROM e QUALIFY row_number() OVER (PARTITION BY user_id, other ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE WHEN confidence = 'high' THEN -event_id ELSE event_id END) = 1""")
def dedup_pair_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("value") / 20).cast("int").alias("other"), F.expr(_CONF).alias("confidence"))
    return dedup.best_pair(e, ["user_id", "other"], "confidence", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def topn_per_group(spark, sf_dir):
    return dedup.top_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 2).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_partkey, '[' || CASE WHEN p_size % 4 = 0 THEN 'I-' ELSE '' END || row_number() OVER (PARTITION BY p_brand, p_size % 4 = 0 ORDER BY p_partkey) || ']' AS label FROM part")
def reference_numbering(spark, sf_dir):
    side = F.col("p_size") % 4 == 0
    n = F.row_number().over(Window.partitionBy("p_brand", side).orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.when(side, "I-").otherwise(""), n.cast("string"), F.lit("]")).alias("label"))


@query("SELECT doc_id, source, used::BIGINT AS used FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 30000")
def context_budget(spark, sf_dir):
    """Blocks of each source while they fit the budget; the first that does not ends the list."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return dedup.running_sum(d, ["source"], "doc_id", F.col("n_chars"), "used").where("used <= 30000").select("doc_id", "source", "used")


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 1200 THEN left(text, 1200) || '...' ELSE text END AS body FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8)
SELECT conv_id, count(*) AS n, md5(string_agg(role || ': ' || body, chr(10) ORDER BY turn)) AS context_md5 FROM m GROUP BY conv_id""")
def conversation_context(spark, sf_dir):
    clipped = F.when(F.length("text") > 1200, F.concat(F.substring("text", 1, 1200), F.lit("..."))).otherwise(F.col("text"))
    last = dedup.top_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 8)
    g = last.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), clipped).alias("line")))).alias("x"))
    return g.select("conv_id", "n", F.md5(F.array_join(F.col("x.line"), "\n")).alias("context_md5"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def replay_last(spark, sf_dir):
    return dedup.top_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id")


@query("SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS section, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def carry_forward(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opened = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("user_id", "event_id", opened.alias("section"), F.lag("event_type").over(w).alias("previous"))


@query(r"""WITH w AS (SELECT conv_id, turn, t.w AS word, t.i AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM conversations), LATERAL (SELECT unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i) t),
f AS (SELECT conv_id, word, turn, i FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, lower(word) ORDER BY turn, i) = 1),
k AS (SELECT conv_id, word, turn, i FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) <= 80)
SELECT conv_id, left(string_agg(word, ' ' ORDER BY turn, i), 3000) AS terms FROM k GROUP BY conv_id""")
def query_terms(spark, sf_dir):
    """The first distinct words of a conversation, without regard to case."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)).alias("i", "word"))
    fresh = dedup.first_seen(words.withColumn("key", F.lower("word")), ["conv_id", "key"], ["turn", "i"])
    top = dedup.top_per_group(fresh, ["conv_id"], [F.col("turn"), F.col("i")], 80)
    g = top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "i", "word"))).alias("x"))
    return g.select("conv_id", F.substring(F.array_join(F.col("x.word"), " "), 1, 3000).alias("terms"))


@query("SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)) - 1) // 12 AS batch FROM orders")
def batch_assign(spark, sf_dir):
    o = dedup.running_sum(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", F.lit(1).cast("long"), "n")
    return o.select("o_orderkey", "o_orderstatus", F.floor((F.col("n") - 1) / 12).cast("long").alias("batch"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, len(string_split(text, chr(10))) AS n FROM documents),
h AS (SELECT doc_id, line, pos, n FROM l WHERE length(line) BETWEEN 1 AND 12)
SELECT doc_id, line AS section, pos::INT AS start_line, (coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n + 1) - 1)::INT AS end_line FROM h""")
def section_spans(spark, sf_dir):
    """Short lines stand for headings here; each section ends before the next one."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.size(tx.lines(F.col("text"))).alias("n"), F.posexplode(tx.lines(F.col("text"))).alias("p", "line"))
    heads = lines.where(F.length("line").between(1, 12)).withColumn("at", F.col("p") + 1)
    following = F.lead("at").over(Window.partitionBy("doc_id").orderBy("at"))
    return heads.select("doc_id", F.col("line").alias("section"), F.col("at").alias("start_line"), (F.coalesce(following, F.col("n") + 1) - 1).alias("end_line"))
