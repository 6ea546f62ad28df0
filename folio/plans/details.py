"""Queries over answers, records, nested values and what surrounds retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx
from folio.operators import dedup, synthesis
from folio.operators import graph as gx
from folio.plans.graph import _COLUMNS, _DEGREE, _NODES, papers
from folio.plans.registry import query
from folio.plans.retrieval import _duck_keyword
from folio.sources import sinks
from folio.sources.tables import fan_out, table, year_of

_ANSWER = "concat('As shown [CITE:', doc_id, '] and [CITE: ', doc_id + 100000, ' ] by ', text)"


@query("SELECT doc_id, 'As shown [CITE:' || doc_id || '] and [citation removed] by ' || text AS answer FROM documents")
def sanitize_citations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.known_citations(F.expr(_ANSWER), F.array(F.col("doc_id").cast("string"))).alias("answer"))


@query("SELECT doc_id, md5('As shown [CITE:' || doc_id || '] and [citation removed] by ' || text) AS answer_md5 FROM documents")
def sanitize_citations_whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.known_citations(F.expr(_ANSWER), F.array(F.col("doc_id").cast("string")))).alias("answer_md5"))


@query(f"SELECT conv_id, turn, '- ' || replace(regexp_replace(text, '{tx.DECORATION}', '', 'g'), '•', '-') || ' done' AS answer FROM conversations")
def strip_emoji(spark, sf_dir):
    raw = F.concat(F.lit("• "), F.col("text"), F.lit("\U0001f600✨ done"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.plain_answer(raw).alias("answer"))


@query(f"SELECT conv_id, turn, md5('- ' || replace(regexp_replace(text, '{tx.DECORATION}', '', 'g'), '•', '-') || ' done') AS answer_md5 FROM conversations")
def strip_emoji_whole(spark, sf_dir):
    raw = F.concat(F.lit("• "), F.col("text"), F.lit("\U0001f600✨ done"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.plain_answer(raw)).alias("answer_md5"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || ' ' || p_type END AS q FROM part")
def evidence_query(spark, sf_dir):
    some = lambda c: F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col(c))
    return table(spark, sf_dir, "part").select("p_partkey", tx.joined_fields([some("p_brand"), F.lit(None).cast("string"), some("p_type")], F.col("p_name")).alias("q"))


@query("SELECT doc_id, md5('Paper: ' || source || chr(10) || 'Section: ' || CASE WHEN doc_id % 4 = 0 THEN 'Unknown' ELSE lang END || chr(10) || 'Content type: narrative' || chr(10) || chr(10) || 'Chunk:' || chr(10) || text) AS text_md5 FROM documents")
def embedding_text(spark, sf_dir):
    section = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.embedding_text(F.col("source"), section, F.lit(""), F.col("text"))).alias("text_md5"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'high|low|medium' WHEN 1 THEN 'high|medium|medium' ELSE 'medium|medium|medium' END AS scores FROM events")
def parse_scores(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, '["High", "low", "?", "high"]').when(F.col("event_id") % 3 == 1, "very high, unsure").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(tx.screening_scores(raw, 3), "|").alias("scores"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) END AS label FROM events")
def extract_intent_label(spark, sf_dir):
    raw = F.concat(F.lit("The intent is **"), F.col("event_type"), F.lit("**."))
    return table(spark, sf_dir, "events").select("event_id", tx.intent_label(raw, ["CLICK", "VIEW"]).alias("label"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', '''')
 || ' Andr' || chr(233) || ' Bj' || chr(246) || 'rk ' || chr(128512) || ' ' || chr(8364) || ' &#1114112; &#xD800; &#; ' || chr(233)) AS html_md5 FROM pages""")
def unescape_entities(spark, sf_dir):
    """Named and numeric entities; numbers that are no character stay, and an escaped ampersand may make an entity."""
    raw = F.concat("html", F.lit(" Andr&#233; Bj&#xF6;rk &#x1F600; &#8364; &#1114112; &#xD800; &#; &amp;#233;"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.unescaped_entities(raw)).alias("html_md5"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 0 ELSE year(o_orderdate)::INT END AS year FROM orders")
def parse_year(spark, sf_dir):
    form = F.when(F.col("o_orderkey") % 4 == 0, "yyyy-MM-dd").when(F.col("o_orderkey") % 4 == 1, "yyyy-MM").otherwise("yyyy")
    raw = F.when(F.col("o_orderkey") % 4 == 3, "soon").when(form == "yyyy-MM-dd", F.date_format("o_orderdate", "yyyy-MM-dd")).when(form == "yyyy-MM", F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(year_of(raw), F.lit(0)).alias("year"))


@query("SELECT event_id, strftime(CASE event_id % 3 WHEN 2 THEN TIMESTAMP '2000-01-01' ELSE ts END, '%Y-%m-%d %H:%M') AS minute FROM events")
def parse_iso_time(spark, sf_dir):
    """Times with Z or without a zone are UTC; others fall back."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, iso).otherwise("none")
    at = F.coalesce(F.try_to_timestamp(raw), F.lit("2000-01-01").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("minute"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"done\":2,\"k\":' || json_extract(props, '$.k') || '}' ELSE '{\"done\":1,\"k\":' || json_extract(props, '$.k') || '}' END AS progress FROM events")
def merge_json(spark, sf_dir):
    """Later progress overwrites the fields of earlier progress; keys are sorted."""
    kind = "map<string,bigint>"
    new = F.create_map(F.lit("done"), F.when(F.col("event_id") % 2 == 0, 2).otherwise(1).cast("bigint"))
    old = F.from_json("props", kind)
    rest = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(rest, new))))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(merged).alias("progress"))


@query("SELECT event_id, left(sha256('{\"k\":' || json_extract(props, '$.k') || ',\"type\":\"' || event_type || '\"}'), 16) AS key FROM events")
def stable_hash(spark, sf_dir):
    """The same key for the same arguments, in whatever order they come."""
    args = F.array(F.struct(F.lit("type").alias("k"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')).alias("v")), F.struct(F.lit("k").alias("k"), F.get_json_object("props", "$.k").alias("v")))
    body = F.array_join(F.transform(F.array_sort(args), lambda a: F.concat(F.lit('"'), a["k"], F.lit('":'), a["v"])), ",")
    return table(spark, sf_dir, "events").select("event_id", F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16).alias("key"))


@query("SELECT gap_type, kind FROM (SELECT unnest(['limitation', 'method_gap', 'result_pattern', 'result_pattern', 'missing_dataset', 'missing_dataset']) AS gap_type, unnest(['limitation', 'method', 'results', 'narrative', 'method', 'narrative']) AS kind)")
def evidence_kinds(spark, sf_dir):
    #: The content types that back each kind of gap.
    kinds = {"limitation": ["limitation"], "method_gap": ["method"], "result_pattern": ["results", "narrative"], "missing_dataset": ["method", "narrative"]}
    entries = F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return spark.range(1).select(F.explode(entries).alias("gap_type", "list")).select("gap_type", F.explode("list").alias("kind"))


@query("SELECT conv_id, count(*) AS n, array_to_string(list(role ORDER BY turn)[1:3], ',') AS first_roles FROM conversations GROUP BY conv_id")
def array_cap(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", "n", F.array_join(F.slice(F.col("x.role"), 1, 3), ",").alias("first_roles"))


@query(f"SELECT source, count(*) AS n, round(avg(score), 6) AS mean, count(DISTINCT lang) AS languages FROM (SELECT source, lang, {_duck_keyword(['the', 'of'])} AS score FROM documents) WHERE score > 0 GROUP BY source")
def retrieval_summary(spark, sf_dir):
    score = F.round(vx.keyword_score(F.array(F.lit("the"), F.lit("of")), tx.tokens(F.col("text"))), 6)
    hits = table(spark, sf_dir, "documents").select("source", "lang", score.alias("score")).where("score > 0")
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.countDistinct("lang").alias("languages"))


@query(f"""WITH r AS (SELECT kind, label, coalesce(degree, 0) AS degree FROM {_NODES} LEFT JOIN {_DEGREE} USING (id) WHERE kind <> 'paper' QUALIFY row_number() OVER (PARTITION BY kind ORDER BY coalesce(degree, 0) DESC, label) <= 5)
SELECT kind, 'Central ' || kind || 's: ' || string_agg(label, ', ' ORDER BY degree DESC, label) AS line FROM r GROUP BY kind""")
def graph_context(spark, sf_dir):
    """The five best-connected concepts of each kind in a line for a prompt."""
    p = papers(spark, sf_dir)
    ranked = gx.ranked(gx.nodes(p, "p_partkey", _COLUMNS).drop("kind").withColumn("kind", F.split_part("id", F.lit(":"), F.lit(1))), gx.links(p, "p_partkey", _COLUMNS), "")
    rows = ranked.withColumn("kind", F.split_part("id", F.lit(":"), F.lit(1)))
    top = dedup.top_per_group(rows, ["kind"], [F.desc("rank"), F.col("label")], 5)
    g = top.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "label"))).alias("x"))
    return g.select("kind", F.concat(F.lit("Central "), "kind", F.lit("s: "), F.array_join(F.col("x.label"), ", ")).alias("line"))


@query(f"""SELECT id, neighbour, degree FROM (SELECT l.target AS id, l.source AS neighbour, d.degree FROM (SELECT 'paper:' || p_partkey AS source, 'dataset:' || lower(p_name) AS target FROM part) l JOIN {_DEGREE} d ON d.id = l.source) QUALIFY row_number() OVER (PARTITION BY id ORDER BY degree DESC, neighbour) <= 5""")
def graph_neighbours(spark, sf_dir):
    """The five best-connected neighbours of each data set."""
    links = gx.links(papers(spark, sf_dir), "p_partkey", _COLUMNS)
    near = links.where(F.col("target").startswith("dataset:")).join(gx.degrees(links).withColumnsRenamed({"id": "source"}), "source")
    top = dedup.top_per_group(near, ["target"], [F.desc("degree"), F.col("source")], 5)
    return top.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "degree")


@query("""SELECT l_orderkey AS a, l_partkey AS b, CASE WHEN l_quantity > 40 AND l_returnflag <> 'R' THEN 'medium' WHEN l_quantity > 40 THEN 'high' ELSE 'low' END AS confidence FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_linestatus <> ''""")
def conflict_guard(spark, sf_dir):
    """Conflicts whose papers are known and whose context says something; high ones without evidence are medium."""
    l = table(spark, sf_dir, "lineitem").where("l_linestatus <> ''")
    known = l.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    confidence = F.when((F.col("l_quantity") > 40) & (F.col("l_returnflag") != "R"), "medium").when(F.col("l_quantity") > 40, "high").otherwise("low")
    return known.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), confidence.alias("confidence"))


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'click') ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id LIMIT 25")
def auto_save_cap(spark, sf_dir):
    """At most 25 hits are saved by themselves: the limit is the feature."""
    hits = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    return hits.orderBy(F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").limit(25).select("event_id")


@query("SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier) AND (c_acctbal > 0 OR c_mktsegment = 'BUILDING') AS can_download FROM customer")
def can_download(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("near", F.lit(True))
    c = table(spark, sf_dir, "customer").join(s, "c_nationkey", "left")
    return c.select("c_custkey", (F.coalesce("near", F.lit(False)) & ((F.col("c_acctbal") > 0) | (F.col("c_mktsegment") == "BUILDING"))).alias("can_download"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, split_part(c_name, '#', 1)) AS name FROM customer")
def backfill_name(spark, sf_dir):
    own = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(own, F.split_part("c_name", F.lit("#"), F.lit(1))).alias("name"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, substring(text, greatest(1, length(text) - 79)) AS tail FROM conversations")
def chunk_index(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.cast("long").alias("chunk_index"), F.right("text", F.lit(80)).alias("tail"))


@query("SELECT DISTINCT l_orderkey AS paragraph FROM lineitem WHERE l_quantity <= 40 AND l_partkey IN (SELECT p_partkey FROM part)")
def supported_paragraphs(spark, sf_dir):
    """Paragraphs that keep at least one citation."""
    cites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paragraph")).agg(F.collect_list(F.when(F.col("l_quantity") > 40, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))).alias("cites"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return synthesis.valid_citations(cites, known).where("valid > 0").select("paragraph")


@query("SELECT c_custkey, coalesce(p, 'none') AS title FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def title_lookup(spark, sf_dir):
    """Titles by one join, where a lookup for each row would be slow."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"))
    return table(spark, sf_dir, "customer").join(p, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit("none")).alias("title"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id AS known FROM documents")
def content_probe(spark, sf_dir):
    """Whether a document's content came before."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return d.join(first, "hash").select("doc_id", (F.col("first") != F.col("doc_id")).alias("known"))


@query("SELECT stage, '## ' || stage || chr(10) || chr(10) || string_agg('- ' || label || ': ' || n, chr(10) ORDER BY label) AS body FROM (SELECT lang AS stage, source AS label, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY stage")
def audit_markdown(spark, sf_dir):
    long = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("stage"), F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.long_markdown(long, "stage", "label", "n")


@query("""SELECT conv_id, md5(string_agg(CASE WHEN before IS NULL OR before <> role THEN '### ' || role || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY turn)) AS body_md5 FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id""")
def report_markdown(spark, sf_dir):
    body = sinks.report_markdown(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return body.select("conv_id", F.md5("body").alias("body_md5"))


@query("SELECT url, min(page_id) AS page_id, count(*) AS matches FROM (SELECT page_id, lower(trim(split_part(url, '?', 1))) AS url FROM pages UNION ALL SELECT page_id + 1000000, lower(trim(split_part(url, '?', 1))) FROM pages WHERE contains(url, 'page=2')) GROUP BY url")
def source_fan_out(spark, sf_dir):
    """Two sources, of which the second repeats some of the first's records."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), F.split_part("url", F.lit("?"), F.lit(1)).alias("title"), F.col("url").alias("raw"))
    none = F.lit(None).cast("string")
    rows = p.select("page_id", "title", none.alias("arxiv_id"), none.alias("doi"), F.col("raw").alias("url"))
    second = rows.where(F.col("url").contains("page=2")).withColumn("page_id", F.col("page_id") + 1_000_000)
    merged = fan_out([rows.withColumn("url", F.lpad(F.col("page_id").cast("string"), 9, "0")), second])
    return merged.select(F.lower(F.trim("title")).alias("url"), "page_id", "matches")
