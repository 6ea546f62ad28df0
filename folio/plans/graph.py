"""Queries over the concept graph, claims, conflicts and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import graph as gx
from folio.operators import synthesis as sx
from folio.plans.registry import query
from folio.sources.tables import table

_COLUMNS = {"method": "method", "dataset": "dataset"}
_LONG = "(SELECT p_partkey, 'method' AS kind, p_brand || ' ' || p_type || ' ' || p_size AS label FROM part UNION SELECT p_partkey, 'dataset', p_name FROM part)"
_LINKS = f"(SELECT 'paper:' || p_partkey AS source, kind || ':' || lower(label) AS target, 'uses_' || kind AS relation FROM {_LONG})"
_NODES = f"(SELECT 'paper:' || p_partkey AS id, 'paper' AS kind, p_partkey::VARCHAR AS label FROM part UNION SELECT kind || ':' || lower(label), kind, label FROM {_LONG})"
_DEGREE = f"(SELECT id, count(*) AS degree FROM (SELECT source AS id FROM {_LINKS} UNION ALL SELECT target FROM {_LINKS}) GROUP BY id)"


def papers(spark, sf_dir):
    """Parts stand for papers, what they are made of for methods and their names for data sets."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("method"), F.col("p_name").alias("dataset"))


@query(f"SELECT * FROM {_NODES}")
def graph_nodes(spark, sf_dir):
    return gx.nodes(papers(spark, sf_dir), "p_partkey", _COLUMNS)


@query(f"SELECT * FROM {_LINKS}")
def graph_links(spark, sf_dir):
    return gx.links(papers(spark, sf_dir), "p_partkey", _COLUMNS)


@query(f"SELECT a.p_partkey AS a, b.p_partkey AS b, a.kind, count(*) AS n FROM {_LONG} a JOIN {_LONG} b ON a.kind = b.kind AND a.label = b.label AND a.p_partkey < b.p_partkey GROUP BY 1, 2, 3")
def graph_shared_edges(spark, sf_dir):
    return gx.shared(papers(spark, sf_dir), "p_partkey", _COLUMNS)


@query(f"SELECT * FROM {_DEGREE}")
def graph_degree(spark, sf_dir):
    return gx.degrees(gx.links(papers(spark, sf_dir), "p_partkey", _COLUMNS))


@query(f"SELECT kind, count(*) AS n FROM {_NODES} GROUP BY kind UNION ALL SELECT 'edges', count(*) FROM {_LINKS}")
def graph_stats(spark, sf_dir):
    p = papers(spark, sf_dir)
    n = gx.nodes(p, "p_partkey", _COLUMNS).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(gx.links(p, "p_partkey", _COLUMNS).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))


@query(f"WITH k AS (SELECT id FROM {_DEGREE} WHERE degree >= 3) SELECT source, target, relation FROM {_LINKS} WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) UNION ALL SELECT id, NULL, 'node' FROM {_NODES} WHERE id IN (SELECT id FROM k)")
def graph_min_degree(spark, sf_dir):
    p = papers(spark, sf_dir)
    kept, edges = gx.filtered(gx.nodes(p, "p_partkey", _COLUMNS), gx.links(p, "p_partkey", _COLUMNS), 3)
    return edges.unionByName(kept.select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("node").alias("relation")))


@query(rf"""SELECT id, label, len(list_intersect(['steel', 'brand#11', 'large'], list_filter(regexp_split_to_array(lower(replace(replace(label, '/', ' '), '-', ' ')), '[ \t]+'), lambda x: x <> ''))) * 10 + coalesce(degree, 0) AS rank FROM {_NODES} LEFT JOIN {_DEGREE} USING (id) WHERE kind <> 'paper'""")
def graph_concept_rank(spark, sf_dir):
    p = papers(spark, sf_dir)
    return gx.ranked(gx.nodes(p, "p_partkey", _COLUMNS), gx.links(p, "p_partkey", _COLUMNS), "Steel Brand#11/large").withColumn("rank", F.col("rank").cast("long"))


def pairs_of(items):
    return items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_partkey").alias("paper_a"), F.col("l_suppkey").alias("paper_b"), F.concat(F.lit("ships "), F.to_date("l_shipdate").cast("string")).alias("claim_a"), F.concat(F.lit("returns "), F.col("l_returnflag")).alias("claim_b"), F.col("l_linestatus").alias("confidence"))


@query("""SELECT pair_id, side, paper, left(claim, 500) AS claim, 'contradict' AS type, 1 AS supports, 1 AS contradicts, confidence FROM (
SELECT l_orderkey * 10 + l_linenumber AS pair_id, unnest(['a', 'b']) AS side, unnest([l_partkey, l_suppkey]) AS paper, unnest(['ships ' || l_shipdate::DATE, 'returns ' || l_returnflag]) AS claim, l_linestatus AS confidence FROM lineitem WHERE l_quantity > 45)""")
def claims_from_pairs(spark, sf_dir):
    return sx.claims_from_pairs(pairs_of(table(spark, sf_dir, "lineitem").where("l_quantity > 45")))


@query("""SELECT pair_id, side, paper, left(claim, 500) AS claim, 'contradict' AS type, 1 AS supports, 1 AS contradicts, confidence FROM (
SELECT l_orderkey * 10 + l_linenumber AS pair_id, unnest(['a', 'b']) AS side, unnest([l_partkey, l_suppkey]) AS paper, unnest(['ships ' || l_shipdate::DATE, 'returns ' || l_returnflag]) AS claim, l_linestatus AS confidence FROM lineitem)""")
def claims_from_pairs_whole(spark, sf_dir):
    return sx.claims_from_pairs(pairs_of(table(spark, sf_dir, "lineitem")))


@query("""SELECT paper, type, claim FROM (SELECT p_partkey AS paper, unnest(['support', 'weak']) AS type, unnest([CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE trim(p_name) END, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE trim(p_type) END]) AS claim FROM part) WHERE trim(claim) <> ''""")
def claims_from_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_name")).alias("key_result"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("limitation"))
    return sx.claims_from_matrix(rows)


@query("""SELECT field, value, n FROM (SELECT 0 AS place, 'p_brand' AS field, p_brand AS value, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand UNION ALL SELECT 1, 'p_type', p_type, count(*), min(p_partkey) FROM part GROUP BY p_type) WHERE n >= 2 ORDER BY place, first, value LIMIT 10""")
def conflict_groups(spark, sf_dir):
    return sx.conflict_groups(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"])


_PARAGRAPHS = "(SELECT l_orderkey AS paragraph, list(CASE WHEN l_quantity > 40 THEN -1 - l_partkey ELSE l_partkey END) AS cites FROM lineitem GROUP BY l_orderkey)"


def _paragraphs(spark, sf_dir):
    id_ = F.when(F.col("l_quantity") > 40, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paragraph")).agg(F.collect_list(id_).alias("cites"))


@query("SELECT l_orderkey AS paragraph, count(*) AS cited, count(*) FILTER (l_quantity <= 40 AND l_partkey IN (SELECT p_partkey FROM part)) AS valid FROM lineitem GROUP BY 1")
def citation_validate(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return sx.valid_citations(_paragraphs(spark, sf_dir), known)


@query("SELECT count(*) AS total, count(*) FILTER (l_quantity > 40) AS invalid, count(DISTINCT CASE WHEN l_quantity <= 40 THEN l_partkey END) AS valid_papers, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity <= 40)) AS uncited FROM lineitem")
def citation_audit(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    good = l.where("l_quantity <= 40")
    uncited = p.join(good.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").agg(F.count(F.lit(1)).alias("uncited"))
    return l.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_quantity") > 40).alias("invalid"), F.countDistinct(F.when(F.col("l_quantity") <= 40, F.col("l_partkey"))).alias("valid_papers")).crossJoin(uncited)


@query("SELECT l_orderkey AS section, count(DISTINCT l_partkey) AS papers, count(DISTINCT l_partkey) < 3 AS flagged FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def citation_density(spark, sf_dir):
    n = F.countDistinct("l_partkey")
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("section")).agg(n.alias("papers"), (n < 3).alias("flagged"))


_C = r"list_distinct(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?[ ]*%') || regexp_extract_all(text, '(?i)\b[0-9][0-9,]*[ ]*tokens?\b') || regexp_extract_all(text, '(?i)\b[0-9]+[ ]+of[ ]+[0-9]+\b') || list_filter(regexp_extract_all(text, '\b[0-9][0-9,]*(?:\.[0-9]+)?\b'), lambda x: length(rtrim(replace(x, ',', ''), '.0')) >= 3))"


@query(f"""WITH c AS (SELECT doc_id AS key, source, unnest({_C}) AS claim FROM documents WHERE lang = 'en'), k AS (SELECT source, text AS chunk FROM documents WHERE lang <> 'en')
SELECT key, claim, coalesce(bool_or(contains(chunk, claim) OR contains(chunk, replace(claim, ',', '')) OR contains(chunk, trim(replace(claim, '%', '')))), false) AS grounded FROM c LEFT JOIN k USING (source) GROUP BY key, claim""")
def claim_grounding(spark, sf_dir):
    """English documents stand for reports, others of the same source for the evidence they cite."""
    d = table(spark, sf_dir, "documents")
    texts = d.where("lang = 'en'").select(F.col("doc_id").alias("key"), "source", "text")
    return sx.grounded(texts, d.where("lang <> 'en'").select("source", F.col("text").alias("chunk_text")))


@query("""WITH v AS (SELECT l_orderkey AS gap, count(DISTINCT l_partkey) AS valid FROM lineitem WHERE l_quantity <= 10 AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1)
SELECT o_orderkey AS gap, coalesce(valid, 0) AS valid, CASE WHEN coalesce(valid, 0) >= 2 THEN 'kept' WHEN valid = 1 AND o_orderstatus = 'O' THEN 'downgraded' ELSE 'dropped' END AS status FROM orders LEFT JOIN v ON gap = o_orderkey""")
def gap_guard(spark, sf_dir):
    gaps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gap"), F.when(F.col("o_orderstatus") == "O", "A single paper says so").otherwise("Several say so").alias("text"))
    evidence = table(spark, sf_dir, "lineitem").where("l_quantity <= 10").select(F.col("l_orderkey").alias("gap"), F.col("l_partkey").alias("id"))
    return sx.gap_guard(gaps, evidence, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html || ' http://x.org/' || page_id || '.pdf ', 'https?://[^ \"<>()]+\\.pdf'), ''), '') AS pdf FROM pages")
def pages_pdf_links(spark, sf_dir):
    body = F.concat("html", F.lit(" http://x.org/"), F.col("page_id"), F.lit(".pdf "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(body, 'https?://[^ "<>()]+\\.pdf', 0).alias("pdf"))


@query("""SELECT page_id, len(l)::INT AS n_links, md5(array_to_string(l, '|')) AS links_md5 FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def pages_links(spark, sf_dir):
    l = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(l).alias("n_links"), F.md5(F.array_join(l, "|")).alias("links_md5"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style|figure|math|nav)\b.*?</(?:script|style|figure|math|nav)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS text_md5 FROM pages""")
def pages_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("text_md5"))


_SIDES = "pair_id, unnest([0, 1]) AS k, unnest([pa, pb]) AS own, unnest([pb, pa]) AS other, unnest([ca, cb]) AS said, confidence"
_PAIRS = """(SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_partkey AS pa, l_suppkey AS pb, '  ships ' || l_shipdate::DATE AS ca, CASE l_returnflag WHEN 'N' THEN '  ' WHEN 'R' THEN 'returns ' || l_returnflag || ' ' ELSE NULL END AS cb, CASE WHEN l_linestatus = 'O' THEN 'high' END AS confidence FROM lineitem)"""


def _conflicts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    said = F.when(F.col("l_returnflag") == "N", "  ").when(F.col("l_returnflag") == "R", F.concat(F.lit("returns "), "l_returnflag", F.lit(" ")))
    ships = F.concat(F.lit("  ships "), F.to_date("l_shipdate").cast("string"))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_partkey").alias("paper_a"), F.col("l_suppkey").alias("paper_b"), ships.alias("claim_a"), said.alias("claim_b"), F.when(F.col("l_linestatus") == "O", "high").alias("confidence"))


@query(f"SELECT pair_id * 2 + k AS claim_id, CASE k WHEN 0 THEN 'claim_a' ELSE 'claim_b' END AS field_origin, trim(said) AS text, 'contradict' AS type, 1 AS supports, 1 AS contradicts, coalesce(confidence, 'medium') AS confidence FROM (SELECT {_SIDES} FROM {_PAIRS}) WHERE trim(said) <> ''")
def conflict_claims(spark, sf_dir):
    return sx.conflict_claims(_conflicts(spark, sf_dir))[0]


@query(f"""WITH c AS (SELECT * FROM (SELECT {_SIDES} FROM {_PAIRS}) WHERE trim(said) <> '')
SELECT pair_id * 2 + k AS claim_id, own AS paper, 'support' AS polarity, left(said, 500) AS snippet FROM c UNION ALL SELECT pair_id * 2 + k, other, 'contradict', NULL FROM c""")
def conflict_evidence(spark, sf_dir):
    """Two pieces of evidence for each claim of a conflict, tied to it by an identifier of its own."""
    return sx.conflict_claims(_conflicts(spark, sf_dir))[1]


@query("""WITH l AS (SELECT o_custkey AS report, o_orderkey AS section, (l_linenumber - 1) // 2 AS para, l_linenumber AS n, CASE WHEN l_quantity > 25 THEN -1 - l_partkey ELSE l_partkey END AS cite FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT *, cite IN (SELECT p_partkey FROM part) AS good FROM l),
p AS (SELECT report, section, para, string_agg(cite::VARCHAR, ',' ORDER BY n, cite) FILTER (good) AS cites FROM v GROUP BY ALL),
s AS (SELECT report, section, string_agg('p' || para || ':' || cites, ';' ORDER BY para) AS body, count(*) AS n_paragraphs FROM p WHERE cites IS NOT NULL GROUP BY ALL),
r AS (SELECT report, count(*) AS n_sections, sum(n_paragraphs)::BIGINT AS n_paragraphs, string_agg('s' || section || '[' || body || ']', '' ORDER BY section) AS tree FROM s GROUP BY report)
SELECT a.report, coalesce(n_sections, 0) AS n_sections, coalesce(n_paragraphs, 0) AS n_paragraphs, md5(coalesce(tree, '')) AS tree_md5, total, invalid, cited
FROM (SELECT report, count(*) AS total, count(*) FILTER (NOT good) AS invalid, count(DISTINCT CASE WHEN good THEN cite END) AS cited FROM v GROUP BY report) a LEFT JOIN r USING (report)""")
def report_pruning(spark, sf_dir):
    """Reports (a customer's orders) without unknown citations, and what that leaves empty."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    cite = F.when(F.col("l_quantity") > 25, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))
    paras = l.groupBy("o_custkey", "o_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).alias("para")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cite.alias("cite")))).alias("x"))
    paras = paras.select("o_custkey", "o_orderkey", F.struct("para", F.concat(F.lit("p"), F.col("para").cast("string")).alias("text"), F.col("x.cite").alias("cites")).alias("p"))
    sections = paras.groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_list("p")).alias("paragraphs"))
    reports = sections.groupBy(F.col("o_custkey").alias("report")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("title"), "paragraphs"))).alias("sections"))
    kept = sx.pruned(reports, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))
    text = lambda p: F.concat(p["text"], F.lit(":"), F.array_join(p["cites"].cast("array<string>"), ","))
    tree = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("s"), s["title"].cast("string"), F.lit("["), F.array_join(F.transform(s["paragraphs"], text), ";"), F.lit("]"))), "")
    n = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.size(s["paragraphs"]))
    return kept.select("report", F.size("sections").cast("long").alias("n_sections"), n.alias("n_paragraphs"), F.md5(tree).alias("tree_md5"), F.col("total").cast("long").alias("total"), F.col("invalid").cast("long").alias("invalid"), F.col("cited").cast("long").alias("cited"))
