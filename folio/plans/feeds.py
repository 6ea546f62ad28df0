"""Queries over readers and sinks: raw records are made of the tables, as the services' formats have them, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx
from folio.operators import dedup, retrieval
from folio.operators import graph as gx
from folio.operators import slots
from folio.plans.graph import _COLUMNS, _LINKS, _NODES, papers
from folio.plans.registry import query
from folio.plans.retrieval import ANGLES, _duck_keyword
from folio.sources import hits, sinks
from folio.sources import tables as st
from folio.sources.tables import staging_path, table


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("""SELECT doc_id::VARCHAR AS title, md5(text) AS abstract_md5, (2000 + doc_id % 20)::INT AS year, CASE WHEN doc_id % 3 <> 0 THEN source END AS venue,
 CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id END AS doi, 'http://x.org/' || doc_id AS url, lang || ',B' AS authors FROM documents WHERE doc_id % 7 <> 0""")
def read_scholarly_hits(spark, sf_dir):
    """Search hits as JSON lines, some of them malformed."""
    d = documents(spark, sf_dir)
    ids = F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), "doc_id")).alias("DOI"))
    names = F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("B").alias("name")))
    hit = F.struct(
        F.col("doc_id").cast("string").alias("title"), F.col("text").alias("abstract"), (F.col("doc_id") % 20 + 2000).cast("int").alias("year"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source")).alias("venue"),
        F.concat(F.lit("http://x.org/"), "doc_id").alias("url"), ids.alias("externalIds"), names.alias("authors"),
    )
    lines = d.select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"title": '), "source")).otherwise(F.to_json(hit)).alias("value"))
    p = st.parsed_hits(lines)
    return p.select("title", F.md5("abstract").alias("abstract_md5"), "year", "venue", "doi", "url", F.array_join("authors", ",").alias("authors"))


@query("SELECT p_partkey::VARCHAR AS arxiv_id, p_name || ' & ' || p_type || ' é' AS title, 2020 AS year, 'Ann Lee,Bj' || chr(246) || 'rk' AS authors FROM part")
def read_atom_entries(spark, sf_dir):
    """Entries of a feed for each brand; entities in them are read."""
    entry = F.concat(
        F.lit("<entry><id>http://x.org/abs/"), "p_partkey", F.lit("v2</id>\n<title>\n  "), "p_name", F.lit(" &amp;\n  "), "p_type", F.lit(" &#233;</title><published>2020-05-01T00:00:00Z</published><summary>s</summary>"),
        F.lit("<author><name>Ann  Lee</name></author><author><name>Bj&#xF6;rk</name></author></entry>"),
    )
    feeds = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("value"))
    return st.parsed_entries(feeds).select("arxiv_id", "title", "year", F.array_join("authors", ",").alias("authors"))


@query("SELECT url, 'Page ' || page_id AS title, md5(html) AS text_md5, CASE WHEN page_id % 2 = 0 THEN 2021 ELSE 0 END::INT AS year, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 2 END::INT AS n_authors FROM pages")
def read_web_hits(spark, sf_dir):
    """Answers of a web search, authors as a comma-separated list with blanks in it."""
    date = F.when(F.col("page_id") % 2 == 0, "2021-03-04T05:06:07.000Z").otherwise("recently")
    author = F.when(F.col("page_id") % 3 != 0, F.lit(" Ann Lee, ,Bo Sun,"))
    hit = F.struct(F.concat(F.lit(" Page "), "page_id").alias("title"), "url", date.alias("publishedDate"), author.alias("author"), F.col("html").alias("text"))
    lines = table(spark, sf_dir, "pages").select(F.to_json(F.struct(F.array(hit).alias("results"))).alias("value"))
    return st.web_hits(lines).select("url", "title", F.md5("abstract").alias("text_md5"), F.coalesce("year", F.lit(0)).alias("year"), F.size("authors").alias("n_authors"))


@query("SELECT c_custkey, array_to_string(list_filter([trim(c_name), trim(c_mktsegment)], lambda x: x <> ''), '|') AS names FROM customer")
def author_names(spark, sf_dir):
    raw = F.concat(F.lit(" "), "c_name", F.lit(", ,"), "c_mktsegment", F.lit(" ,"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(st.author_names(raw), "|").alias("names"))


@query(r"""SELECT doc_id, md5('## ' || source || ' & more' || chr(10) || chr(10) || trim(regexp_replace(replace(replace(text, '<', '('), '&', '+'), '[ \t\n\r\f\v]+', ' ', 'g')) || chr(10) || chr(10) || 'end') AS body_md5 FROM documents WHERE doc_id % 5 <> 0 AND trim(text) <> ''""")
def read_xml_full_text(spark, sf_dir):
    """Articles in XML; those without a body are left out."""
    text = F.replace(F.replace("text", F.lit("<"), F.lit("(")), F.lit("&"), F.lit("+"))
    body = F.concat(F.lit('<article><front><title>no</title></front><body id="b"><sec><title>'), "source", F.lit(" &amp; <b>more</b></title><p>"), F.regexp_replace(text, r"\n{2,}", "\n"), F.lit("</p><p>e<i>nd</i></p></sec></body></article>"))
    d = st.spread(documents(spark, sf_dir).select("doc_id", "source", "text")).where(F.trim("text") != "")
    own = st.xml_body(F.when(F.col("doc_id") % 5 == 0, F.lit("<article><front/></article>")).otherwise(body))
    # a filter on a projected column is moved below it and reads each body again; one on a generated column is not
    rows = d.select("doc_id", F.explode_outer(F.array(own)).alias("body"))
    return rows.where("body IS NOT NULL").select("doc_id", F.md5("body").alias("body_md5"))


@query("SELECT doc_id, lang AS categories FROM documents WHERE lang IN ('en', 'de') AND doc_id % 9 <> 0")
def read_json_lines(spark, sf_dir):
    """A bulk file of JSON lines, of which some are blank, malformed or of other categories."""
    record = F.to_json(F.struct("doc_id", F.concat("lang", F.lit(" x")).alias("categories")))
    lines = documents(spark, sf_dir).select(F.when(F.col("doc_id") % 9 == 0, F.when(F.col("doc_id") % 2 == 0, "").otherwise('{"doc_id": ')).otherwise(record).alias("value"))
    found = st.parsed_lines(lines, "doc_id long, categories string", ["en", "de"])
    return found.select("doc_id", F.split_part("categories", F.lit(" "), F.lit(1)).alias("categories"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')) AS text_md5 FROM documents")
def rebuild_inverted_index(spark, sf_dir):
    """Texts as maps from words to their positions, and back."""
    d = st.spread(documents(spark, sf_dir).select("doc_id", "text"))
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)
    maps = d.select("doc_id", st.inverted_index(words).alias("index"))
    return maps.select("doc_id", F.md5(st.rebuilt_text(F.col("index"))).alias("text_md5"))


@query(r"SELECT 'mem:/' || conv_id || '/' || turn || '.md' AS path, CASE WHEN length(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) < 50 THEN 'ocr_required' ELSE 'completed' END AS status, md5(text) AS text_md5 FROM conversations WHERE text IS NOT NULL")
def read_files(spark, sf_dir):
    """Uploaded files, given as path and content."""
    raw = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.concat(F.lit("mem:/"), "conv_id", F.lit("/"), "turn", F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return st.scanned(raw).select("path", "status", F.md5("text").alias("text_md5"))


_HITS = "SELECT doc_id, {k} AS place, (2000 + doc_id % 20)::INT AS year, source AS title FROM documents WHERE lang = '{lang}' AND contains(lower(source || ' ' || text), 'a') ORDER BY year DESC, title, 'u' || doc_id LIMIT 25"


@query(f"SELECT doc_id, place FROM (SELECT * FROM ({_HITS.format(k=0, lang='fr')}) UNION ALL SELECT * FROM ({_HITS.format(k=1, lang='en')}) UNION ALL SELECT * FROM ({_HITS.format(k=2, lang='de')})) ORDER BY place, year DESC, title, 'u' || doc_id LIMIT 40")
def search_sources(spark, sf_dir):
    """Three sources (one for each language) are searched in turn, until 40 hits are found: the limits are the feature."""

    def rows(lang):
        def read(session):
            d = documents(session, sf_dir).where(F.col("lang") == lang)
            none = F.lit(None).cast("string")
            return d.select(F.lit(lang).alias("source"), F.col("source").alias("title"), F.col("text").alias("abstract"), (F.col("doc_id") % 20 + 2000).cast("int").alias("year"), none.alias("venue"), none.alias("doi"), F.col("doc_id").cast("string").alias("arxiv_id"), F.concat(F.lit("u"), "doc_id").alias("url"), F.array().cast("array<string>").alias("authors"))

        return read

    sources = [st.Source(x, rows(x)) for x in ("fr", "en", "de")]
    return st.search_all(spark, sources, ["a"], 40).select(F.col("arxiv_id").cast("long").alias("doc_id"), "place")


@query("SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def csv_matrix(spark, sf_dir):
    return sinks.csv_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("""SELECT 0::BIGINT AS place, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey) + 1, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region""")
def markdown_table(spark, sf_dir):
    rows = sinks.markdown_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])
    return rows.select(F.row_number().over(dedup.Window.orderBy("place")).cast("long").alias("n"), "line").select((F.col("n") - 1).alias("place"), "line")


@query("SELECT n_regionkey, n_nationkey, 'old' AS version FROM nation WHERE n_regionkey NOT IN (1, 2) UNION ALL SELECT n_regionkey, n_nationkey, 'new' FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey % 2 = 0")
def refresh_by_key(spark, sf_dir):
    """Rows of the keys that come anew replace all old rows of those keys."""
    old = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.lit("old").alias("version"))
    new = old.where("n_regionkey IN (1, 2) AND n_nationkey % 2 = 0").withColumn("version", F.lit("new"))
    return sinks.refreshed(old, new, ["n_regionkey"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1)")
def append_log(spark, sf_dir):
    """Two appended parts of a log, read in each user's order of time."""
    e = table(spark, sf_dir, "events")
    log = e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1"))
    return log.select("user_id", "event_id", F.row_number().over(dedup.Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


@query("""WITH f AS (SELECT n_regionkey, n_name, n_nationkey % 5 AS k, '"' || n_name || '":' || CASE n_nationkey % 5 WHEN 0 THEN '{"type":["number","null"]}' WHEN 1 THEN '{"type":["boolean","null"]}' WHEN 2 THEN '{"type":["string","null"],"enum":["a","b",null]}'
 WHEN 3 THEN '{"type":"array","items":{"type":"string","enum":["a","b"]}}' ELSE '{"type":["string","null"]}' END AS field FROM nation)
SELECT n_regionkey, '{"type":"object","properties":{' || string_agg(field, ',' ORDER BY n_name) || '},"required":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || '],"additionalProperties":false}' AS schema FROM f GROUP BY n_regionkey""")
def extraction_schema(spark, sf_dir):
    """JSON Schema of each set of typed fields (regions stand for sets, nations for fields)."""
    kind = F.element_at(F.array(*map(F.lit, ("number", "boolean", "enum", "multi_select", "text"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    options = F.when(kind.isin("enum", "multi_select"), F.array(F.lit("a"), F.lit("b")))
    return vx.json_schema(table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("name"), kind.alias("kind"), options.alias("options")), "n_regionkey")


@query(f"""WITH shown AS (SELECT id FROM {_NODES} WHERE contains(lower(label), 'promo') OR kind = 'paper')
SELECT source, target FROM {_LINKS} WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)""")
def graph_node_search(spark, sf_dir):
    """Links between the papers and the concepts whose label holds a search text."""
    p = papers(spark, sf_dir)
    _, links = gx.searched(gx.nodes(p, "p_partkey", _COLUMNS), gx.links(p, "p_partkey", _COLUMNS), "Promo")
    return links.select("source", "target")


@query("""WITH c AS (SELECT DISTINCT source, lang AS label, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)),
t AS (SELECT source, label, n FROM c WHERE label <> 'en' QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, label) <= 2)
SELECT s.source, 'en ' || s.source || coalesce(' ' || string_agg(label, ' ' ORDER BY n DESC, label), '') AS query FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN t ON t.source = s.source GROUP BY s.source""")
def expand_queries(spark, sf_dir):
    """Each query with the two best-ranked concepts that it does not name yet (sources stand for queries, languages for concepts)."""
    d = documents(spark, sf_dir)
    queries = d.select("source").distinct().select("source", F.concat(F.lit("en "), "source").alias("query"))
    concepts = d.groupBy("source", F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("rank"))
    return retrieval.expanded_queries(queries, concepts, "source", 2)


_PAPER_OF = "doc_id % 10"


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS query, doc_id, {_duck_keyword(v)} AS score FROM documents" for k, v in ANGLES.items()) + f"""),
b AS (SELECT query, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 15),
m AS (SELECT doc_id, max(score) AS score FROM b GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 40)
SELECT {_PAPER_OF} AS paper, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY score DESC, doc_id) AS chunks FROM m GROUP BY 1""")
def gap_retrieval(spark, sf_dir):
    """Four queries for gaps, 15 chunks each, 40 in all, grouped by paper."""
    d = st.spread(documents(spark, sf_dir).select("doc_id", "text")).select(F.col("doc_id").alias("chunk_id"), tx.tokens(F.col("text")).alias("tokens"))
    score = lambda words: F.round(vx.keyword_score(F.array(*map(F.lit, words)), F.col("tokens")), 6)
    scored = d.select("chunk_id", F.explode(F.array(*(F.struct(F.lit(k).alias("query"), score(v).alias("score")) for k, v in ANGLES.items()))).alias("x"))
    top = retrieval.merged(scored.select("chunk_id", "x.query", "x.score").where("score > 0"), "chunk_id", "query", 15, 40)
    each = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id")))
    return top.groupBy((F.col("chunk_id") % 10).alias("paper")).agg(F.count(F.lit(1)).alias("n"), F.array_join(each["chunk_id"].cast("array<string>"), ",").alias("chunks"))


@query("SELECT o_orderkey, CASE WHEN (o_orderkey // 25) % 4 = 3 THEN 'medium' WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'low' END AS score FROM orders")
def batch_scoring(spark, sf_dir):
    """Scores by a model that gets 25 rows at a time; where its answer fails, rows are medium."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") / 25).cast("long").alias("batch"))

    def model(batch: int, values: list[float]) -> list[str]:
        return [] if batch % 4 == 3 else ["high" if v > 200_000 else "medium" if v > 50_000 else "low" for v in values]

    return slots.scored(rows, "batch", "o_orderkey", "o_totalprice", model).select("o_orderkey", "score")


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 OR vec_id % 10 = 1 THEN 'old' ELSE 'new' END AS model, CASE WHEN vec_id % 3 = 0 OR vec_id % 10 = 1 THEN len(embedding) ELSE 2 END::INT AS size,
 CASE WHEN vec_id % 3 = 0 OR vec_id % 10 = 1 THEN 0 ELSE length('t' || vec_id) END::INT AS first FROM (SELECT *, vec_id % 3 <> 0 AS stale FROM embeddings)""")
def reembed(spark, sf_dir):
    """Vectors that another model made are made anew from their texts (here: of two numbers); some texts fail and stay as they are."""
    target, old = "new", "old"

    def embed(texts):
        return texts.map(lambda t: None if t.endswith("1") else [float(len(t)), 1.0])

    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.lit(old).alias("model"), "embedding", F.concat(F.lit("t"), "vec_id").alias("text"))
    kept = rows.where("vec_id % 3 = 0").withColumn("model", F.lit(target))
    out = slots.renewed(rows.where("vec_id % 3 <> 0").unionByName(kept), "vec_id", "model", "embedding", target, embed)
    stale = (F.col("vec_id") % 3 == 0) | (F.col("model") == old)
    return out.select("vec_id", F.when(stale, old).otherwise("new").alias("model"), F.size("embedding").alias("size"), F.when(stale, 0).otherwise(F.get("embedding", F.lit(0)).cast("int")).alias("first"))


@query("SELECT doc_id AS id, md5(text) AS title, (1990 + doc_id % 30)::INT AS year FROM documents WHERE doc_id % 11 <> 0 AND 1990 + doc_id % 30 BETWEEN 2001 AND 2012")
def hits_source(spark, sf_dir):
    """Documents as pages of a service's answers, written and read back by the data source, which gets the years as bounds."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("title"), F.when(F.col("doc_id") % 11 != 0, (1990 + F.col("doc_id") % 30).cast("int")).alias("year"), F.lit(0).alias("answer"))
    placed = dedup.running_sum(d, ["answer"], "id", F.lit(1).cast("long"), "n").select((F.col("n") - 1).alias("place"), "id", "title", "year")
    folder = staging_path(spark, "hits")
    hits.write_pages(placed, folder)
    return hits.read_hits(spark, folder).where("year BETWEEN 2001 AND 2012")
