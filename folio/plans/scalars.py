"""Queries that show the scalar functions over text, numbers, vectors, JSON and typed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx
from folio.plans.registry import query
from folio.sources import tables as st
from folio.sources.tables import spread, table




def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*')) AS t FROM documents)")
def tokenize_set(spark, sf_dir):
    t = tx.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ")).alias("tokens_md5"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(replace(replace(p_name || '/' || p_type, '/', ' '), '-', ' ')), '[ \t\n\r\f\v]+'), lambda x: x <> ''), '|') AS words FROM part""")
def simple_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.simple_tokens(F.concat_ws("/", "p_name", "p_type")), "|").alias("words"))


@query(r"""WITH w AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')[1:10], ' ') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 120 THEN rtrim(left(s, 119)) ELSE s END AS label FROM w""")
def compact_label(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.compact_label(F.col("text")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS short FROM documents")
def truncate_ellipsis(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.truncated(F.col("text"), 60).alias("short"))


_VALUES = "CASE o_orderkey % 6 WHEN 0 THEN ' n/a ' WHEN 1 THEN 'None given' WHEN 2 THEN '' WHEN 3 THEN ' ' || o_orderpriority || ' ' WHEN 4 THEN 'Unknown' ELSE o_orderstatus END"


@query(f"WITH v AS (SELECT o_orderkey, trim({_VALUES}) AS raw FROM orders) SELECT o_orderkey, CASE WHEN raw = '' OR regexp_matches(lower(raw), '^(not specified|n/a|none|unknown|not available|unspecified)') THEN NULL ELSE raw END AS value FROM v")
def clean_placeholder(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.clean_value(F.expr(_VALUES)).alias("value"))


@query("""WITH a AS (SELECT s_nationkey, list(s_name ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey)
SELECT s_nationkey, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS authors FROM a""")
def format_authors(spark, sf_dir):
    grouped = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))
    return grouped.select("s_nationkey", tx.author_line(F.col("names")).alias("authors"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g') AS term FROM documents")
def normalize_term(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.squeeze(F.col("text")).alias("term"))


_NAMES = "CASE event_id % 6 WHEN 0 THEN 'Semantic Scholar, arXiv' WHEN 1 THEN ' arXiv ' WHEN 2 THEN 'Exa, Firecrawl' WHEN 3 THEN 'Open Alex' WHEN 4 THEN 'via firecrawl and exa' ELSE event_type END"


@query(f"""WITH n AS (SELECT event_id, lower(trim({_NAMES})) AS x FROM events),
p AS (SELECT event_id, x, list_min(list_filter([struct_pack(at := strpos(x, 'semantic_scholar'), name := 'semantic_scholar'), struct_pack(at := strpos(x, 'arxiv'), name := 'arxiv'),
 struct_pack(at := strpos(x, 'exa'), name := 'exa'), struct_pack(at := strpos(x, 'firecrawl'), name := 'firecrawl'), struct_pack(at := strpos(x, 'openalex'), name := 'openalex')], lambda y: y.at > 0)) AS first FROM n)
SELECT event_id, CASE WHEN x IN ('semantic_scholar', 'arxiv', 'exa', 'firecrawl', 'openalex') THEN x WHEN contains(x, 'semantic scholar') THEN 'semantic_scholar' WHEN contains(x, 'open alex') THEN 'openalex' ELSE first.name END AS source FROM p""")
def normalize_source(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.source_name(F.expr(_NAMES)).alias("source"))


_MARKED = "concat('**', left(text, 10), '** and *', substring(text, 11, 8), '* `', right(text, 6), '` [', left(text, 4), '](http://x.y/z)  end')"
#: A star beside another one opens and closes nothing, so stars in a row are set aside as a sign first.
_BOLD = r"regexp_replace({}, '\*\*([^*\n]+)\*\*', '\1', 'g')"
_ASIDE = f"replace(replace({_BOLD}, '**', chr(1) || chr(1)), chr(1) || '*', chr(1) || chr(1))"
_ITALIC = rf"replace(regexp_replace({_ASIDE}, '\*([^*\x01\n]+)\*', '\1', 'g'), chr(1), '*')"
_STRIPPED = rf"regexp_replace(regexp_replace({_ITALIC}, '`([^`\n]+)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"


_MARKED_WHOLE = f"concat(text, ' ', {_MARKED})"
_STARRED = f"concat(text, ' **a* ***b*** *c** ', {_MARKED})"


@query(f"SELECT doc_id, {_STRIPPED.format(_STARRED)} AS plain FROM documents")
def strip_markdown(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.strip_markdown(F.expr(_STARRED)).alias("plain"))


@query(f"SELECT doc_id, md5({_STRIPPED.format(_MARKED_WHOLE)}) AS plain_md5 FROM documents")
def strip_markdown_whole(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.strip_markdown(F.expr(_MARKED_WHOLE))).alias("plain_md5"))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_STRIPPED.format('text')}, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) AS plain_md5 FROM documents""")
def strip_markdown_noise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.strip_noise(F.col("text"))).alias("plain_md5"))


#: Whole texts among lines of every kind that page layout leaves.
_PAGED = """concat('Some phys- ics of text 13 More and 14 Than that', chr(10), ' 12 ', chr(10), '**7**', chr(10), '-----', chr(10), 'A. Title of it 12', chr(10), 'x arXiv:2101.00001v2 [cs] 1 Jan', chr(10), '# arXiv:2101.00001', chr(10),
 text, chr(10), chr(10), chr(10), 'The last part ..... 9', chr(10), '...... 3', chr(10), 'Write E-mail: a.b@c.org to us', chr(10), 'Tel.: +32 1', chr(10), 'Doi:10.1/2', chr(10), 'Volume 3 | Issue 4 of it', chr(10), 'see http://x.org  twice')"""
_BARE = "regexp_replace({}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"


def _between(x: str) -> str:
    """Page numbers between a word and a capital, twice, since one match may end where the next begins."""
    for _ in range(2):
        x = rf"regexp_replace({x}, '([A-Za-z.)])[ \t]+[0-9]{{1,3}}([ \t]+[A-Z])', '\1 \2', 'g')"
    return x


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split({_PAGED}, chr(10))) AS line, unnest(generate_series(1, len(string_split({_PAGED}, chr(10))))) AS i FROM documents),
b AS (SELECT doc_id, i, {_BARE.format('line')} AS bare FROM l),
m AS (SELECT *, {_BARE.format(rf"regexp_replace(bare, '(?i)\b(e-?mail|electronic address)[ \t]*[:-]?[ \t]*[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+[ \t]*', '', 'g')")} AS mailed FROM b
 WHERE NOT regexp_matches(lower(bare), '^(-{{3,}}|\*{{3,}}|[0-9]{{1,4}}|\*\*[0-9]{{1,4}}\*\*)$') AND NOT regexp_matches(lower(bare), '^(e-?mail|electronic address|tel\.?|phone|fax)[ \t]*[:-]')
 AND NOT regexp_matches(lower(bare), '^(published by|©|copyright|doi:|http://|https://|www\.|research article[ \t]+issn\b|i[ \t]*j[ \t]*t[ \t]*c[ \t]*physics\b|v[ \t]*olume[ \t]+[0-9]+[ \t]*\|[ \t]*issue[ \t]+[0-9]+)')),
o AS (SELECT *, CASE WHEN contains(mailed, 'arXiv:') THEN regexp_replace({_BARE.format(r"regexp_replace(mailed, '(?i)arXiv:[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?([ \t]*\[[^\]]+\])?.*$', '')")}, '^#+[ \t]*', '') ELSE mailed END AS own FROM m),
p AS (SELECT doc_id, i, CASE WHEN bare = '' THEN '' WHEN regexp_matches(own, '[ \t]*\.{{3,}}[ \t]*[0-9]{{1,4}}$') THEN nullif({_BARE.format(r"regexp_replace(own, '[ \t]*\.{3,}[ \t]*[0-9]{1,4}$', '')")}, '')
 ELSE regexp_replace(regexp_replace({_between('own')}, '([\p{{L}}\p{{N}}_])-[ \t]+([\p{{L}}\p{{N}}_])', '\1\2', 'g'), ' {{2,}}', ' ', 'g') END AS clean
 FROM o WHERE bare = '' OR (own <> '' AND NOT regexp_matches({_STRIPPED.format('own')}, '^(\*+[ \t]*)?([0-9]+(\.[0-9]+)*\.?|[A-Z]+)\.[ \t]+[A-Z][^.\n]{{0,80}}?(\*+[ \t]*)?[0-9]{{1,3}}$'))),
t AS (SELECT doc_id, string_agg(clean, chr(10) ORDER BY i) FILTER (clean IS NOT NULL) AS t FROM p GROUP BY doc_id)
SELECT doc_id, md5({_BARE.format(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")}) AS body_md5 FROM t""")
def strip_layout(spark, sf_dir):
    return spread(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.md5(tx.strip_layout(F.expr(_PAGED))).alias("body_md5"))


_LEAKED = "concat(text, ' [12345678-abcd-4abc-8abc-1234567890ab, 12345678-ABCD-4abc-8abc-1234567890ac] mid (12345678-abcd-4abc-8abc-1234567890ab), bare 12345678-abcd-4abc-8abc-1234567890ab.')"
_U = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LEAKED}, '(?i)[ ]*\[[ ]*{_U}([ ]*,[ ]*{_U})*[ ]*\]', '', 'g'), '(?i)[ ]*\({_U}\)', '', 'g'), '(?i)[ ]*{_U}', '', 'g'), '[ ]+([,.;])', '\1', 'g'), '[ ]{{2,}}', ' ', 'g') AS clean FROM documents""")
def strip_uuids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.strip_uuids(F.expr(_LEAKED)).alias("clean"))


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LEAKED}, '(?i)[ ]*\[[ ]*{_U}([ ]*,[ ]*{_U})*[ ]*\]', '', 'g'), '(?i)[ ]*\({_U}\)', '', 'g'), '(?i)[ ]*{_U}', '', 'g'), '[ ]+([,.;])', '\1', 'g'), '[ ]{{2,}}', ' ', 'g')) AS clean_md5 FROM documents""")
def strip_uuids_whole(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.strip_uuids(F.expr(_LEAKED))).alias("clean_md5"))


@query(r"""WITH h AS (SELECT p_partkey, concat('## ', p_partkey % 9, '.', p_partkey % 4, ' ', p_type, '  ', p_name, ':') AS x FROM part),
b AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(x), '^#{1,6}[ \t]*', ''), '^\*+', '') AS x FROM h),
c AS (SELECT p_partkey, regexp_replace(x, '^([0-9]+(\.[0-9]+)*\.?[ \t]+|[A-Z]+\.[ \t]+)+', '') AS x FROM b),
d AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g')), '[.:]+$', '') AS x FROM c)
SELECT p_partkey, CASE WHEN x = '' THEN 'Section' ELSE array_to_string(string_split(x, ' ')[1:8], ' ') END AS section FROM d""")
def clean_section_name(spark, sf_dir):
    raw = F.expr("concat('## ', p_partkey % 9, '.', p_partkey % 4, ' ', p_type, '  ', p_name, ':')")
    return table(spark, sf_dir, "part").select("p_partkey", tx.section_name(raw).alias("section"))


@query("""SELECT doc_id, left(regexp_replace(regexp_replace(lower(left(text, 120)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) || '_' || left(md5(text), 8) AS filename FROM documents""")
def doc_safe_filename(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.concat(tx.slug(F.substring(F.col("text"), 1, 120)), F.lit("_"), F.substring(F.md5(F.col("text")), 1, 8)).alias("filename"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 3000 THEN left(text, 1500) || chr(10) || '...' || chr(10) || right(text, 1500) ELSE text END) AS sample_md5 FROM documents")
def head_tail_sample(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.head_and_tail(F.col("text"), 3000)).alias("sample_md5"))


@query(r"SELECT doc_id, left(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g'), 220) AS preview FROM documents")
def text_preview(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) AS text_md5 FROM documents""")
def normalize_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.normal_space(F.col("text"))).alias("text_md5"))


@query("""SELECT doc_id, '[' || doc_id || '] ' || coalesce(nullif(source, ''), 'Unknown author') || ' (' || CASE WHEN doc_id % 7 = 0 THEN 'n.d.' ELSE (2000 + doc_id % 25)::VARCHAR END || '). *' || text || '*' || CASE WHEN doc_id % 3 = 0 THEN ' · [Link](http://d/' || doc_id || ')' ELSE '' END AS line FROM documents""")
def format_reference(spark, sf_dir):
    year = F.when(F.col("doc_id") % 7 == 0, "n.d.").otherwise((F.col("doc_id") % 25 + 2000).cast("string"))
    link = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" · [Link](http://d/"), F.col("doc_id"), F.lit(")"))).otherwise("")
    author = F.coalesce(F.nullif("source", F.lit("")), F.lit("Unknown author"))
    line = F.concat(F.lit("["), F.col("doc_id"), F.lit("] "), author, F.lit(" ("), year, F.lit("). *"), F.col("text"), F.lit("*"), link)
    return docs(spark, sf_dir).select("doc_id", line.alias("line"))


#: Hosts and title words of commentary that is not scholarly.
COMMENTARY_HOSTS = ("agentmarketcap.ai", "appxlab.io", "awesomeagents.ai", "blog.appxlab.io", "digitalapplied.com", "easycoding.tools", "lunexcoding.com", "medium.com", "particula.tech", "pith.science")
COMMENTARY_TITLES = ("blog", "leaderboard", "vendor benchmark")


@query("""SELECT page_id, CASE WHEN regexp_matches(u, 'agentmarketcap\\.ai|appxlab\\.io|awesomeagents\\.ai|digitalapplied\\.com|easycoding\\.tools|lunexcoding\\.com|medium\\.com|particula\\.tech|pith\\.science') OR regexp_matches(h, 'blog|leaderboard|vendor benchmark') THEN 'industry_commentary' ELSE 'scholarly' END AS reference_group
FROM (SELECT page_id, lower(CASE WHEN page_id % 5 = 0 THEN 'https://medium.com/x' ELSE url END) AS u, lower(CASE WHEN page_id % 11 = 0 THEN 'A Leaderboard' ELSE html END) AS h FROM pages)""")
def classify_reference(spark, sf_dir):
    url = F.lower(F.when(F.col("page_id") % 5 == 0, "https://medium.com/x").otherwise(F.col("url")))
    title = F.lower(F.when(F.col("page_id") % 11 == 0, "A Leaderboard").otherwise(F.col("html")))
    group = F.when(url.rlike(tx.any_of(COMMENTARY_HOSTS)) | title.rlike(tx.any_of(COMMENTARY_TITLES)), "industry_commentary").otherwise("scholarly")
    return table(spark, sf_dir, "pages").select("page_id", group.alias("reference_group"))


_SAID = "CASE event_id % 8 WHEN 0 THEN concat('List', chr(9), 'my ', chr(10), 'projects') WHEN 1 THEN 'find papers about LLM evaluation' WHEN 2 THEN 'write me a report' WHEN 3 THEN ' help me ' WHEN 4 THEN 'search papers about X, then generate matrix' WHEN 5 THEN 'compare my papers' WHEN 6 THEN 'What does paper 3 say about it' ELSE event_type END"


@query(rf"""SELECT event_id, CASE WHEN regexp_matches(m, '^(list|show|get|view|display)[ \t\n\r\f\v]+(my[ \t\n\r\f\v]+)?(projects?|papers?|reports?|gaps?|conflicts?|matrices?|results?)\b') THEN 'DIRECT_LIST'
WHEN regexp_matches(m, '^(compare|analyze|evaluate|assess)[ \t\n\r\f\v]+(my[ \t\n\r\f\v]+)?papers?') THEN 'ANALYZE' WHEN regexp_matches(m, '\bthen\b|\band\b.*\b(search|generate|detect|analyze|compare|write)\b') THEN 'COMPLEX'
WHEN regexp_matches(m, '^(search|find|look[ \t\n\r\f\v]+up|lookup)[ \t\n\r\f\v]+(for[ \t\n\r\f\v]+)?papers?') THEN 'SEARCH' WHEN regexp_matches(m, '^(write|generate|create|make)[ \t\n\r\f\v]+(me[ \t\n\r\f\v]+)?a?[ \t\n\r\f\v]*(report|summary|literature[ \t\n\r\f\v]+review|overview)') THEN 'REPORT'
WHEN regexp_matches(m, 'what[ \t\n\r\f\v]+does[ \t\n\r\f\v]+(paper[ \t\n\r\f\v]+[A-Za-z0-9_-]+|["'']?[^"'']+["'']?)[ \t\n\r\f\v]+say[ \t\n\r\f\v]+about') THEN 'RAG_QA' WHEN regexp_matches(m, '^(help me|i want something|do something|help|idk)$') THEN 'AMBIGUOUS' END AS intent FROM (SELECT event_id, lower(trim({_SAID})) AS m FROM events)""")
def intent_classify(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.intent(F.expr(_SAID)).alias("intent"))


_CLAIM_LIST = r"regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?[ ]*%') || regexp_extract_all(text, '(?i)\b[0-9][0-9,]*[ ]*tokens?\b') || regexp_extract_all(text, '(?i)\b[0-9]+[ ]+of[ ]+[0-9]+\b')"
_NUMBERS = r"list_distinct(list_filter(regexp_extract_all(text, '\b[0-9][0-9,]*(?:\.[0-9]+)?\b'), lambda x: length(rtrim(replace(x, ',', ''), '.0')) >= 3))"


@query(f"""SELECT doc_id, len(c)::INT AS n_claims, array_to_string(list_sort(c), ';') AS claims FROM (SELECT doc_id, s || list_filter({_NUMBERS}, lambda x: NOT list_contains(s, x)) AS c FROM (SELECT doc_id, text, {_CLAIM_LIST} AS s FROM documents))""")
def extract_claims(spark, sf_dir):
    claims = tx.numeric_claims(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(claims).alias("n_claims"), F.array_join(F.array_sort(claims), ";").alias("claims"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN substring(text, greatest(1, strpos(text, 'the') - 40), strpos(text, 'the') + 43 - greatest(1, strpos(text, 'the') - 40)) END AS context FROM documents")
def claim_context(spark, sf_dir):
    at = F.instr(F.col("text"), "the")
    start = F.greatest(F.lit(1), at - 40)
    return docs(spark, sf_dir).select("doc_id", F.when(at > 0, F.substr(F.col("text"), start, at + 43 - start)).alias("context"))


#: Terms of a screening protocol on the table's own words; real lists come with the project.
TERMS = {"condition": ("the ", "la "), "intervention": ("ertion", "ment"), "methodology": ("thand", "ung"), "outcome": ("heing", "oueau"), "evidence": ("ndnt", "encia")}


@query("""WITH x AS (SELECT doc_id, regexp_matches(lower(text), 'the |la ') AS c, regexp_matches(lower(text), 'ertion|ment') AS i, regexp_matches(lower(text), 'thand|ung') AS m, regexp_matches(lower(text), 'heing|oueau') AS o, regexp_matches(lower(text), 'ndnt|encia') AS e FROM documents)
SELECT doc_id, CASE WHEN NOT (c OR i) THEN 'off_topic_condition' WHEN m AND NOT o THEN 'methodology_only' WHEN e OR i THEN 'clinical_or_domain_evidence' ELSE 'neutral' END AS category FROM x""")
def eligibility_classify(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.eligibility(F.col("text"), F.lit("on the topic"), TERMS).alias("category"))


# --- numbers, vectors, hashes -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, date_trunc('month', o_orderdate)::DATE::VARCHAR AS first_day, last_day(o_orderdate::DATE)::VARCHAR AS last_day, day(last_day(o_orderdate::DATE))::INT AS days FROM orders")
def month_label(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM").alias("month"), F.to_date(F.date_trunc("month", d)).cast("string").alias("first_day"), F.last_day(d).cast("string").alias("last_day"), F.day(F.last_day(d)).alias("days"))


_DUCK_NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"


@query(f"SELECT vec_id, round({_DUCK_NORM}, 4) AS length, round(embedding[1]::DOUBLE / {_DUCK_NORM}, 6) AS first, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / {_DUCK_NORM}) * (x / {_DUCK_NORM})))), 6) AS unit_length FROM embeddings")
def l2_normalize(spark, sf_dir):
    u = vx.unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.norm(F.col("embedding")), 4).alias("length"), F.round(u[0], 6).alias("first"), F.round(vx.norm(u), 6).alias("unit_length"))


@query("SELECT vec_id, 80 AS size, round(list_sum(embedding::DOUBLE[]), 5) AS total, 0.0::DOUBLE AS last FROM embeddings")
def fit_dimension(spark, sf_dir):
    v = vx.fitted(F.col("embedding"), 80)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).alias("size"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), v[79].alias("last"))


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row: vec_id is unique
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


_QUERY_WORDS = ["the", "of", "and", "la", "die"]


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*')) AS t FROM documents)
SELECT doc_id, coalesce(round(CASE WHEN len(t) > 0 THEN len(list_intersect(t, ['the', 'of', 'and', 'la', 'die'])) / sqrt(5.0 * len(t)) END, 6), 0) AS score FROM t""")
def keyword_score(spark, sf_dir):
    words = F.array(*map(F.lit, _QUERY_WORDS))
    return docs(spark, sf_dir).select("doc_id", F.round(vx.keyword_score(words, tx.tokens(F.col("text"))), 6).alias("score"))


_MODEL = "CASE event_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'openai/gpt-4o-mini' WHEN 2 THEN 'anthropic/claude-sonnet-4-5' WHEN 3 THEN 'other' ELSE 'deepseek-chat' END"


@query(f"""WITH e AS (SELECT event_id, {_MODEL} AS model, floor(value)::BIGINT AS ti, floor(value / 2)::BIGINT AS tout FROM events)
SELECT event_id, round((ti * CASE split_part(model || '/', '/', CASE WHEN contains(model, '/') THEN 2 ELSE 1 END) WHEN 'gpt-4o' THEN 5.0 WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'claude-sonnet-4-5' THEN 3.0 WHEN 'deepseek-chat' THEN 0.27 ELSE 0 END::DOUBLE
 + tout * CASE split_part(model || '/', '/', CASE WHEN contains(model, '/') THEN 2 ELSE 1 END) WHEN 'gpt-4o' THEN 15.0 WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'claude-sonnet-4-5' THEN 15.0 WHEN 'deepseek-chat' THEN 1.1 ELSE 0 END::DOUBLE) / 1000000, 8) AS cost FROM e""")
def token_cost(spark, sf_dir):
    cost = vx.token_cost(F.expr(_MODEL), F.floor("value"), F.floor(F.col("value") / 2))
    return table(spark, sf_dir, "events").select("event_id", F.round(cost, 8).alias("cost"))


@query("SELECT doc_id, greatest(1, length(text) // 3)::BIGINT AS by_three, greatest(1, length(text) // 4)::BIGINT AS by_four FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", vx.token_estimate(F.col("text")).alias("by_three"), vx.token_estimate(F.col("text"), 4).alias("by_four"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, left(sha256(text), 16) AS key FROM documents")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), F.substring(F.sha2("text", 256), 1, 16).alias("key"))


# --- JSON and typed fields --------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k, coalesce(json_extract_string(props, '$.none'), 'missing') AS other FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("missing")).alias("other"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END::INT AS n FROM events")
def json_array_len(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(", 1]")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.json_array_length(raw), F.lit(0)).alias("n"))


_RAW = "CASE event_id % 5 WHEN 0 THEN (event_id / 4.0)::VARCHAR WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '42' ELSE '3.14' END"


@query("SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN event_id / 4.0 WHEN 3 THEN 42 WHEN 4 THEN 3.14 END, 4)::DOUBLE AS number FROM events")
def coerce_number(spark, sf_dir):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN cast(event_id / 4.0 AS string) WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '42' ELSE '3.14' END")
    return table(spark, sf_dir, "events").select("event_id", F.round(vx.as_number(raw), 4).alias("number"))


_YES = "CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN ' YES ' WHEN 2 THEN '0' WHEN 3 THEN 'maybe' WHEN 4 THEN 'No' ELSE NULL END"


@query(f"SELECT event_id, CASE WHEN lower(trim({_YES})) IN ('true', 'yes', '1') THEN true WHEN lower(trim({_YES})) IN ('false', 'no', '0') THEN false END AS flag FROM events")
def coerce_boolean(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", vx.as_boolean(F.expr(_YES)).alias("flag"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'VIEW' END AS choice FROM events")
def coerce_enum(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", vx.as_choice(F.upper("event_type"), ["Click", "VIEW"]).alias("choice"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'click|red' WHEN 'view' THEN 'view|red' ELSE 'red' END AS choices FROM events")
def coerce_multiselect(spark, sf_dir):
    raw = F.concat(F.upper("event_type"), F.lit("; Red, none"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(vx.as_choices(raw, ["red", "click", "view"]), "|").alias("choices"))


@query("SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i), ' ') AS terms FROM (SELECT conv_id, turn, string_split(text || ' ' || translate(left(text, 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ') AS ws FROM conversations WHERE text IS NOT NULL)")
def distinct_ci(spark, sf_dir):
    """The words of each turn, once each, as they are spelled first."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    own = F.split(F.concat("text", F.lit(" "), F.translate(F.left("text", F.lit(40)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), " ")
    return c.select("conv_id", "turn", F.array_join(vx.distinct_first(own), " ").alias("terms"))


@query("SELECT page_id, page_id % 3 = 0 OR starts_with(html, '%PDF') AS is_pdf FROM pages")
def pages_magic(spark, sf_dir):
    """Whether a download is what it is taken for: its first bytes, not its name, tell (a third of the pages get those of a PDF)."""
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), F.coalesce("html", F.lit("")))).otherwise(F.coalesce("html", F.lit(""))).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", st.is_pdf(content).alias("is_pdf"))


@query("SELECT c_custkey, list_sort(list_filter(['AUTOMOBILE', 'BUILDING', 'name'], lambda x: x <> c_mktsegment)) AS missing FROM customer")
def missing_reserved(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(F.array_except(F.array(F.lit("AUTOMOBILE"), F.lit("BUILDING"), F.lit("name")), F.array("c_mktsegment"))).alias("missing"))


@query("SELECT user_id, list_sort(list_distinct(list(event_type) || ['view', 'other'])) AS sources FROM events GROUP BY user_id")
def array_union_sources(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return own.select("user_id", F.array_sort(F.array_union("s", F.array(F.lit("view"), F.lit("other")))).alias("sources"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'accepted' ELSE 'quarantined' END AS status FROM customer")
def validate_enum(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "accepted").otherwise("quarantined").alias("status"))


@query(r"""SELECT doc_id, len(w) < 6 AND len(list_intersect(w, ['the', 'of', 'la'])) = 0 AS off_topic FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents)""")
def offtopic_flag(spark, sf_dir):
    own = tx.words(F.lower(F.col("text")))
    return docs(spark, sf_dir).select("doc_id", ((F.size(own) < 6) & ~F.arrays_overlap(own, F.array(F.lit("the"), F.lit("of"), F.lit("la")))).alias("off_topic"))


@query(r"""SELECT doc_id, len(w) < 6 AND len(list_intersect(w, ['the', 'of', 'la'])) = 0 AS off_topic FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents)""")
def offtopic_flag_whole(spark, sf_dir):
    own = tx.words(F.lower("text"))
    return docs(spark, sf_dir).select("doc_id", ((F.size(own) < 6) & ~F.arrays_overlap(own, F.array(F.lit("the"), F.lit("of"), F.lit("la")))).alias("off_topic"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 's' || doc_id END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), lower(trim(text))) AS key FROM documents""")
def canonical_key(spark, sf_dir):
    s2 = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("doc_id")))
    arxiv = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source"))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(F.nullif(s2, F.lit("")), F.nullif(arxiv, F.lit("")), F.lower(F.trim(F.col("text")))).alias("key"))


@query("""SELECT c_custkey, i::INT AS place, CASE WHEN i < 2 THEN ['high', 'low'][i + 1] ELSE 'medium' END AS score FROM customer, (SELECT unnest([0, 1, 2]) AS i)""")
def array_align_default(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.lit("high"), F.lit("low")).alias("scores"), F.posexplode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("place", "hit"))
    return rows.select("c_custkey", "place", F.coalesce(F.get("scores", F.col("place")), F.lit("medium")).alias("score"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'low' ELSE 'medium' END AS confidence FROM events")
def map_confidence(spark, sf_dir):
    """A stated confidence as one of three; what is none of them is medium."""
    raw = F.when(F.col("event_type") == "purchase", " HIGH").when(F.col("event_type") == "click", "Low ").when(F.col("event_type") == "view", "quite sure")
    return table(spark, sf_dir, "events").select("event_id", tx.mapped_confidence(raw).alias("confidence"))
