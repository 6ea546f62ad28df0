"""Queries over web pages: their text as Markdown, and their authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import html as hx
from folio.plans.registry import query
from folio.sources.tables import table

#: Whole pages with what they lack: hidden and nested elements, lists in lists, pictures, marks with an end; a fifth have a main part.
_EXTRA = """'<figure>x<figure>y</figure>z <b>no</b></figure><h2>A &amp; <b>B</b> of it</h2><ol><li>one<ul><li>in <a href="u/v">l  m</a></li><li>more</li></ul></li><li>two <img alt="p" src="q.png"> <em>three</em></li></ol><p>end <code>x</code><br>now <a>none</a></body>'"""
_PAGE = f"""replace(CASE WHEN page_id % 5 = 0 THEN replace(replace(html, '<article>', '<div class="a ltx_page_main"><div>'), '</article>', '</div></div>') ELSE html END, '</body>', {_EXTRA})"""
_SHOWN = r"regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script[^>]*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style[^>]*>', '', 'g')"
_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', '''')"
_BLOCKS = ", ".join(f"'{x}'" for x in hx.BLOCKS)


@query(rf"""WITH RECURSIVE p AS (SELECT page_id, regexp_extract_all({_SHOWN.format(_PAGE)}, '<[^>]*>|[^<]+') AS ts FROM pages),
t AS (SELECT page_id, unnest(ts) AS token, unnest(generate_series(1, len(ts))) AS pos FROM p),
k AS (SELECT page_id, pos, token, CASE WHEN starts_with(token, '<') THEN lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) ELSE 'text' END AS tag, starts_with(token, '</') AS closes,
 starts_with(token, '<div') AND regexp_matches(token, '(?i)class\s*=\s*["''](?:[^"'']*\s)?ltx_page_main[\s"'']') AS main FROM t),
m AS (SELECT page_id, coalesce(min(pos) FILTER (main), min(pos) FILTER (tag = 'body' AND NOT closes)) AS first, count(*) FILTER (main) > 0 AS main FROM k GROUP BY page_id),
s AS (SELECT k.page_id, k.pos, k.token, k.tag, k.closes, m.main, row_number() OVER (PARTITION BY k.page_id ORDER BY k.pos) AS i FROM k JOIN m USING (page_id) WHERE k.pos > m.first),
r AS (SELECT page_id, first AS pos, '' AS token, '' AS tag, false AS closes, 0 AS i, 1 AS divs, true AS going, 0 AS hidden, []::STRUCT(tag VARCHAR, n INT)[] AS lists, NULL::VARCHAR AS href, false AS shown, '' AS piece FROM m WHERE first IS NOT NULL
UNION ALL SELECT page_id, pos, token, tag, closes, i, divs, going AND NOT ended, h, ls, a, going AND NOT ended AND h = 0 AND tag NOT IN ('figure', 'math'),
 CASE WHEN tag = 'li' AND NOT closes THEN chr(10) || repeat(chr(1), greatest(len(ls) - 1, 0)) || CASE WHEN ls[-1].tag = 'ol' THEN ls[-1].n || '. ' ELSE '* ' END WHEN tag IN ('ul', 'ol') THEN CASE WHEN greatest(len(ls), len(before)) > 1 THEN '' ELSE chr(10) || chr(10) END ELSE '' END
FROM (SELECT *, going AND CASE WHEN main THEN d < 1 ELSE tag = 'body' AND closes END AS ended, d AS divs FROM (
 SELECT s.page_id, s.pos, s.token, s.tag, s.closes, s.i, s.main, r.going, r.lists AS before, r.divs + CASE WHEN s.tag = 'div' THEN CASE WHEN s.closes THEN -1 ELSE 1 END ELSE 0 END AS d,
 greatest(0, r.hidden + CASE WHEN s.tag IN ('figure', 'math') THEN CASE WHEN s.closes THEN -1 ELSE 1 END ELSE 0 END) AS h,
 CASE WHEN s.tag IN ('ul', 'ol') THEN CASE WHEN s.closes THEN r.lists[1:len(r.lists) - 1] ELSE list_append(r.lists, struct_pack(tag := s.tag, n := 0)) END
  WHEN s.tag = 'li' AND NOT s.closes AND len(r.lists) > 0 THEN list_append(r.lists[1:len(r.lists) - 1], struct_pack(tag := r.lists[-1].tag, n := r.lists[-1].n + 1)) ELSE r.lists END AS ls,
 CASE WHEN s.tag = 'a' AND NOT s.closes THEN regexp_extract(s.token, '(?i)\bhref\s*=\s*["'']([^"'']*)["'']', 1) ELSE r.href END AS a FROM r JOIN s ON s.page_id = r.page_id AND s.i = r.i + 1))),
v AS (SELECT *, CASE WHEN closes THEN NOT lag(closes) OVER w ELSE lead(closes) OVER w END AS paired FROM r WHERE i > 0 AND going WINDOW w AS (PARTITION BY page_id, tag ORDER BY pos)),
x AS (SELECT page_id, pos, CASE WHEN NOT shown THEN '' WHEN tag = 'text' THEN {_ENTITIES.format("regexp_replace(token, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")} WHEN regexp_matches(tag, '^h[1-6]$') THEN CASE WHEN closes THEN chr(10) || chr(10) ELSE chr(10) || chr(10) || repeat('#', substring(tag, 2, 1)::INT) || ' ' END
 WHEN tag IN ('li', 'ul', 'ol') THEN piece WHEN tag = 'br' THEN chr(10) WHEN tag = 'a' THEN CASE WHEN coalesce(href, '') = '' OR NOT coalesce(paired, false) THEN '' WHEN closes THEN '](' || href || ')' ELSE '[' END
 WHEN tag = 'img' THEN '![' || regexp_extract(token, '(?i)\balt\s*=\s*["'']([^"'']*)["'']', 1) || '](' || regexp_extract(token, '(?i)\bsrc\s*=\s*["'']([^"'']*)["'']', 1) || ')'
 WHEN tag IN ('b', 'strong', 'i', 'em', 'code') THEN CASE WHEN NOT coalesce(paired, false) THEN '' WHEN tag IN ('b', 'strong') THEN '**' WHEN tag = 'code' THEN '`' ELSE '*' END WHEN tag IN ({_BLOCKS}) THEN chr(10) || chr(10) ELSE '' END AS piece FROM v),
g AS (SELECT page_id, string_agg(piece, '' ORDER BY pos) AS body FROM x GROUP BY page_id)
SELECT m.page_id, CASE WHEN first IS NOT NULL THEN md5(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), ' {{2,}}', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), chr(1), '  ')) END AS markdown_md5
FROM m LEFT JOIN g USING (page_id)""")
def pages_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_PAGE).alias("page"))
    return hx.markdown(pages, "page_id", "page").select("page_id", F.md5("markdown").alias("markdown_md5"))


#: A third of the pages name their authors in meta tags, another third in a list.
_NAMED = """CASE page_id % 3 WHEN 0 THEN '<META name="citation_author" content="Lee, Ann"><meta name="citation_author" content="O&#39;Neil &amp; Sons &lt;x&gt;">' || html WHEN 1 THEN html || '<div id="x" class="authors"> <a href="/a">Ann Lee </a>, <a>Bo</a><a> </a></div><a>no</a>' ELSE html END"""


@query(rf"""SELECT page_id, len(a)::INT AS n_authors, md5(array_to_string(a, '|')) AS authors_md5 FROM (SELECT page_id, CASE WHEN len(n) > 0 THEN list_transform(n, lambda x: {_ENTITIES.format('x')}) ELSE list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') END AS a
FROM (SELECT page_id, regexp_extract_all(h, '(?i)<meta\s+name="citation_author"\s+content="([^"]+)"', 1) AS n, regexp_extract_all(regexp_extract(h, '(?is)<div[^>]+class="authors"[^>]*>(.*?)</div>', 1), '(?i)<a[^>]*>([^<]+)</a>', 1) AS l FROM (SELECT page_id, {_NAMED} AS h FROM pages)))""")
def pages_authors(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select("page_id", hx.authors(F.expr(_NAMED)).alias("a"))
    return a.select("page_id", F.size("a").alias("n_authors"), F.md5(F.array_join("a", "|")).alias("authors_md5"))
