"""Pages as Markdown and their authors, and other small operators of this round."""

import pytest
from pyspark.sql import functions as F

from folio.functions import values as vx
from folio.operators import html as hx
from folio.operators import synthesis as sx


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body><h1>A</h1><p>b <b>c</b></p></body>", "# A\n\nb **c**"),
        ("<body>x<div class='ltx_page_main a'><h2>M</h2><div>in</div></div><p>out</p></body>", "## M\n\nin"),
        ("<body>a<figure>b<figure>c</figure>d</figure>e<math><mi>x</mi></math>f</body>", "aef"),
        ("<body><ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>e</body>", "* a\n\n  1. b\n  2. c\n\n* d\n\ne".replace("a\n\n", "a\n").replace("c\n\n", "c\n")),
        ("<body><a href='u'>l</a> <a>m</a> <img alt='p' src='q'/></body>", "[l](u) m ![p](q)"),
        ("<body><p>never <b>closed</p><p>next</p>", "never closed\n\nnext"),
        ("<body>1 &lt; 2 &amp;&amp; x&#39;s<script>if (a<b) {}</script><style>p{}</style><!-- <p> --></body>", "1 < 2 && x's"),
        ("<p>no body</p>", None),
        ("", None),
        (None, None),
        ("<body></body>", ""),
    ],
)
def test_markdown(spark, html, want):
    rows = spark.createDataFrame([(1, html)], "id int, html string")
    assert [r.markdown for r in hx.markdown(rows, "id", "html").collect()] == [want]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<meta name="citation_author" content="Yin, Z"><META NAME="citation_author" CONTENT="Andr&#233; M">', ["Yin, Z", "André M"]),
        ('<div class="authors"><a href="x">Ann</a>, <a>\n Bo </a><a> </a></div><a>no</a>', ["Ann", "Bo"]),
        ("<a>x</a>", []),
        ("", []),
    ],
)
def test_authors(spark, html, want):
    assert spark.range(1).select(hx.authors(F.lit(html)).alias("a")).first().a == want


def test_language_audit(spark):
    diagnostics = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (1, "c", 0), (1, "d", -2), (2, "a", 0)], "k int, source string, result_count int")
    variants = spark.createDataFrame([(1, "b", "en", 1), (1, "b", "fr", 2), (1, "c", "de", 1)], "k int, source string, language string, place int")
    got = {r.k: (r.counts, r.score, r.other_languages) for r in sx.language_audit(diagnostics, variants, "k").collect()}
    assert got == {1: ({"en": 3, "fr": 5}, 0.38, True), 2: ({}, 0.0, False)}


@pytest.mark.parametrize(("first", "second", "want"), [("high", "low", "low"), ("low", "high", "low"), ("medium", "unclear", "medium"), ("unclear", "medium", "unclear"), ("high", "x", "x"), ("high", None, None)])
def test_lower_confidence(spark, first, second, want):
    assert spark.range(1).select(vx.lower_confidence(F.lit(first), F.lit(second)).alias("c")).first().c == want


def test_conflict_claims_and_their_evidence(spark):
    pairs = spark.createDataFrame([(7, "p", "q", " A said ", "b" * 600, None), (8, "q", "r", " ", None, "high"), (9, "p", "r", "x", "y", "low")], "pair_id long, paper_a string, paper_b string, claim_a string, claim_b string, confidence string")
    claims, evidence = sx.conflict_claims(pairs)
    own = {r.claim_id: r for r in claims.collect()}
    assert {k: (r.field_origin, r.text[:6], r.confidence) for k, r in own.items()} == {14: ("claim_a", "A said", "medium"), 15: ("claim_b", "bbbbbb", "medium"), 18: ("claim_a", "x", "low"), 19: ("claim_b", "y", "low")}
    rows = evidence.collect()
    assert len(rows) == 8 and {r.claim_id for r in rows} == {*own}
    assert sorted((r.claim_id, r.paper, r.polarity, len(r.snippet or "")) for r in rows if r.claim_id < 18) == [(14, "p", "support", 8), (14, "q", "contradict", 0), (15, "p", "contradict", 0), (15, "q", "support", 500)]


def test_reports_are_pruned_from_the_bottom(spark):
    tree = "array<struct<title:string,paragraphs:array<struct<text:string,cites:array<bigint>>>>>"
    rows = [
        (1, [("a", [("x", [1, 9, 2, 1]), ("y", [9])]), ("b", [("z", [])]), ("c", [("w", [2])])]),
        (2, [("a", [("x", [9])])]),
        (3, []),
    ]
    reports = spark.createDataFrame(rows, f"report int, sections {tree}")
    known = spark.createDataFrame([(1,), (2,), (2,), (5,)], "id long")
    got = {r.report: r for r in sx.pruned(reports, known).collect()}
    plain = lambda sections: [(s.title, [(p.text, p.cites) for p in s.paragraphs]) for s in sections]
    assert plain(got[1].sections) == [("a", [("x", [1, 2, 1])]), ("c", [("w", [2])])]
    assert (got[1].total, got[1].invalid, got[1].cited) == (6, 2, 2)
    assert (got[2].sections, got[2].total, got[2].invalid, got[2].cited) == ([], 1, 1, 0) and (got[3].sections, got[3].total) == ([], 0)


def test_partitions_are_bounded_before_pages_become_rows(spark, monkeypatch):
    monkeypatch.setattr(hx, "PART_CHARS", 1000)
    pages = spark.createDataFrame([(k, f"<body><p>{'x' * 990}{k}</p></body>") for k in range(40)], "id int, html string")
    found = hx.markdown(pages, "id", "html")
    assert sorted(r.markdown for r in found.collect()) == sorted("x" * 990 + str(k) for k in range(40))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan and plan.index("Generate") < plan.index("RepartitionByExpression")
