"""Functions and operators on the cases that the survey lists."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx
from folio.operators import chunking, dedup, retrieval, synthesis
from folio.operators import graph as gx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("42", 42.0), ("3.14", 3.14), ("abc", None), ("", None)])
def test_number(spark, raw, want):
    assert one(spark, vx.as_number(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("true", True), ("YES", True), ("0", False), ("no", False), ("maybe", None)])
def test_boolean(spark, raw, want):
    assert one(spark, vx.as_boolean(F.lit(raw))) is want


def test_choices(spark):
    phases = ["Phase 1", "Phase 2", "Phase 3"]
    assert one(spark, vx.as_choice(F.lit("phase 2"), phases)) == "Phase 2"
    assert one(spark, vx.as_choice(F.lit("Phase 4"), phases)) is None
    assert one(spark, vx.as_choices(F.lit("red; green; yellow"), ["red", "green", "blue"])) == ["red", "green"]


@pytest.mark.parametrize(
    "op,value,want",
    [("eq", "RAG", [1, 3]), ("neq", "RAG", [2]), ("contains", "A", [1, 3]), ("in", ["BM25", "x"], [2]), ("eq", None, [4]), ("gt", 1, []), ("neq", None, [1, 2, 3])],
)
def test_typed_predicate(spark, op, value, want):
    rows = spark.createDataFrame([(1, "RAG"), (2, "BM25"), (3, "RAG"), (4, None)], "id int, method string")
    assert sorted(r.id for r in rows.where(vx.typed_predicate(F.col("method"), op, value)).collect()) == want


def test_unknown_operator(spark):
    with pytest.raises(ValueError, match="unknown operator"):
        vx.typed_predicate(F.col("x"), "like", 1)


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vx.unit(v)) == [0.6, 0.8]
    assert one(spark, vx.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vx.fitted(v, 3)) == [3.0, 4.0, 0.0] and one(spark, vx.fitted(v, 1)) == [3.0]
    assert one(spark, vx.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_tokens_and_scores(spark):
    assert sorted(one(spark, tx.tokens(F.lit("RAG for Medical QA 2024!")))) == ["2024", "for", "medical", "qa", "rag"]
    empty = F.array().cast("array<string>")
    assert one(spark, vx.keyword_score(empty, empty)) == 0.0
    boosts = [one(spark, vx.blended(F.lit(0.5), F.lit(0.5), F.lit(k))) for k in ("limitation", "results", "method", "narrative")]
    assert boosts == sorted(boosts, reverse=True) and boosts[-1] == 0.5
    assert one(spark, vx.blended(F.lit(0.5), F.lit(0.5), F.lit(None).cast("string"))) == 0.5


@pytest.mark.parametrize(
    "text,want",
    [
        ("51.7% and 73.2% of 1,794 and 456,535, but 9", {"51.7%", "73.2%", "1,794", "456,535", "51.7", "73.2"}),
        ("5 agents on 3 benchmarks with 2 reviewers", set()),
        ("170 of 500 used 436 tokens", {"170 of 500", "436 tokens", "436"}),
    ],
)
def test_claims(spark, text, want):
    assert {*one(spark, tx.numeric_claims(F.lit(text)))} >= {w for w in want if "%" in w or " " in w or "," in w}
    assert {*one(spark, tx.numeric_claims(F.lit(text)))} <= want | {"170", "500"}


def test_grounding(spark):
    texts = spark.createDataFrame([(1, "p1", "It reached 51.7% on 1,794 tasks."), (2, "p2", "It reached 73.2%.")], "key int, source string, text string")
    chunks = spark.createDataFrame([("p1", "51.7 percent of 1794"), ("p3", "73.2%")], "source string, chunk_text string")
    got = {(r.key, r.claim): r.grounded for r in synthesis.grounded(texts, chunks).collect()}
    assert got[1, "51.7%"] and got[1, "1,794"] and not got[2, "73.2%"]


def test_quality_signals(spark):
    prose = "\n".join("This is a sentence of plain prose that goes on for a while. It ends here." if i % 5 else "" for i in range(30))
    assert one(spark, tx.quality(F.lit(""))) == 0.0
    assert one(spark, tx.weakest_signal({k: f(F.lit("")) for k, f in tx.SIGNALS.items()})) == "density"
    assert one(spark, tx.alpha_ratio(F.lit(prose))) > 0.7 and one(spark, tx.alpha_ratio(F.lit("= + 3 / 5 ∑"))) < 0.1
    assert one(spark, tx.mojibake(F.lit("cafÃ© naÃ¯ve rÃ©sumÃ© " * 5))) < 0.7
    assert one(spark, tx.column_order(F.lit(prose))) == 1.0
    assert one(spark, tx.column_order(F.lit("\n".join(["Smith, J.", "et al. (2020)", "short one", "[12]"] * 6)))) < 0.5
    total = sum(w * one(spark, tx.SIGNALS[k](F.lit(prose))) for k, w in tx.WEIGHTS.items())
    assert abs(one(spark, tx.quality(F.lit(prose))) - total) < 1e-9


@pytest.mark.parametrize(
    "text,want",
    [("$$E = mc^2$$ in prose", "equation"), ("Figure 3: a plot", "figure_caption"), ("a | b\n1 | 2", "table"), ("Plain words, nothing else.", "narrative"), ("x = µ + 1\ny = ν − 2 = ρ\na ≤ b ≤ c ≥ d", "equation")],
)
def test_chunk_kind(spark, text, want):
    assert one(spark, tx.chunk_kind(F.lit(text))) == want


@pytest.mark.parametrize(
    "message,want",
    [("list my projects", "DIRECT_LIST"), ("find papers about LLM evaluation", "SEARCH"), ("write me a report", "REPORT"), ("help me", "AMBIGUOUS"), ("search papers about X, then generate matrix and detect gaps", "COMPLEX"), ("hello", None)],
)
def test_intents(spark, message, want):
    assert one(spark, tx.intent(F.lit(message))) == want


def test_cleanup(spark):
    assert one(spark, tx.strip_noise(F.lit("**bold**  *italic* `code` [l](http://x)"))) == "bold italic code l"
    assert one(spark, tx.strip_uuids(F.lit("so [12345678-abcd-4abc-8abc-1234567890ab] it, (12345678-abcd-4abc-8abc-1234567890ab). end"))) == "so it,. end"
    assert one(spark, tx.strip_layout(F.lit("word-\nbreak\n12\nContents .... 7\ncopyright 2020\nend"))) == "word-\nbreak\nContents\nend"  # words are joined within a line, a title stays without its leader
    assert one(spark, tx.section_name(F.lit("## 2.1 The  Method:"))) == "The Method"
    assert one(spark, tx.clean_value(F.lit(" N/A for now"))) is None


def test_pair_precedence(spark):
    rows = [(1, "a", "b", "low"), (2, "a", "b", "high"), (3, "a", "b", "high"), (4, "b", "a", "medium"), (5, "b", "a", "low"), (6, "c", "d", "low"), (7, "c", "d", "medium"), (8, "c", "d", "medium")]
    best = dedup.best_pair(spark.createDataFrame(rows, "seq int, x string, y string, confidence string"), ["x", "y"], "confidence", "seq")
    assert sorted(r.seq for r in best.collect()) == [3, 4, 7]


def test_first_seen_and_counts(spark):
    rows = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p1"), (4, "p1"), (5, "p2")], "seq int, key string")
    assert sorted(r.seq for r in dedup.first_seen(rows, ["key"], ["seq"]).collect()) == [1, 2]
    assert sorted((r.seq, r.matches) for r in dedup.match_counts(rows, ["key"], "seq").collect()) == [(1, 3), (2, 2)]


def test_graph(spark):
    papers = spark.createDataFrame([(1, "RAG", "PubMedQA"), (2, "RAG", "n/a"), (3, "", "PubMedQA")], "p int, method string, data string")
    columns = {"method": "method", "dataset": "data"}
    assert [(r.a, r.b, r.kind) for r in gx.shared(papers, "p", columns).orderBy("a", "b").collect()] == [(1, 2, "method"), (1, 3, "dataset")]
    assert gx.nodes(papers, "p", columns).count() == 5 and gx.links(papers, "p", columns).count() == 4
    kept, edges = gx.filtered(gx.nodes(papers, "p", columns), gx.links(papers, "p", columns), 2)
    assert sorted(r.id for r in kept.collect()) == ["dataset:pubmedqa", "method:rag", "paper:1"] and edges.count() == 2


def test_chunkers(spark):
    text = "Front\n\nAbstract\n" + "A sentence here. " * 20 + "\n2. Methods\n" + "We did things. " * 200 + "\nReferences\n[1] Doe, J. A paper that is long enough to be kept as one entry of this list, with more words. 2020.\n[2] Roe, K. Another paper that is long enough to be kept as one entry, with even more words. 2021.\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "short")], "id int, text string")
    chunks = chunking.chunked(rows, "id", "text").collect()
    own = [c for c in chunks if c.id == 1]
    assert {c.section for c in own} == {"Abstract", "Methods", "References"}
    assert all(80 <= len(c.chunk_text) <= 2000 for c in own) and sum(c.section == "References" for c in own) == 2
    assert [(c.id, c.section, c.chunk_text) for c in chunks if c.id != 1] == [(4, "Full Text", "short")]
    rows = spark.createDataFrame([(1, "p1\n\np2\n\n" + "x" * 50)], "id int, text string")
    assert rows.select(chunking.packed_paragraphs(F.col("text"), 20).alias("c")).first().c == ["p1\n\np2", "x" * 20, "x" * 20, "x" * 10]
    windows = chunking.char_windows(spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, text string"), "id", "text", 4, 1)
    assert [(r.start, r.chunk) for r in windows.orderBy("start").collect()] == [(0, "abcd"), (3, "defg"), (6, "ghij")]


def test_hybrid_falls_back_to_keywords(spark):
    rows = spark.createDataFrame([(1, "rag retrieval augmented", "method", [1.0, 0.0]), (2, "nothing shared", None, None)], "chunk_id int, chunk_text string, content_type string, embedding array<float>")
    best = retrieval.hybrid(rows, None, [], ["rag", "retrieval", "augmented"], 5).collect()
    assert [r.chunk_id for r in best] == [1] and best[0].keyword > 0.3
    assert [r.chunk_id for r in retrieval.hybrid(rows, rows.select("chunk_id", "embedding"), [1.0, 0.0], ["rag"], 5).collect()] == [1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("phys- ics", "physics"),
        ("a- b- c", "ab- c"),
        ("Text 13 More", "Text More"),
        ("a 1 B 2 C 3 d", "a B C 3 d"),
        ("x arXiv:2101.00001v2 [cs] 1 Jan", "x"),
        ("# arXiv:2101.00001\ny", "y"),
        ("The part ..... 9\n..... 3", "The part"),
        ("A. Title of it 12\n2.1. Other one 3\nkept", "kept"),
        ("12\n**12**\n---\n***\nTel.: 1\nwww.x.org\nVolume 3 | Issue 4\nok", "ok"),
        ("write e-mail: a@b.c to us", "write to us"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_layout(spark, text, want):
    assert spark.range(1).select(tx.strip_layout(F.lit(text)).alias("t")).first().t == want


@pytest.mark.parametrize(("text", "want"), [("**a*", "**a*"), ("*a*", "a"), ("***a***", "a"), ("*a**", "*a**"), ("**a** *b* `c` [d](e)", "a b c d")])
def test_stars_beside_stars_open_nothing(spark, text, want):
    assert spark.range(1).select(tx.strip_markdown(F.lit(text)).alias("t")).first().t == want


def test_forms_of_a_line_and_entities_are_made_once(spark):
    count = lambda c, sign: spark.range(1).select(F.concat(F.col("id"), F.lit("")).alias("x")).select(c(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString().count(sign)
    assert count(tx.layout_line, "electronic address)[ \\t]*[:-]?") == 1
    assert count(lambda x: tx.unescaped_entities(F.regexp_replace(x, "once", "")), "once") == 1
