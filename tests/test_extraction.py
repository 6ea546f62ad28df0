"""Engines in two tiers, page repair, and the plans of the retrieval queries."""

import re

from pyspark.sql import functions as F

from folio.operators import extraction
from folio.plans import registry
from tests.conftest import DATA

registry.load()
GOOD = "\n\n".join("This is a whole sentence of some forty characters. Another one follows it here." for _ in range(12))


def test_slow_engines_see_weak_rows_alone(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(text):
        asked.add(1)
        return None if text is None else GOOD if "mend" in text else "worse"

    rows = spark.createDataFrame([(1, GOOD), (2, "x" * 300 + " mend"), (3, "no"), (4, None), (5, "")], "id int, raw string")
    fast = [extraction.Engine("one", lambda t: t), extraction.Engine("two", lambda t: F.concat(t, F.lit("")))]
    got = {r.id: r for r in extraction.routed(rows, "id", "raw", fast, [extraction.Engine("slow", slow)], 0.8).collect()}
    assert asked.value == 4
    assert (got[1].engine, got[1].text, got[1].fell_back, [t.engine for t in got[1].tried]) == ("one", GOOD, False, ["one", "two"])  # a tie stays with the first
    assert (got[2].engine, got[2].text, got[2].fell_back, [t.engine for t in got[2].tried]) == ("slow", GOOD, False, ["one", "two", "slow"])
    assert got[3].fell_back and got[3].engine in ("one", "slow")
    assert (got[4].engine, got[4].text, got[4].score) == ("", None, 0.0) and got[5].engine == "slow"
    alone = {r.id: r.engine for r in extraction.routed(rows, "id", "raw", fast, [], 0.8).collect()}
    assert alone == {1: "one", 2: "one", 3: "one", 4: "", 5: ""}


def test_pages_are_spliced(spark):
    pages = [(1, 0, GOOD, "a"), (1, 1, "x", GOOD + "!"), (1, 2, GOOD, "b"), (2, 0, "x", "slow 0"), (2, 1, GOOD, "slow 1"), (3, 0, "x", None), (3, 1, GOOD, "c"), (3, 2, GOOD, "d"), (4, 0, None, None), (5, 0, GOOD, "e")]
    rows = spark.createDataFrame(pages, "id int, page int, fast string, slow string")
    got = {r.id: r for r in extraction.repaired(rows, "id", "page", "fast", "slow", 0.8).collect()}
    assert (got[1].weak_pages, got[1].whole, got[1].text) == ([1], False, f"{GOOD}\n\n{GOOD}!\n\n{GOOD}") and min(got[1].score, got[1].fast_score) > 0.9
    assert (got[2].weak_pages, got[2].whole, got[2].text) == ([0], True, "slow 0\n\nslow 1")
    assert (got[3].weak_pages, got[3].whole, got[3].text) == ([0], False, f"x\n\n{GOOD}\n\n{GOOD}")
    assert (got[4].weak_pages, got[4].whole, got[4].text, got[4].score) == ([0], True, "", 0.0)
    assert (got[5].weak_pages, got[5].whole, got[5].text) == ([], False, GOOD)


def test_texts_are_not_shuffled_before_the_limit(spark):
    for name in ("hybrid_retrieval", "paper_retrieval", "dedup_strongest_id", "dedup_match_counts"):
        plan = registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for exchange in re.findall(r"Exchange (?:hash|range|Single|RoundRobin).*\n(.*)", plan):
            assert not re.search(r"\b(text|chunk_text|key)#", exchange.split("FileScan")[0]), (name, exchange)
