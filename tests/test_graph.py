"""Pairs of papers by shared concepts: classes, blocks, and no shuffle of pairs."""

import random
from itertools import combinations

import pytest

from folio.operators import graph as gx

COLUMNS = {"method": "method", "dataset": "dataset"}


@pytest.mark.parametrize("block", [3, 1000])
def test_shared_pairs_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(gx, "BLOCK", block)
    rng = random.Random(7)
    rows = [(k % 60, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"])) for k in range(120)]  # a paper has two rows, so up to two methods
    got = gx.shared(spark.createDataFrame(rows, "p int, method string, dataset string"), "p", COLUMNS).collect()
    stated = {}
    for p, m, d in rows:
        stated.setdefault(("method", p), set()).add(m)
        stated.setdefault(("dataset", p), set()).add(d)
    want = sorted((a, b, kind, n) for kind in COLUMNS for a, b in combinations(range(60), 2) if (n := len((stated[kind, a] & stated[kind, b]) - {None})))
    assert sorted(map(tuple, got)) == want


def test_pairs_are_not_shuffled(spark):
    papers = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y")], "p int, method string, dataset string")
    plan = gx.shared(papers, "p", COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < min(plan.index(x) for x in ("Aggregate", "Join", "Repartition") if x in plan)  # nothing but a filter and a projection follows


def test_no_row_is_expanded_to_all_pairs_of_two_blocks_in_generated_code(spark):
    """Generated code holds what it makes of one row: it may make a block's members of it, not the pairs of two blocks."""
    papers = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y")], "p int, method string, dataset string")
    plan = gx.shared(papers, "p", COLUMNS)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    expansions = [line for line in plan.split("\n") if "Generate explode" in line][:2]
    assert "members_b" in expansions[0] and "transform" in expansions[1]
