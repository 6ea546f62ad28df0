"""The data source over pages of answers."""

import re

import pytest

from folio.sources import hits as hs


def made(spark, n, at, size=10, with_total=True):
    rows = spark.createDataFrame([(k, k * 7, f"T {k}", None if k % 11 == 0 else 1990 + k % 30) for k in range(n)], "place long, id long, title string, year int")
    hs.write_pages(rows, at, size, with_total)
    return rows.select("id", "title", "year")


@pytest.mark.parametrize(("n", "with_total"), [(95, True), (95, False), (100, True), (3, True)])
def test_all_pages_are_read(spark, tmp_path, n, with_total):
    rows = made(spark, n, f"{tmp_path}/p", with_total=with_total)
    got = hs.read_hits(spark, f"{tmp_path}/p", 3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    parts = hs.HitsReader({"path": f"{tmp_path}/p", "range": "3"}).partitions()
    assert [(p.first, p.last) for p in parts] == ([(0, None)] if not with_total else [(lo, min(lo + 3, -(-n // min(n, 10)))) for lo in range(0, -(-n // min(n, 10)), 3)])


def test_bounds_on_the_year_are_pushed_down(spark, tmp_path):
    rows = made(spark, 95, f"{tmp_path}/p")
    where = "year >= 2001 AND year < 2010 AND title <> 'T 20'"
    got = hs.read_hits(spark, f"{tmp_path}/p").where(where)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where(where).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    left = re.findall(r"Filter (.*)", plan)
    assert not any(">= 2001" in f or "< 2010" in f for f in left), plan
    reader = hs.HitsReader({"path": f"{tmp_path}/p"})
    rest = list(reader.pushFilters([hs.GreaterThan(("year",), 2000), hs.LessThanOrEqual(("year",), 2009), hs.EqualTo(("title",), "x")]))
    assert (reader.low, reader.high, len(rest)) == (2001, 2009, 1)


def test_no_pages(spark, tmp_path):
    assert hs.read_hits(spark, f"{tmp_path}/none").collect() == []
