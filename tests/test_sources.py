"""Readers and writers."""

import json

from pyspark.sql import functions as F

from folio.plans import registry
from folio.sources import sinks, tables
from tests.conftest import DATA

registry.load()


def test_hits_and_atom(spark, tmp_path):
    hit = {"title": "T", "venue": " ", "year": 2020, "externalIds": {"DOI": "10.1/x"}, "authors": [{"name": "A"}]}
    (tmp_path / "hits.json").write_text(json.dumps(hit) + "\n\n{broken\n")
    (row,) = tables.scholarly_hits(spark, str(tmp_path / "hits.json")).collect()
    assert (row.title, row.venue, row.doi, row.authors) == ("T", None, "10.1/x", ["A"])
    feed = "<feed><entry><id>http://arxiv.org/abs/2001.00001v2</id><title> A\n B </title><published>2020-01-02T00:00:00Z</published><author><name>X Y</name></author></entry></feed>"
    (tmp_path / "feed.xml").write_text(feed)
    (row,) = tables.atom_entries(spark, str(tmp_path / "feed.xml")).collect()
    assert (row.arxiv_id, row.title, row.year, row.authors) == ("2001.00001", "A B", 2020, ["X Y"])


def test_json_lines_years_and_indexes(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "1", "categories": "cs.AI cs.LG"}\n\n{"id": "2", "categories": "math.CO"}\nnot json\n')
    assert [r.id for r in tables.json_lines(spark, str(tmp_path / "d.jsonl"), "id string, categories string", ["cs.LG"]).collect()] == ["1"]
    dates = spark.createDataFrame([("2020-01-05",), ("2021-03",), ("2022",), ("x",), (None,)], "d string")
    assert [r.y for r in dates.select(tables.year_of(F.col("d")).alias("y")).collect()] == [2020, 2021, 2022, None, None]
    index = spark.createDataFrame([({"b": [1, 3], "a": [0, 2]},)], "m map<string,array<int>>")
    assert index.select(tables.rebuilt_text(F.col("m")).alias("t")).first().t == "a b a b"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("word " * 30)
    (tmp_path / "b.txt").write_text("short")
    assert sorted(r.status for r in tables.files(spark, str(tmp_path)).collect()) == ["completed", "ocr_required"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c", ["x"]), (1, "a", [])], "id int, name string, tags array<string>")
    lines = [r.line for r in sinks.markdown_rows(rows, ["id"]).orderBy("place").collect()]
    assert lines == ["| id | name | tags |", "| --- | --- | --- |", "| 1 | a | [] |", '| 2 | b\\|c | ["x"] |']
    sinks.write_csv(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    sinks.refresh(rows.select("id", "name"), f"{tmp_path}/t", ["id"])
    sinks.refresh(spark.createDataFrame([(2, "new")], "id int, name string"), f"{tmp_path}/t", ["id"])
    assert sorted((r.id, r.name) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "new")]
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(2, "n"), (1, "x"), (3, "y")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.filled(old, new, ["k"]).collect()) == [(1, "a"), (2, "n"), (3, "y")]
    assert sorted(tuple(r) for r in sinks.upserted(old, new, ["k"]).collect()) == [(1, "x"), (2, "n"), (3, "y")]


def test_search_and_fan_out(spark):
    rows = [
        ("a", "Deep nets", "about cancer", 2020, None, " 10.1/x ", None, "u1", ["A"]),
        ("a", "Old nets", "cancer", 2001, None, None, "2001.1", "u2", []),
        ("a", "No year", "cancer nets", None, None, None, None, "u3", []),
    ]
    first = spark.createDataFrame(rows, tables.PAPER)
    second = spark.createDataFrame([("b", "DEEP NETS again", None, 2021, None, "10.1/x", None, "v1", ["B"]), ("b", " no YEAR ", None, None, None, None, None, "v2", [])], tables.PAPER)
    assert [r.url for r in tables.search(first, ["CANCER", "nets"]).collect()] == ["u1", "u2", "u3"]
    assert [r.url for r in tables.search(first, ["cancer"], year_from=2010, year_to=2030).collect()] == ["u1"]
    got = sorted((r.url, r.source, r.matches) for r in tables.fan_out([first, second]).collect())
    assert got == [("u1", "a", 2), ("u2", "a", 1), ("u3", "a", 2)]


def test_inverted_index_is_made_without_a_shuffle_of_words(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "é"]), (2, []), (3, None)], "id int, words array<string>").select("id", tables.inverted_index(F.col("words")).alias("m"))
    assert [r.m for r in rows.orderBy("id").collect()] == [{"b": [0, 2], "a": [1], "é": [3]}, {}, None]
    plan = registry.QUERIES["rebuild_inverted_index"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
