"""Model slots, schemas, running sums and raw records on odd input."""

import json
import re

from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx
from folio.operators import chunking, dedup, slots
from folio.sources import tables as st
from tests.test_streams import ev


def test_batches_without_an_answer_are_medium(spark):
    rows = spark.createDataFrame([(k, k // 3, f"v{k}") for k in range(11)], "id long, batch long, value string")
    asked = lambda n, values: {0: ["high", "low", "high"], 1: ["low"], 2: ["maybe", None, "low"], 3: []}[n]
    got = {r.id: r.score for r in slots.scored(rows, "batch", "id", "value", asked).collect()}
    assert got == {0: "high", 1: "low", 2: "high", 3: "low", 4: "medium", 5: "medium", 6: "medium", 7: "medium", 8: "low", 9: "medium", 10: "medium"}
    assert slots.scored(rows.where("false"), "batch", "id", "value", asked).collect() == []


def test_vectors_of_other_models_are_renewed(spark):
    rows = spark.createDataFrame([(1, "new", [1.0], "a"), (2, "old", [2.0], "bb"), (3, None, None, "ccc"), (4, "old", [4.0], "fail")], "id long, model string, vector array<float>, text string")

    def embed(texts):
        return texts.map(lambda t: None if t == "fail" else [float(len(t))])

    got = {r.id: (r.model, r.vector) for r in slots.renewed(rows, "id", "model", "vector", "new", embed).collect()}
    assert got == {1: ("new", [1.0]), 2: ("new", [2.0]), 3: ("new", [3.0]), 4: ("old", [4.0])}


def test_json_schema_is_json(spark):
    fields = spark.createDataFrame([("s", "b", "number", None), ("s", "a", "multi_select", ["x", "y"]), ("s", "c", "enum", ["x"]), ("t", "z", "text", None)], "k string, name string, kind string, options array<string>")
    got = {r.k: json.loads(r.schema) for r in vx.json_schema(fields, "k").select("k", F.col("schema")).collect()}
    assert got["s"]["required"] == ["a", "b", "c"] and got["s"]["properties"]["a"] == {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}
    assert got["s"]["properties"]["c"]["enum"] == ["x", None] and got["t"]["properties"] == {"z": {"type": ["string", "null"]}}


def test_running_sums_in_two_levels(spark):
    rows = [(k % 2, k * 37 % 10_007, k) for k in range(500)]
    got = {r.at: r.s for r in dedup.running_sum(spark.createDataFrame(rows, "g long, at long, v long").repartition(5), ["g"], "at", F.col("v"), "s", 100).collect()}
    assert got == {at: sum(v for h, b, v in rows if h == g and b <= at) for g, at, _ in rows}


def test_entities(spark):
    texts = {"&amp;lt;": "<", "a&#233;b&#xE9;&#x1F600;": "aébé\U0001f600", "&#0;&#xD800;&#1114112;&#;&#xZ;": "&#0;&#xD800;&#1114112;&#;&#xZ;", "&amp;#65;": "A", "": "", "no & none; #1": "no & none; #1"}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in frame.select("t", tx.unescaped_entities(F.col("t")).alias("u")).collect()} == texts


def test_records_that_are_none(spark):
    lines = spark.createDataFrame([('{"title": "T", "year": 2001}',), ("{",), ("",), ("null",), (None,), ("{}",)], "value string")
    assert [(r.title, r.year, r.authors) for r in st.parsed_hits(lines).collect()] == [("T", 2001, None)]
    web = spark.createDataFrame([('{"results": [{"title": " A ", "url": "u", "publishedDate": "2020-01", "author": "x, ,y"}, {"title": "no url"}]}',), ('{"results": []}',), ("{",)], "value string")
    assert [(r.title, r.year, r.authors) for r in st.web_hits(web).collect()] == [("A", 2020, ["x", "y"])]
    xml = spark.createDataFrame([("<a><body><title>T &amp; U</title><p>x  <i>y</i></p></body></a>",), ("<a/>",), ("",), (None,)], "x string")
    assert [r.b for r in xml.select(st.xml_body(F.col("x")).alias("b")).collect()] == ["## T & U\n\nx y", None, None, None]


def pack_sentences(text: str, most: int, overlap: int) -> list[str]:
    """Sentences joined while they fit; each chunk begins with the last `overlap` characters' worth of the one before."""
    chunks: list[str] = []
    held: list[str] = []
    for s in (x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x):
        for part in (s[k : k + most] for k in range(0, len(s), most)):
            if held and len(" ".join(held)) + 1 + len(part) > most:
                chunks.append(" ".join(held))
                tail: list[str] = []
                while held and len(" ".join([held[-1], *tail])) <= overlap:
                    tail.insert(0, held.pop())
                held = tail if len(" ".join(tail)) + 1 + len(part) <= most else []
            held.append(part)
    return [*chunks, " ".join(held)] if held else chunks


def test_sentences_are_packed_as_in_plain_python(spark):
    texts = ["", " ", "One. Two! Three?  Four.\nFive", "x" * 95, "A. " * 60, "Long sentence of words here. Short. " * 9, "é. ß! " * 20]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most, overlap in ((40, 0), (40, 12), (30, 29)):
        got = {r.i: r.c for r in frame.select("i", chunking.packed_sentences(F.col("t"), most, overlap).alias("c")).collect()}
        assert got == {i: pack_sentences(t, most, overlap) for i, t in enumerate(texts)}


def test_sessions_end_after_steps_or_time(spark):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", 1, "a") for k in range(30)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, session string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.event_id for r in ev.bounded(frame, 15, 600).where("goes_on").orderBy("event_id").collect()] == list(range(10))
    assert [r.event_id for r in ev.bounded(frame, 5, 600).where("goes_on").orderBy("event_id").collect()] == list(range(4))
