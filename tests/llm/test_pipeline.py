"""Every stage of the pipeline against brute force, on its own input; and what the registered queries return."""

from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm import bpe, queries
from folio.llm.common import shared_folder
from folio.llm.quality import quality_scores
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_tokens import check_pieces

SF = f"{DATA}/sf0.001"
COLUMNS = {
    "op1_": ["doc_id", "held_out", "score", "predicted"],
    "op2_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op3_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op4_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"],
    "op6_": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_their_contract(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = next(v for k, v in COLUMNS.items() if name.startswith(k))
    assert got.columns == want
    source = "conversations" if name.startswith("op2_") else "pages" if name.startswith("op7_") else "documents"
    rows = spark.read.parquet(f"{SF}/{source}.parquet")
    key = want[0]
    assert got.select(key).distinct().count() == rows.select(key).distinct().count() + name.startswith("op2_")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if name == "packing":
            check_pieces(out.collect(), rows, Tokenizer.from_file(bpe.default_path()), 4096)
            break
        assert sorted(out.columns) == sorted(columns)
        kept = sorted(r.doc_id for r in out.collect())
        if name == "quality":
            low = {r.doc_id for r in queries.op1_quality(spark, SF).where("predicted = 0").collect()}
            want = [i for i, _ in rows if i not in low]
        elif name == "exact_dedup":
            want = [r[0] for r in brute.exact(rows) if r[3]]
        elif name == "near_dedup":
            want = [r[0] for r in brute.near(rows) if r[3]]
        else:
            want = [r[0] for r in brute.contamination(rows, items) if not r[5]]
        assert kept == sorted(want)
        docs = spark.createDataFrame([tuple(r) for r in out.select(columns).collect()], docs.schema)


def test_run(spark):
    folder = Path(shared_folder(spark))
    before = {p.name for p in folder.iterdir()}
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "ids"} <= {*got.columns}
    assert {p.name.split("-")[0] for p in folder.iterdir() if p.name not in before} == {"pipeline"}


ODD = "doc_id long, text string, row long, component_id string, kept string, predicted int"


def odd_rows(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(2).collect()
    long = " ".join(f"w{k}" for k in range(60_000))
    texts = [(None, good[0].text), (None, good[0].text), (3, good[0].text), (3, good[1].text), (3, good[1].text), (9, None), (9, ""), (None, None), (4, long), (5, long + " x")]
    return [(i, t, 1, "clash", "clash", 0) for i, t in texts], long


def left(spark, stage, rows):
    out = stage(spark, spark.createDataFrame(rows, ODD).repartition(3), SF)
    assert out.columns == [c.split()[0] for c in ODD.split(", ")]
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, equal rows and clashing columns."""
    rows, long = odd_rows(spark)
    a, b = rows[0][1], rows[3][1]
    plain = [(r[0], r[1]) for r in rows]
    exact = left(spark, corpus_pipeline.exact_stage, rows)
    assert len(exact) == 5 and {(3, a), (3, b), (4, long), (5, long + " x")} <= {*exact} and sum(not t for _, t in exact) == 1
    near = left(spark, corpus_pipeline.near_stage, rows)
    assert near == sorted([(3, a), (3, b), (9, None), (9, ""), (None, None), (4, long)], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    hit = [(None, item, 1, "", "", 0), (9, item, 1, "", "", 0)]
    assert left(spark, corpus_pipeline.decontamination_stage, rows + hit) == sorted(plain, key=str)
    junk = [(None, "### || ### || x9 || " * 40, 1, "", "", 0), (9, "### || ### || x9 || " * 40, 1, "", "", 0)]
    docs = spark.createDataFrame([(i, t, k, "clash", "clash", 0) for k, (i, t, *_) in enumerate(rows + junk)], ODD)
    scores = quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"), carry=("row",)).collect()
    assert len(scores) == docs.count()
    kept = {r.row for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    assert kept == {r.row for r in scores if r.predicted == 1}
    packed = corpus_pipeline.packing_stage(spark, spark.createDataFrame(rows, ODD), SF).collect()
    assert sum(r.start == 0 for r in packed) == len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], ODD), SF).collect() == []
