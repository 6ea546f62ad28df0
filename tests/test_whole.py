"""Queries over whole texts: what stands behind the first characters counts."""

import hashlib

import pytest

from tests.conftest import DATA
from folio.plans import registry

registry.load()

LONG = "short start with **bold** and " + "word " * 200 + "of **late** marks, 12345678-abcd-4abc-8abc-1234567890ab, [CITE:77] and \u2728"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(4, "aaaaaaaaaaaaaaa bbbbbbbbbbbbbbbbbbbbbbb " + "word " * 20 + "of"), (8, "a b"), (12, LONG)], "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, LONG)], "conv_id bigint, turn int, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def of(spark, folder, name, key, value):
    return {r[key]: r[value] for r in registry.QUERIES[name](spark, folder).collect()}


def test_judged_by_the_whole_text(spark, folder):
    assert of(spark, folder, "low_value_chunks_whole", "doc_id", "low") == {4: False, 8: True, 12: False}
    assert of(spark, folder, "offtopic_flag_whole", "doc_id", "off_topic") == {4: False, 8: True, 12: False}


def test_cleaned_to_the_end(spark, folder):
    starred = f"*{LONG[10:18]}*"  # ends with two stars, which close nothing
    marks = " " + LONG[:10] + f" and {starred} " + LONG[-6:] + " " + LONG[:4] + "  end"
    assert of(spark, folder, "strip_markdown_whole", "doc_id", "plain_md5")[12] == md5(LONG.replace("**", "") + marks)
    assert of(spark, folder, "strip_uuids_whole", "doc_id", "clean_md5")[12] == md5(LONG.replace(" 12345678-abcd-4abc-8abc-1234567890ab", "") + " mid, bare.")
    assert of(spark, folder, "sanitize_citations_whole", "doc_id", "answer_md5")[12] == md5("As shown [CITE:12] and [citation removed] by " + LONG.replace("[CITE:77]", "[citation removed]"))
    assert of(spark, folder, "strip_emoji_whole", "conv_id", "answer_md5")[1] == md5("- " + LONG.replace("\u2728", "") + " done")


def test_page_repair_scores_each_text_once(spark):
    from folio.plans import registry

    registry.load()
    plan = registry.QUERIES["page_repair"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # the scores are read back, not made again for the share
