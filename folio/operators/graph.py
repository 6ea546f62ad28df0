"""Concept graph: nodes, links, shared concepts, degrees, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as tx


def long_concepts(papers: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """key, kind, label: one row for each stated concept; columns: from kind to the column that states it."""
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), tx.clean_value(F.col(c)).alias("label")) for kind, c in columns.items())))
    return papers.select(key, rows.alias("x")).select(key, "x.kind", tx.compact_label(F.col("x.label")).alias("label")).where("label IS NOT NULL").distinct()


def nodes(papers: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """id, kind, label of papers and concepts."""
    own = papers.select(F.concat(F.lit("paper:"), F.col(key)).alias("id"), F.lit("paper").alias("kind"), F.col(key).cast("string").alias("label"))
    concepts = long_concepts(papers, key, columns).select("kind", "label").distinct()
    return own.unionByName(concepts.select(F.concat_ws(":", "kind", F.lower("label")).alias("id"), "kind", "label").dropDuplicates(["id"]))


def links(papers: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """source, target, relation from papers to concepts."""
    c = long_concepts(papers, key, columns)
    return c.select(F.concat(F.lit("paper:"), F.col(key)).alias("source"), F.concat_ws(":", "kind", F.lower("label")).alias("target"), F.concat(F.lit("uses_"), F.col("kind")).alias("relation"))


#: Papers of a block: two blocks give at most its square of pairs in one row's expansion.
BLOCK = 1000


def shared(papers: DataFrame, key: str, columns: dict[str, str], most_papers: int | None = None) -> DataFrame:
    """a, b, kind, n: pairs of papers (a < b) with n common concepts of a kind.

    The pairs are the result, so a concept of m papers gives m * (m - 1) / 2
    rows.  Papers with the same concepts of a kind are one class: n is found
    for pairs of classes, and pairs of papers are made from blocks of their
    members where these lie, so no pair is shuffled, sorted or counted.

    most_papers, if given, leaves out concepts that say little because
    so many papers state them; it is the caller's choice and none by default.
    """
    # labels take long for the few bytes of a paper: papers are dealt out before they are cleaned
    c = long_concepts(papers.where(F.col(key).isNotNull()).select(key, *dict.fromkeys(columns.values())).repartition(papers.sparkSession.sparkContext.defaultParallelism), key, columns)
    if most_papers is not None:
        c = c.join(c.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= most_papers), ["kind", "label"], "left_semi")
    own = c.groupBy(key, "kind").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    # a class is cut into blocks by a hash of the key, so that none is too large for a row
    sizes = own.groupBy("kind", "labels").agg(F.count(F.lit(1)).alias("m"))
    placed = own.join(sizes.where(F.col("m") > BLOCK), ["kind", "labels"], "left")
    block = F.when(F.col("m").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.ceil(F.col("m") / BLOCK)))
    blocks = placed.groupBy("kind", "labels", block.alias("block")).agg(F.collect_list(key).alias("members"))

    classes = sizes.select("kind", "labels")
    each = classes.withColumn("label", F.explode("labels"))
    other = each.withColumnsRenamed({"labels": "labels_b"})
    apart = each.join(other, ["kind", "label"]).where("labels < labels_b").groupBy("kind", "labels", "labels_b").agg(F.count(F.lit(1)).alias("n"))
    alike = classes.select("kind", "labels", F.col("labels").alias("labels_b"), F.size("labels").cast("long").alias("n"))
    right = blocks.withColumnsRenamed({"labels": "labels_b", "block": "block_b", "members": "members_b"})
    both = alike.unionByName(apart).join(blocks, ["kind", "labels"]).join(right, ["kind", "labels_b"])
    same = F.col("labels") == F.col("labels_b")
    within = same & (F.col("block") == F.col("block_b"))
    met = both.where(~same | (F.col("block") < F.col("block_b")) | (within & (F.size("members") > 1)))
    # pairs of blocks differ in what they give: they are dealt out before any is expanded
    dealt = met.select("kind", "n", "members", "members_b", within.alias("within")).repartition(_parts(papers))
    # generated code holds all rows that it makes of one row: transform ends it between the expansions, so these are a block's members, not its pairs
    x = dealt.select("kind", "n", "within", "members_b", F.explode(F.transform("members", lambda m: F.struct(m.alias("x")))).alias("m"))
    x = x.select("kind", "n", "within", "m.x", F.explode("members_b").alias("y"))
    return x.where(~F.col("within") | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind", "n")


def _parts(rows: DataFrame) -> int:
    """Enough partitions for all cores to end at about the same time."""
    return max(8 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def filtered(node_rows: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least that degree, and the links between them."""
    kept = node_rows.join(degrees(edges).where(F.col("degree") >= least), "id", "left_semi")
    ids = kept.select("id")
    left = edges.join(ids.withColumnsRenamed({"id": "source"}), "source", "left_semi")
    return kept, left.join(ids.withColumnsRenamed({"id": "target"}), "target", "left_semi").select("source", "target", "relation")


def ranked(node_rows: DataFrame, edges: DataFrame, question: str) -> DataFrame:
    """Concepts by ten times the words they share with a question, plus their degree."""
    words = F.array_distinct(tx.simple_tokens(F.lit(question)))
    shared_words = F.size(F.array_intersect(words, tx.simple_tokens(F.col("label"))))
    rows = node_rows.where("kind <> 'paper'").join(degrees(edges), "id", "left")
    return rows.select("id", "label", (shared_words * 10 + F.coalesce("degree", F.lit(0))).alias("rank"))


def searched(node_rows: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Papers and the concepts whose label holds the text, without regard to case; and the links with both ends among them."""
    shown = node_rows.where((F.col("kind") == "paper") | F.contains(F.lower("label"), F.lit(text.lower())))
    ids = shown.select("id")
    left = edges.join(ids.withColumnsRenamed({"id": "source"}), "source", "left_semi")
    return shown, left.join(ids.withColumnsRenamed({"id": "target"}), "target", "left_semi").select("source", "target", "relation")
