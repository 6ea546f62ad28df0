"""Claims, conflicts, gaps, citations and the grounding of numeric claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as tx


def claims_from_pairs(pairs: DataFrame) -> DataFrame:
    """Two contradicting claims of each pair (pair_id, paper_a, paper_b, claim_a, claim_b, confidence)."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"paper_{s}").alias("paper"), F.col(f"claim_{s}").alias("claim"))
    rows = pairs.select("pair_id", "confidence", F.explode(F.array(side("a"), side("b"))).alias("x"))
    return rows.select("pair_id", "x.side", "x.paper", F.substring("x.claim", 1, 500).alias("claim"), F.lit("contradict").alias("type"), F.lit(1).alias("supports"), F.lit(1).alias("contradicts"), "confidence")


def claims_from_matrix(rows: DataFrame) -> DataFrame:
    """Up to two claims of each row (paper, key_result, limitation): a supporting and a weak one."""
    part = lambda c, kind: F.struct(F.lit(kind).alias("type"), tx.strip(F.col(c)).alias("claim"))
    out = rows.select("paper", F.explode(F.array(part("key_result", "support"), part("limitation", "weak"))).alias("x"))
    return out.select("paper", "x.type", "x.claim").where("claim IS NOT NULL AND claim <> ''")


def conflict_groups(rows: DataFrame, key: str, columns: list[str], least_rows: int = 4, most_groups: int = 10) -> DataFrame:
    """Groups of two rows or more that share a value: field, value, members.  None under `least_rows` rows in all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("field"), tx.clean_value(F.col(c)).alias("value")) for i, c in enumerate(columns)))).alias("x"))
    groups = long.where("x.value IS NOT NULL").groupBy("x.place", "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n >= 2")
    kept = groups.crossJoin(F.broadcast(total)).where(F.col("total") >= least_rows)
    return kept.orderBy("place", "first", "value").limit(most_groups).select("field", "value", "n")


def valid_citations(paragraphs: DataFrame, known: DataFrame) -> DataFrame:
    """paragraph, cited, valid: paragraphs (paragraph, cites array) with the number of their citations that are known."""
    cites = paragraphs.select("paragraph", F.explode_outer("cites").alias("id"))
    marked = cites.join(known.select("id").distinct().withColumn("ok", F.lit(1)), "id", "left")
    return marked.groupBy("paragraph").agg(F.count("id").alias("cited"), F.coalesce(F.sum("ok"), F.lit(0)).alias("valid"))


#: Parts into which the chunks of one source are dealt.
PARTS = 32


def grounded(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """key, claim, grounded: whether a numeric claim of a text stands in a chunk of the source it cites.

    texts: key, source, text.  chunks: source, chunk_text.  The different
    claims about a source are looked for once, in its chunks alone; a source's
    chunks are dealt in parts, and a chunk looks for all its source's claims at
    once, so no row of a claim and a chunk is made.
    """
    claims = texts.select("key", "source", F.explode(F.array_distinct(tx.numeric_claims(F.col("text")))).alias("claim"))
    once = claims.select("source", "claim").distinct()
    # a claim whose digits no chunk has is not looked for there: one list a source and first digit
    lists = once.withColumn("digit", F.regexp_extract("claim", "[0-9]", 0)).groupBy("source", "digit").agg(F.collect_list(F.struct("claim", tx.claim_forms(F.col("claim")).alias("forms"))).alias("claims"))
    part = F.pmod(F.xxhash64("chunk_text"), F.lit(PARTS)).cast("int")
    dealt = chunks.select("source", "chunk_text", part.alias("part"), F.explode(F.array_distinct(F.regexp_extract_all("chunk_text", F.lit("[0-9]"), 0))).alias("digit"))
    asked = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    both = dealt.join(asked, ["source", "digit", "part"])
    hits = F.filter("claims", lambda c: F.exists(c["forms"], lambda f: F.contains(F.col("chunk_text"), f)))
    found = both.select("source", F.explode(F.transform(hits, lambda c: c["claim"])).alias("claim")).distinct()
    return claims.join(found.withColumn("hit", F.lit(True)), ["source", "claim"], "left").select("key", "claim", F.coalesce("hit", F.lit(False)).alias("grounded"))


def gap_guard(gaps: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """gap, valid, status: a gap needs two known papers, unless its text speaks of a single one; weaker ones are downgraded."""
    n = evidence.join(known.select("id").distinct(), "id", "left_semi").groupBy("gap").agg(F.countDistinct("id").alias("valid"))
    valid = F.coalesce("valid", F.lit(0))
    status = F.when(valid >= 2, "kept").when((valid == 1) & F.lower("text").rlike("single|one paper"), "downgraded").otherwise("dropped")
    return gaps.join(n, "gap", "left").select("gap", valid.alias("valid"), status.alias("status"))


def language_audit(diagnostics: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """key, counts (results by language), score (share of English ones, two digits half to even), other_languages of each search.

    diagnostics: key, source, result_count; without results a source counts for
    nothing.  variants: key, source, language, place: what a source was asked in,
    the last one stated; English where none is.  other_languages: some variant is
    in another language.  Without any result the score is 0.
    """
    asked = variants.groupBy(key, "source").agg(F.max_by("language", "place").alias("language"))
    others = variants.groupBy(key).agg(F.bool_or(F.col("language") != "en").alias("other"))
    found = diagnostics.where("result_count > 0").join(asked, [key, "source"], "left").groupBy(key, F.coalesce("language", F.lit("en")).alias("language")).agg(F.sum("result_count").alias("n"))
    total = F.sum("n")
    english = F.coalesce(F.sum(F.when(F.col("language") == "en", F.col("n"))), F.lit(0))
    sums = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("counts"), F.bround(F.try_divide(english.cast("double"), total), 2).alias("score"))
    every = diagnostics.select(key).distinct().join(sums, key, "left").join(others, key, "left")
    return every.select(key, F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("other", F.lit(False)).alias("other_languages"))


def conflict_claims(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and their evidence from pairs (pair_id, paper_a, paper_b, claim_a, claim_b, confidence).

    Claims: claim_id, field_origin, text, type, supports, contradicts,
    confidence; a blank claim is none, without a confidence it is medium.
    Evidence, two rows for each claim: claim_id, paper, polarity, snippet: its
    own paper supports it with its first 500 characters, the other contradicts
    it.  claim_id is made of the pair's and the side, so both tables are made
    from the pairs alone and agree however often they are.
    """
    claim_id = lambda k: (F.col("pair_id") * 2 + k).alias("claim_id")
    side = lambda k, own, other: F.struct(claim_id(k), F.lit(f"claim_{own}").alias("field_origin"), F.col(f"claim_{own}").alias("said"), F.col(f"paper_{own}").alias("own"), F.col(f"paper_{other}").alias("other"))
    rows = pairs.select("confidence", F.explode(F.array(side(0, "a", "b"), side(1, "b", "a"))).alias("x")).select("confidence", "x.*").withColumn("text", tx.strip(F.col("said"))).where("text <> ''")
    confidence = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("medium"))
    claims = rows.select("claim_id", "field_origin", "text", F.lit("contradict").alias("type"), F.lit(1).alias("supports"), F.lit(1).alias("contradicts"), confidence.alias("confidence"))
    proof = lambda paper, polarity, snippet: F.struct(F.col(paper).alias("paper"), F.lit(polarity).alias("polarity"), snippet.alias("snippet"))
    both = F.array(proof("own", "support", F.substring("said", 1, 500)), proof("other", "contradict", F.lit(None).cast("string")))
    return claims, rows.select("claim_id", F.explode(both).alias("e")).select("claim_id", "e.*")


def pruned(reports: DataFrame, known: DataFrame, key: str = "report") -> DataFrame:
    """key, sections, total, invalid, cited: reports without citations that are not known, from the bottom up.

    reports: key, sections: array<struct<title, paragraphs: array<struct<text,
    cites>>>>.  Paragraphs that are left without a citation go, then sections
    without a paragraph; all others stay in their order, with their fields.
    total, invalid: citations there were, and of unknown papers; cited:
    different known papers.  The trees stay whole: ids alone are looked up, and
    a report gets the list of those that are known.
    """
    cites = F.flatten(F.flatten(F.transform("sections", lambda s: F.transform(s["paragraphs"], lambda p: p["cites"]))))
    ids = reports.select(key, F.explode(F.array_distinct(cites)).alias("id"))
    found = ids.join(known.select("id").distinct(), "id", "left_semi").groupBy(key).agg(F.collect_set("id").alias("good"))
    kind = reports.schema["sections"].dataType.elementType["paragraphs"].dataType.elementType["cites"].dataType.simpleString()
    rows = reports.join(found, key, "left").withColumn("good", F.coalesce("good", F.array().cast(kind))).withColumn("every", F.coalesce(cites, F.array().cast(kind)))
    own = lambda p: p.withField("cites", F.filter(p["cites"], lambda c: F.array_contains(F.col("good"), c)))
    kept = lambda s: s.withField("paragraphs", F.filter(F.transform(s["paragraphs"], own), lambda p: F.size(p["cites"]) > 0))
    sections = F.filter(F.transform("sections", kept), lambda s: F.size(s["paragraphs"]) > 0)
    valid = F.size(F.filter("every", lambda c: F.array_contains(F.col("good"), c)))
    return rows.select(key, sections.alias("sections"), F.size("every").alias("total"), (F.size("every") - valid).alias("invalid"), F.size("good").alias("cited"))
