"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each five-word shingle is hashed once.  The leading bits name its bin, the rest
is its rank there; a bin keeps the least.  An empty bin takes the value of the
first filled bin in a probing order of its own, which depends on nothing else
(optimal densification).  Of each bin's value the low-order byte is stored, and
the share of equal bytes is corrected for those that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import written

SHINGLE = 5
#: Bins and stored bits of each: a likeness of 0.75 has a standard error of 0.027.
BINS, BITS = 256, 8
_BIN_BITS = BINS.bit_length() - 1
#: Bins that are tried one by one before all filled ones are compared.
TRIES = 16
#: Equal rows (same doc_id and text) that one task puts out.
COPIES_IN_TASK = 1_000
_UPPER, _LOWER, _SPACE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"


def _draw(b: int) -> tuple[int, int]:
    """First bin and odd step of the probing order of bin b, start + step * t modulo BINS: every bin comes once."""
    x = int.from_bytes(hashlib.sha256(f"probe {b}".encode()).digest()[:8], "big")
    return x % BINS, (x >> 32) % BINS | 1


_ORDERS = [_draw(b) for b in range(BINS)]


def _literal(values: Iterable[object], kind: str) -> Column:
    return F.expr(f"array({','.join(map(repr, values))})").cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """A hash of each five-word shingle (A-Z lower-cased), of all words where there are fewer; none without words."""
    trimmed = F.btrim(F.translate(text, _UPPER, _LOWER), F.lit(_SPACE))

    def shingles(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))  # what is missing is left out

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(F.split(trimmed, r"[\x20\x09-\x0D]+"), shingles))


def bins(hashes: Column) -> Column:
    """The least hash of each bin, an odd number; an even number where a bin is empty.

    Hashes are made odd and sorted together with an even mark before each bin
    and one after the last, so a bin's least hash is what follows its mark.
    """
    marks = _literal([*((b - BINS // 2) << (64 - _BIN_BITS) for b in range(1, BINS)), (1 << 63) - 2], "bigint")
    first = F.lit(-(1 << 63)).cast("bigint")
    odd = F.transform(hashes, lambda h: h.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(1)))
    held = F.sort_array(F.concat(F.array(first), marks, odd))
    return let(held, lambda s: F.filter(s, lambda x, i: F.get(s, i - 1).bitwiseAND(F.lit(1)) == 0))


def densified(code: Column) -> Column:
    """Empty (null) bins take the code of the first filled one in their order; at least one bin is filled.

    The order is walked for some steps; where all of them are empty, which
    happens if few bins are filled, the filled bins are compared by their place in it.
    """
    tried = [_literal([(start + step * t) % BINS for start, step in _ORDERS], "int") for t in range(TRIES)]
    start = _literal([start for start, _ in _ORDERS], "int")
    inverse = _literal([pow(step, -1, BINS) for _, step in _ORDERS], "int")

    def dense(own: Column) -> Column:
        filled = F.array_compact(F.transform(own, lambda x, i: i * 256 + x.cast("int") + 128))

        def least(entries: Column, b: Column) -> Column:
            place = lambda e: ((F.shiftright(e, 8) - F.get(start, b)) * F.get(inverse, b)).bitwiseAND(F.lit(BINS - 1))
            return (F.array_min(F.transform(entries, lambda e: place(e) * 256 + e.bitwiseAND(F.lit(255)))).bitwiseAND(F.lit(255)) - 128).cast("tinyint")

        return let(filled, lambda entries: F.transform(own, lambda x, b: F.coalesce(x, *(F.get(own, F.get(t, b)) for t in tried), least(entries, b))))

    return let(code, dense)


def codes(text: Column) -> Column:
    """The stored bytes of a text's fingerprint, as array<tinyint>; none for a text without words."""

    def of(hashes: Column) -> Column:
        low = lambda x: (F.shiftright(x, 2).bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint")
        own = F.transform(bins(hashes), lambda x: F.when(x.bitwiseAND(F.lit(1)) == 1, low(x)))
        return F.when(F.size(hashes) == 0, F.array().cast("array<tinyint>")).otherwise(densified(own))

    return let(shingle_hashes(text), of)


def packed(code: Column) -> Column:
    """The fingerprint as lowercase hex, two digits a bin; an empty string for a text without words."""
    digits = _literal([f"{x:02x}" for x in range(256)], "string")
    return F.array_join(F.transform(code, lambda x: F.get(digits, x.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity (0 to 1) of two shingle sets from their codes; sets without shingles are like each other alone."""
    chance = 2.0**-BITS
    same = F.size(F.array_remove(F.zip_with(a, b, lambda x, y: x == y), False)) / BINS
    some = F.greatest((same - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(some)


def _successors(keyed: DataFrame) -> DataFrame:
    """of, copies, before, wanted for each document: its rows, the document before it, and how many code points that one takes of it.

    Documents are ranked by a range sort of their keys alone; a rank is a row's
    place in its partition and the rows of the partitions before it.
    """
    keys = keyed.groupBy("of").agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ordered = keys.orderBy(F.col("of.doc_id").asc_nulls_last(), F.col("of.text_key"))
    placed = written(ordered.select("*", F.monotonically_increasing_id().alias("place")), "places")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition of the sort
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("part", F.coalesce(before, F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total")), "parts")
    ranks = placed.withColumn("part", part).join(F.broadcast(counts), "part")
    ranks = ranks.withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    prior = ranks.select(F.pmod(F.col("rank") + 1, F.col("total")).alias("rank"), F.col("of").alias("before"), F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"))
    return written(ranks.select("rank", "of", "copies").join(prior, "rank").drop("rank"), "successors")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many of the next document, or all where that is shorter.  Documents
    are in the order of doc_id, null ids last, texts of one doc_id in the order
    of their SHA-256; rows that repeat both are one document.  After the last
    comes the first, so a document alone is its own next.  A null text is an
    empty one.  doc_id may be of any type with an order; further columns are
    ignored.  An empty table gives an empty result.

    A text is shuffled once, and of it the part that another takes once more.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("doc_id", F.unhex(F.sha2(text, 256)).alias("text_key")).alias("of"), text.alias("text"))
    order = _successors(keyed.select("of", F.length("text").alias("n_chars")))
    several = order.where(F.col("copies") > COPIES_IN_TASK)
    texts = keyed.select("of", "text", codes(F.col("text")).alias("code")).groupBy("of").agg(F.first("text").alias("text"), F.first("code").alias("code"))
    own = texts.join(order, "of")
    heads = own.select(F.col("before").alias("of"), F.expr("substring(text, 1, wanted)").alias("head"), F.col("code").alias("next_code"))
    both = own.select("of", "copies", "text", "code").join(heads, "of")
    edited = F.expr("concat(substring(text, 1, cast(length(text) - floor(length(text) / 4) as int)), head)")
    both = both.withColumn("edited", edited).withColumn("edited_code", codes(F.col("edited")))
    out = both.select(
        F.col("of.doc_id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("code")).alias("fingerprint"),
        packed(F.col("edited_code")).alias("edited_fingerprint"),
        likeness(F.col("code"), F.col("edited_code")).alias("near_edited"),
        likeness(F.col("code"), F.col("next_code")).alias("near_next"),
        "copies",
    )
    if several.isEmpty():
        return _repeated(out, F.col("copies"))
    out = written(out, "fingerprints")
    blocks = out.where(F.col("copies") > COPIES_IN_TASK).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("copies") / COPIES_IN_TASK).cast("int") - 1)))
    blocks = blocks.repartition("fingerprint", "block")
    left = F.least(F.col("copies") - F.col("block") * COPIES_IN_TASK, F.lit(COPIES_IN_TASK))
    return _repeated(out.where(F.col("copies") <= COPIES_IN_TASK), F.col("copies")).union(_repeated(blocks, left).drop("block"))


def _repeated(rows: DataFrame, times: Column) -> DataFrame:
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("nth", "copies")
