"""Exact dedup with an extendible-hash index on shared files.

Every row gets a 64-bit key of its normalised text.  A directory over the key's
leading bits splits overfull buckets, one more bit at a time, which doubles it
where a bucket is as deep as the directory; a bucket is a range of keys.  Rows
whose key is not alone go to the owner of their bucket, which keeps its rows
sorted by key and bytes: rows of one key are a chain, its links differ in
bytes, and a link is a group of equal texts.  What the owners find is the index, written as shared files.

A key that many rows share is dealt to several owners by a salt.  Each of them
compares its own rows, and the first row of each of its links meets those of
the other salts in a second, small round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_KEYS, attach, partitions, written

#: Entries of a bucket, and bytes of text that one owner task gets, as far as buckets can be dealt.
CAPACITY, OWNER_BYTES = 4_000, 64 << 20
#: Bits of a cell beyond those that evenly spread keys need, and of the directory's first depth below those.
SPARE_BITS, LESS_BITS = 4, 3
#: Keys of more than one row that are all sent to every executor (16 bytes each); with more, rows are shuffled to meet them.
FEW_KEYS = 100_000
#: Rows of one salt of a key; of a key with more rows than this squared, there are as many salts as rows in each.
ROWS_PER_SALT = 500


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def depth_of(entries: int, capacity: int = CAPACITY) -> int:
    """Bits with which evenly spread keys fill no bucket."""
    return max(0, (-(-entries // capacity) - 1).bit_length())


def cell(key: Column, bits: int) -> Column:
    """The leading bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(cells: DataFrame, bits: int, capacity: int = CAPACITY, least: int = 0) -> DataFrame:
    """cell, bucket, depth from cell, entries: for each cell of `bits` leading bits, the bucket it belongs to.

    A bucket of `least` bits is split while it holds more than `capacity`
    entries and bits are left.  It is named by its first cell, so buckets are in
    the order of keys.  The table has a row for each cell that is not empty;
    depths are found from sums over all cells that share the leading bits.
    """
    depth = F.lit(bits)
    for b in range(bits - 1, least - 1, -1):
        held = F.sum("entries").over(Window.partitionBy(F.shiftright("cell", bits - b)))
        depth = F.when(held <= capacity, F.lit(b)).otherwise(depth)
    found = cells.withColumn("depth", depth)
    return found.select("cell", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)").alias("bucket"), "depth")


def index(docs: DataFrame, text: Column, key, capacity: int = CAPACITY) -> DataFrame:
    """The written index: a row for each row of docs with doc_id, bucket, key, salt, link, text_sha256, first, members, body.

    first and members: smallest doc_id and number of rows of the link within
    the salt.  body: the text of a link's first row where its key is salted.
    A key of one row is a chain of one link; its text stays where it is.
    """
    body = docs.select("doc_id", normalised(text).alias("body")).withColumn("key", key(F.col("body")))
    entries = written(body.select("doc_id", "key", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("text_sha256")), "entries")
    keys = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "keys")
    total, size = keys.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("bytes"))), F.lit(0))).first()
    bits = depth_of(total, capacity) + SPARE_BITS
    cells = written(keys.groupBy(cell(F.col("key"), bits).alias("cell")).agg(F.sum(F.least("rows", F.lit(ROWS_PER_SALT))).alias("entries")), "cells")
    slots = written(directory(cells, bits, capacity, max(0, bits - SPARE_BITS - LESS_BITS)), "directory").drop("depth")
    slots = F.broadcast(slots) if slots.count() <= BROADCAST_KEYS else slots
    shared = keys.where("rows > 1").select("key", "rows")
    bound = max(ROWS_PER_SALT, -(-total // BROADCAST_KEYS))
    salts = F.when(F.col("rows") > bound, F.ceil(F.col("rows") / F.greatest(F.lit(ROWS_PER_SALT), F.sqrt("rows"))).cast("int"))

    alone = attach(entries.select("doc_id", "key", "text_sha256"), shared, ["key"], F.col("doc_id"), "rows", few=FEW_KEYS).where("rows is null")
    alone = alone.withColumn("cell", cell(F.col("key"), bits)).join(slots, "cell")
    single = alone.select("doc_id", "bucket", "key", F.lit(0).alias("salt"), F.lit(1).alias("link"), "text_sha256", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("members"), F.lit(None).cast("string").alias("body"))

    several = attach(body, shared, ["key"], F.col("doc_id"), "rows", few=FEW_KEYS).where("rows is not null").withColumn("salts", salts)
    several = several.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")))
    placed = several.withColumn("cell", cell(F.col("key"), bits)).join(slots, "cell").drop("rows")
    owned = placed.withColumn("text_sha256", F.sha2("body", 256)).repartition(partitions(docs, size, OWNER_BYTES), "bucket", "salt")
    chain = Window.partitionBy("bucket", "salt", "key").orderBy("body")
    link = Window.partitionBy("bucket", "salt", "key", "body")
    held = owned.withColumn("link", F.dense_rank().over(chain)).withColumn("first", F.min("doc_id").over(link)).withColumn("members", F.count(F.lit(1)).over(link))
    kept = F.when(F.col("salts").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first")), F.col("body"))
    chains = held.select("doc_id", "bucket", "key", "salt", "link", "text_sha256", "first", "members", kept.alias("body"))
    return written(single.unionByName(chains), "index")


def exact_groups(docs: DataFrame, text: Column | str = "text", key=F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: identical after normalised().  The smallest doc_id of a group stays;
    rows that repeat that doc_id stay with it.  Each row is judged by its own
    text, also where a doc_id comes with several.  A null text is an empty one;
    a row with a null doc_id is never preferred to one that has an id, and a
    group of only such rows keeps them all.  An empty table gives an empty
    result.  doc_id may be of any type with an order.  key: a function of the
    normalised text (tests make keys collide).
    """
    text = F.col(text) if isinstance(text, str) else text
    found = index(docs, text, key, capacity)
    heads = found.where("body is not null").select("key", "salt", "link", "body", "first", "members").distinct()
    same = Window.partitionBy("key", "body")
    across = heads.select("key", "salt", "link", F.min("first").over(same).alias("keep_id"), F.sum("members").over(same).alias("group_size"))
    joined = found.drop("body").join(across, ["key", "salt", "link"], "left")
    keep = F.coalesce("keep_id", "first", "doc_id")
    stays = F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "first"), F.coalesce("keep_id", "first").isNull())
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", "members").alias("group_size"), stays.alias("kept"), "text_sha256")
