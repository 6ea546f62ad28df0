"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Equal shingle sets collapse to one class first.  A band bucket never emits all
its pairs: each member is checked against the bucket's hub, the class that
meets most others in all its buckets (of a text and its edited copies, the
text itself), some bands at a time; links are contracted to components, pairs inside a component
are left out of what follows, and only buckets that still hold several
components in the end are joined on their rarest shingles, in blocks, where
component, sizes, sketches and the places of shared shingles allow a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textscan as ts
from folio.llm.common import attach, named, numbered, semi, written
from folio.llm.graph import components

SHINGLE = 5
#: 4 rows and 32 bands: a pair at similarity 0.75 shares no band with probability 5e-6.
SLOTS, ROWS = 128, 4
BLOCK = 512
#: Elements whose permutations are held at a time (128 bytes each), and bytes of one text that are read at a time.
RANKED, STRETCH = 1 << 17, 1 << 20
#: Members that are verified against one copy of their hub's text.
HUB_MEMBERS = 32
#: Bands are verified in rounds; after each, pairs of one component need no verification any more.
ROUNDS = ((0, 2), (2, 8), (8, SLOTS // ROWS))
#: Slots that must agree before two members of an unresolved bucket are verified: 0.55, over five deviations below 0.75.
LEAST_AGREE = int(SLOTS * 0.55)
_GOLD = 0x9E3779B97F4A7C15


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each word, and each document's first word."""
    w = ts.words(data, offsets, ts.SPACE_WORDS, True)
    return w.hash, ts.span_hash(ts.FOLD[data], w.start, w.end, 1), w.first


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _hashed(); a long text is read in stretches that end between words."""
    if len(offsets) > 2 or len(data) <= 2 * STRETCH:
        return _hashed(data, offsets)
    ends = np.flatnonzero(~ts.SPACE_WORDS[data])
    cuts = ends[np.searchsorted(ends, np.arange(STRETCH, ends[-1], STRETCH))] if len(ends) else ends
    bounds = np.unique(np.concatenate([[0], cuts, [len(data)]])).tolist()
    some = [_hashed(data[a:b], np.array([0, b - a])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    words, others = (np.concatenate([x[k] for x in some]) for k in (0, 1))
    return words, others, np.array([0, len(words)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted by (document, hash): hashes, each document's first, and an independent hash of each."""
    words, others, begin = _word_hashes(data, offsets)
    count = np.diff(begin)
    n = len(offsets) - 1
    inside = ts.gram_mask(begin, len(words), SHINGLE)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    hashes = []
    for own in (words, others):
        h = ts.grams(own, SHINGLE)[inside]
        whole = [ts.grams(own[begin[i] : begin[i + 1]], int(count[i]))[0] ^ np.uint64(count[i]) for i in short]  # the one shingle
        hashes.append(np.concatenate([h, np.array(whole, dtype=np.uint64)]))
    h, other = hashes
    d = np.concatenate([np.repeat(np.arange(n), count)[: len(inside)][inside], short])
    order = np.lexsort((h, d)) if n > 1 else np.argsort(h, kind="stable")
    h, d, other = h[order], d[order], other[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[fresh], np.searchsorted(d[fresh], np.arange(n + 1)), other[fresh]


def superminhash(h: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of all documents at once, one rank level at a time.

    An element's rank j goes to slot p[j] of its own permutation with the value
    j + r, r uniform in [0, 1).  Values of level j are at least j, so a document
    whose slots are all below j stops before that level.  Slots of documents
    without elements stay infinite.
    """
    n = len(first) - 1
    sig = np.full(n * slots, np.inf)
    doc = np.repeat(np.arange(n), np.diff(first))
    for lo in range(0, len(h), RANKED):
        _ranked(h[lo : lo + RANKED], doc[lo : lo + RANKED], sig, slots)
    return sig.reshape(n, slots)


def _ranked(h: np.ndarray, doc: np.ndarray, sig: np.ndarray, slots: int) -> None:
    """Lower the signatures by these elements; what earlier ones have reached stops them early."""
    low = int(doc[0]) if len(doc) else 0
    doc = doc - low
    n = int(doc[-1]) + 1 if len(doc) else 0
    sig = sig[low * slots : (low + n) * slots]  # of the documents that are met here
    perm = None
    for j in range(slots):
        if not len(h):
            break
        with np.errstate(over="ignore"):
            x = ts.mix64(h + np.uint64((j + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        r = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + ((x & np.uint64(0x7FF)) * np.uint64(slots - j) >> np.uint64(11)).astype(np.int64)
        rows = np.arange(len(h))
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        perm[rows, j] = slot
        at = doc * slots + slot
        better = sig[at] > j
        np.minimum.at(sig, at[better], r[better] + j)
        open_docs = (sig.reshape(n, slots) >= j + 1).any(axis=1)
        on = open_docs[doc]
        if not on.all():
            h, doc, perm = h[on], doc[on], perm[on]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in ts.slices(batch.column(1), 1 << 20):
            h, first, other = shingle_sets(s.data, s.offsets)
            size = np.diff(first)
            own = [batch.column(c).slice(s.lo, s.hi - s.lo) for c in (0, 2)]
            with np.errstate(over="ignore"):
                sums = []
                for hashes in (h, other):
                    pad = np.concatenate([ts.mix64(hashes), np.zeros(1, np.uint64)])
                    sums.append(np.where(size > 0, np.add.reduceat(pad, np.minimum(first[:-1], len(pad) - 1)), np.uint64(0)))
                bits = superminhash(h, first).view(np.uint64)
                sketch = (ts.mix64(bits) >> np.uint64(56)).astype(np.uint8)
                lanes = bits.reshape(len(size), SLOTS // ROWS, ROWS)
                band = np.arange(SLOTS // ROWS, dtype=np.uint64)[None, :]
                for i in range(ROWS):
                    band = ts.mix64(band * np.uint64(_GOLD) + lanes[:, :, i])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * (SLOTS // ROWS)), ts.as_long(np.ascontiguousarray(band).ravel()))
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(size, pa.int64()), ts.as_long(sums[0]), ts.as_long(sums[1]), lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The document's set itself: its five-word shingles, or all of fewer words."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, the six ASCII spaces part words
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return {*zip(*(words[i:] for i in range(SHINGLE)))}


def _alike(both: int, x: int, y: int) -> bool:
    return both > 0 and 100 * both >= 75 * (x + y - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, member, text), a hub's own (member null) before its members: the linked pairs (a, b).

    Hashes of the shingles refuse most pairs; those that they allow are linked
    if the shingles themselves, word by word, allow it too.
    """
    hub, own, exact = None, np.zeros(0, np.uint64), None
    for batch in batches:
        hubs, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        found = []
        for s in ts.slices(batch.column(3)):
            h, first, _ = shingle_sets(s.data, s.offsets)
            for i in range(s.hi - s.lo):
                a, b = hubs[s.lo + i], members[s.lo + i]
                raw = s.data[s.offsets[i] : s.offsets[i + 1]]
                mine = h[first[i] : first[i + 1]]
                if b is None:
                    hub, own, text, exact = a, mine.copy(), raw.tobytes(), None
                elif hub == a and _alike(len(np.intersect1d(mine, own, assume_unique=True)), len(mine), len(own)):
                    exact = shingles(text) if exact is None else exact
                    sure = shingles(raw.tobytes())
                    if _alike(len(sure & exact), len(sure), len(exact)):
                        found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents are linked.

    A hub `a` may have any number of members: they are dealt in blocks, and its
    text is sent once for each block, each member's text once for each pair.
    pairs: cheap to read again.
    """
    blocks = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("blocks")), "blocks")
    dealt = attach(pairs, blocks, ["a"], F.col("b"), "n").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    wanted = dealt.select("a", "salt", "b", F.col("b").alias("doc_id")).union(heads)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = written(semi(docs, ids, "doc_id").groupBy("doc_id").agg(F.min_by("text", "text_key").alias("text")), "texts")
    rows = wanted.join(texts, "doc_id").select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_linked, "a long, b long")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j): pairs of classes of different components that may be linked.

    A bucket is a shingle; place is where it stands among the class's own, rarest first.
    """
    held: list[pa.RecordBatch] = []

    def pairs(group: pa.Table) -> pa.RecordBatch | None:
        _, bi, bj, block, rep, comp, size, place = (group.column(c).to_numpy() for c in range(8))
        rest = size - place  # shingles from the shared one on
        sketch = np.frombuffer(b"".join(group.column(8).to_pylist()), np.uint8).reshape(-1, SLOTS)
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        found = []
        for x in left:
            near = (comp[right] != comp[x]) & (4 * size[right] >= 3 * size[x]) & (4 * size[x] >= 3 * size[right])
            y = right[near & (7 * np.minimum(rest[right], rest[x]) >= 3 * (size[right] + size[x]))]
            y = y[y > x] if bi[0] == bj[0] else y
            if len(y):
                y = y[(sketch[y] == sketch[x]).sum(axis=1) >= LEAST_AGREE]
                found += [(min(rep[x], rep[z]), max(rep[x], rep[z])) for z in y]
        if found:
            a, b = np.unique(np.array(found, np.int64), axis=0).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        return None

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(3)])
        if held and (key[:, 0] != [held[-1].column(c)[0].as_py() for c in range(3)]).any():
            if (out := pairs(pa.Table.from_batches(held))) is not None:
                yield out
            held = []
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            held.append(batch.slice(lo, hi - lo))
            if k < len(cuts) - 2:
                if (out := pairs(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
    if held and (out := pairs(pa.Table.from_batches(held))) is not None:
        yield out


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A null or empty text has no shingles and is linked with nothing, so it is
    its own component; a null doc_id is never linked and stays.  Rows that
    repeat a doc_id are one document, which is linked by the first of its texts
    (by a hash of the text) where they differ; n_shingles is each row's own.
    doc_id may be of any type with an order.  Columns besides doc_id and text are ignored.
    """
    docs, ids = numbered(docs.select("doc_id", "text"))
    return named(_near_groups(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))), ids, "doc_id", "component_id")


def _near_groups(docs: DataFrame) -> DataFrame:
    signed = written(docs.mapInArrow(_signatures, "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"), "signatures")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_key").alias("own"), F.max("text_key").alias("last")).where("own <> last")
    several = written(several.select("doc_id", "own"), "several")
    chosen = signed.where("doc_id is not null").join(several, "doc_id", "left").where("own is null or own = text_key").drop("own")
    real = chosen.where("n_shingles > 0")
    classes = written(real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    tagged = attach(real, classes, ["set_a", "set_b", "n_shingles"], F.col("doc_id"), "copies")
    first = F.col("doc_id") == F.col("rep")
    tagged = written(tagged.select("doc_id", "n_shingles", "rep", F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("sketch")).alias("sketch")), "classes")
    reps = tagged.where("bands is not null").dropDuplicates(["rep"])
    member = written(reps.select("rep", F.posexplode("bands").alias("band", "bucket")), "bands")
    shared = written(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    filled = written(attach(member, shared, ["bucket"], F.col("rep"), "members").where("members is not null"), "filled")
    scored = filled.join(filled.groupBy("rep").agg(F.sum("members").alias("score")), "rep")
    hubs = scored.groupBy("bucket").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("hub"), F.count(F.lit(1)).alias("members"))
    member = written(attach(member, written(hubs, "hubs"), ["bucket"], F.col("rep"), "members").where("members is not null"), "buckets")
    star = member.where("rep <> hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.min("band").alias("band"))
    star = written(star, "star")
    links = comp = None
    for lo, hi in ROUNDS:
        pairs = star.where((F.col("band") >= lo) & (F.col("band") < hi)).select("a", "b")
        more = pairs if comp is None else written(_apart(pairs, comp), "pairs")
        links = _and(links, written(verify(more, docs), "links"))
        comp = components(links, "a", "b")
    more = _unresolved(member, comp, tagged, star, docs)
    if not more.isEmpty():
        links = links.union(verify(more, docs))
        comp = components(links, "a", "b")
    sizes = classes.groupBy(F.col("rep").alias("node")).agg(F.sum("copies").alias("copies"))
    placed = written(comp.join(sizes, "node").select("node", "component", "copies"), "placed")
    named = attach(tagged.select("doc_id", "n_shingles", F.col("rep").alias("node")), placed, ["node"], F.col("doc_id"), "copies")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    by_id = several.join(named.select("doc_id", "component_id").distinct(), "doc_id", "left").select("doc_id", "own", "component_id")
    others = signed.join(by_id, "doc_id").where("text_key <> own").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null").unionByName(chosen.where("n_shingles = 0")).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = named.union(others).union(alone)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _and(rows: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if rows is None else rows.union(more)


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(comp.toDF("a", "component_a"), "a")
    placed = attach(pairs, written(hubs, "hubs"), ["a"], F.col("b"), "n").join(comp.toDF("b", "component_b"), "b", "left")
    return placed.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in ts.slices(batch.column(1), 1 << 20):
            h, first, _ = shingle_sets(s.data, s.offsets)
            doc = s.lo + np.repeat(np.arange(len(first) - 1), np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), ts.as_long(h)], ["rep", "shingle"])


def _unresolved(member: DataFrame, comp: DataFrame, tagged: DataFrame, star: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that are still to be verified: members of mixed buckets, in different components, that may be linked.

    Their shingles are put in the order of frequency, rarest first.  Linked sets
    share one of the first |set| / 4 + 1 of them, and where the first shared one
    stands bounds what they can share in all; pairs under the bound are left out.
    """
    placed = member.select("bucket", "rep").join(comp.withColumnsRenamed({"node": "rep"}), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("bucket", "n")
    loose = attach(placed, written(mixed, "mixed"), ["bucket"], F.col("rep"), "n").where("n is not null")
    loose = written(loose.select("rep", "component").distinct(), "loose")
    texts = semi(docs.withColumnRenamed("doc_id", "rep"), loose.select("rep"), "rep").groupBy("rep").agg(F.min_by("text", "text_key").alias("text"))
    shingles = written(texts.mapInArrow(_shingled, "rep long, shingle long"), "shingles")
    often = written(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")), "often")
    ranked = attach(shingles, often, ["shingle"], F.col("rep"), "often").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("own"))
    head = F.size("own") - F.ceil(F.size("own") * 0.75).cast("int") + 1
    rows = ranked.select("rep", F.size("own").alias("size"), F.posexplode(F.slice("own", F.lit(1), head)).alias("place", "x")).where("x.often > 1")
    rows = written(rows.select("rep", "size", "place", F.col("x.shingle").alias("bucket")).join(loose, "rep"), "rarest")
    shared = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("bucket", "members")
    rows = attach(rows, written(shared, "common"), ["bucket"], F.col("rep"), "members").where("members is not null").join(tagged.where("bands is not null").select("rep", "sketch").dropDuplicates(["rep"]), "rep")
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "size", "place", "sketch")
    pairs = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_across, "a long, b long").distinct()
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return written(pairs.join(done, ["a", "b"], "left_anti"), "across")
