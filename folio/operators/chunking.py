"""Cutting documents: sections, typed runs, paragraph and sentence packers, character windows, references, pages.

Headings are found by rules over lines, all of them columns; what a document is
cut into is an array that is made where its text lies, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as tx

#: Names of sections.
HEADERS = (
    "abstract",
    "introduction",
    "background",
    "related work",
    "literature review",
    "preliminaries",
    "methodology",
    "method",
    "approach",
    "system design",
    "proposed method",
    "framework",
    "experimental setup",
    "experiments",
    "experimental results",
    "results",
    "evaluation",
    "discussion",
    "conclusion",
    "conclusions",
    "future work",
    "limitations",
    "acknowledgments",
    "acknowledgements",
    "references",
    "appendix",
)
#: Names that are known besides.
OWN_HEADERS = ("bibliography", "keywords")
#: Sections whose parts are entries.
LISTS = ("references", "bibliography")
#: A number or letter before a title, a heading that the text follows in its line, and a LaTeX command around a title.
NUMBERED = r"^(?:[0-9]+(?:\.[0-9]+)*[.)]?|[IVXLC]+\.|[A-Z]\.)[ \t]+"
INLINE = r"(?i)^[#* \t]*(abstract|keywords?)\.\**[ \t]+[^ \t]"
COMMAND = r"^\\section\*?\{[ \t]*([^}]*)\}"
MOST_CHARS, LEAST_CHARS = 2000, 80
#: Longest line that may be a heading of a chunk, and most words of a title and of a section's name.
HEADING_CHARS, TITLE_WORDS, NAME_WORDS = 120, 10, 8


def char_windows(rows: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """key, start, chunk: windows of `size` characters, each `overlap` into the one before; the last ends with the text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    starts = rows.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    return starts.select(key, (F.col("_k") * step).alias("start"), tx.strip(F.substr(text, F.col("_k") * step + 1, F.lit(size))).alias("chunk"))


def packed_paragraphs(text: Column, most: int = MOST_CHARS) -> Column:
    """Paragraphs joined while they fit; one that is too long for itself is cut hard."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), tx.strip), lambda x: x != "")
    cut = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substr(p, k * most + 1, F.lit(most)))))

    def add(state: Column, p: Column) -> Column:
        fits = (F.length(state["open"]) > 0) & (F.length(state["open"]) + F.length(p) < most)
        opened = F.when(fits, F.concat(state["open"], F.lit("\n\n"), p)).otherwise(p)
        done = F.when(fits | (F.length(state["open"]) == 0), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), opened.alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(cut, start, add, lambda s: F.when(F.length(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def packed_sentences(text: Column, most: int = MOST_CHARS, overlap: int = 0) -> Column:
    """What pack_sentences() makes of a text, as an array: the fold stays in the JVM."""
    sentences = F.filter(F.split(tx.strip(text), rf"(?<=[.!?]){tx.SPACE}+"), lambda x: x != "")
    parts = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda k: F.substr(s, k * most + 1, F.lit(most)))))
    no_text = F.array().cast("array<string>")

    def tail(held: Column) -> Column:
        """The last sentences that fit the overlap."""

        def back(s: Column, x: Column) -> Column:
            size = s["size"] + F.length(x) + F.when(F.size(s["kept"]) > 0, 1).otherwise(0)
            fits = s["open"] & (size <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), F.when(fits, size).otherwise(s["size"]).alias("size"), fits.alias("open"))

        return F.aggregate(F.reverse(held), F.struct(no_text.alias("kept"), F.lit(0).alias("size"), F.lit(True).alias("open")), back, lambda s: s["kept"])

    def add(s: Column, x: Column) -> Column:
        full = (F.size(s["held"]) > 0) & (F.length(F.array_join(s["held"], " ")) + 1 + F.length(x) > most)
        kept = tail(s["held"]) if overlap else no_text
        begun = F.when(F.length(F.array_join(kept, " ")) + 1 + F.length(x) <= most, F.concat(kept, F.array(x))).otherwise(F.array(x))
        done = F.when(full, F.concat(s["done"], F.array(F.array_join(s["held"], " ")))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, begun).otherwise(F.concat(s["held"], F.array(x))).alias("held"))

    last = lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(F.array_join(s["held"], " ")))).otherwise(s["done"])
    return F.aggregate(parts, F.struct(no_text.alias("done"), no_text.alias("held")), add, last)


def _known(low: Column) -> Column:
    """A known name, or its singular or plural."""
    names = [*HEADERS, *OWN_HEADERS]
    return low.isin(names) | F.concat(low, F.lit("s")).isin(names) | F.regexp_replace(low, "s$", "").isin(names)


def _reads_as_title(title: Column) -> Column:
    """At most TITLE_WORDS words that begin with a capital, hold no sign of a sentence, and of which at least half of the long ones are capitalised."""
    long = F.regexp_extract_all(title, F.lit(r"[A-Za-z]{4,}"), 0)
    capital = F.filter(long, lambda w: w.rlike("^[A-Z]"))
    return title.rlike(r"^[A-Z][A-Za-z0-9 \t:&/'-]*$") & (F.size(tx.words(title)) <= TITLE_WORDS) & (F.size(long) > 0) & (2 * F.size(capital) >= F.size(long))


def heading(line: Column, longest: int | None = None) -> Column:
    """The name of the section that a line opens, null for all other lines.

    A line opens a section if it is a known name, an abstract or a list of
    keywords that begins in its line, a title behind a number, a mark or in a
    LaTeX command, or holds a known name in capitals.  Lines of page layout and
    of lists of contents open none, nor do lines of over `longest` characters.
    """
    named = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))

    def parted(bare: Column) -> Column:
        seen = tx.strip(tx.strip_markdown(F.regexp_replace(bare, r"^#{1,6}[ \t]+", "")))
        parts = F.struct(bare.alias("bare"), F.regexp_extract(bare, COMMAND, 1).alias("command"), seen.alias("seen"))
        none = bare == "" if longest is None else (bare == "") | (F.length(bare) > longest)
        return F.when(none, None).otherwise(tx.let(parts, titled))

    def titled(s: Column) -> Column:
        shown = F.when(s["command"] != "", s["command"]).otherwise(s["seen"])
        title = F.regexp_replace(F.regexp_replace(shown, NUMBERED, ""), r"[ \t]*[:.]*$", "")
        part = s["bare"].rlike(r"^#{1,6}[ \t]") | (s["command"] != "") | shown.rlike(NUMBERED)
        return tx.let(F.struct(title.alias("title"), part.alias("part"), s.alias("of")), lambda t: tx.let(F.struct(t.alias("t"), F.lower(t["title"]).alias("low")), name))

    def name(x: Column) -> Column:
        t, low = x["t"], x["low"]
        of, short = t["of"], F.array_join(F.slice(tx.words(t["title"]), 1, NAME_WORDS), " ")
        capitals = t["title"].rlike(r"^[A-Z][A-Z \t&-]{3,58}$") & low.rlike("|".join(HEADERS))
        none = F.lower(of["bare"]).rlike("|".join(tx.LAYOUT_LINES)) | of["seen"].rlike(tx.LEADER) | low.rlike("^(?:table of )?contents$")
        return F.when(_known(low) | (t["part"] & _reads_as_title(t["title"])) | capitals, F.when(~none, named(short)))

    return F.when(_begins_inline(line), named(F.regexp_extract(line, INLINE, 1))).otherwise(tx.let(tx.strip(line), parted))


def _begins_inline(line: Column) -> Column:
    return line.rlike(INLINE)


def _spans(rows: DataFrame, key: str, text: str, longest: int | None = None) -> DataFrame:
    """key, lines, spans: array<struct<section, first_line, last_line>>.

    Explode spans by posexplode_outer and drop nulls after it: of posexplode,
    Spark infers a filter on the array's size, moves it below the projections
    here and so reads all lines again for every heading.
    """
    lines = rows.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    heads = lines.select(key, "lines", F.filter(F.transform("lines", lambda x, i: F.struct(heading(x, longest).alias("section"), i.alias("at"))), lambda h: h["section"].isNotNull()).alias("heads"))
    front = F.coalesce(F.get(F.filter("heads", lambda h: h["section"] == "Abstract"), F.lit(0))["at"], F.lit(0))
    kept = heads.withColumn("front", front).select(key, "lines", F.filter("heads", lambda h: h["at"] >= F.col("front")).alias("heads"))
    ends = lambda i: F.coalesce(F.get(F.col("heads"), i + 1)["at"], F.size("lines")) - 1
    return kept.select(key, "lines", F.transform("heads", lambda h, i: F.struct(h["section"].alias("section"), h["at"].alias("first_line"), ends(i).alias("last_line"))).alias("spans"))


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, section, first_line, last_line: the sections of every document, lines counted from 0.

    What stands before an abstract is front matter and in no section; without an
    abstract, what stands before the first heading.
    """
    return _spans(rows, key, text).select(key, F.posexplode_outer("spans").alias("place", "s")).where("place IS NOT NULL").select(key, "place", "s.*")


def reference_entries(text: Column) -> Column:
    """Entries of a reference list: by number, else by author and year at a line's beginning, else by paragraph."""
    sign = "\x01"
    cut = lambda pattern: F.filter(F.transform(F.split(F.regexp_replace(text, pattern, f"{sign}$1"), sign), tx.strip), lambda x: x != "")
    numbered, dated = cut(r"(?m)^[ \t]*(\[[0-9]+\]|[0-9]{1,3}[.)][ \t])"), cut(r"(?m)^([A-Z][A-Za-z'-]+,[ \t][^\n]*(?:19|20)[0-9]{2})")
    paragraphs = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), tx.strip), lambda x: x != "")
    return F.when(F.size(numbered) > 1, numbered).when(F.size(dated) > 1, dated).otherwise(paragraphs)


def references(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, entry: the entries of every reference list."""
    return rows.select(key, F.posexplode(reference_entries(F.col(text))).alias("place", "entry"))


def chunked(rows: DataFrame, key: str, text: str, most: int = MOST_CHARS, least: int = LEAST_CHARS) -> DataFrame:
    """key, place, section, chunk_text, content_type: chunks of at most `most` characters, section by section.

    Paragraphs of a section are packed, a reference list is parted into its
    entries.  A document without headings is one section, Full Text.  Parts
    under `least` characters are dropped; a document of which nothing is left is
    packed whole.
    """
    found = _spans(rows, key, text, HEADING_CHARS)
    whole = F.array(F.struct(F.lit("Full Text").alias("section"), F.lit(-1).alias("first_line"), (F.size("lines") - 1).alias("last_line")))
    spans = F.when(F.size("spans") > 0, F.col("spans")).otherwise(whole.cast("array<struct<section:string,first_line:int,last_line:int>>"))
    begin = lambda s: F.when((s["first_line"] >= 0) & ~_begins_inline(F.get(F.col("lines"), s["first_line"])), s["first_line"] + 1).otherwise(F.greatest(s["first_line"], F.lit(0)))
    body = lambda s: tx.strip(F.array_join(F.slice(F.col("lines"), begin(s) + 1, F.greatest(s["last_line"] - begin(s) + 1, F.lit(0))), "\n"))
    bodies = found.select(key, "lines", F.transform(spans, lambda s: F.struct(s["section"].alias("section"), body(s).alias("body"))).alias("bodies"))
    entries = lambda b: F.flatten(F.transform(reference_entries(b), lambda e: packed_paragraphs(e, most)))
    parts = lambda s: F.when(F.lower(s["section"]).isin(*LISTS), entries(s["body"])).otherwise(packed_paragraphs(s["body"], most))
    cut = F.flatten(F.transform("bodies", lambda s: F.transform(F.filter(parts(s), lambda p: F.length(p) >= least), lambda p: F.struct(s["section"].alias("section"), p.alias("chunk_text")))))
    every = F.transform(packed_paragraphs(F.array_join("lines", "\n"), most), lambda p: F.struct(F.lit("Full Text").alias("section"), p.alias("chunk_text")))
    kind = "array<struct<section:string,chunk_text:string>>"
    chunks = bodies.select(key, "lines", cut.cast(kind).alias("cut")).select(key, F.posexplode_outer(F.when(F.size("cut") > 0, F.col("cut")).otherwise(every.cast(kind))).alias("place", "c")).where("place IS NOT NULL")
    return chunks.select(key, "place", "c.section", "c.chunk_text", tx.chunk_kind(F.col("c.chunk_text")).alias("content_type"))


def typed_runs(rows: DataFrame, key: str, text: str, content_type: str = "narrative", least_table: int = 30) -> DataFrame:
    """key, place, kind, part: tables, figure captions and runs of prose of each text.

    A caption is a part for itself.  Prose ends at a table line or a caption.
    Table lines go to one part up to the next caption, also across prose; parts
    of under `least_table` characters are headings of tables and go.
    """
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line")).withColumn("bare", tx.strip(F.col("line")))
    kind = F.when(tx.table_line(F.col("bare")), "table").when(tx.figure_line(F.col("bare")), "figure_caption").otherwise(content_type)
    order = Window.partitionBy(key).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("kind", kind)
    n = lambda x: F.coalesce(F.sum(x.cast("int")).over(before), F.lit(0))
    prose, caption = F.col("kind") == content_type, F.col("kind") == "figure_caption"
    run = F.when(prose, n(~prose)).when(caption, F.col("at")).otherwise(n(caption))
    placed = marked.withColumn("run", run)
    said = F.when(prose, F.col("line")).otherwise(F.col("bare"))
    # where a part ends: prose at the next line that is none, a table at the next caption, both at the end of the text
    after = order.rowsBetween(1, Window.unboundedFollowing)
    end = F.when(prose, F.min(F.when(~prose, F.col("at"))).over(after)).when(caption, F.col("at")).otherwise(F.min(F.when(caption, F.col("at"))).over(after))
    placed = placed.withColumn("end", end).withColumn("said", said)
    parts = placed.groupBy(key, "kind", "run").agg(F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("at", "said"))).alias("own"))
    parts = parts.withColumn("part", tx.strip(F.array_join(F.col("own.said"), "\n"))).where((F.col("part") != "") & ((F.col("kind") != "table") | (F.length("part") >= least_table)))
    rank = F.when(F.col("kind") == "table", F.when(F.isnull("end"), 0).otherwise(1)).when(F.col("kind") == "figure_caption", 2).otherwise(F.when(F.isnull("end"), 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("end").asc_nulls_last(), rank)) - 1
    return parts.select(key, place.alias("place"), "kind", "part")


def heading_context(heads: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """heads with `context`: each heading behind the ones it stands under, "Method > 2.1 Data".

    A heading without a point, "sub" or "part" in it is a top one and begins
    anew.  Any other is put behind what stood before it, unless the heading just
    before holds a point.  So a context is a run of headings, and a running list
    within the run.
    """
    order = Window.partitionBy(key).orderBy(at)
    low = F.lower(name)
    top = ~(low.contains(".") | low.contains("sub") | low.contains("part"))
    starts = top | F.coalesce(F.lag(low).over(order).contains("."), F.lit(True))
    run = F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(key, "run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return heads.where(F.col(name) != "").withColumn("run", run).withColumn("context", F.array_join(F.collect_list(name).over(within), " > ")).drop("run")


def page_spans(pages: DataFrame, key: str, page: str, text: str, most: int = MOST_CHARS) -> DataFrame:
    """key, place, first_page, last_page, chunk_text: paragraphs packed across the pages of a document."""
    parts = F.filter(F.transform(F.split(text, rf"\n{tx.SPACE}*\n"), tx.strip), lambda x: x != "")
    own = pages.select(key, F.col(page).alias("p"), parts.alias("parts"))
    ordered = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "parts"))).alias("pages"))
    flat = F.flatten(F.transform("pages", lambda x: F.transform(x["parts"], lambda t: F.struct(x["p"].alias("p"), t.alias("t")))))
    chunk = lambda s: F.array(F.struct(s["first"].alias("first_page"), s["last"].alias("last_page"), s["open"].alias("chunk_text")))

    def add(s: Column, x: Column) -> Column:
        full = (s["open"] != "") & (F.length(s["open"]) + F.length(x["t"]) + 2 > most)
        fresh = full | (s["open"] == "")
        return F.struct(
            F.when(full, F.concat(s["done"], chunk(s))).otherwise(s["done"]).alias("done"),
            F.when(fresh, x["p"]).otherwise(s["first"]).alias("first"),
            x["p"].alias("last"),
            F.when(fresh, x["t"]).otherwise(F.concat(s["open"], F.lit("\n\n"), x["t"])).alias("open"),
        )

    kind = pages.schema[page].dataType.simpleString()
    none = F.lit(None).cast(kind)
    start = F.struct(F.array().cast(f"array<struct<first_page:{kind},last_page:{kind},chunk_text:string>>").alias("done"), none.alias("first"), none.alias("last"), F.lit("").alias("open"))
    packed = F.aggregate(flat, start, add, lambda s: F.when(s["open"] != "", F.concat(s["done"], chunk(s))).otherwise(s["done"]))
    return ordered.select(key, F.posexplode(packed).alias("place", "c")).select(key, "place", "c.*")


def with_overlap(chunks: DataFrame, key: str, tail: int = 80) -> DataFrame:
    """Each chunk preceded by the end of the one before it in its section."""
    before = F.lag("chunk_text").over(Window.partitionBy(key, "section").orderBy("place"))
    return chunks.withColumn("chunk_text", F.when(before.isNotNull(), F.concat(F.right(before, F.lit(tail)), F.lit(" "), F.col("chunk_text"))).otherwise(F.col("chunk_text")))
