"""Sections, typed runs and heading contexts against brute force."""

import random
import re

import pytest

from folio.operators import chunking

PROSE = "One sentence of plain prose stands here. "


@pytest.mark.parametrize(
    ("lines", "names"),
    [
        (["Abstract", "x", "1. Introduction", "x", "C E U R", "W Pr o o r c k", "2. Methodology", "x", "3. Results and Evaluation", "x", "4. Conclusion and Future Work", "x", "References", "[1] x"], ["Abstract", "Introduction", "Methodology", "Results and evaluation", "Conclusion and future work", "References"]),
        (["Title", "Abstract. We present an effective approach.", "1 Introduction", "x", "2 Related Work", "x", "3 Method", "x", "4 Results", "x", "5 Conclusion", "x", "References", "[1] x"], ["Abstract", "Introduction", "Related work", "Method", "Results", "Conclusion", "References"]),
        (["\\section{Introduction}", "x", "\\section{The Grandfather Paradox}", "x"], ["Introduction", "The grandfather paradox"]),
        (["**Ann Lee**", "arXiv:1234.5678", "Copyright 2020", "Introduction", "x", "Manuscript"], ["Introduction"]),
        (["#### Introduction", "x", "#### Data Sources", "x"], ["Introduction", "Data sources"]),
        (["Contents", "1. Introduction ........ 3", "2. Our Method ....... 9", "1. Introduction", "x"], ["Introduction"]),
        (["Introduction", "x", "1. Let us choose the coordinates so that", "2. We show results", "3. The second approach creates a user feature vector it"], ["Introduction"]),
        (["RELATED WORK", "x", "III. PROPOSED METHOD", "x", "**Discussion**", "x"], ["Related work", "Proposed method", "Discussion"]),
        (["nothing here", "**Ann Lee**"], []),
    ],
)
def test_section_names(spark, lines, names):
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "id int, text string")
    assert [r.section for r in chunking.sections(rows, "id", "text").orderBy("place").collect()] == names


def test_sections_cover_their_lines(spark):
    text = "\n".join(["front", "Abstract", "a", "b", "1 Methods", "c", "References", "[1] d"])
    got = chunking.sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("place").collect()
    assert [(r.section, r.first_line, r.last_line) for r in got] == [("Abstract", 1, 3), ("Methods", 4, 5), ("References", 6, 7)]


def test_inline_abstract_is_kept(spark):
    text = f"Title\n**Ann Lee**\nAbstract. We present chunks. {PROSE * 4}\n1 Introduction\n{PROSE * 4}"
    got = chunking.chunked(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("place").collect()
    assert [(r.section, r.chunk_text) for r in got] == [("Abstract", f"Abstract. We present chunks. {PROSE * 4}".strip()), ("Introduction", (PROSE * 4).strip())]


@pytest.mark.parametrize(
    ("text", "entries"),
    [
        ("[1] Lee. x\n more\n[2] Sun. y", ["[1] Lee. x\n more", "[2] Sun. y"]),
        ("1) Lee. x\n2) Sun. y", ["1) Lee. x", "2) Sun. y"]),
        ("1. Lee\n12. Sun", ["1. Lee", "12. Sun"]),
        ("Lee, A. (1999). x\nSun, B. and " + "many others, " * 40 + "2001. y\n  z", ["Lee, A. (1999). x", "Sun, B. and " + "many others, " * 40 + "2001. y\n  z"]),
        ("on x\n\nby y\n \nend", ["on x", "by y", "end"]),
        ("", []),
    ],
)
def test_reference_entries(spark, text, entries):
    got = chunking.references(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("place").collect()
    assert [r.entry for r in got] == entries


def is_table(x: str) -> bool:
    low = x.lower()
    if not x or re.fullmatch(r"(table|tab\.)\s+\d+\.?", low):
        return False
    return low.startswith(("table ", "tab. ")) or x.count("|") + x.count("\t") >= 2 or (sum(c.isdigit() for c in x) / len(x) > 0.25 and len(x.split()) >= 4)


def runs(text: str) -> list[tuple[str, str]]:
    """One line after the other, with what is open."""
    out, prose, tables = [], [], []

    def close(held, kind, least):
        part = "\n".join(held).strip()
        held.clear()
        if len(part) >= least:
            out.append((kind, part))

    for line in text.split("\n"):
        bare = line.strip()
        if is_table(bare):
            close(prose, "narrative", 1)
            tables.append(bare)
        elif bare.lower().startswith(("figure ", "fig. ", "fig ")):
            close(prose, "narrative", 1)
            close(tables, "table", 30)
            out.append(("figure_caption", bare))
        else:
            prose.append(line)
    close(tables, "table", 30)
    close(prose, "narrative", 1)
    return out


def test_typed_runs(spark):
    rng = random.Random(3)
    lines = ["a | b | c", "Table 3 a and some more", "Table 3.", "12 13 14 15 16 17", "Figure 2 shows", "Fig. 1", "fig x", "plain", "  more of it ", "", "12 monkeys", "x\ty\tz"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["", "\n", "Table 3 a", "12 13 14 15"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.typed_runs(rows, "id", "text").orderBy("id", "place").collect():
        assert r.place == len(got.setdefault(r.id, []))
        got[r.id].append((r.kind, r.part))
    assert got == {i: found for i, t in enumerate(texts) if (found := runs(t))}


def test_heading_context_is_the_recurrence(spark):
    rng = random.Random(4)
    names = ["Method", "2.1 Data", "Part B", "Subset", "Results", "3.", "sub. x", "", "End"]
    heads = [(d, k, rng.choice(names)) for d in range(40) for k in range(rng.randrange(12))]
    want, current = {}, {}
    for d, k, name in heads:
        now = current.get(d, "")
        if not name:
            continue
        if not any(x in name.lower() for x in (".", "sub", "part")):
            now = name
        else:
            now = f"{now} > {name}" if now and "." not in now else name
        current[d] = want[d, k] = now
    got = chunking.heading_context(spark.createDataFrame(heads, "d int, k int, name string"), "d", "k", "name").collect()
    assert {(r.d, r.k): r.context for r in got} == want


def test_no_line_is_read_again_for_each_heading(spark):
    found = chunking.sections(spark.createDataFrame([(1, "# Results\na"), (2, "no heading"), (3, None)], "id int, text string"), "id", "text")
    assert [tuple(r) for r in found.collect()] == [(1, 0, "Results", 0, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("abstract|keywords?") == 3  # one test, one name, which is named twice


def test_headings_of_any_length(spark):
    long = "Electroencephalographically " * 5
    text = f"# {long}\na\n## Results\n" + "\n".join(f"{k} Title Of It" for k in range(1, 5))
    found = chunking.sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("place").collect()
    assert [(r.section.split()[0], r.first_line, r.last_line) for r in found] == [("Electroencephalographically", 0, 1), ("Results", 2, 2), *(("Title", k, k) for k in range(3, 7))]
