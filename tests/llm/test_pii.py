import hashlib
import random
import time
import re

import pytest
from pyspark.sql import functions as F

from folio.llm import crf, pii
from tests.conftest import DATA

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    """Base spans by the plain patterns: (start, kind, end)."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                k == 0
                or (k == 1 and all(int(x) <= 255 for x in m[0].split(".")))
                or (k == 2 and 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0)
                or (k == 3 and 10 <= len(digits) <= 15)
            )
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(2)
    signs = [*"0123456789", *"0123456789", *".-+() @@..ab_%é😀\n", "1.2.3.4", "4111111111111111", "+1 (555) 555-0143", "a@b.c", "@", "::1", "255.0.0.1", "4111 1111 1111 1111"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(70))) for _ in range(3000)]
    return [None, "", "a@b@c.d@e.f.g", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0001.2.3.255 1.2.3.256", "9" * 20_000, "x" * 20_000 + "@y.z", "+1" * 9000, *out]


def test_base_spans_and_digests_match_brute_force(spark):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("found", F.lit("clash"))
    for r in pii.digest(pii.personal_data(df)).collect():
        want = brute(data[r.doc_id][1])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[1] == k for w in want) for k in range(4)], data[r.doc_id]
        own = [f"{KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert {*own} <= {*r.spans.split(",")} or not own


def test_on_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.digest(pii.personal_data(docs)).collect()
    for r in rows:
        own = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(text[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 5


@pytest.mark.parametrize(
    "text,want",
    [
        ("Please call (212) 555-0123 today", ["phone:12:26"]),
        ("her mail is zoe [at] post [dot] org, I think", ["email:12:35"]),
        ("server 10.1.2.3 and bob@example.org", ["ip:7:15", "email:20:35"]),
        ("version 2.0 of 1999, order 7536784127813053, pages 11-19", []),
        ("The cat sat at home. Dot and at.", []),
    ],
)
def test_the_field_adds_what_patterns_miss(spark, text, want):
    (row,) = pii.digest(pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert [x for x in row.spans.split(",") if x] == want


def test_viterbi_matches_exhaustive_search():
    import itertools

    field = crf.trained()
    words = ["call", "(212)", "555-0123", "x"]
    row = field.row(words)
    (path,) = field.decode([words])
    score = lambda p: sum(row[t, k] for t, k in enumerate(p)) + field.move[-1, p[0]] + sum(field.move[a, b] for a, b in zip(p[:-1], p[1:]))
    best = max(itertools.product(range(len(crf.LABELS)), repeat=len(words)), key=score)
    assert tuple(path) == best
    longer = ["a", "call", "(212)", "555-0123"]
    assert [x.tolist() for x in field.decode([words, longer, words[:1]])] == [x.tolist() for s in (words, longer, words[:1]) for x in field.decode([s])]


def test_recall_of_added_spans_on_planted_forms(spark):
    """Forms that no pattern knows, with digits and names that the labelled table does not hold, among other numbers."""
    rng = random.Random(31)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    forms = {
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)} {digits(4)}"],
        "email": [lambda: f"{name()} [at] {name()} [dot] org", lambda: f"{name()} (at) {name()} (dot) net", lambda: f"{name()} [at] {name()} [dot] com"],
    }
    noise = ["in 1998", "version 2.1", "pages 11-19", "of 25 people", "at 10:30", "room 12", "3.5 of 7", "on 12/05/2001"]
    docs, want = [], {}
    for i in range(600):
        kind = rng.choice([*forms])
        planted = rng.choice(forms[kind])()
        before = f"the {name()} {rng.choice(noise)} {name()} {rng.choice(['call', 'write to', 'ask', 'see'])}"
        docs.append((i, f"{before} {planted} {name()} and {name()} {rng.choice(noise)}"))
        want[i] = (kind, len(before) + 1, len(before) + 1 + len(planted))
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found if not x.base] for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hit = sum(any(k == want[i][0] and a < want[i][2] and want[i][1] < b for k, a, b in got[i]) for i in got)
    extra = sum(not (a < want[i][2] and want[i][1] < b) for i in got for _, a, b in got[i])
    print(f"recall {hit / len(docs):.3f}, spans elsewhere {extra / len(docs):.3f} a document")
    assert hit >= 0.9 * len(docs) and extra <= 0.1 * len(docs)


def test_recall_on_shapes_and_words_that_were_not_trained(spark):
    """Other digits, names, neighbours and some other forms; what looks alike but is none must stay."""
    rng = random.Random(77)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    forms = [
        lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"({digits(3)}){digits(3)}-{digits(4)}", lambda: f"00{rng.randrange(30, 50)} {digits(2)} {digits(4)} {digits(4)}",
        lambda: f"{name()} at {name()} dot com", lambda: f"{name()}(at){name()}(dot)org", lambda: f"{name()} at {name()} dot {name()} dot net", lambda: f"{digits(3)} {digits(3)} {digits(4)}",
        lambda: f"({digits(3)}) {digits(3)}.{digits(4)}", lambda: f"{digits(3)}/{digits(3)}-{digits(4)}",  # in no line of the table
    ]
    decoys = [lambda: f"figure ({digits(3)}) {digits(3)}", lambda: f"order number {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"looked at the {name()} dot there", lambda: f"page {digits(3)} of {digits(3)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(3)},{digits(3)}"]
    docs, want = [], {}
    for i in range(900):
        planted = forms[i % len(forms)]()
        before = f"the {name()} {rng.choice(decoys)()} {name()} {name()} {rng.choice(['reach', 'try', 'see', 'so', 'is', 'ask'])}"
        docs.append((i, f"{before} {planted} {name()} and {name()} {rng.choice(decoys)()}."))
        want[i] = (len(before) + 1, len(before) + 1 + len(planted))
    got = {r.doc_id: [(x.start, x.end) for x in r.found] for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hit = [any(a < want[i][1] and want[i][0] < b for a, b in got[i]) for i in range(len(docs))]
    by_form = [sum(hit[k :: len(forms)]) / len(hit[k :: len(forms)]) for k in range(len(forms))]
    extra = sum(not (a < want[i][1] and want[i][0] < b) for i in got for a, b in got[i]) / len(docs)
    print(f"recall {sum(hit) / len(docs):.3f} {by_form}, spans elsewhere {extra:.3f} a document")
    assert sum(hit) >= 0.9 * len(docs) and extra <= 0.1


def test_many_spans_in_one_text_are_compared_once(spark):
    text = " ".join(f"a{i}@b.org and (212) 555-{i % 10000:04d} or" for i in range(50_000))
    began = time.monotonic()
    (row,) = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(x.base for x in row.found) == 50_000 and len(row.found) > 95_000
    assert time.monotonic() - began < 120
    known = [(2, 0, 9), (3, 1, 4), (12, 0, 14)]
    assert pii.apart([(0, 3, 2), (5, 3, 6), (9, 3, 12), (8, 3, 10), (13, 3, 20), (14, 3, 15)], known) == [(0, 3, 2), (9, 3, 12), (14, 3, 15)]


def test_pieces_of_a_long_sequence_are_labelled_as_a_whole(monkeypatch):
    field = crf.trained()
    rng = random.Random(8)
    vocab = ["call", "(212)", "555-0123", "bob", "[at]", "mail", "[dot]", "org", "7", "1990", "4111", "1111", "the", "x9", "+44", "20", "7946", "0958"]
    for n in (2, 70, 5000):
        words = [rng.choice(vocab) for _ in range(n)]
        (whole,) = field.viterbi([field.row(words)])
        monkeypatch.setattr(crf, "PIECE", 200)
        (cut,) = field.decode([words])
        monkeypatch.undo()
        assert cut.tolist() == whole.tolist() and (n < 70 or cut.any())


def test_a_long_text_of_numbers(spark):
    """Many short sequences and one of 250,000 words are decoded in bounded blocks."""
    text = "1 " * 250_000 + " ".join(f"{'plain words ' * 8}{k}" for k in range(2000)) + " call (212) 555-0123 " + "9" * 300 + "@" + "x" * 300 + ".org"
    (row,) = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    found = {(x.kind, text[x.start : x.end]) for x in row.found}
    assert {("phone", "(212) 555-0123"), ("email", "9" * 300 + "@" + "x" * 300 + ".org")} <= found


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
