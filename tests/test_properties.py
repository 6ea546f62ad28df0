"""Text functions against plain Python, on seeded random texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vx

BLANKS = " \t\n\r\f\x0b"


def texts():
    rng = random.Random(11)
    signs = [*"abcXYZ 019 .,;:!?-_/%()[]*`#|\n\t", "  ", "é", "ß", "ñ", " ", "😀", "token", " of ", "1,794", "51.7%", "100", "www.", "\r\n"]
    return ["", " ", "\n\n\n", "  a  b  ", *("".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(400))]


def words(t):
    return [w for w in re.split(rf"[{BLANKS}]+", t) if w]


def compact(t, most_words=10, most_chars=120):
    s = " ".join(words(t)[:most_words])
    return s[: most_chars - 1].rstrip(" ") if len(s) > most_chars else s


def normal(t):
    t = re.sub("[ \t]+", " ", re.sub("\r\n?", "\n", t.replace("\x00", "")))
    return re.sub("\n{3,}", "\n\n", t).strip(BLANKS)


def claims(t):
    special = [m[0] for p in (r"\b[0-9]+(?:\.[0-9]+)?[ ]*%", r"(?i)\b[0-9][0-9,]*[ ]*tokens?\b", r"(?i)\b[0-9]+[ ]+of[ ]+[0-9]+\b") for m in re.finditer(p, t)]
    numbers = [m[0] for m in re.finditer(r"\b[0-9][0-9,]*(?:\.[0-9]+)?\b", t)]
    return sorted([*special, *{n for n in numbers if len(n.replace(",", "").rstrip(".0")) >= 3 and n not in special}])


def density(t):
    own = [x for x in t.split("\n") if x.strip(BLANKS)]
    if not t:
        return 0.0
    if len(t) < 200:
        return 0.2
    return 0.3 if len(own) < 4 else 0.4 if sum(map(len, own)) / len(own) < 10 else 1.0


def alpha(t):
    full = re.sub(f"[{BLANKS}]", "", t)
    return len(re.findall("[A-Za-z]", full)) / len(full) if full else 0.0


CASES = {
    "tokens": (lambda c: F.array_sort(tx.tokens(c)), lambda t: sorted({m.lower() for m in re.findall("[a-z0-9][a-z0-9_-]*", t.lower())})),
    "words": (tx.words, words),
    "squeeze": (tx.squeeze, lambda t: " ".join(words(t))),
    "compact": (tx.compact_label, compact),
    "truncated": (lambda c: tx.truncated(c, 20), lambda t: t if len(t) <= 20 else t[:19] + "…"),
    "normal": (tx.normal_space, normal),
    "slug": (lambda c: tx.slug(c, 30), lambda t: re.sub("[^a-z0-9]+", "_", t.lower()).strip("_")[:30]),
    "claims": (lambda c: F.array_sort(tx.numeric_claims(c)), claims),
    "density": (tx.density, density),
    "alpha": (lambda c: F.round(tx.alpha_ratio(c), 9), lambda t: round(alpha(t), 9)),
    "estimate": (vx.token_estimate, lambda t: max(1, len(t) // 3)),
    "head_and_tail": (lambda c: tx.head_and_tail(c, 40), lambda t: t if len(t) <= 40 else t[:20] + "\n...\n" + t[-20:]),
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id int, text string").repartition(4).cache()


@pytest.mark.parametrize("name", sorted(CASES))
def test_matches_python(frame, name):
    column, plain = CASES[name]
    got = {r.id: r.x for r in frame.select("id", column(F.col("text")).alias("x")).collect()}
    for i, t in enumerate(texts()):
        assert got[i] == plain(t), t


@pytest.mark.parametrize("name", ["tokens", "words", "squeeze", "compact", "truncated", "normal", "slug", "claims", "head_and_tail"])
def test_null_stays_null(spark, name):
    column, _ = CASES[name]
    assert spark.range(1).select(column(F.lit(None).cast("string")).alias("x")).first().x is None


def test_keyword_score_by_definition(frame):
    query = {"token", "a", "of"}
    got = {r.id: r.x for r in frame.select("id", vx.keyword_score(F.array(*map(F.lit, sorted(query))), tx.tokens(F.col("text"))).alias("x")).collect()}
    for i, t in enumerate(texts()):
        own = {m.lower() for m in re.findall("[a-z0-9][a-z0-9_-]*", t.lower())}
        want = len(own & query) / math.sqrt(len(query) * len(own)) if own else 0.0
        assert math.isclose(got[i], want)
