"""Column builders over numbers, vectors, dates, JSON and typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    length = norm(vector)
    return F.when(length > 0, F.transform(doubles(vector), lambda x: x / length)).otherwise(doubles(vector))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def fitted(vector: Column, size: int) -> Column:
    """Cut or padded with zeros to `size`."""
    return F.slice(F.concat(doubles(vector), F.array_repeat(F.lit(0.0), size)), 1, size)


#: What a chunk's content type adds to its score.
BOOSTS = {"abstract": 0.08, "method": 0.08, "results": 0.12, "limitation": 0.16, "table": 0.1, "figure_caption": 0.08}


def keyword_score(query: Column, text: Column) -> Column:
    """Shared tokens over the geometric mean of both token counts."""
    both = F.size(F.array_intersect(query, text)).cast("double")
    return F.coalesce(F.try_divide(both, F.sqrt(F.size(query) * F.size(text).cast("double"))), F.lit(0.0))


def blended(keyword: Column, vector: Column, kind: Column) -> Column:
    boost = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BOOSTS.items() for x in kv)), kind), F.lit(0.0))
    return keyword * 0.45 + F.coalesce(vector, F.lit(0.0)) * 0.55 + boost


#: US dollars for a million input and output tokens of each model.
PRICES = {
    "claude-sonnet-4-5": (3.00, 15.00),
    "claude-haiku-3-5": (0.80, 4.00),
    "claude-opus-4-5": (15.00, 75.00),
    "deepseek-chat": (0.27, 1.10),
    "deepseek-reasoner": (0.55, 2.19),
    "gpt-4o": (5.00, 15.00),
    "gpt-4o-mini": (0.15, 0.60),
    "mimo-v2.5": (0.435, 0.87),
    "mimo-v2.5-pro": (0.435, 0.87),
    "mimo-v2.5-lite": (0.15, 0.30),
    "text-embedding-3-small": (0.02, 0.0),
}


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a call; the provider's prefix of a model name is ignored, unknown models cost nothing."""
    key = F.element_at(F.split(model, "/"), -1)
    price = lambda i: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in PRICES.items() for x in (k, v[i]))), key), F.lit(0.0))
    return (tokens_in * price(0) + tokens_out * price(1)) / 1_000_000


def token_estimate(text: Column, chars: int = 3) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars)).cast("long")


def json_number(document: Column, path: str) -> Column:
    return F.get_json_object(document, path).try_cast("double")


def as_number(raw: Column) -> Column:
    return raw.try_cast("double")


def as_boolean(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def as_choice(raw: Column, allowed: list[str]) -> Column:
    """The allowed value that equals the raw one without regard to case, as it is spelt in the list."""
    out = F.when(F.lit(False), F.lit(""))
    for value in allowed:
        out = out.when(F.lower(F.trim(raw)) == value.lower(), F.lit(value))
    return out


def as_choices(raw: Column, allowed: list[str]) -> Column:
    parts = F.transform(F.split(raw, "[,;]"), lambda x: as_choice(x, allowed))
    return F.filter(parts, lambda x: x.isNotNull())


def missing(value: Column) -> Column:
    return value.isNull() | (value == "") | (value == "[]")


def typed_predicate(field: Column, op: str, value) -> Column:
    """A filter on a semi-structured field.  Nulls match `eq` null alone; comparisons read both sides as numbers."""
    if value is None and op in ("eq", "neq"):
        return field.isNull() if op == "eq" else field.isNotNull()
    number = field.try_cast("double")
    tests = {
        "eq": lambda: field == F.lit(str(value)),
        "neq": lambda: field != F.lit(str(value)),
        "contains": lambda: field.contains(str(value)),
        "in": lambda: field.isin(*map(str, value)),
        "gt": lambda: number > float(value),
        "gte": lambda: number >= float(value),
        "lt": lambda: number < float(value),
        "lte": lambda: number <= float(value),
    }
    if op not in tests:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(tests[op](), F.lit(False))


def json_schema(fields: DataFrame, key: str) -> DataFrame:
    """key, schema: the JSON Schema of each set of typed fields (key, name, kind, options); every value but a list may be null."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    options = F.array_join(F.transform("options", quoted), ",")
    one = F.when(F.col("kind") == "multi_select", F.concat(F.lit('{"type":"array","items":{"type":"string","enum":['), options, F.lit("]}}")))
    for kind, name in (("number", "number"), ("boolean", "boolean")):
        one = one.when(F.col("kind") == kind, F.lit(f'{{"type":["{name}","null"]}}'))
    one = one.when(F.col("kind") == "enum", F.concat(F.lit('{"type":["string","null"],"enum":['), options, F.lit(",null]}"))).otherwise(F.lit('{"type":["string","null"]}'))
    listed = fields.select(key, F.struct(quoted(F.col("name")).alias("name"), one.alias("one")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    properties = F.array_join(F.transform("x", lambda x: F.concat(x["name"], F.lit(":"), x["one"])), ",")
    return listed.select(key, F.concat(F.lit('{"type":"object","properties":{'), properties, F.lit('},"required":['), F.array_join(F.col("x.name"), ","), F.lit('],"additionalProperties":false}')).alias("schema"))


def lower_confidence(primary: Column, verified: Column) -> Column:
    """The lower of two stated confidences; words that are none count as medium, and the first one stays if both are alike."""
    rank = lambda c: F.when(c == "high", 0).when(c == "low", 2).otherwise(1)
    return F.when(rank(verified) > rank(primary), verified).otherwise(primary)


def distinct_first(values: Column) -> Column:
    """Values without those that stand earlier in another spelling; order and first spellings stay."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
