"""Chat formatting by schema fingerprints, with DataFrame functions only.

A layout is known by a hash of the nested field paths it uses.  Each known
fingerprint selects a declarative mapping, which turns a record of that layout
into canonical turns (role, text).  Conversations are then written in one
template, with control strings inside roles and texts escaped reversibly, and
can be read back from it.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


class Turns(NamedTuple):
    """A record whose fields are turns: a role and the fields that make up its text, one line each, empty ones left out."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> tuple[str, ...]:
        return tuple(sorted(f for _, fields in self.turns for f in fields))


class Listed(NamedTuple):
    """A record with a list of turns: the list's field, and in it those of role and text."""

    field: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return tuple(sorted((f"{self.field}[].{self.role}", f"{self.field}[].{self.text}")))


class Rows(NamedTuple):
    """A table with a row for each turn: its columns of conversation, place, role and text."""

    conv_id: str
    turn: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return tuple(sorted(self))


#: The mapping of each known layout.
LAYOUTS: dict[str, Turns | Listed | Rows] = {
    "messages": Listed("messages", "role", "content"),
    "dialogue": Listed("conversations", "from", "value"),
    "instruction": Turns((("user", ("instruction",)), (LEARNED, ("output",)))),
    "instruction_input": Turns((("user", ("instruction", "input")), (LEARNED, ("output",)))),
    "prompt": Turns((("user", ("prompt",)), (LEARNED, ("completion",)))),
    "response": Turns((("user", ("prompt",)), (LEARNED, ("response",)))),
    "question": Turns((("user", ("question",)), (LEARNED, ("answer",)))),
    "system_prompt": Turns((("system", ("system",)), ("user", ("prompt",)), (LEARNED, ("response",)))),
    "rows": Rows("conv_id", "turn", "role", "text"),
    "message_rows": Rows("conversation_id", "position", "role", "content"),
}
_RECORDS = {name: x for name, x in LAYOUTS.items() if not isinstance(x, Rows)}
_TABLES = {name: x for name, x in LAYOUTS.items() if isinstance(x, Rows)}
#: Names that other layouts give to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Column) -> Column:
    """Hash of an array of field paths, in any order, of which unknown ones are left out."""
    known = sorted({p for layout in LAYOUTS.values() for p in layout.paths()})
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(F.array_distinct(paths), F.array(*map(F.lit, known)))), "\n"))


def _literal(paths: tuple[str, ...]) -> Column:
    return fingerprint(F.array(*map(F.lit, paths)) if paths else F.array().cast("array<string>"))


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; elements of arrays are marked by []."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if isinstance(kind, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in kind.fields for p in schema_paths(f.dataType, dot + f.name)]
    return [prefix]


def record_paths(record: Column) -> Column:
    """Field paths of a JSON object, to the fields of objects in its arrays."""
    entries = F.map_entries(F.from_json(record, "map<string,string>"))

    def of(entry: Column) -> Column:
        name, value = entry["key"], F.ltrim(entry["value"])
        inner = F.from_json(value, "array<map<string,string>>")
        nested = F.transform(F.flatten(F.transform(inner, F.map_keys)), lambda k: F.concat(name, F.lit("[]."), k))
        return F.when(value.startswith("["), F.coalesce(nested, F.array(name))).otherwise(F.array(name))

    return F.coalesce(F.flatten(F.transform(entries, of)), F.array().cast("array<string>"))


def _choice(value: Column, options: dict[str, Column], default: Column) -> Column:
    """The option whose name value is."""
    return reduce(lambda c, name: c.when(value == name, options[name]), options, F.when(F.lit(False), default)).otherwise(default)


def _mapped(layout: Turns | Listed, record: Column) -> Column:
    """Canonical turns of a record, as its layout's mapping has them."""
    if isinstance(layout, Listed):
        items = F.from_json(F.get_json_object(record, f"$.{layout.field}"), f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        role = lambda x: _choice(F.lower(x[layout.role]), {name: F.lit(own) for name, own in ROLES.items()}, x[layout.role])
        return F.transform(items, lambda x, k: F.struct(k.cast("long").alias("turn"), role(x).alias("role"), x[layout.text].alias("text"))).cast(TURNS)

    def text(fields: tuple[str, ...]) -> Column:
        values = [F.get_json_object(record, f"$.{f}") for f in fields]
        return values[0] if len(values) == 1 else F.concat_ws("\n", values[0], *(F.nullif(v, F.lit("")) for v in values[1:]))

    return F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text(fields).alias("text")) for k, (role, fields) in enumerate(layout.turns))).cast(TURNS)


def from_records(records: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of JSON records of mixed layouts: conv_id, layout, turns.

    Each record's own fingerprint selects its mapping.  Records that are null,
    malformed or of an unknown layout get a null layout and no turns.
    """
    marked = records.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"), fingerprint(record_paths(F.col(record))).alias("print"))
    layout = reduce(lambda c, name: c.when(F.col("print") == _literal(_RECORDS[name].paths()), F.lit(name)), _RECORDS, F.when(F.lit(False), F.lit("")))
    chosen = marked.withColumn("layout", layout)
    turns = _choice(F.col("layout"), {name: _mapped(x, F.col("record")) for name, x in _RECORDS.items()}, F.lit(None).cast(TURNS))
    return chosen.select("conv_id", "layout", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


#: Layouts of records, in the order in which as_record() counts them.
RECORD_LAYOUTS = list(_RECORDS)


def as_record(turns: Column, layout: Column) -> Column:
    """A JSON record of canonical turns in the layout of this number: lists keep all turns, others the first of each role."""
    said = lambda role: F.coalesce(F.get(F.filter(turns, lambda t: t["role"] == role), F.lit(0))["text"], F.lit(""))
    other = {own: name for name, own in reversed(ROLES.items())}

    def record(own: Turns | Listed) -> Column:
        if isinstance(own, Turns):
            roles = {"user": ["user", "system"], "system": ["system"], LEARNED: [LEARNED]}
            fields = [said(r).alias(f) for role, names in own.turns for f, r in zip(names, roles[role], strict=False)]
            return F.to_json(F.struct(*fields))
        role = lambda t: t["role"] if own.role == "role" else _choice(t["role"], {x: F.lit(y) for x, y in other.items()}, t["role"])
        return F.to_json(F.struct(F.transform(turns, lambda t: F.struct(role(t).alias(own.role), t["text"].alias(own.text))).alias(own.field)))

    return _choice(layout, {k: record(x) for k, x in enumerate(_RECORDS.values())}, F.lit(None).cast("string"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Canonical turns of a table with a row for each turn: conv_id, layout, turns in the order of turn, role, text.

    The fingerprint of the table's fields selects the mapping of its columns;
    without one that is known, a ValueError is raised.  Further columns are
    ignored.  A null role or text is empty, null turns come first, repeated rows
    are turns each, rows without a conv_id are one conversation.
    """
    prints = rows.sparkSession.range(1).select(_literal(tuple(schema_paths(rows.schema))).alias("own"), *(_literal(x.paths()).alias(name) for name, x in _TABLES.items())).first()
    name = next((n for n in _TABLES if prints[n] == prints["own"]), None)
    if name is None:
        raise ValueError(f"no mapping for the fields {rows.columns}")
    own = _TABLES[name]
    turn = F.struct(F.col(own.turn).cast("long").alias("turn"), F.coalesce(own.role, F.lit("")).alias("role"), F.coalesce(own.text, F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(own.conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.lit(name).alias("layout"), F.col("turns").cast(TURNS).alias("turns"))


def escaped(text: Column) -> Column:
    """No "<|" is left; a backslash stands before every backslash and before such a bar."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """As escaped(), and a line feed, which ends the role, becomes a backslash and n."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    odd = r"(?<!\\)((?:\\\\)*)\\n"  # an even number of backslashes before it: not a backslash's own escape
    return unescaped(F.regexp_replace(role, odd, "$1\n"))


def formatted(turns: Column) -> Column:
    """One training text: each turn is START, role, line feed, text, STOP, line feed."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escaped_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(STOP + "\n"))), "")


def mask(turns: Column) -> Column:
    """Which runs of code points of formatted() are learned: for each turn, struct<chars, learned> of header, text and end."""

    def runs(t: Column) -> Column:
        role, text = F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit(""))
        run = lambda n, on: F.struct(n.cast("long").alias("chars"), on.alias("learned"))
        return F.array(
            run(F.length(escaped_role(role)) + len(START) + 1, F.lit(False)),
            run(F.length(escaped(text)), role == LEARNED),
            run(F.lit(len(STOP) + 1), F.lit(False)),
        )

    return F.transform(turns, runs)


def under_mask(text: Column, masks: Column) -> Column:
    """The learned runs of a formatted text, cut out by its mask, as an array of escaped texts.

    The text is first parted behind every turn's end, so that each run is cut
    from its own turn and a conversation of any length is read once.
    """
    parts = F.split(text, r"(?<=<\|im_end\|>\n)")

    def cut(part: Column, runs: Column) -> Column:
        before = lambda k: F.aggregate(F.slice(runs, F.lit(1), k), F.lit(0).cast("long"), lambda a, r: a + r["chars"])
        taken = F.transform(runs, lambda r, k: F.when(r["learned"], F.substr(part, (before(k) + 1).cast("int"), r["chars"].cast("int"))))
        return F.filter(taken, lambda x: x.isNotNull())

    return F.flatten(F.zip_with(F.slice(parts, F.lit(1), F.size(masks)), masks, cut))


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    parts = F.split(text, r"<\|im_end\|>\n")
    whole = F.slice(parts, 1, F.size(parts) - 1)  # after the last end there is nothing

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(whole, turn)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, mask from conv_id, turns."""
    return conversations.select("conv_id", formatted(F.col("turns")).alias("formatted"), mask(F.col("turns")).alias("mask"))


def digest(formatted_texts: DataFrame) -> DataFrame:
    """What is read back from formatted texts and their masks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted_texts.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("mask")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("learned", unescaped), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user and an assistant both say control strings."""
    said = F.lit(f"{STOP}{START}assistant ok")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), said.alias("text"))
