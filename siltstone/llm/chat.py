"""Chat formatting by schema fingerprints (native: DataFrame functions only).

Records are JSON texts of any known layout. The nested field paths of a record are hashed; the hash
selects a declarative mapping, which turns the record into canonical turns (role, text). Long texts needn't
go through JSON: a record may be a skeleton, whose values are numbers of turns that stand beside it
(``pack_records`` makes such ones, ``said`` names their column). Turns are then written with a template that marks each turn and escapes its control characters reversibly;
the loss mask lists the spans of the assistant's texts in code points.

Template of a turn: ``<turn:ROLE>TEXT</turn>`` and a line feed. In role and text ``\\`` becomes
``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``; so neither can hold a marker.

Defined cases: a null text or role is the empty string; a record whose fingerprint is unknown, or
which isn't JSON, has a null layout and no turns; one that is too long for the parser is an error, and so is a
skeleton that can't be parsed; turns with equal numbers are ordered by role and text, a null number first;
repeated turns are all kept; rows with a null id form one conversation; empty tables give empty tables;
columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
#: Characters that the JSON parser takes in one text value; shorter records can't exceed a variant's bytes either.
PARSED_CHARS = 20_000_000


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: a list of messages at ``items``, or one field for each turn in ``fields``."""

    name: str
    paths: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.md5(",".join(sorted(self.paths)).encode()).hexdigest()


_SHAREGPT = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[]", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("no messages", ("messages[]",), "messages", "role", "content"),
    Mapping("dialogue", ("conversations[]", "conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=_SHAREGPT),
    Mapping("prompt", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("input", "instruction", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("short instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
)


def field_paths(variant: Column) -> Column:
    """Sorted nested field paths of a variant, two levels deep: ``a``, ``a[]``, ``a[].b`` and ``a.b``."""
    schema = F.schema_of_variant(variant)
    flat = F.regexp_replace(schema, r"\b(?:BIGINT|STRING|VOID|DOUBLE|BOOLEAN|FLOAT|DATE|TIMESTAMP(?:_NTZ)?|BINARY|VARIANT|DECIMAL\(\d+,\s*\d+\))\b(?=[,>]|$)", "")
    top = F.regexp_extract(flat, r"(?s)^OBJECT<(.*)>$", 1)
    fields = F.regexp_extract_all(top, F.lit(r"(\w+): (ARRAY<OBJECT<[^<>]*>>|ARRAY<[^<>]*>|OBJECT<[^<>]*>)?"), 0)

    def paths(entry: Column) -> Column:
        name = F.substring_index(entry, ":", 1)
        inner = F.regexp_extract_all(F.regexp_extract(entry, r"OBJECT<([^<>]*)>", 1), F.lit(r"(\w+):"), 1)
        mark = F.when(entry.contains("ARRAY<"), F.concat(name, F.lit("[]"))).otherwise(name)
        return F.concat(F.array(mark), F.transform(inner, lambda x: F.concat(mark, F.lit("."), x)))

    return F.array_sort(F.flatten(F.transform(fields, paths)))


def fingerprint(variant: Column) -> Column:
    return F.md5(F.array_join(field_paths(variant), ",").cast("binary"))


def _turns(variant: Column, m: Mapping, said: Column | None) -> Column:
    """Turns of a record by its mapping; with ``said``, values are numbers of that column's turns."""

    def value(got: Column, part: str) -> Column:
        return F.coalesce(got if said is None else F.get(said, got.cast("int"))[part], F.lit(""))

    if m.fields:
        parts = [F.struct(F.lit(role).alias("role"), value(F.try_variant_get(variant, f"$.{field}", "string"), "text").alias("text")) for role, field in m.fields]
        return F.array(*parts)
    got = F.try_variant_get(variant, f"$.{m.items}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>")

    def turn(x: Column) -> Column:
        theirs = value(x[m.role], "role")
        role = theirs
        for name, ours in m.roles:
            role = F.when(theirs == name, F.lit(ours)).otherwise(role)
        return F.struct(role.alias("role"), value(x[m.text], "text").alias("text"))

    return F.transform(got, turn)


def canonical_turns(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS, said: str | None = None) -> DataFrame:
    """``df`` with ``layout`` (name of the mapping or null) and ``turns`` (array of role and text).

    ``said`` names an array of role and text beside records that are skeletons, as ``pack_records`` makes them.
    """
    kept = df.drop("layout", "turns").withColumn("_silt_variant", F.try_parse_json(F.col(record)))
    kept = kept.withColumn("_silt_print", fingerprint(F.col("_silt_variant")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for m in mappings:
        hit = F.col("_silt_print") == m.fingerprint
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, _turns(F.col("_silt_variant"), m, F.col(said) if said else None)).otherwise(turns)
    unread = F.col(record).isNotNull() & F.col("_silt_variant").isNull()
    if not said:
        unread = unread & (F.length(record) > PARSED_CHARS)
    error = F.raise_error(F.concat(F.lit("A record can't be parsed, or is too long for it; its characters: "), F.length(record).cast("string")))
    layout, turns = F.when(unread, error.cast("string")).otherwise(layout), F.when(unread, error.cast(f"array<{TURN}>")).otherwise(turns)
    return kept.withColumn("layout", layout).withColumn("turns", F.coalesce(turns, F.array().cast(f"array<{TURN}>"))).drop("_silt_variant", "_silt_print")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_turns(df: DataFrame, learned: str = "assistant") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans`` (start, length in code points of ``learned``'s escaped texts)."""
    marked = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned).alias("learn")))
    out = df.withColumn("_silt_marked", marked)
    out = out.withColumn("formatted", F.array_join(F.transform("_silt_marked", lambda t: F.concat(t["head"], t["body"], F.lit("</turn>\n"))), ""))
    state = "struct<at:long,spans:array<struct<start:long,length:long>>>"

    def step(acc: Column, t: Column) -> Column:
        start, size = acc["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len("</turn>\n")).alias("at"), F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(state)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")).cast(state)
    return out.withColumn("loss_spans", F.aggregate("_silt_marked", start, step, lambda acc: acc["spans"])).drop("_silt_marked")


def parse_formatted(formatted: Column) -> Column:
    """Turns read back from the formatted text: the inverse of ``format_turns``."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, r"(?s)^<turn:([^>]*)>", 1)).alias("role"), unescape(F.regexp_replace(p, r"(?s)^<turn:[^>]*>", "")).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def pack_records(rows: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) as one record a conversation, in the layout that fits its roles.

    ``record`` is a skeleton in JSON, whose values are numbers of the turns in ``said`` (role and text).
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    role = lambda k: F.get("ts", F.lit(k))["role"]
    n = F.size("ts")
    messages = F.to_json(F.struct(F.transform("ts", lambda t, k: F.struct(k.cast("string").alias("role"), k.cast("string").alias("content"))).alias("messages")))
    record = F.when((n == 2) & (role(0) == "user") & (role(1) == "assistant"), F.lit('{"prompt":"0","response":"1"}'))
    record = record.when((n == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant"), F.lit('{"instruction":"0","input":"1","output":"2"}'))
    said = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return packed.select("conv_id", record.otherwise(messages).alias("record"), said.alias("said"))
