"""Chat formatting of heterogeneous records, by schema fingerprinting.

A record is one JSON value in any known layout. Its fingerprint is a hash of its nested field paths: the shape that Spark
infers for the parsed value, without leaf types and without scalar fields that no layout knows. The fingerprint selects a
declarative mapping (how to read the turns), which turns the record into canonical ``(role, text)`` turns; these are
formatted under one template and read back from it.

Template: ``<|im_start|>role\n text <|im_end|>\n`` per turn. Inside roles and texts, ``<``, any backslashes and ``|`` get
one more backslash between them, so no text can hold a control string, and taking one away restores it exactly.

Defined results: null or missing texts and roles are empty; a record without turns formats as the empty text; a record
whose fingerprint is unknown, a null and a malformed record have a null ``layout`` and no turns; line breaks in a role
become blanks; equal records get equal results; a record is one row, however long: its texts are left out before its shape
is taken, so the limits of the JSON parser and of variants do not bound them, and a record that is still too large for these
is an error and not lost (a row itself holds less than 2 GiB); other columns pass through, but the
names ``layout, fingerprint, turns, formatted, loss_spans`` are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.tables import let, once

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"

NEW = ["fingerprint", "layout", "turns", "formatted", "loss_spans"]

# Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

# (layout, list field, role field, text field): a list of turns.
LISTS = [
    ("messages", "messages", "role", "content"),
    ("messages_text", "messages", "role", "text"),
    ("conversations", "conversations", "from", "value"),
    ("dialog", "dialog", "speaker", "text"),
    ("turns", "turns", "role", "text"),
]
# (layout, [(role, fields joined by a blank line)]): one field or two per turn.
FIELDS = [
    ("prompt_completion", [("user", ["prompt"]), ("assistant", ["completion"])]),
    ("prompt_response", [("user", ["prompt"]), ("assistant", ["response"])]),
    ("instruction_output", [("user", ["instruction"]), ("assistant", ["output"])]),
    ("instruction_input_output", [("user", ["instruction", "input"]), ("assistant", ["output"])]),
    ("instruction_response", [("user", ["instruction"]), ("assistant", ["response"])]),
    ("question_answer", [("user", ["question"]), ("assistant", ["answer"])]),
]
KNOWN = sorted({n for _, *names in LISTS for n in names} | {n for _, turns in FIELDS for _, names in turns for n in names} | {"system"})

LEAF = r"(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|UUID|VARIANT|DECIMAL\(\d+,\d+\))"


# What a well-formed JSON string holds; anything else is left for the parser to refuse.
SIGNS = r"""(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"""
# A variant holds 128 MiB, and fewer signs than this never fill it. Jackson's limit for one text, raised to what Spark holds.
ROOM, READ = 16_000_000, {"maxStringLen": "2147483647"}


def outline(record: Column) -> Column:
    """The record with its texts emptied and equal neighbours in lists merged; its shape is the same."""
    bare = F.regexp_replace(record, rf'("{SIGNS}"\s*+:)|("){SIGNS}(")', "$1$2$3")
    return F.regexp_replace(bare, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def _schema(record: Column) -> Column:
    parsed = F.schema_of_variant(F.try_parse_json(record))
    lost = parsed.isNull() & (F.length(record) > ROOM) & record.rlike(r"^\s*+\{") & record.rlike(r"\}\s*$")
    return F.when(lost, F.raise_error(F.lit("RECORD_TOO_LARGE: the outline of a chat record exceeds what a variant holds.")).cast("string")).otherwise(parsed)


def shape(record: Column) -> Column:
    """The nested field paths of a JSON record as text, names sorted; null when it is not JSON."""
    full = let(outline(record), _schema)
    full = F.regexp_replace(full, rf"(?<=[<,] ?)(?!(?:{'|'.join(KNOWN)}): )(?:\w+|`[^`]*`): {LEAF}(?:, |(?=>))", "")
    full = F.regexp_replace(full, r", >", ">")
    return F.regexp_replace(F.regexp_replace(full, rf": {LEAF}(?=[,>])", ""), rf"ARRAY<{LEAF}>", "ARRAY")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


def _object(names: list[str]) -> str:
    return "OBJECT<" + ", ".join(sorted(names)) + ">"


def layouts() -> list[tuple[str, str, str, object]]:
    """``(layout, shape, schema to read, column of turns from the read struct)``, with and without a system text."""
    out = []
    for system in (False, True):
        extra, ddl = (["system"], ", system string") if system else ([], "")

        def lead(c: Column, turns: Column, system: bool = system) -> Column:
            return F.concat(F.array(turn(F.lit("system"), c["system"])), turns) if system else turns

        for name, field, role, text in LISTS:
            def read(c: Column, field: str = field, role: str = role, text: str = text) -> Column:
                return F.coalesce(F.transform(c[field], lambda m: turn(m[role], m[text])), F.array().cast(TURNS))

            schema = f"`{field}` array<struct<`{role}`:string,`{text}`:string>>{ddl}"
            for paths in (f": ARRAY<{_object([role, text])}>", ": ARRAY"):
                out.append((name, _object([field + paths, *extra]), schema, lambda c, r=read, a=lead: a(c, r(c))))
        for name, pairs in FIELDS:
            def pick(c: Column, pairs: list = pairs) -> Column:
                return F.array(*[turn(F.lit(role), F.array_join(F.filter(
                    F.array(*[c[n] for n in names]), lambda v: v.isNotNull() & (v != "")), "\n\n")) for role, names in pairs])

            names = [n for _, fields in pairs for n in fields]
            schema = ", ".join(f"`{n}` string" for n in names) + ddl
            out.append((name, _object([*names, *extra]), schema, lambda c, p=pick, a=lead: a(c, p(c))))
    return out


def turn(role: Column, text: Column) -> Column:
    role = F.regexp_replace(F.coalesce(role, F.lit("")), r"[\r\n]", " ")
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _canonical(turns: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.transform(turns, lambda t: F.struct(
        F.coalesce(F.try_element_at(names, F.lower(t["role"])), t["role"]).alias("role"), t["text"].alias("text")))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def to_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and the canonical ``turns``."""
    marked = once(df, fingerprint=fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for name, paths, schema, read in reversed(layouts()):
        here = F.col("fingerprint") == F.xxhash64(F.lit(paths))
        layout = F.when(here, F.lit(name)).otherwise(layout)
        turns = F.when(here, read(F.from_json(F.col(record), schema, READ))).otherwise(turns)
    return once(marked, layout=layout, turns=_canonical(turns))


def render(df: DataFrame) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``: 1-based start and length, in code points, of each assistant text."""
    whole = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (F.lower(t["role"]) == "assistant").alias("loss")))
    tail = CLOSE + "\n"
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin, size = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("bigint")
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size + len(tail)).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    parts = once(df, __parts=whole)
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return once(parts, formatted=text, loss_spans=F.aggregate("__parts", start, step)["spans"]).drop("__parts")


def format_chats(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with ``fingerprint, layout, turns, formatted, loss_spans``."""
    kept = df.select(*[c for c in df.columns if c.lower() not in NEW or c == record])
    return render(to_turns(kept, record))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")

    def parse(p: Column) -> Column:
        head = F.instr(p, "\n")
        body = F.substring(p, head + 1, F.length(p) - head - len(CLOSE) - 1)
        return F.struct(unescape(F.substring(p, F.lit(1), head - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, parse)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def records_from_turns(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """Rows by turn as one ``{"messages": [{"role", "content"}]}`` record per key."""
    message = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))
    sorted_ = F.array_sort(F.collect_list(message))
    messages = F.transform(sorted_, lambda m: F.struct(
        F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    return df.groupBy(F.col(key)).agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))
