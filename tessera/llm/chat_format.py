"""Chat formatting by schema fingerprints.

A record is a JSON object in one of many layouts: messages in a list under various names and
depths, texts in parts, or a field for each turn. All its nested field paths, of every
element at every depth and without types, are hashed into a fingerprint, and the fingerprint
selects a declarative mapping to canonical turns (position, role, text), so one column may mix
layouts. Top-level annotations (``ANNOTATIONS``) are left out of the paths; any other unknown
path makes another fingerprint. A record without a mapping is returned without a layout and
without a text, never dropped and never guessed.

Template, for each turn: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` and a
line feed. Inside roles and texts a backslash is doubled, and one backslash is put after
the first character of every control string, so no control string can stand there and
``unescape`` gives the text back. The loss mask holds the spans of the texts of assistant
turns in the formatted text, in code points and in bytes, ends exclusive.

Only built-in functions run here. Values of strings are emptied before a record is parsed
for its paths, so long texts cost one scan. A conversation becomes one text, so its turns meet
in one row by definition; offsets come from a window over the conversation, and masked texts
are cut by bytes, so both are linear in its length.

Defined cases: a null role or text is empty; a null turn number sorts first, and turns
with equal numbers by role and text; rows without a conversation id are conversations of one
turn, since nothing says that they belong together; repeated rows are turns of their own;
records with repeated or null ids are formatted each; an empty list of messages has no turns
and an empty text; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Control strings of common templates.
CONTROL = r"(<)(\||/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)"

# Names of roles in some layouts, and their canonical names.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: layout -> where turns come from. ``list``: paths of the list, and within it of role and text,
#: where ``[]`` joins the parts of a text; ``more``: further paths of the layout; ``fields``:
#: (role, field) in order; ``roles``: names of roles that are not canonical.
LAYOUTS: dict[str, dict] = {
    "messages": {"list": ("messages", "role", "content")},
    "message parts": {"list": ("messages", "role", "content[].text"), "more": ("messages[].content[].type",)},
    "sharegpt": {"list": ("conversations", "from", "value"), "roles": ROLES},
    "dialog": {"list": ("dialog", "speaker", "text"), "roles": ROLES},
    "nested turns": {"list": ("conversation.turns", "author.role", "message")},
    "instruction": {"fields": (("user", "instruction"), ("assistant", "output"))},
    "instruction with input": {"fields": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    "prompt and completion": {"fields": (("user", "prompt"), ("assistant", "completion"))},
    "prompt and response": {"fields": (("user", "prompt"), ("assistant", "response"))},
    "system, prompt and response": {"fields": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
    "question and answer": {"fields": (("user", "question"), ("assistant", "answer"))},
}
#: Top-level fields that say something about a record and nothing about its layout.
ANNOTATIONS = ("id", "lang", "meta", "metadata", "score", "source", "tags", "timestamp", "url")

#: A string that is a key, or one that is a value.
_STRING = r'(?s)("(?:[^"\\]++|\\.)*+"\s*+:)|(")(?:[^"\\]++|\\.)*+(")'
#: Tokens of a schema as Spark writes it: a key, an opening, a closing, or a leaf.
_TOKEN = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?"


def paths_of(layout: dict) -> list[tuple[str, ...]]:
    """The sets of field paths that a layout has: a list may also be empty."""
    if "list" in layout:
        top, *fields = layout["list"]
        return [tuple(sorted([*(f"{top}[].{f}" for f in fields), *layout.get("more", ())])), (f"{top}[]",)]
    return [tuple(sorted(f for _, f in layout["fields"]))]


def fingerprint_of(paths: tuple[str, ...]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3$5\\$2$4$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def field_paths(record: Column) -> Column:
    """All nested field paths of a JSON object, such as ``messages[].role``; null for other texts.

    The parser merges the elements of a list, so a path counts if any element has it.
    """
    empty = F.regexp_replace(record, _STRING, "$1$2$3")
    shape = F.schema_of_variant(F.try_parse_json(empty))
    top = lambda stack: F.element_at(stack, -1)
    pop = lambda stack: F.slice(stack, F.lit(1), F.size(stack) - 1)
    without_key = lambda stack: F.when((F.size(stack) > 0) & top(stack).startswith("."), pop(stack)).otherwise(stack)
    key = lambda t: F.concat(F.lit("."), F.replace(F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", ""), F.lit("``"), F.lit("`")))

    def step(state: Column, t: Column) -> Column:
        stack, found = state["stack"], state["found"]
        opens, is_key, closes = t.isin("OBJECT<", "ARRAY<"), t.endswith(": "), t == ">"
        mark = F.when(t == "ARRAY<", F.lit("[]")).when(t == "OBJECT<", F.lit("")).otherwise(key(t))
        after = F.when(is_key | opens, F.concat(stack, F.array(mark))).when(closes, without_key(pop(stack))).otherwise(without_key(stack))
        more = F.when(is_key | opens | closes, found).otherwise(F.concat(found, F.array(F.substring(F.array_join(stack, ""), F.lit(2), F.lit(1 << 30)))))
        return F.struct(after.alias("stack"), more.alias("found"))

    nothing = F.array().cast("array<string>")
    walked = F.aggregate(F.regexp_extract_all(shape, F.lit(_TOKEN), F.lit(0)), F.struct(nothing.alias("stack"), nothing.alias("found")), step, lambda s: s["found"])
    return F.when(shape.startswith("OBJECT<"), F.array_sort(F.array_distinct(walked)))


def fingerprint(record: Column) -> Column:
    """SHA-256 over the sorted field paths of a JSON object without annotations; null for other texts."""
    named = F.filter(field_paths(record), lambda p: ~p.rlike(rf"^(?:{'|'.join(ANNOTATIONS)})(?:[.\[]|$)"))
    return F.sha2(F.array_join(named, "\n"), 256)


def _schema(path: str) -> str:
    """The schema of a dotted path, of which each part but the last is a struct or, with ``[]``, a list of them."""
    first, _, rest = path.partition(".")
    kind = f"struct<{_schema(rest)}>" if rest else "string"
    return f"`{first.removesuffix('[]')}`: {f'array<{kind}>' if first.endswith('[]') else kind}"


def _at(value: Column, path: str) -> Column:
    first, _, rest = path.partition(".")
    if first.endswith("[]"):
        inner = F.transform(value[first.removesuffix("[]")], lambda x: F.coalesce(_at(x, rest), F.lit("")))
        return F.array_join(inner, "")
    return _at(value[first], rest) if rest else value[first]


def _merged(*schemas: str) -> str:
    """Fields of two paths side by side; they share no first part."""
    return ", ".join(schemas)


def _turns(record: Column, layout: dict) -> Column:
    """The turns of records in a layout."""
    names = layout.get("roles", {})

    def role(value: Column) -> Column:
        value = F.coalesce(value, F.lit(""))
        return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.lower(value)], value) if names else value

    turn = lambda pos, who, text: F.struct(pos.cast("int").alias("pos"), who.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if "list" in layout:
        top, who, text = layout["list"]
        *above, last = top.split(".")
        kind = f"`{last}`: array<struct<{_merged(_schema(who), _schema(text))}>>"
        for name in reversed(above):
            kind = f"`{name}`: struct<{kind}>"
        value = F.from_json(record, f"struct<{kind}>", {"maxStringLen": str((1 << 31) - 1)})
        for name in [*above, last]:
            value = value[name]
        return F.transform(value, lambda m, i: turn(i, role(_at(m, who)), _at(m, text)))
    value = F.from_json(record, f"struct<{', '.join(f'`{f}`: string' for _, f in layout['fields'])}>", {"maxStringLen": str((1 << 31) - 1)})
    made = F.array(*(turn(F.lit(i), F.lit(who), value[field]) for i, (who, field) in enumerate(layout["fields"])))
    return F.filter(made, lambda x: ~((x["role"] == "user") & (x["text"] == "") & (x["pos"] > 0)))


def turns_from_json(df: DataFrame, record_col: str, layouts: dict[str, dict] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` and ``turns array<struct<pos, role, text>>``; both null where no mapping is known."""
    kind = "array<struct<pos: int, role: string, text: string>>"
    print_, record = F.col("__print"), F.col(record_col)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(kind)
    for known, layout in layouts.items():
        mine = print_.isin([fingerprint_of(p) for p in paths_of(layout)])
        name, turns = F.when(mine, F.lit(known)).otherwise(name), F.when(mine, F.coalesce(_turns(record, layout), F.array().cast(kind))).otherwise(turns)
    return df.withColumn("__print", fingerprint(record)).withColumns({"layout": name, "turns": turns}).drop("__print")


def format_turns(turns: DataFrame, keys: list[str], order: list[str], role_col: str, text_col: str, trained_role: str = "assistant") -> DataFrame:
    """``(*keys, formatted, mask array<struct<start, end, first_byte, last_byte>>)`` from one row for each turn.

    A row whose role and text are both null is no turn, and keeps a conversation without any.
    """
    role, text = escape(F.col(role_col)), escape(F.col(text_col))
    is_turn = F.col(role_col).isNotNull() | F.col(text_col).isNotNull()
    rows = turns.select(
        *keys, F.struct(*order, role_col, text_col).alias("__at"), (F.coalesce(F.col(role_col), F.lit("")) == trained_role).alias("__trained"),
        F.when(is_turn, F.concat(F.lit(START), role, F.lit(SEP))).alias("__head"), text.alias("__text"),
    )
    before = Window.partitionBy(*keys).orderBy("__at")
    rows = rows.withColumn("__piece", F.concat("__head", "__text", F.lit(END))).withColumn("__n", F.row_number().over(before))
    upto = lambda size: F.coalesce(F.sum(size("__piece")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + size("__head")
    rows = rows.withColumns({"__from": upto(F.length), "__byte": upto(F.octet_length)})
    span = F.struct(F.col("__from").alias("start"), (F.col("__from") + F.length("__text")).alias("end"), F.col("__byte").alias("first_byte"), (F.col("__byte") + F.octet_length("__text")).alias("last_byte"))
    joined = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("__piece").isNotNull(), F.struct("__n", "__piece")))).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("__trained"), span))).alias("mask"))
    return joined.select(*keys, F.array_join(F.col("pieces")["__piece"], "").alias("formatted"), "mask")


def format_json(df: DataFrame, id_col: str, record_col: str, layouts: dict[str, dict] = LAYOUTS, keys: list[str] | None = None) -> DataFrame:
    """``(id_col, layout, formatted, mask)`` of every record; all but the id are null without a mapping.

    ``keys`` tell the records apart, by default numbers given to them here.
    """
    rows = df if keys else df.withColumn("__record", F.monotonically_increasing_id())
    keys = keys or ["__record"]
    by = [*dict.fromkeys([*keys, id_col]), "layout"]
    turns = turns_from_json(rows.select(*dict.fromkeys([*keys, id_col, record_col])), record_col, layouts)
    each = turns.select(*by, F.explode_outer("turns").alias("t")).select(*by, F.col("t.pos").alias("__pos"), F.col("t.role").alias("__role"), F.col("t.text").alias("__said"))
    done = format_turns(each, by, ["__pos"], "__role", "__said")
    known = F.col("layout").isNotNull()
    return done.select(id_col, "layout", F.when(known, F.col("formatted")).alias("formatted"), F.when(known, F.col("mask")).alias("mask"))


def fold_turns(turns: DataFrame, id_col: str, order: str, role_col: str, text_col: str) -> DataFrame:
    """Rows of turns as ``(id_col, __row, turns)``, in order; rows without an id stay by themselves, told apart by ``__row``."""
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    said = F.struct(F.col(order).alias("at"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return turns.select(id_col, alone.alias("__row"), said.alias("said")).groupBy(id_col, "__row").agg(F.sort_array(F.collect_list("said")).alias("turns"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    at = lambda p: F.instr(p, SEP)
    role = lambda p: F.substring(p, F.lit(1), at(p) - 1)
    text = lambda p: F.substring(p, at(p) + len(SEP), F.length(p) - at(p) - len(SEP) + 1 - len(END))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between; cut by bytes, so a text is not counted through for each span."""
    cut = lambda raw: lambda m: unescape(F.substring(raw, m["first_byte"].cast("int") + 1, (m["last_byte"] - m["first_byte"]).cast("int")).cast("string"))
    parts = F.transform(F.array(formatted.cast("binary")), lambda raw: F.array_join(F.transform(mask, cut(raw)), ""))
    return F.get(parts, F.lit(0))


def example_record(layout: str) -> str:
    """A JSON record in a layout, for documentation and tests."""
    known = LAYOUTS[layout]
    if "fields" in known:
        return json.dumps({field: role for role, field in known["fields"]})

    def nested(path: str, value):
        first, _, rest = path.partition(".")
        inner = nested(rest, value) if rest else value
        return {first.removesuffix("[]"): [inner] if first.endswith("[]") else inner}

    top, who, text = known["list"]
    messages = [nested(who, role) | nested(text, said) for role, said in (("user", "a"), ("assistant", "b"))]
    if "more" in known:
        messages = [{**m, "content": [{**part, "type": "text"} for part in m["content"]]} for m in messages]
    return json.dumps(nested(top, messages))
