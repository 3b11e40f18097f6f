"""Chat formatting by schema fingerprint, in built-in functions only.

Records come in many JSON layouts. The nested field paths of a record, without
their values, hash to a fingerprint; a small declarative table says for each known
fingerprint where the turns lie. Canonical turns are rows (key, position, role,
text); the template turns them into one text a conversation with a loss mask, and
`read_back` recovers turns and masked text from that alone.

Template, one piece a turn: `### role: text</turn>` and a line feed. Inside a role
or a text every backslash and every `#` has a backslash before it and the end mark
one in it, so neither control string can occur there, and `\\x` reads back as `x`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</turn>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: single fields, a list of objects, or one row a turn."""

    name: str
    #: (role, JSON path) of single-field turns, in their order.
    fields: tuple[tuple[str, str], ...] = ()
    #: JSON path of a list of turns, with the paths of role and text in each.
    turns: tuple[str, str, str] | None = None
    #: The names of role, text and position, where each record is a turn.
    row: tuple[str, str, str] | None = None
    #: The layout's own role names, with the canonical ones.
    roles: tuple[tuple[str, str], ...] = ()


#: Role names of one layout. Fixed values.
SPEAKERS = (("human", "user"), ("gpt", "assistant"))

#: Field paths of a record (sorted, as `field_paths` gives them) and what they mean. Fixed values.
LAYOUTS: dict[str, Layout] = {
    "conv_id,role,text,turn": Layout("rows", row=("role", "text", "turn")),
    "completion,prompt": Layout("prompt", fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    "prompt,response": Layout("prompt", fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    "instruction,output": Layout("instruction", fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    "input,instruction,output": Layout("instruction", fields=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    "instruction,output,system": Layout("instruction", fields=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output"))),
    "messages[],messages[].content,messages[].role": Layout("messages", turns=("$.messages", "$.role", "$.content")),
    "conversations[],conversations[].from,conversations[].value": Layout("messages", turns=("$.conversations", "$.from", "$.value"), roles=SPEAKERS),
    "conversation,conversation.messages[],conversation.messages[].content,conversation.messages[].role": Layout("nested", turns=("$.conversation.messages", "$.role", "$.content")),
    "messages[],messages[].author,messages[].author.role,messages[].content,messages[].content.text": Layout("nested", turns=("$.messages", "$.author.role", "$.content.text")),
    "data,data.completion,data.prompt": Layout("nested", fields=(("user", "$.data.prompt"), ("assistant", "$.data.completion"))),
}
#: Objects in objects that field paths go down into.
DEPTH = 4


def fingerprint(paths: str) -> Column:
    """The fingerprint of known field paths, as a literal."""
    return F.sha2(F.lit(paths), 256)


def field_paths(record: Column) -> Column:
    """Sorted, comma-joined nested field paths of a JSON record; `[]` marks lists, whose objects' paths are put together.

    Read from the record's own structure, so the order of fields, their values and
    nulls among them do not matter. What lies deeper than `DEPTH` objects has no path.
    Null for null or malformed records.
    """
    none = F.array().cast("array<string>")

    def paths(value: Column, depth: int) -> Column:
        keys = F.coalesce(F.json_object_keys(value), none)
        if not depth:
            return keys

        def below(k: Column) -> Column:
            child = F.call_function("get_json_object", value, F.concat(F.lit("$['"), k, F.lit("']")))
            in_list = F.flatten(F.transform(F.coalesce(F.from_json(child, "array<string>"), none), lambda x: paths(x, depth - 1)))
            listed = F.concat(F.array(F.concat(k, F.lit("[]"))), F.transform(F.array_distinct(in_list), lambda x: F.concat(k, F.lit("[]."), x)))
            inner = F.concat(F.array(k), F.transform(paths(child, depth - 1), lambda x: F.concat(k, F.lit("."), x)))
            return F.when(child.startswith("["), listed).when(child.startswith("{"), inner).otherwise(F.array(k))

        return F.flatten(F.transform(keys, below))

    return F.when(F.json_object_keys(record).isNotNull(), F.array_join(F.array_sort(paths(record, DEPTH - 1)), ","))


def canonical_turns(records: DataFrame, key: str = "key", record: str = "record", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """Turns of JSON records of any known layout: `key`, `pos` (long), `role`, `text`, `layout`.

    Records of unknown layout, malformed or null give no turns (find them with
    `unknown_layouts`). Null roles and texts become ''. In a layout of single fields,
    a field that is null is no turn.
    """
    base = records.select(F.col(key).alias("key"), F.col(record).alias("record"))
    base = base.withColumn("print", F.sha2(field_paths(F.col("record")), 256))
    turn = "array<struct<pos:long,role:string,text:string>>"
    found, name = F.lit(None).cast(turn), F.lit(None).cast("string")
    for paths, layout in layouts.items():
        if layout.row:
            role, text, pos = (F.get_json_object("record", f"$.{x}") for x in layout.row)
            turns = F.array(F.struct(pos.cast("long").alias("pos"), role.alias("role"), text.alias("text")))
        elif layout.turns:
            path, role, text = layout.turns
            listed = F.from_json(F.get_json_object("record", path), "array<string>")
            turns = F.transform(listed, lambda x, i: F.struct(i.cast("long").alias("pos"), F.get_json_object(x, role).alias("role"), F.get_json_object(x, text).alias("text")))  # noqa: B023
        else:
            each = F.array(*(F.struct(F.lit(i).cast("long").alias("pos"), F.lit(role).alias("role"), F.get_json_object("record", path).alias("text")) for i, (role, path) in enumerate(layout.fields)))
            turns = F.filter(each, lambda x: x["text"].isNotNull())
        for own, canonical in layout.roles:
            turns = F.transform(turns, lambda x: x.withField("role", F.when(x["role"] == own, canonical).otherwise(x["role"])))  # noqa: B023
        here = F.col("print") == fingerprint(paths)
        found, name = F.when(here, turns.cast(turn)).otherwise(found), F.when(here, F.lit(layout.name)).otherwise(name)
    rows = base.select("key", name.alias("layout"), F.explode(found).alias("t")).select("key", "layout", "t.pos", "t.role", "t.text")
    return rows.select("key", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "layout")


def unknown_layouts(records: DataFrame, record: str = "record", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """Field paths that no mapping knows, with their fingerprint and number of records."""
    paths = field_paths(F.col(record))
    seen = records.groupBy(paths.alias("paths")).agg(F.count("*").alias("records"))
    return seen.where(F.col("paths").isNull() | ~F.col("paths").isin(*layouts)).withColumn("fingerprint", F.sha2("paths", 256))


def _all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    """`text` without control strings, reversibly."""
    return _all(_all(_all(text, "\\", "\\\\"), "#", "\\#"), END, "<\\/turn>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: `key`, `formatted`, `loss` (array by turn).

    `loss` holds for each turn where its piece starts in `formatted`, where its text
    starts, and how many code points of it the loss covers (0 outside `trained`).
    Turns with equal positions keep a fixed order by role, then text; repeated turns
    are kept. A conversation is one text, so its turns meet in one row; they are
    escaped before that.
    """
    head = F.concat(F.lit("### "), _all(escaped(F.col("role")), ":", "\\:"), F.lit(": "))
    tail = f"{END}\n"
    piece = turns.select("key", "pos", head.alias("head"), escaped(F.col("text")).alias("body"), F.col("role").isin(*trained).alias("trained"))
    size = (F.length("head") + F.length("body") + len(tail)).cast("long")
    # Where a turn starts is a running sum over its conversation, whose rows are sorted for that.
    before = W.partitionBy("key").orderBy("pos", "head", "body").rowsBetween(W.unboundedPreceding, -1)
    placed = piece.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))
    whole = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "head", "body", "trained"))).alias("t"))
    loss = F.transform("t", lambda x: F.struct(x["at"].alias("turn"), (x["at"] + F.length(x["head"])).alias("start"), F.when(x["trained"], F.length(x["body"])).otherwise(0).cast("long").alias("length")))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
    return whole.select("key", text.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From `formatted` and `loss` alone: `key`, `turns` (array of role, text), `learned` (array of the texts under the mask), `chars` (code points of `formatted`)."""
    pieces = F.split(F.col("formatted"), f"{END}\n", -1)
    whole = formatted.select("key", "loss", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"), F.length("formatted").cast("long").alias("chars"))

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)^### ((?:[^:\\]|\\.)*+): ", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, F.length(role) + 7, F.length(p))).alias("text"))

    masked = F.filter(F.arrays_zip("pieces", "loss"), lambda z: z["loss"]["length"] > 0)
    learned = F.transform(masked, lambda z: unescaped(F.substring(z["pieces"], (z["loss"]["start"] - z["loss"]["turn"] + 1).cast("int"), z["loss"]["length"].cast("int"))))
    return whole.select("key", F.transform("pieces", turn).alias("turns"), learned.alias("learned"), "chars")
