"""Chat formatting: schema fingerprints choose a mapping to canonical turns.

A layout is known by its fingerprint: the hash of its nested field paths (arrays
as `[]`, in sorted order, fields that no mapping knows left out).  MAPPINGS declares, for
each layout, how its fields become rows (conv_id, turn, role, text).  Typed tables are
fingerprinted by their schema, JSON records one by one by the paths they hold.

Template: every turn is `### role: text</turn>` and a line feed.  A backslash stands before
every backslash, `###` and `</turn>` of a text, and before colons of a role too, so
control strings are only ever the template's own and all texts come back.  The loss mask
is the span of the text in turns of the role `assistant`.

Turns are ordered by (turn, role, text), nulls first; repeated rows are repeated
turns.  Null text or role is an empty one; a null conv_id is a conversation of its own.  Empty
tables give no rows.  Extra columns are ignored.  A schema without a mapping is an error; a JSON
record without one gets a null fingerprint and no turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the template.
OPEN, SEP, CLOSE, END = "### ", ": ", "</turn>", "\n"
LEARNED = "assistant"
_CONTROLS = r"\\|###|</turn>"

# Role names of the layouts that have their own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout's paths, and SQL for its turns.

    `turns` is an array of (turn, role, text); for a layout of one turn a row it has
    one entry.  `own_roles` says that the layout names roles as ROLES does; elsewhere a role is
    handed on as it is.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    own_roles: bool = False


def _two(question: str, answer: str) -> str:
    return f"array(struct(0L AS turn, 'user' AS role, {question} AS text), struct(1L AS turn, 'assistant' AS role, {answer} AS text))"


def _listed(array: str, role: str, text: str) -> str:
    return (
        f"transform({array}, (m, i) -> struct(CAST(i AS BIGINT) AS turn, "
        f"CAST(m.{role} AS STRING) AS role, CAST(m.{text} AS STRING) AS text))"
    )


MAPPINGS = (
    Mapping(
        "turn rows",
        ("conv_id", "role", "text", "turn"),
        "array(struct(CAST(turn AS BIGINT) AS turn, CAST(role AS STRING) AS role, CAST(text AS STRING) AS text))",
    ),
    Mapping("messages", ("conv_id", "messages[].content", "messages[].role"), _listed("messages", "role", "content")),
    Mapping(
        "from and value",
        ("conv_id", "conversations[].from", "conversations[].value"),
        _listed("conversations", "from", "value"),
        own_roles=True,
    ),
    Mapping("prompt and response", ("conv_id", "prompt", "response"), _two("prompt", "response")),
    Mapping("prompt and completion", ("completion", "conv_id", "prompt"), _two("prompt", "completion")),
    Mapping(
        "instruction",
        ("conv_id", "input", "instruction", "output"),
        _two("concat_ws('\\n', nullif(instruction, ''), nullif(input, ''))", "output"),
    ),
)
_KNOWN = {path for m in MAPPINGS for path in m.paths}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves of a type."""
    if isinstance(schema, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in schema for p in field_paths(f.dataType, dot + f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    known = sorted(set(paths) & _KNOWN)
    return hashlib.sha256("\n".join(known).encode()).hexdigest()[:16]


_BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def canonical_turns(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout."""
    print_ = fingerprint(field_paths(table.schema))
    if print_ not in _BY_FINGERPRINT:
        raise ValueError(f"no mapping for layout {print_}: {field_paths(table.schema)}")
    mapping = _BY_FINGERPRINT[print_]
    turns = F.expr(mapping.turns).alias("turns")
    role = F.coalesce(F.col("t.role"), F.lit(""))
    if mapping.own_roles:
        for name, canonical in ROLES.items():
            role = F.when(F.col("t.role") == name, canonical).otherwise(role)
    listed = table.select(F.col("conv_id").cast("bigint").alias("conv_id"), turns)
    return listed.select("conv_id", F.explode("turns").alias("t")).select(
        "conv_id", "t.turn", role.alias("role"), F.coalesce("t.text", F.lit("")).alias("text")
    )


def json_fingerprint(record: Column) -> Column:
    """Fingerprint of one JSON record by the paths it holds."""
    variant = F.try_parse_json(record)
    held = [
        F.when(F.variant_get(variant, "$." + p.replace("[]", "[0]"), "variant").isNotNull(), F.lit(p))
        for p in sorted(_KNOWN)
    ]
    return F.substring(F.sha2(F.concat_ws("\n", *held), 256), 1, 16)


def json_turns(records: DataFrame, column: str = "json") -> DataFrame:
    """(layout, conv_id, turn, role, text) of JSON records of mixed layouts.

    Records of unknown layout, or that are no JSON, give one row with null layout.
    """
    fields = (
        "conv_id bigint, turn bigint, role string, text string, prompt string, response string, "
        "completion string, instruction string, input string, output string, "
        "messages array<struct<role: string, content: string>>, "
        "conversations array<struct<`from`: string, value: string>>"
    )
    parsed = records.select(
        json_fingerprint(F.col(column)).alias("print"), F.from_json(column, fields).alias("r")
    ).select("print", "r.*")
    name, turns = F.lit(None).cast("string"), F.lit(None)
    for print_, mapping in _BY_FINGERPRINT.items():
        chosen = F.col("print") == print_
        name = F.when(chosen, mapping.name).otherwise(name)
        turns = F.when(chosen, F.expr(mapping.turns)).otherwise(turns)
    rows = parsed.select(name.alias("layout"), "conv_id", turns.alias("turns"))
    return rows.select("layout", "conv_id", F.explode_outer("turns").alias("t")).select(
        "layout", "conv_id", "t.*"
    )


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, f"({_CONTROLS}{more})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({_CONTROLS}|:)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end): a turn's output and its loss span.

    A conversation's output is its pieces in the order of their turns; rows of one
    conversation need not meet in one task for that.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), "|:"), F.lit(SEP))
    text = escaped(F.col("text"))
    learned = F.col("role") == LEARNED
    start = F.char_length("head")
    return turns.withColumn("head", head).withColumn("body", text).select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(CLOSE + END)).alias("piece"),
        F.when(learned, start).alias("loss_start"),
        F.when(learned, start + F.char_length("body")).alias("loss_end"),
    )


_PIECE = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*)</turn>\n$"


def read_back(output: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, learned, chars) from formatted pieces alone.

    `learned` is the text under the loss mask, without its escapes.
    """
    masked = F.substring("piece", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return output.select(
        "conv_id",
        "turn",
        unescaped(F.regexp_extract("piece", _PIECE, 1)).alias("role"),
        unescaped(F.regexp_extract("piece", _PIECE, 2)).alias("text"),
        unescaped(masked).alias("learned"),
        F.char_length("piece").alias("chars"),
    )


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


class _Conversation:
    """Running digests of one conversation: its size does not matter."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, learned: str | None, chars: int) -> None:
        self.turns += 1
        self.chars += chars
        self.all.update(f"{role}\n{text}\n".encode())
        if learned is not None:
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def digests(turns: DataFrame) -> DataFrame:
    """The columns of DIGESTS for each conversation that `read_back` found.

    Turns meet by conversation, sorted, and are folded one by one.
    """
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (part.split() for part in DIGESTS.split(", "))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        at = None
        for batch in batches:
            rows = []
            for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at.conv_id != conv_id:
                    rows += [at.row()] if at else []
                    at = _Conversation(conv_id)
                at.add(*turn)
            yield out(rows)
        if at:
            yield out([at.row()])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "learned", "chars").mapInArrow(fold, DIGESTS)
