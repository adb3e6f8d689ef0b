"""Operator 3: chat formatting with layouts chosen by schema fingerprint.

A layout is known by the sorted list of its nested field paths, hashed.  ``LAYOUTS``
maps that hash to a declarative description of where roles and texts stand.  Each row
is fingerprinted by the layout fields it really fills, so one table may mix layouts.
Turns are then rendered with a template whose marks cannot occur inside escaped text,
and every rendered turn can be read back exactly.

Defined results: null texts and roles are empty; a null list of messages fills no
field; a row whose filled fields match no layout gives no turn and is returned by
``rejects`` with its fields; repeated rows are repeated turns; turns with equal numbers are ordered by role and text; an empty table
gives an empty result; columns that belong to no layout are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
#: Names that message lists use for the canonical roles; turn rows keep the role they name.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: a list field, fixed fields, or one row per turn."""

    name: str
    paths: tuple[str, ...]
    fixed: tuple[tuple[str, str], ...] = ()  # (role, field)
    items: tuple[str, str, str] | None = None  # (list field, role field, text field)
    row: tuple[str, str, str] | None = None  # (number field, role field, text field)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    """Hash of a set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = {
    layout.fingerprint: layout
    for layout in (
        Layout("turn_rows", ("role", "text", "turn"), row=("turn", "role", "text")),
        Layout("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
        Layout("conversations", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
        Layout("prompt_completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
        Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
        Layout("question_answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
        Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
        Layout("instruction_input", ("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
        Layout("system_prompt", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    )
}


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of all leaf fields; ``[]`` stands for any element of a list."""
    found = []
    for field in schema.fields:
        kind, path = field.dataType, prefix + field.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        found += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return found


def row_fingerprint(schema: T.StructType) -> Column:
    """Fingerprint of the layout fields that a row fills.

    Turn rows count by their columns alone, since their role or text may be null.
    """
    known = {p for layout in LAYOUTS.values() for p in layout.paths}
    there = [p for p in sorted(field_paths(schema)) if p in known]
    rows = {p for layout in LAYOUTS.values() if layout.row for p in layout.paths}
    always = rows if rows <= set(there) else set()
    filled = [
        F.lit(p) if p in always else F.when(F.col(f"`{p.split('[]')[0].split('.')[0]}`").isNotNull(), F.lit(p))
        for p in there
        if p not in rows or p in always
    ]
    return F.sha2(F.array_join(F.array_compact(F.array(*filled)), "\n"), 256) if filled else F.lit("")


def _turn(number: Column, role: Column, text: Column, rename: bool = True) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for name, canonical in ROLES.items() if rename else ():
        role = F.when(role == name, canonical).otherwise(role)
    return F.struct(number.cast("long").alias("turn"), role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(layout: Layout) -> Column:
    if layout.row:
        number, role, text = layout.row
        return F.array(_turn(F.col(number), F.col(role), F.col(text), rename=False))
    if layout.items:
        items, role, text = layout.items
        return F.transform(F.col(items), lambda m, i: _turn(i, m[role], m[text]))
    return F.array(*[_turn(F.lit(i), F.lit(role), F.col(field)) for i, (role, field) in enumerate(layout.fixed)])


def _usable(df: DataFrame) -> list[Layout]:
    there = set(field_paths(df.schema))
    return [layout for layout in LAYOUTS.values() if set(layout.paths) <= there]


def rejects(df: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """conv_id, fingerprint, fields: rows from which no layout makes turns, with the layout fields they fill.

    Every row either gives its turns or is here; a known layout with an empty list is a
    conversation without turns, not a reject.
    """
    known = [layout.fingerprint for layout in _usable(df)]
    paths = {p for layout in LAYOUTS.values() for p in layout.paths}
    filled = [
        F.when(F.col(f"`{p.split('[]')[0].split('.')[0]}`").isNotNull(), F.lit(p)) for p in sorted(field_paths(df.schema)) if p in paths
    ]
    fields = F.array_compact(F.array(*filled)) if filled else F.array().cast("array<string>")
    rows = df.select(F.col(conversation).cast("long").alias("conv_id"), row_fingerprint(df.schema).alias("fingerprint"), fields.alias("fields"))
    return rows.filter(~F.col("fingerprint").isin(known)) if known else rows


def canonical_turns(df: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, layout: the turns of every row of a known layout."""
    usable = _usable(df)
    if not usable:
        raise ValueError(f"no known layout among the fields {sorted(field_paths(df.schema))}")
    mark = row_fingerprint(df.schema)
    turns = F.coalesce(*[F.when(F.col("_mark") == layout.fingerprint, _turns(layout)) for layout in usable])
    name = F.coalesce(*[F.when(F.col("_mark") == layout.fingerprint, F.lit(layout.name)) for layout in usable])
    return (
        df.withColumn("_mark", mark)
        .select(F.col(conversation).cast("long").alias("conv_id"), name.alias("layout"), F.explode(turns).alias("_t"))
        .select("conv_id", "_t.turn", "_t.role", "_t.text", "layout")
    )


def escape(text: Column) -> Column:
    """Put a backslash into every ``<|`` (and one more into ``<\\|``), so no mark is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, is_loss, formatted: every turn rendered by the template.

    A conversation is its rendered turns one after the other, by turn, then role and
    text.  The loss mask covers the text of assistant turns, without any mark.
    """
    role = F.replace(F.replace(F.col("role"), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    rendered = F.concat(F.lit(START), escape(role), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    return turns.select("conv_id", "turn", "role", (F.col("role") == LEARNED_ROLE).alias("is_loss"), rendered.alias("formatted"))


def read_back(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    import re

    if not (formatted.startswith(START) and formatted.endswith(END + "\n")):
        raise ValueError("not a rendered turn")
    role, _, text = formatted[len(START) : -len(END) - 1].partition("\n")
    if START in text or END in text:
        raise ValueError("an unescaped mark inside a turn")
    role, text = (re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in (role, text))
    return role.replace("%0A", "\n").replace("%25", "%"), text


DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = object()
    current, state, done = nothing, None, []

    def close() -> None:
        if current is not nothing:
            n, turns, chars, loss, size = state
            done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, DIGEST.fieldNames())

    for batch in batches:
        for conv, is_loss, formatted in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_loss", "formatted")), strict=True):
            if current is nothing or conv != current:
                close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_back(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if is_loss:
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        yield out()
    close()
    yield out()


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of every conversation, read back from its rendered turns.

    The turns of a conversation pass a task in order, one at a time; nothing is
    gathered, so even a conversation that holds most rows needs little memory.
    """
    return (
        formatted.select("conv_id", "turn", "role", "is_loss", "formatted")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted")
        .mapInArrow(_digest, DIGEST)
    )
