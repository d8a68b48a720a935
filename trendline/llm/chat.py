"""Chat formatting: every assistant turn as an example of its own, with what came before it."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The control strings of the template and the role whose turns are learnt.
REPLY, END, OPEN, CLOSE, TEXT = "<s>", "</s>", "[INST]", "[/INST]", "[TEXT]"
ASSISTANT = "assistant"

CHARACTERS_AT_ONCE = 1 << 22
CONTROLS = (REPLY, END, OPEN, CLOSE, TEXT)
_RAW = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))
_MARK = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """No control string is left in the result: each gets one more backslash after its first sign.

    Strings that look escaped already get one more as well, so that ``unescape`` is exact.
    """
    return _RAW.sub(lambda found: f"{found[0][0]}\\{found[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: found[0][0] + found[0][2:], text)


def turn_markup(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where in it the text to be learnt starts and ends."""
    body = escape(text)
    if role == ASSISTANT:
        return f"{REPLY}{body}{END}", len(REPLY), len(REPLY) + len(body)
    return f"{OPEN}{escape(role)}{TEXT}{body}{CLOSE}", 0, 0


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns of a formatted example."""
    pieces = _MARK.split(formatted)
    marks = _MARK.findall(formatted)
    place = 0
    while place < len(marks):
        if marks[place] == REPLY:
            yield ASSISTANT, unescape(pieces[place + 1])
            place += 2
        else:
            yield unescape(pieces[place + 1]), unescape(pieces[place + 2])
            place += 3


def expand(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per example: ``example`` (from 0), ``text``, ``loss_start`` and ``loss_end``.

    Every assistant turn gives an example: all turns before it as context, and itself, of which only
    the text (``loss_start`` to ``loss_end``, in code points) is to be learnt. Turns after the last
    assistant turn give one more example with nothing to learn, so that no turn is lost. Turns go by
    number, then role and text, so repeated rows have one order; NULL comes first; a NULL role or
    text counts as empty. NULL conversations belong together.

    The turns of a conversation are sorted outside Python and streamed through one task, which holds
    the context so far: an example contains all of it, so it must fit a string anyway. Rows leave in
    blocks of bounded size.
    """
    rows = turns.select(
        turns[conversation].alias("_id"),
        turns[turn].alias("_turn"),
        F.coalesce(turns[role], F.lit("")).alias("_role"),
        F.coalesce(turns[text], F.lit("")).alias("_text"),
    )
    ordered = rows.repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text")
    ids = ordered.select("_id").schema
    schema = StructType().add(conversation, ids["_id"].dataType)
    for name, kind in (
        ("example", LongType()),
        ("text", StringType()),
        ("loss_start", LongType()),
        ("loss_end", LongType()),
    ):
        schema = schema.add(name, kind)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, context, number, open_turns, started = None, "", 0, False, False
        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("_id", "_role", "_text")]
            for owner, speaker, body in zip(*columns, strict=True):
                if started and owner != current:
                    if open_turns:
                        yield current, number, context, len(context), len(context)
                    context, number = "", 0
                current, started = owner, True
                piece, start, end = turn_markup(speaker, body)
                before, context = len(context), context + piece
                open_turns = speaker != ASSISTANT
                if not open_turns:
                    yield current, number, context, before + start, before + end
                    number += 1
        if open_turns:
            yield current, number, context, len(context), len(context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [batch_type(ids["_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = schema.names
        block: list[tuple] = []
        size = 0
        for example in examples(batches):
            block.append(example)
            size += len(example[2])
            if size >= CHARACTERS_AT_ONCE:
                yield _batch(block, names, types)
                block, size = [], 0
        if block:
            yield _batch(block, names, types)

    return ordered.mapInArrow(run, schema)


def batch_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(values, kind) for values, kind in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def read_back(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the examples of each conversation say, as digests.

    ``n_turns`` and ``turns_sha256`` (role, line break, text, line break per turn) come from the
    last example, which holds every turn; ``loss_chars`` and ``loss_sha256`` from what is to be
    learnt of all examples, in order; ``formatted_chars`` is the length of all examples together.
    The examples must lie as ``expand`` leaves them: those of a conversation together, in order.
    """
    kind = examples.schema[conversation].dataType
    schema = StructType().add(conversation, kind)
    for name in ("n_turns", "loss_chars", "formatted_chars"):
        schema = schema.add(name, LongType())
    schema = schema.add("turns_sha256", StringType()).add("loss_sha256", StringType())

    def summary(owner, last: str, learnt_chars: int, learnt, formatted: int) -> tuple:
        from hashlib import sha256

        whole, count = sha256(), 0
        for role, text in turns_of(last):
            whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            count += 1
        return owner, count, learnt_chars, formatted, whole.hexdigest(), learnt.hexdigest()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from hashlib import sha256

        names = (conversation, "example", "text", "loss_start", "loss_end")
        state = None
        for batch in batches:
            columns = [batch[name].to_pylist() for name in names]
            for owner, number, text, start, end in zip(*columns, strict=True):
                if number == 0:
                    if state:
                        yield summary(*state)
                    state = [owner, "", 0, sha256(), 0]
                learnt = unescape(text[start:end])
                state[1] = text
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
        if state:
            yield summary(*state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [batch_type(kind), *[pa.int64()] * 3, pa.string(), pa.string()]
        block: list[tuple] = []
        for row in summaries(batches):
            block.append(row)
            if len(block) >= 4096:
                yield _batch(block, schema.names, types)
                block = []
        if block:
            yield _batch(block, schema.names, types)

    return examples.mapInArrow(run, schema)
