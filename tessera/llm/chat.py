"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

The template writes a turn as ``<turn role>``, a line break, the text, ``</turn>`` and a line break. Backslashes in texts are
doubled and a control string gets a backslash inside, so that no text holds one and all texts can be read back; roles are
percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "<turn ", "</turn>\n"
#: Code points of a context beyond which it stands in rows of its own, which the later examples share.
SHARE = 1 << 18
#: Code points that an output batch may gather before it is handed on.
BATCH = 1 << 22
ROWS = "conv_id {0}, seq long, kind string, example long, parts long, text string, loss_start long, loss_end long"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("<turn", "<\\turn")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    for turn in text.split(END)[:-1]:
        role, body = turn[len(HEAD):].split(">\n", 1)
        yield unquote(role), unescaped(body)


class _Rows:
    """Output rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: tuple, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if self.chars >= BATCH or len(self.rows) >= 10_000:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows, self.chars = [], 0


def _schema(conv: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    return pa.schema([("conv_id", conv), ("seq", long), ("kind", text), ("example", long), ("parts", long), ("text", text), ("loss_start", long), ("loss_end", long)])


def expand(turns: DataFrame, target: str = "assistant", share: int = SHARE) -> DataFrame:
    """(conv_id, seq, kind, example, parts, text, loss_start, loss_end) of turns (conv_id, turn, role, text).

    Every turn of the role ``target`` gives one row of kind ``example``: ``text`` holds all turns before it and the turn itself,
    and only ``[loss_start, loss_end)``, the reply's own code points, is trainable. What follows a conversation's last reply
    (all of it, if it has none) is kept in a row of kind ``rest``, of which nothing is trainable.

    Examples repeat their context, which is quadratic in a conversation. Where a context exceeds ``share`` code points, its
    whole turns so far become a row of kind ``context``, written once: the first ``parts`` of these rows precede the text of
    every later example. No text is left out, and no row holds more than ``share`` code points, a turn and a reply.

    Turns are ordered by turn, role and text; rows that repeat a turn are turns each. Null roles and texts are empty; a null
    turn comes first, and rows of a null conv_id form one conversation. Other columns are ignored. An empty table gives no
    rows. A conversation is streamed by one task in the order of its sorted rows and never held; rows of a conversation come
    out together and in the order of ``seq``.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = conv = None
        begun = False
        seq = example = parts = held = 0
        open_: list[str] = []
        answered = True

        def row(what: str, text: str, start: int | None = None, end: int | None = None) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            seq += 1
            yield from out.add((conv, seq - 1, what, example if what == "example" else None, parts, text, start, end), len(text))

        for b in batches:
            out = out or _Rows(_schema(b.schema.field(0).type))
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not begun or c != conv:
                    if begun and not answered:
                        yield from row("rest", "".join(open_))
                    begun, conv, seq, example, parts, held, open_ = True, c, 0, 0, 0, 0, []
                if held >= share:
                    yield from row("context", "".join(open_))
                    parts, held, open_ = parts + 1, 0, []
                head, body = f"{HEAD}{quote(role, safe='')}>\n", escaped(text)
                open_.append(f"{head}{body}{END}")
                if answered := role == target:
                    start = held + len(head)
                    open_ = ["".join(open_)]
                    yield from row("example", open_[0], start, start + len(body))
                    example += 1
                held += len(head) + len(body) + len(END)
        if begun and not answered:
            yield from row("rest", "".join(open_))
        if out:
            yield from out.flush()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(examples, ROWS.format(kind))


def read_back(examples: DataFrame, arranged: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as the rows of ``expand`` state them.

    Turns are read from the shared contexts and the last row of a conversation, replies from the loss spans, one an example.
    ``formatted_chars`` counts every example (and rest) with its whole context. ``arranged``: the rows are those of ``expand``
    and still in their order; if they have been written and read, they are brought into it.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    if not arranged:
        examples = examples.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = conv = last = None
        begun = False
        n_turns = loss_chars = formatted = shared = 0
        all_, loss = hashlib.sha256(), hashlib.sha256()

        def read(text: str) -> None:
            nonlocal n_turns
            for role, body in turns_of(text):
                n_turns += 1
                all_.update(f"{role}\n{body}\n".encode())

        def done() -> Iterator[pa.RecordBatch]:
            read(last)
            yield from out.add((conv, n_turns, all_.hexdigest(), loss_chars, loss.hexdigest(), formatted))

        for b in batches:
            long, text_ = pa.int64(), pa.string()
            out = out or _Rows(pa.schema([("conv_id", b.schema.field(0).type), ("n_turns", long), ("turns_sha256", text_), ("loss_chars", long), ("loss_sha256", text_), ("formatted_chars", long)]))
            for c, what, text, start, end in zip(*[b.column(i).to_pylist() for i in (0, 2, 5, 6, 7)]):
                if not begun or c != conv:
                    if begun:
                        yield from done()
                    begun, conv, n_turns, loss_chars, formatted, shared = True, c, 0, 0, 0, 0
                    all_, loss = hashlib.sha256(), hashlib.sha256()
                if what == "context":
                    read(text)
                    shared += len(text)
                    continue
                formatted, last = formatted + shared + len(text), text
                if start is not None:
                    reply = unescaped(text[start:end])
                    loss_chars += len(reply)
                    loss.update(reply.encode())
        if begun:
            yield from done()
            yield from out.flush()

    return examples.mapInArrow(digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
