"""Chat formatting with a grammar round trip: turns are rendered with a
template, the rendered text is parsed again, and content that does not come
back is escaped until it does."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm.common import partitions_for, ready, scratch

# The template.  A turn is HEAD, its role, a line end, its text,
# and END; CONTROL finds what marks turns, with the backslashes before it.
HEAD = "### "
CLOSE = "</turn>"
END = f"\n{CLOSE}\n"
CONTROL = re.compile(r"^\\*### |\\*</turn>", re.MULTILINE)
ROLE_ESCAPE = re.compile(r"\\([\\n])")

# Fixed value: code points after which a conversation goes on in a new part.
PART = 4_000_000

PARTS = pa.schema([("conv", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
                   ("loss", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])
DIGESTS = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class Turn(NamedTuple):
    """A turn that the parser found; its raw text is ``[start, end)`` there."""
    role: str | None
    text: str
    start: int
    end: int


def escape(text: str) -> str:
    """One backslash more before each control string."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][m[0][0] == "\\":], text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return ROLE_ESCAPE.sub(lambda m: "\n" if m[1] == "n" else "\\", role)


def render(role: str, text: str) -> str:
    return f"{HEAD}{role}\n{text}{END}"


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted text.  Every text has exactly one reading: a
    turn runs from HEAD to the next control string without a backslash; what
    stands where HEAD should stand is a turn without a role."""
    out: list[Turn] = []
    at = 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        if not formatted.startswith(HEAD, at) or line < 0:
            out.append(Turn(None, formatted[at:], at, len(formatted)))
            break
        role, start = unescape_role(formatted[at + len(HEAD):line]), line + 1
        mark = next((m for m in CONTROL.finditer(formatted, start) if m[0][0] != "\\"), None)
        end = at = mark.start() if mark else len(formatted)
        if mark and mark[0] == CLOSE:
            # A text and its closing mark stand on lines of their own.
            if end > start and formatted[end - 1] == "\n":
                end -= 1
            at = mark.end() + formatted.startswith("\n", mark.end())
        out.append(Turn(role, unescape(formatted[start:end]), start, end))
    return out


def settle(role: str, text: str) -> tuple[str, int, int]:
    """A turn's rendering that parses back to ``role`` and ``text``, and where
    its text lies there.  Escapes only what conflicts; both escapes can be
    undone whatever they meet, so at most two are needed."""
    shown_role, shown = role, text
    while True:
        out = render(shown_role, shown)
        got = parse(out)
        if len(got) == 1 and (got[0].role, got[0].text) == (role, text):
            return out, got[0].start, got[0].end
        before = shown_role, shown
        if "\n" in shown_role or got[0].role != role:
            shown_role = escape_role(role)
        else:
            shown = escape(text)
        if before == (shown_role, shown):
            raise ValueError(f"a turn of role {role!r} does not come back from its rendering")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """``conv, part, formatted, loss`` of all conversations: the formatted
    text and the loss mask, spans ``[s, e)`` in code points that hold the texts
    of the role ``learn``.

    Every turn is rendered, parsed and, where the reading differs from the
    source, escaped until both agree; the parts are then parsed once more as a
    whole, and a difference is an error.  No control string of a text survives
    without a backslash, and ``parse`` gives every role and text back.

    A conversation is one part or, beyond ``PART`` code points or across the
    border of two sorted partitions, several, each of whole turns; in order of
    ``part`` they make up its text.  Rows are dealt by (conversation, turn), so
    a conversation with a third of all rows is shared by many tasks, and a task
    holds one part at a time.

    Turns stand by turn number (a missing one first), rows of one turn by role
    and hash of their text; repeated rows are repeated turns.  A null role or
    text is empty, a null conversation id is a conversation of its own, empty
    and very long texts are turns like others.  Other columns are not read.  An
    empty table gives no part."""
    spark = ready(turns)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = ["conv", "turn", "role", F.xxhash64("text")]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part() -> pa.RecordBatch:
            text = "".join(shown)
            read = parse(text)
            if [(t.role, t.text) for t in read] != said:
                raise ValueError(f"conversation {conv} does not come back from its rendering")
            loss = [{"s": t.start, "e": t.end} for t in read if t.role == learn]
            return pa.RecordBatch.from_pydict({"conv": [conv], "part": [number], "formatted": [text], "loss": [loss]}, PARTS)

        number = TaskContext.get().partitionId() << 32
        conv, size = None, 0
        said: list[tuple[str, str]] = []
        shown: list[str] = []
        for b in batches:
            for of, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if said and (of != conv or size >= PART):
                    yield part()
                    number, size, said, shown = number + 1, 0, [], []
                conv = of
                said.append((role, text))
                shown.append(settle(role, text)[0])
                size += len(shown[-1])
        if said:
            yield part()

    return (rows.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order)
            .mapInArrow(parts, "conv long, part long, formatted string, loss array<struct<s: int, e: int>>"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``DIGESTS`` of conversations whose parts follow each other in order."""
    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(DIGESTS.names, ([x] for x in (
            conv, n_turns, turns.hexdigest(), chars, loss.hexdigest(), size)), strict=True)), DIGESTS)

    conv, n_turns, chars, size, open_ = None, 0, 0, 0, False
    for b in batches:
        for of, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv", "formatted", "loss")), strict=True):
            if open_ and of != conv:
                yield row()
            if not open_ or of != conv:
                conv, n_turns, chars, size, open_ = of, 0, 0, 0, True
                turns, loss = hashlib.sha256(), hashlib.sha256()
            read = parse(text)
            n_turns, size = n_turns + len(read), size + len(text)
            for t in read:
                turns.update(f"{t.role}\n{t.text}\n".encode())
            for span in spans:
                learnt = unescape(text[span["s"]:span["e"]])
                chars += len(learnt)
                loss.update(learnt.encode())
    if open_:
        yield row()


def read_back(parts: DataFrame) -> DataFrame:
    """``DIGESTS`` of each conversation, read back from the output of
    ``format_chats``: turns as the parser finds them, and the text under the
    loss mask with its escapes taken away.

    A conversation of one part is digested where it lies.  Only the others are
    sent, to one task each, which reads their parts in order, one at a time: a
    digest runs over the whole conversation from its first byte to its last.
    An empty table gives an empty result."""
    spark = ready(parts)
    parts = scratch(parts, "chat-parts", spark)
    kind = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    long = scratch(parts.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("long")),
                   "chat-long", spark)
    same = parts["conv"].eqNullSafe(long["long"])
    short = parts.join(long, same, "left_anti").mapInArrow(_digests, kind)
    several = parts.join(long, same, "left_semi").repartition(partitions_for(spark), "conv").sortWithinPartitions("conv", "part")
    return short.unionByName(several.mapInArrow(_digests, kind))
