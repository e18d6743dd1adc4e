"""Chat formatting by incremental black-box rendering (operator 1).

A template is any function from a list of (role, text) turns to a string.  It
is called on successive prefixes of the turns; where two consecutive outputs
begin to differ the next turn begins.  A template that closes the dialogue takes
its end mark back when another turn comes, and that mark may begin like the next
header: what the output without turns and the last output end in alike, behind
the last text, is that mark, and the next turn begins where it stood.  If a turn
begins before the end of an earlier text, the template rewrites history, and the
first such turn is reported.  The end mark stays with the last turn.  The text of a turn inside its span is located by rendering the turn
twice more with two different private-use characters instead of its text: what
both outputs share before and after is the turn's frame.

A template that looks at no more than ``context`` earlier turns is rendered in
pieces: a task streams over the sorted rows, carries ``context`` turns into the
next piece and never holds a conversation.  With ``context=None`` the whole
conversation is one piece, as a template that looks at everything needs it.

Rows stay one per turn, in the order (turn, role, text), nulls first and null
role or text as empty, so a conversation is never gathered into one row.

Defined cases: a null conv_id is a conversation of its own; repeated rows are
repeated turns; unknown roles are rendered like any other; an empty table gives
an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

PIECE = 16
TRAINED = ("assistant",)
_PROBES = ("\ue000", "\ue001")

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")


def escape(value: str) -> str:
    """Marks control strings with a backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], value)


def unescape(value: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], value)


def _role(value: str) -> str:
    return escape(value).replace(":", "\\:")


def plain_template(turns: list[Turn]) -> str:
    """The registered template: a header with the role, the text and an end mark per turn."""
    return "".join(f"### {_role(role)}: {escape(value)}</turn>\n" for role, value in turns)


def parse_turn(piece: str) -> Turn:
    """Role and text of one rendered turn of ``plain_template``."""
    at, role = 4, []
    while not piece.startswith(": ", at):
        if piece[at] == "\\":
            step = next(len(t) for t in ("\\", "###", "</turn>", ":") if piece.startswith(t, at + 1))
            role.append(piece[at + 1:at + 1 + step])
            at += 1 + step
        else:
            role.append(piece[at])
            at += 1
    return "".join(role), unescape(piece[at + 2:len(piece) - len("</turn>\n")])


@dataclass
class Rendered:
    """Spans of the turns of one rendered piece."""

    output: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewritten: int | None  # first turn whose output a later turn changed


def _common(a: str, b: str) -> int:
    """Length of the shared beginning, by halving."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def render_incrementally(template: Template, turns: list[Turn]) -> Rendered:
    """Spans of every turn, from the outputs of successive prefixes alone."""
    empty = template([])
    before, starts, sizes, texts, rewritten = empty, [], [len(empty)], [], None
    closed, mark = False, len(empty)
    for k, (role, value) in enumerate(turns):
        output = template(turns[:k + 1])
        start = _common(before, output)
        # a tail that only closes the dialogue may move; a turn's text may not
        changed = [i for i, (_, end) in enumerate(texts) if end > start]
        if changed and (rewritten is None or changed[0] < rewritten):
            rewritten = changed[0]
        closed |= start < len(before) and not changed
        one, two = (template([*turns[:k], (role, probe)]) for probe in _PROBES)
        head = _common(one, two)
        tail = min(_common(one[::-1], two[::-1]), len(one) - head)
        starts.append(start)
        sizes.append(len(output))
        texts.append((min(head, len(output)), max(head, len(output) - tail)))
        # of the end mark no more than all outputs have behind their last text
        mark = min(mark, _common(empty[::-1], output[::-1]), len(output) - texts[-1][1])
        before = output
    if closed:
        starts = [min(start, size - mark) for start, size in zip(starts, sizes)]
    spans = [(start, max(start, min([size, *starts[k + 1:k + 2]])))
             for k, (start, size) in enumerate(zip(starts, sizes[1:]))]
    return Rendered(before, spans, texts, rewritten)


def format_turns(
    conversations: DataFrame, template: Template = plain_template, context: int | None = None,
    trained: tuple[str, ...] = TRAINED, piece: int = PIECE,
) -> DataFrame:
    """One row per turn: conv_id, place in the conversation, role, the turn's part of the
    formatted text, where its own text begins and ends in that part, whether that text is under
    the loss mask, and whether the template rewrote the turn later on.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    schema = ("conv_id long, place long, turn long, role string, part string, text_start long, "
              "text_end long, trained boolean, rewritten boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = (), 0
        carried: list[Turn] = []
        held: list[tuple[int, Turn]] = []

        def flush() -> pa.RecordBatch | None:
            nonlocal carried, held, place
            if not held:
                return None
            turns = [*carried, *(t for _, t in held)]
            done = render_incrementally(template, turns)
            skip = len(carried)
            out = []
            for k, (turn, (role, _)) in enumerate(held):
                start, end = done.spans[skip + k]
                first, last = done.texts[skip + k]
                out.append((current[0], place + k, turn, role, done.output[start:end],
                            first - start, last - start, role in trained,
                            done.rewritten is not None and skip + k >= done.rewritten))
            place += len(held)
            if context is not None:
                carried = turns[len(turns) - context:] if context else []
            held = []
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.int64(), pa.bool_(), pa.bool_()]
        names = [f.strip().split()[0] for f in schema.split(",")]
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for conv, turn, role, value in zip(*columns):
                if current != (conv,) or (context is not None and len(held) >= piece):
                    if (out := flush()) is not None:
                        yield out
                    if current != (conv,):
                        current, place, carried = (conv,), 0, []
                held.append((turn, (role, value)))
        if (out := flush()) is not None:
            yield out

    return rows.mapInArrow(run, schema)


def digests(turns: DataFrame, parse: Callable[[str], Turn], read: Callable[[str], str]) -> DataFrame:
    """Per conversation what can be read back from the formatted parts.

    Parts are streamed in order through running digests, so a conversation of
    any length takes constant memory.  The rows arrive already dealt by conv_id.
    """
    rows = turns.select("conv_id", "place", "part", "text_start", "text_end", "trained",
                        "rewritten").sortWithinPartitions("conv_id", "place")
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long, rewritten boolean")
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        state: list = []

        def done() -> pa.RecordBatch:
            n, every, chars, loss, length, rewritten = state
            return pa.RecordBatch.from_pylist([dict(zip(names, (
                current[0], n, every.hexdigest(), chars, loss.hexdigest(), length, rewritten)))],
                schema=pa.schema([(c, k) for c, k in zip(names, (
                    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                    pa.bool_()))]))

        for batch in batches:
            for r in batch.to_pylist():
                if current != (r["conv_id"],):
                    if current:
                        yield done()
                    current = (r["conv_id"],)
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                role, value = parse(r["part"])
                state[0] += 1
                state[1].update(f"{role}\n{value}\n".encode())
                if r["trained"]:
                    own = read(r["part"][r["text_start"]:r["text_end"]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(r["part"])
                state[5] |= r["rewritten"]
        if current:
            yield done()

    return rows.mapInArrow(run, schema)
