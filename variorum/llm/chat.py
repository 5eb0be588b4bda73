"""Chat formatting: conversations as marked text with a loss mask, by a grammar round trip.

Rendered text is read again by a deterministic parser. Where what comes back isn't what went in, the turns in conflict are
escaped (each control string in them, or escaped control string, gets one backslash after its first character) and all is
rendered anew, until both are identical. So most texts stay as they are, and every text comes back.

Template: `[SYS] text [/SYS]` of a system turn, `[INST] text [/INST]` of a user's, `<s>text</s>` of an assistant's, and
`[ROLE] role [/ROLE] text [/TURN]` of any other role. No control string begins inside another, so a conversation's turns
parse independently, and a long conversation may be cut between turns.

Rows are dealt by ranges of (conv_id, turn, role): a conversation of any size is spread over tasks as segments of bounded
size. Only its digests need all its segments in order; one task streams them and keeps two hash states.

Cases. A null text or role is empty. A null conv_id is a conversation of its own. Turns stand in the order of turn (nulls
first), role and text; repeated rows are turns of their own. Other columns don't matter, whatever their names. No rows:
no conversations. A turn longer than a segment is a segment of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm import bytesops as B
from variorum.llm import storage

#: The role whose texts are under the loss mask.
LEARNED = "assistant"
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), LEARNED: ("<s>", "</s>")}
#: Characters after which a conversation's segment ends.
SEGMENT = 1 << 20
#: Characters of rows that leave a task together.
_BATCH = 4 << 20

_WORDS = "/?(?:INST|SYS|ROLE|TURN)"
_CONTROL = re.compile(rf"(\[{_WORDS}\]|</?s>)")
_PLAIN = re.compile(rf"(?<=\[)(?=\\*{_WORDS}\])|(?<=<)(?=\\*/?s>)")
_ESCAPED = re.compile(rf"(?<=\[)\\(?=\\*{_WORDS}\])|(?<=<)\\(?=\\*/?s>)")
#: By the control string that opens a turn: its role, what stands before and after its text, and the one that closes it.
_OPENED = {a.strip(): (role, a[len(a.strip()) :], b[: len(b) - len(b.strip())], b.strip()) for role, (a, b) in MARKS.items()}

Turn = tuple[str, str]
FORMATTED = "conv_id long, part int, segment int, text string, loss array<struct<start:int,length:int>>, n_turns long, open boolean"
RECOVERED = "conv_id long, part int, segment int, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def render(turn: Turn, escaped: bool = False) -> tuple[str, int, int]:
    """A turn's marked text, and where its own text starts in it and how long that is."""
    role, text = (escape(x) for x in turn) if escaped else turn
    before, after = MARKS.get(role) or (f"[ROLE] {role} [/ROLE] ", " [/TURN]")
    return before + text + after, len(before), len(text)


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered text, or None where it isn't one."""
    tokens = _CONTROL.split(text)
    turns: list[Turn] = []
    at = 0
    while at < len(tokens) - 1:
        if tokens[at] or at + 4 >= len(tokens):
            return None
        opened, body, closed = tokens[at + 1 : at + 4]
        if opened == "[ROLE]":
            if at + 6 >= len(tokens) or closed != "[/ROLE]" or tokens[at + 5] != "[/TURN]":
                return None
            role, body = body[1:-1], tokens[at + 4]
            if tokens[at + 2] != f" {role} " or role in MARKS:
                return None
            role, before, after, at = unescape(role), " ", " ", at + 6
        elif opened in _OPENED and closed == _OPENED[opened][3]:
            role, before, after, _ = _OPENED[opened]
            at += 4
        else:
            return None
        if len(body) < len(before) + len(after) or not body.startswith(before) or not body.endswith(after):
            return None
        turns.append((role, unescape(body[len(before) : len(body) - len(after)])))
    return None if tokens[at] else turns


def round_trip(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The text that parses back to these turns, and the spans of it that are learned."""
    escaped = [False] * len(turns)
    while True:
        pieces = [render(t, e) for t, e in zip(turns, escaped, strict=True)]
        text = "".join(p[0] for p in pieces)
        if parse(text) == turns:
            break
        conflicts = [i for i, t in enumerate(turns) if not escaped[i] and parse(pieces[i][0]) != [t]]
        if not conflicts:
            raise ValueError("turns that don't come back though all conflicts are escaped")
        for i in conflicts:
            escaped[i] = True
    spans, at = [], 0
    for (role, _), (piece, start, length) in zip(turns, pieces, strict=True):
        if role == LEARNED:
            spans.append((at + start, length))
        at += len(piece)
    return text, spans


def _assemble(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Segments of the conversations of a task whose rows come in order."""
    part = TaskContext.get().partitionId()
    rows: list[dict] = []
    held = 0
    turns: list[Turn] = []
    now: object = _assemble  # no conversation's id
    size, segment, first = 0, 0, True

    def close(more: bool) -> None:
        """more: whether rows of this conversation may follow, here or in the next task."""
        nonlocal turns, size, segment, held
        if not turns:
            return
        text, spans = round_trip(turns)
        rows.append({"conv_id": now, "part": part, "segment": segment, "text": text, "loss": [{"start": s, "length": n} for s, n in spans], "n_turns": len(turns), "open": more or first or segment > 0})
        held += len(text)
        turns, size, segment = [], 0, segment + 1

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                close(False)
                first = now is _assemble
                now, segment = conv, 0
            elif size >= longest:
                close(True)
            turns.append((role or "", text or ""))
            size += len(text or "")
            if held >= _BATCH:
                yield pa.RecordBatch.from_pylist(rows, _FORMATTED)
                rows, held = [], 0
    close(True)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _FORMATTED)


_SPAN = pa.struct([("start", pa.int32()), ("length", pa.int32())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.list_(_SPAN)), ("n_turns", pa.int64()), ("open", pa.bool_())])


def formatted(turns: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """Segments of every conversation (conv_id, turn, role, text): its text is theirs in the order of part and segment.

    longest: characters after which a segment ends.
    loss: the spans of a segment's text that are learned, in code points; open: whether other segments may belong to it.
    """
    order = ["conv_id", "turn", "role"]
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return storage.kept(dealt.mapInArrow(B.task(lambda batches: _assemble(batches, longest)), FORMATTED), "chat-formatted")


def _read(row: dict) -> tuple[list[Turn], str]:
    """Turns and learned text of a segment; it must parse, and its mask must cover the assistant's texts."""
    turns = parse(row["text"])
    loss = "".join(unescape(row["text"][s["start"] : s["start"] + s["length"]]) for s in row["loss"])
    if turns is None or len(turns) != row["n_turns"]:
        raise ValueError(f"a segment of conversation {row['conv_id']} doesn't parse")
    return turns, loss


def turns_of(segments: DataFrame) -> DataFrame:
    """conv_id, part, segment, position, role, text: the turns that a formatted table's segments hold."""
    kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("position", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ({**{c: r[c] for c in ("conv_id", "part", "segment")}, "position": i, "role": role, "text": text} for r in batch.to_pylist() for i, (role, text) in enumerate(_read(r)[0]))
            yield pa.RecordBatch.from_pylist(list(rows), kinds)

    return segments.mapInArrow(B.task(run), "conv_id long, part int, segment int, position int, role string, text string")


_RECOVERED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("n_turns", pa.int64()), ("turns", pa.binary()), ("loss_chars", pa.int64()), ("loss", pa.binary()), ("formatted_chars", pa.int64())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What segments hold, as the bytes that digests are taken of."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            turns, loss = _read(r)
            told = "".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "surrogatepass")
            rows.append({"conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "n_turns": len(turns), "turns": told, "loss_chars": len(loss), "loss": loss.encode("utf-8", "surrogatepass"), "formatted_chars": len(r["text"])})
        yield pa.RecordBatch.from_pylist(rows, _RECOVERED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation, whose segments come one after the other in order."""
    now: object = _digest  # no conversation's id
    counts, hashes = [0, 0, 0], []

    def told() -> dict:
        return {"conv_id": now, "n_turns": counts[0], "turns_sha256": hashes[0].hexdigest(), "loss_chars": counts[1], "loss_sha256": hashes[1].hexdigest(), "formatted_chars": counts[2]}

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["conv_id"] != now:
                if now is not _digest:
                    done.append(told())
                now, counts, hashes = r["conv_id"], [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
            for i, c in enumerate(("n_turns", "loss_chars", "formatted_chars")):
                counts[i] += r[c]
            hashes[0].update(r["turns"])
            hashes[1].update(r["loss"])
        yield pa.RecordBatch.from_pylist(done, _DIGESTS)
    if now is not _digest:
        yield pa.RecordBatch.from_pylist([told()], _DIGESTS)


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from a formatted table: number of turns, digest of them, and of the learned text."""
    whole = segments.where("not open").mapInArrow(B.task(lambda batches: _digest(_recover(batches))), DIGESTS)
    parts = segments.where("open").mapInArrow(B.task(_recover), RECOVERED)
    joined = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(B.task(_digest), DIGESTS)
    return whole.unionByName(joined)
