r"""Chat formatting with a grammar round trip.

Template of a conversation (no separators between turns)::

    turn      = "[INST]" text "[/INST]"                 a user's turn
              | text "</s>"                             an assistant's turn, under the loss mask
              | "[ROLE]" role "[SEP]" text "[/ROLE]"    any other role

A text that holds a control string would be read as markup. So a turn is rendered, reparsed
with the deterministic parser and compared to its source; where they differ, its content is
escaped and the comparison repeated. Level 1 puts one backslash after the first sign of each
control string in the text (and of each control string that already has backslashes there),
level 2 does so after each "[" and "<". Taking one backslash out of such places undoes it.
The parser knows neither source nor level: the level-2 form is tagged by "[ESC]".

A turn is rendered where it is read, before the shuffle, beside a digest of its source. The
turns of a conversation then stand in order in one task, which joins them, reparses the joined
text and compares the recovered turns to the digests; where they differ, the joined turns are
escaped one level further and compared again. It does so in stretches of ``STRETCH``
characters that end with a turn, where the parser has nothing to remember, and updates the
digests of the conversation, so one with most of the table's rows needs no more memory.

Defined results. Null text: empty. Null role: empty role name. Turns with equal numbers:
ordered by role, then formatted text; null turns first. Repeated rows: repeated turns. Null
conv_id: one conversation of its own. Very long texts: a task holds one and its stretch.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches

#: Characters that are joined and reparsed at once.
STRETCH = 1 << 20
CONTROL = ["[INST]", "[/INST]", "</s>", "[ROLE]", "[SEP]", "[/ROLE]", "[ESC]"]
_ANY = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
_MARK = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: one backslash into each control string; 2: one after each opening sign."""
    if level == 0:
        return text
    if level == 1:
        return _ANY.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return "[ESC]" + re.sub(r"[\[<]", lambda m: m[0] + "\\", text)


def unescape(body: str) -> str:
    """Undo ``escape`` of any level."""
    if body.startswith("[ESC]"):
        return re.sub(r"([\[<])\\", r"\1", body[5:])
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], body)


def _frame(role: str, body: str) -> str:
    if role == "user":
        return f"[INST]{body}[/INST]"
    if role == "assistant":
        return f"{body}</s>"
    return f"[ROLE]{escape(role, 1)}[SEP]{body}[/ROLE]"


def render(role: str, text: str) -> str:
    """One turn, escaped as little as its round trip needs."""
    for level in (0, 1, 2):
        out = _frame(role, escape(text, level))
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError("a turn that can't be rendered")


def parse(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """Role, text and span of the body of each turn; a ValueError where the grammar doesn't hold."""

    def mark(at: int, *allowed: str):
        m = _MARK.search(formatted, at)
        while m is not None and m[0] == "[ESC]":
            m = _MARK.search(formatted, m.end())
        if m is None or m[0] not in allowed:
            raise ValueError(f"{m and m[0]!r} at {m and m.start()}, not one of {allowed}")
        return m

    at = 0
    while at < len(formatted):
        if formatted.startswith("[INST]", at):
            m = mark(at + 6, "[/INST]")
            role, span = "user", (at + 6, m.start())
        elif formatted.startswith("[ROLE]", at):
            s = mark(at + 6, "[SEP]")
            m = mark(s.end(), "[/ROLE]")
            role, span = unescape(formatted[at + 6 : s.start()]), (s.end(), m.start())
        else:
            m = mark(at, "</s>")
            role, span = "assistant", (at, m.start())
        yield role, unescape(formatted[slice(*span)]), span
        at = m.end()


def source_digest(role: str, text: str) -> int:
    """64 bits of a turn's role and text."""
    return int.from_bytes(hashlib.blake2b(f"{len(role)} {role}{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def join_turns(pieces: list[str], sources: list[int]) -> tuple[str, list[tuple[str, str]]]:
    """The joined text of rendered turns and what the parser recovers from it: the turns with these digests."""
    for level in (0, 1, 2):
        whole = "".join(pieces)
        try:
            found = [t[:2] for t in parse(whole)]
            if [source_digest(*t) for t in found] == sources:
                return whole, found
        except ValueError:
            pass
        pieces = [_frame(role, escape(text, min(2, level + 1))) for p in pieces for role, text, _ in parse(p)]
    raise ValueError("turns that can't be joined")


class _Reader:
    """Digests of one conversation, from its formatted text alone."""

    def __init__(self, conv):
        self.conv, self.turns, self.all, self.loss, self.loss_chars, self.chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        self.pieces, self.sources, self.held = [], [], 0

    def add(self, piece: str, source: int) -> None:
        self.pieces.append(piece), self.sources.append(source)
        self.held += len(piece)
        if self.held >= STRETCH:
            self.read()

    def read(self) -> None:
        formatted, turns = join_turns(self.pieces, self.sources)
        for role, text in turns:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            if role == "assistant":
                self.loss.update(text.encode("utf-8", "replace"))
                self.loss_chars += len(text)
        self.chars += len(formatted)
        self.pieces, self.sources, self.held = [], [], 0

    def row(self):
        self.read()
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted text and source digest of each turn; a conversation is the concatenation in order."""
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = [(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            out = [render(*t) for t in turns]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string()), pa.array([source_digest(*t) for t in turns], pa.int64())], names=["conv_id", "turn", "role", "formatted", "source"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, formatted string, source long")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        open_: _Reader | None = None
        for b in batches:
            done = []
            for conv, formatted, source in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "source"))):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Reader(conv)
                open_.add(formatted, source)
            if done:
                yield table(done)
        if open_ is not None:
            yield table([open_.row()])

    dealt = format_turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
