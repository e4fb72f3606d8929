"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor goes
over them in order and flattens them into one formatted string: text parts
escaped, the others as numbered placeholders whose reference and expanded
token count it records. Formatting is per row and needs no shuffle; a
conversation is its formatted turns in order.

    <|im_start|>role\\ncontent<|im_end|>\\n

Control strings inside texts are escaped by one more backslash between ``<``
and ``|``, so formatted content never holds ``<|`` but in marks and
placeholders, and reading takes one backslash away again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped_streams, map_batches

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
ATTACHMENTS = "array<struct<kind: string, index: int, ref: string, at: bigint, tokens: bigint>>"
FORMATTED = f"conv_id long, turn long, formatted string, loss array<struct<start: bigint, stop: bigint>>, attachments {ATTACHMENTS}, attached_tokens long"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for: an image for one token each
    ``patch`` x ``patch`` pixels (rounded up on both sides), audio for
    ``per_second`` tokens a second (rounded up), a document for ``per_page``
    tokens a page. Missing or negative sizes count as none."""

    patch: int = 28
    per_second: int = 25
    per_page: int = 768

    def image(self, part: dict) -> int:
        return -(-max(0, part["width"] or 0) // self.patch) * -(-max(0, part["height"] or 0) // self.patch)

    def audio(self, part: dict) -> int:
        seconds = part["seconds"] or 0.0
        return -int(-seconds * self.per_second // 1) if 0 < seconds < float("inf") else 0

    def document(self, part: dict) -> int:
        return max(0, part["pages"] or 0) * self.per_page


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Also keeps line ends out: the header's line end closes the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class PartVisitor:
    """Flattens the parts of one message, in order."""

    expansion: Expansion = field(default_factory=Expansion)
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type']}", self.visit_other)(part)

    def write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def place(self, kind: str, part: dict, tokens: int) -> None:
        index = len(self.attachments)
        self.attachments.append({"kind": kind, "index": index, "ref": part["ref"], "at": self.length, "tokens": tokens})
        self.write(f"<|{kind}:{index}|>")

    def visit_text(self, part: dict) -> None:
        self.write(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self.place("image", part, self.expansion.image(part))

    def visit_audio(self, part: dict) -> None:
        self.place("audio", part, self.expansion.audio(part))

    def visit_document(self, part: dict) -> None:
        self.place("document", part, self.expansion.document(part))

    def visit_other(self, part: dict) -> None:
        """A part of no known type: a file if it refers to one, else text."""
        if part["ref"] is None:
            self.visit_text(part)
        else:
            self.place("file", part, 0)


def _text_part(text: str | None) -> dict:
    return {"type": "text", "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}


def format_turn(role: str | None, parts: list[dict | None], trained: str = "assistant", expansion: Expansion | None = None) -> tuple:
    """(formatted, loss spans, attachments, their tokens) of one message."""
    visitor = PartVisitor(expansion or Expansion())
    header = f"{START}{escape_role(role or '')}\n"
    for part in parts:
        visitor.visit(part)
    attachments = [{**a, "at": a["at"] + len(header)} for a in visitor.attachments]
    spans = [{"start": len(header), "stop": len(header) + visitor.length}] if role == trained else []
    return f"{header}{''.join(visitor.pieces)}{END}\n", spans, attachments, sum(a["tokens"] for a in attachments)


def format_turns(messages: DataFrame, content: str | Column | None = None, trained: str = "assistant",
                 expansion: Expansion | None = None) -> DataFrame:
    """One formatted turn for each row of ``messages`` (conv_id, turn, role,
    text): columns FORMATTED. Positions and lengths are code points within
    the turn; ``loss`` holds the spans a model is trained on, the content of
    the turns of role ``trained``.

    ``content`` names an array of PARTS that takes the place of ``text``
    where it is not null. Null text and null parts are empty, a null role is
    the empty role, null conv_id and turn stay null. Repeated rows are
    formatted as often as they occur. No rows give no rows.
    """
    parts = F.lit(None).cast(PARTS) if content is None else F.col(content).cast(PARTS) if isinstance(content, str) else content.cast(PARTS)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), parts.alias("parts"))

    def run(columns: dict) -> dict:
        done = [format_turn(role, [_text_part(text)] if parts is None else parts, trained, expansion)
                for role, text, parts in zip(columns["role"], columns["text"], columns["parts"], strict=True)]
        formatted, loss, attachments, tokens = zip(*done, strict=True) if done else ((), (), (), ())
        return {"conv_id": columns["conv_id"], "turn": columns["turn"], "formatted": formatted, "loss": loss,
                "attachments": attachments, "attached_tokens": tokens}

    return map_batches(rows, FORMATTED, run)


PLACEHOLDER = re.compile(r"<\|(image|audio|document|file):(\d+)\|>")


def read_parts(content: str) -> list[tuple[str, str | int]]:
    """The parts of a turn's formatted content, in order: ("text", text) and
    (kind, index of the attachment). Neighbouring texts come as one."""
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(content):
        parts += [("text", unescape(content[at:m.start()]))] * (m.start() > at)
        parts.append((m[1], int(m[2])))
        at = m.end()
    return parts + [("text", unescape(content[at:]))] * (len(content) > at)


#: A turn as formatted; its content ends at the first end mark.
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string. Placeholders stay in
    the text as they are. A string that is not wholly made of turns raises."""
    at = 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2])
    if at != len(formatted):
        raise ValueError(f"no turn at character {at} of a formatted text")


def digests(formatted: DataFrame) -> DataFrame:
    """What ``formatted`` (from ``format_turns``) holds, read back from it:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_attachments, attached_tokens), one row for each conversation.

    Turns come by turn, nulls first, ties by formatted text. Rows with a null
    conv_id are one conversation. Only a sequence of turns is hashed, in
    bounded memory, however long the conversation.
    """

    def fold(conv, rows):
        import hashlib

        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = attached = tokens = 0
        for _, _, text, spans, attachments, expanded in rows:
            for role, said in read_turns(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in spans:
                trained = unescape(text[span["start"]:span["stop"]])
                loss.update(trained.encode())
                loss_chars += len(trained)
            chars += len(text)
            attached += len(attachments)
            tokens += expanded
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, attached, tokens

    return grouped_streams(formatted, "conv_id", ["turn", "formatted"],
                           "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                           "formatted_chars long, n_attachments long, attached_tokens long", fold)
