"""Chat formatting with typed content parts.

A message's content is a list of parts. A visitor flattens them, in order, to text with numbered placeholders, and
records for each attachment its reference and the number of tokens that the placeholder expands to. Turns are
then written as

    <turn role>text</turn>\\n

where each backslash and each < (in roles also >) of the content has a backslash before it: no content can open
or close a turn or pose as a placeholder, and reading back removes the backslashes. The loss mask covers what
assistants say.

Conversations are read in sorted partitions and held a turn at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor):
        return visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int
    height: int

    def accept(self, visitor):
        return visitor.image(self)


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float

    def accept(self, visitor):
        return visitor.audio(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int

    def accept(self, visitor):
        return visitor.document(self)


@dataclass(frozen=True)
class Attachment:
    place: str
    ref: str
    tokens: int


@dataclass
class Flatten:
    """The visitor. Expanded token counts: an image has one token for each started square of PATCH pixels, audio
    PER_SECOND tokens for each started second, a document PER_PAGE for each page."""

    PATCH, PER_SECOND, PER_PAGE = 28, 25, 256
    pieces: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    def text(self, part: Text) -> None:
        self.pieces.append(escape(part.text or ""))

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        place = f"<{kind} {len(self.attachments)}>"
        self.pieces.append(place)
        self.attachments.append(Attachment(place, ref, tokens))

    def image(self, part: Image) -> None:
        self._attach("image", part.ref, -(-part.width // self.PATCH) * -(-part.height // self.PATCH))

    def audio(self, part: Audio) -> None:
        self._attach("audio", part.ref, int(-(-part.seconds // 1)) * self.PER_SECOND)

    def document(self, part: Document) -> None:
        self._attach("document", part.ref, part.pages * self.PER_PAGE)


def flatten(parts) -> tuple[str, list[Attachment]]:
    v = Flatten()
    for p in parts:
        p.accept(v)
    return "".join(v.pieces), v.attachments


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str | None, parts) -> tuple[str, tuple[int, int], list[Attachment]]:
    """The turn's text, the span that counts for the loss (empty but for assistants), and the attachments."""
    body, attachments = flatten(parts)
    head = f"<turn {escape(role or '').replace('>', chr(92) + '>')}>"
    start = len(head)
    return f"{head}{body}</turn>\n", (start, start + len(body) if role == "assistant" else start), attachments


_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def read_turns(formatted: str):
    """(role, text with placeholders, start and end of the content) of each turn."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


#: A typed part as a row: kind is text, image, audio or document; the other fields as the kind needs.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_KINDS = {
    "text": lambda p: Text(p["text"] or ""),
    "image": lambda p: Image(p["ref"] or "", p["width"] or 0, p["height"] or 0),
    "audio": lambda p: Audio(p["ref"] or "", p["seconds"] or 0.0),
    "document": lambda p: Document(p["ref"] or "", p["pages"] or 0),
}


def typed(text: str, parts: list[dict] | None) -> list:
    """A message's parts: those of its list, or the text where there is no list. An unknown kind is an error."""
    return [Text(text)] if parts is None else [_KINDS[p["kind"]](p) for p in parts if p is not None]


def _sorted(rows: DataFrame, parts_col: str | None) -> DataFrame:
    """Rows of a conversation together and in order: by turn, then role, then text (nulls first), then parts."""
    parts = F.col(f"`{parts_col}`") if parts_col else F.lit(None)
    r = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), parts.cast(PARTS).alias("parts"))
    return r.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "parts")


_ATTACHED = "array<struct<place:string,ref:string,tokens:bigint>>"


def format_conversations(rows: DataFrame, parts_col: str | None = None) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end (within formatted), attachments (place, ref, tokens) for every row.

    parts_col: a column of typed parts (PARTS); where it is null, or not given, the text is the one part. A null role is empty, a null
    text too. A null conv_id is a conversation of its own. Rows that repeat are turns that repeat. Turns of equal number follow role, text and
    parts. An empty table gives an empty one; further columns of any name aren't read. A conversation is one task's, for its turns are
    in order; it is held a turn at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    attached = to_arrow_type(_parse_datatype_string(_ATTACHED))

    def work(batches):
        for batch in batches:
            conv, turn, role, text, parts = batch.columns
            out = [format_turn(r, typed(t, p)) for r, t, p in zip(role.to_pylist(), text.to_pylist(), parts.to_pylist(), strict=True)]
            lists = [[{"place": a.place, "ref": a.ref, "tokens": a.tokens} for a in x[2]] for x in out]
            yield pa.RecordBatch.from_arrays([conv, turn, pa.array([x[0] for x in out], pa.string()), pa.array([x[1][0] for x in out], pa.int64()), pa.array([x[1][1] for x in out], pa.int64()), pa.array(lists, attached)], names=["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"])

    return _sorted(rows, parts_col).mapInArrow(work, f"conv_id bigint, turn bigint, formatted string, loss_start bigint, loss_end bigint, attachments {_ATTACHED}")


class _Digest:
    """What is read back of one conversation."""

    def __init__(self):
        self.n = self.loss = self.chars = self.attached = self.tokens = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int, attachments: list[dict]) -> None:
        self.attached += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)
        self.chars += len(formatted)
        for role, text, _, _ in read_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        said = unescape(formatted[start:end])
        self.loss += len(said)
        self.masked.update(said.encode())


def conversation_digests(rows: DataFrame, parts_col: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted turns, and
    n_attachments, attachment_tokens. Nulls, ties, repeated rows, long texts and empty tables are as in format_conversations."""

    def work(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        none = object()
        now, d, done = none, _Digest(), []

        def row():
            return now, d.n, d.turns.hexdigest(), d.loss, d.masked.hexdigest(), d.chars, d.attached, d.tokens

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for conv, formatted, start, end, attachments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachments")), strict=True):
                if conv != now:
                    if now is not none:
                        done.append(row())
                    now, d = conv, _Digest()
                d.add(formatted, start, end, attachments)
            if done:
                yield out()
                done = []
        if now is not none:
            done.append(row())
            yield out()

    return format_conversations(rows, parts_col).mapInArrow(work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint")
