"""Chat formatting of typed content parts.

A visitor flattens a message's parts: text stays, an image, audio or document part becomes a placeholder numbered through
the conversation, its reference is recorded, and the tokens that a model will put in its place are counted. A template
marks turns; what looks like a mark inside a text is escaped, so that the turns can be read back.

The output is a row per turn: its piece of the formatted conversation, with offsets in the whole. So a conversation of
any length is written and read in bounded memory; the pieces in order of `turn_no` are the formatted conversation.

Defined results: turns are ordered by (turn, role, text), a null turn first; a null text or role is empty; turns equal in these
are ordered by their parts as JSON; a part of an unknown type becomes an `other` placeholder of no tokens, recorded with the type
it has; null parts are left out; a null conv_id is a conversation of its own; repeated rows are turns of their own; an
empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, LOSS, CLOSE = '<turn role="{}">', '<turn role="{}" loss>', "</turn>\n"
#: What would be read as a mark: a backslash, and < before the name of a mark.
CONTROL = re.compile(r"\\|<(?=/?(?:turn|image|audio|document|other)\b)")
MARK = re.compile(r'<turn role="([^"]*)"( loss)?>|</turn>\n')
ROLE_ESCAPES = {"\\": "\\\\", '"': "\\q", "\n": "\\n", "<": "\\l", ">": "\\g"}
TRAINED_ROLES = ("assistant",)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "\\l", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "l": "<", "q": '"', "n": "\n", "g": ">"}[m[1]], text)


def escape_role(role: str) -> str:
    return "".join(ROLE_ESCAPES.get(c, c) for c in role)


class PartVisitor:
    """Visits the parts of one conversation's messages in order."""

    patch, audio_rate, page_tokens = 28, 25.0, 258

    def __init__(self, first: int = 0):
        self.n = first

    def visit(self, parts: list[dict]) -> tuple[str, list[dict]]:
        """The flattened, escaped text of one message and its attachments. Texts side by side are joined before escaping."""
        out, run, found = [], [], []
        count = {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        for part in filter(None, parts):
            kind = part.get("type") or "text"
            if kind == "text":
                run.append(part.get("text") or "")
                continue
            out.append(escape("".join(run)))
            run = []
            tokens = count[kind](part) if kind in count else 0
            found.append({"n": self.n, "type": kind, "ref": part.get("ref"), "tokens": tokens})
            out.append(f"<{kind if kind in count else 'other'}:{self.n}:{tokens}>")
            self.n += 1
        return "".join(out) + escape("".join(run)), found

    def visit_image(self, part: dict) -> int:
        """A token for each patch, and one for each row of patches."""
        rows, cols = (max(1, math.ceil((part.get(k) or self.patch) / self.patch)) for k in ("height", "width"))
        return rows * (cols + 1)

    def visit_audio(self, part: dict) -> int:
        return max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> int:
        return max(1, part.get("pages") or 1) * self.page_tokens


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "array<struct<n:int,type:string,ref:string,tokens:bigint>>"


def text_parts(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with each text as one text part."""
    nulls = {f.split(":")[0]: f.split(":")[1] for f in PART[len("struct<") : -1].split(",")}
    part = F.struct(*[(F.lit("text") if n == "type" else F.col("text") if n == "text" else F.lit(None)).cast(k).alias(n) for n, k in nulls.items()])
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(messages: DataFrame, trained_roles: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """messages(conv_id, turn, role, parts) -> conv_id, turn_no, piece, start_char, loss_start, loss_end, attachments.

    start_char, loss_start and loss_end are code points in the whole formatted conversation; the loss fields are null
    outside of trained roles. One pass over sorted rows, which keeps the state of one conversation only.
    """
    conv = messages.schema["conv_id"]
    out = T.StructType([conv, T.StructField("turn_no", T.LongType()), T.StructField("piece", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start_char", "loss_start", "loss_end")]])
    out.add("attachments", T._parse_datatype_string(ATTACHMENT))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, at, visitor = object(), 0, 0, PartVisitor()
        for batch in batches:
            rows = []
            for conv_id, role, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv_id != now:
                    now, number, at, visitor = conv_id, 0, 0, PartVisitor()
                role = role or ""
                body, found = visitor.visit(parts or [])
                trained = role in trained_roles
                head = (LOSS if trained else OPEN).format(escape_role(role))
                piece = head + body + CLOSE
                loss = (at + len(head), at + len(head) + len(body)) if trained else (None, None)
                rows.append({conv.name: conv_id, "turn_no": number, "piece": piece, "start_char": at, "loss_start": loss[0], "loss_end": loss[1], "attachments": found})
                number, at = number + 1, at + len(piece)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    ordered = messages.select("conv_id", "turn", "role", "parts").repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), text, F.to_json("parts"))
    return ordered.mapInArrow(each, out)


def read_back(pieces: DataFrame) -> DataFrame:
    """Reads formatted turns(conv_id, turn_no, piece, start_char, loss_start, loss_end) again: digests per conversation."""
    conv = pieces.schema["conv_id"]
    longs, strings = ("n_turns", "loss_chars", "formatted_chars"), ("turns_sha256", "loss_sha256")
    out = T.StructType([conv, *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.StringType()) for c in strings]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done() -> list:
            return [state["id"], state["turns"], state["loss"], state["chars"], state["all"].hexdigest(), state["mask"].hexdigest()]

        for batch in batches:
            closed = []
            for conv_id, piece, start, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if state is None or conv_id != state["id"]:
                    if state:
                        closed.append(done())
                    state = {"id": conv_id, "turns": 0, "loss": 0, "chars": 0, "all": hashlib.sha256(), "mask": hashlib.sha256()}
                assert start == state["chars"], "pieces don't follow each other"
                state["chars"] += len(piece)
                open_mark = MARK.match(piece)
                body = piece[open_mark.end() : len(piece) - len(CLOSE)]
                state["turns"] += 1
                state["all"].update(f"{unescape(open_mark[1])}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    text = unescape(piece[a - start : b - start])
                    state["loss"] += len(text)
                    state["mask"].update(text.encode("utf-8", "surrogatepass"))
            if closed:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*closed, strict=True), arrow, strict=True)], schema=arrow)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    ordered = pieces.select("conv_id", "turn_no", "piece", "start_char", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return ordered.mapInArrow(each, out)
