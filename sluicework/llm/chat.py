"""Chat formatting over typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor walks them in order; text is escaped,
every other part becomes a placeholder, and its reference is recorded with its place and the number of
tokens that it expands to. A part of a type not known here gets a placeholder of its own and no tokens, unless it
brings a count. The template marks the start of a turn, the end of its role and the end of its
text. Escaping puts a backslash behind the first letter of each control string inside a text and doubles
backslashes, so no control string is left and the text comes back whole.

Turns are formatted row by row. Where a conversation is read back, its turns lie together in a sorted
stream and only hash states are held, so a conversation of any length fits.

Cases: null text and null role count as empty; a null part list is the text alone; null parts are left out and
parts without type are text; turns are ordered by
turn, then role, then text, nulls first; a null conversation id is a conversation of its own; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

START, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
#: Control strings of this template and of common ones, which texts may not hold.
CONTROL = (START, SAYS, END, *PLACEHOLDERS.values(), OTHER, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """The text without control strings."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    out, i = [], 0
    while (at := text.find("\\", i)) >= 0:
        if text.startswith("\\\\", at):  # a doubled backslash
            out.append(text[i : at + 1])
            i = at + 2
        else:  # one behind the first letter of a control string
            out.append(text[i:at])
            i = at + 1
    return "".join(out) + text[i:]


class PartVisitor:
    """Flattens the parts of a turn, in order."""

    def __init__(self, tokens: dict[str, int] | None = None) -> None:
        self.tokens = {"image": 256, "audio": 128, "document": 512} | (tokens or {})
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_attachment)(part)

    def add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit_text(self, part: dict) -> None:
        self.add(escape(part.get("text") or ""))

    def visit_attachment(self, part: dict) -> None:
        kind = part["type"]
        count = part.get("tokens")
        self.attachments.append(
            {"kind": kind, "ref": part.get("ref"), "place": self.size, "tokens": int(self.tokens.get(kind, 0) if count is None else count)}
        )
        self.add(PLACEHOLDERS.get(kind, OTHER))


def format_turn(role: str, parts: list[dict], learn: bool, tokens: dict[str, int] | None = None) -> dict:
    """``formatted``, ``loss_start``, ``loss_end`` (code points), ``attachments`` and ``expanded_tokens``."""
    visitor = PartVisitor(tokens)
    head = f"{START}{escape(role)}{SAYS}"
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.out)
    found = [a | {"place": a["place"] + len(head)} for a in visitor.attachments]
    start = len(head)
    return {
        "formatted": f"{head}{body}{END}",
        "loss_start": start,
        "loss_end": start + len(body) if learn else start,
        "attachments": found,
        "expanded_tokens": sum(a["tokens"] for a in found),
    }


SCHEMA = (
    "conv_id long, turn long, formatted string, loss_start int, loss_end int, "
    "attachments array<struct<kind:string,ref:string,place:int,tokens:int>>, expanded_tokens long"
)
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int32())]))


PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def text_parts(text):
    """A column of part lists that hold one text part each."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
    return F.array(part).cast(PARTS)


def format_turns(df: DataFrame, learn_role: str = "assistant", parts_col: str | None = None) -> DataFrame:
    """Formatted turns of a table ``conv_id, turn, role, text``, sorted within each conversation.

    ``parts_col`` may name a column ``array<struct<type,text,ref,tokens>>`` that takes the place of text.
    """
    part = F.lit(None).cast(PARTS) if parts_col is None else F.col(parts_col)
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), part.alias("parts"))
    # the sort stands before formatting, so formatted turns leave it in order
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        for batch in batches:
            ids, made = [], []
            for conv, turn, role, text, parts in rows_of(batch):
                ids.append((conv, turn))
                made.append(format_turn(role or "", parts if parts is not None else [{"type": "text", "text": text}], role == learn_role))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i[0] for i in ids], type=pa.int64()),
                    pa.array([i[1] for i in ids], type=pa.int64()),
                    pa.array([m["formatted"] for m in made], type=pa.string()),
                    pa.array([m["loss_start"] for m in made], type=pa.int32()),
                    pa.array([m["loss_end"] for m in made], type=pa.int32()),
                    pa.array([m["attachments"] for m in made], type=_KIND),
                    pa.array([m["expanded_tokens"] for m in made], type=pa.int64()),
                ],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    return rows.mapInArrow(run, SCHEMA)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted turns."""
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition(SAYS)
        yield unescape(role), unescape(rest.removesuffix(END))


_PLACEHOLDER = re.compile("(" + "|".join(re.escape(p) for p in (*PLACEHOLDERS.values(), OTHER)) + ")")


def parse_parts(formatted: str, attachments: list[dict]) -> list[dict]:
    """The typed parts of one formatted turn: texts and, in order, what its attachments were."""
    start, end = formatted.index(SAYS) + len(SAYS), len(formatted) - len(END)
    kept = iter(attachments)
    out = []
    for piece in _PLACEHOLDER.split(formatted[start:end]):
        if _PLACEHOLDER.fullmatch(piece):
            found = next(kept)
            out.append({"type": found["kind"], "ref": found["ref"], "tokens": found["tokens"]})
        elif piece:
            out.append({"type": "text", "text": unescape(piece)})
    return out


def attachments(formatted: DataFrame) -> DataFrame:
    """``conv_id, turn, place, kind, ref, tokens``: one row for each attachment of ``format_turns`` output."""
    return formatted.select("conv_id", "turn", F.explode("attachments").alias("a")).select("conv_id", "turn", "a.place", "a.kind", "a.ref", "a.tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests and sums of each conversation, from ``format_turns`` output still in its order."""

    def run(batches):
        now, state = None, None
        done: list[tuple] = []

        def close():
            done.append((now[0], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["held"], state["tokens"]))

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
            out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], type=k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv, text, start, end, held, tokens in rows_of(batch):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = (conv,)
                    state = {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "held": 0, "tokens": 0}
                for role, said in parse_turns(text):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learnt = unescape(text[start:end])
                state["chars"] += len(learnt)
                state["loss"].update(learnt.encode("utf-8", "surrogatepass"))
                state["size"] += len(text)
                state["held"] += held
                state["tokens"] += tokens
            if done:
                yield flush()
        if now is not None:
            close()
            yield flush()

    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    return formatted.select("conv_id", "formatted", "loss_start", "loss_end", F.size("attachments"), "expanded_tokens").mapInArrow(run, shape)
