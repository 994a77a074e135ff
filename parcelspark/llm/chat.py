"""Chat formatting by grammar round trip.

A conversation is rendered as turns `<|im_start|>role NEWLINE text<|im_end|> NEWLINE` and parsed again. Turns that do
not come back as they were are escaped, and the rendering is repeated until the parse equals the source. Escaping puts
one more backslash into each `<` `|` pair with any number of backslashes between; the parser takes one out of each
such pair that has one, so any text can be carried, and texts without control strings stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_escape = re.compile(r"<(\\*)\|")
_unescape = re.compile(r"<\\(\\*)\|")
#: Neither a role nor a text holds a control string, of this template or another one: `<|`, a name, `|>`.
_plain = r"(?:(?!<\|\w+\|>)%s)*"
_turn = re.compile(rf"<\|im_start\|>({_plain % '[^\n]'})\n({_plain % '.'})<\|im_end\|>\n", re.S | re.A)


def escape(text: str) -> str:
    return _escape.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line: its line breaks and percent signs are written as codes."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, from, to) per turn, from and to the place of the text as it stands; None if it is no rendering."""
    out, at = [], 0
    while at < len(rendered):
        m = _turn.match(rendered, at)
        if not m:
            return None
        out.append((unescape_role(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


def render(turns: list[tuple[str, str]]) -> str:
    """The rendering that parses back to `turns`, with as few turns escaped as the round trips find necessary."""
    escaped: set[int] = set()
    while True:
        parts = [f"{START}{escape_role(r)}\n{escape(t) if i in escaped else t}{END}\n" for i, (r, t) in enumerate(turns)]
        rendered = "".join(parts)
        found = parse(rendered)
        if found is not None and [x[:2] for x in found] == turns:
            return rendered
        # A turn that does not survive on its own conflicts; if all do, every turn is escaped.
        wrong = {i for i, (t, p) in enumerate(zip(turns, parts, strict=True)) if [x[:2] for x in parse(p) or []] != [t]}
        escaped = (escaped | wrong) if wrong - escaped else set(range(len(turns)))


def format_conversations(
    conversations: DataFrame, trained: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points [from, to) of the trained roles' texts).

    Turns come in the order of turn, then role and text, so repeated turn numbers have a defined order; repeated rows
    are turns of their own. Null roles and texts are empty; a null conv_id is a conversation. Other columns are ignored.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column("turns").to_pylist():
                rendered = render([(t["role"], t["text"]) for t in turns])
                texts.append(rendered)
                spans.append([{"from": a, "to": b} for r, _, a, b in parse(rendered) if r in trained])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                names=["conv_id", "formatted", "loss_spans"],
            )

    return whole.mapInArrow(run, f"conv_id {dict(whole.dtypes)['conv_id']}, formatted string, loss_spans array<struct<from:int,to:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of format_conversations() output, read from its texts and spans alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["from"] : s["to"]]) for s in spans)
                own = "".join(f"{r}\n{t}\n" for r, t, *_ in turns)
                rows.append((len(turns), hashlib.sha256(own.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
