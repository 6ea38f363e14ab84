"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. The
turns of a conversation are rendered prefix by prefix; consecutive outputs are
compared, so each turn's span is what the longer output adds. An output that
does not start with the one before it shows a template that rewrites history.
Inside a span, rendering the turn once more with a probe as its text shows what
the template writes before and after it.

Null text and null role count as empty. Turns are ordered by turn, role and
text, so ties and repeated rows have one order; a null turn comes first. Rows
with a null conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PROBE = "probe"


def escape(text: str) -> str:
    """No control string is left in the result, which :func:`unescape` undoes."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def chatml(turns: list[Turn]) -> str:
    """The shipped template."""
    return "".join(f"{OPEN}{_escape_role(role)}\n{escape(text)}{CLOSE}" for role, text in turns)


def read_back(output: str) -> list[Turn]:
    """Turns of an output of :func:`chatml`."""
    turns = []
    for part in output.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((_unescape_role(role), unescape(rest[: -len(CLOSE)])))
    return turns


def render_incrementally(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """(output, spans, first rewritten turn or -1).

    A span is (start, text start, text end, end) of a turn in the output; spans
    end at the first turn whose prefix output does not extend the one before.
    """
    before, spans = template([]), []
    for k, (role, _) in enumerate(turns):
        after = template(turns[: k + 1])
        if not after.startswith(before):
            return template(turns), spans, k
        probed = template([*turns[:k], (role, PROBE)])
        at = probed.find(PROBE, len(before))
        if at < 0 or not probed.startswith(before):
            return template(turns), spans, k
        tail = len(probed) - at - len(PROBE)
        spans.append((len(before), at, len(after) - tail, len(after)))
        before = after
    return before, spans, -1


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Runs of rows with one id, across batches."""
    last, turns, any_row = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if any_row and conv != last:
                yield last, turns
                turns = []
            last, any_row = conv, True
            turns.append((role or "", text or ""))
    if any_row:
        yield last, turns


FORMATTED = (
    "conv_id long, output string, spans array<struct<start:int,text_start:int,text_end:int,end:int,role:string>>, "
    "loss array<struct<start:int,end:int>>, rewritten_at int"
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def _grouped(conversations: DataFrame) -> DataFrame:
    return (
        conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )


def format_chats(conversations: DataFrame, template: Template = chatml, loss_role: str = "assistant") -> DataFrame:
    """Output, spans and loss mask of every conversation."""

    def run(batches):
        schema = pa.schema(
            [
                ("conv_id", pa.int64()),
                ("output", pa.string()),
                ("spans", pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "text_start", "text_end", "end")] + [("role", pa.string())]))),
                ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ("rewritten_at", pa.int32()),
            ]
        )
        for conv, turns in _conversations(batches):
            output, spans, rewritten = render_incrementally(turns, template)
            named = [dict(zip(("start", "text_start", "text_end", "end"), s), role=turns[k][0]) for k, s in enumerate(spans)]
            loss = [{"start": s["text_start"], "end": s["text_end"]} for s in named if s["role"] == loss_role]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "output": output, "spans": named, "loss": loss, "rewritten_at": rewritten}], schema=schema)

    return _grouped(conversations).mapInArrow(run, FORMATTED)


def chat_digest(conversations: DataFrame, template: Template = chatml, reader=read_back, loss_role: str = "assistant") -> DataFrame:
    """The columns of query op5, all read back from the outputs."""

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
        rows: list[tuple] = []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=names
            )
            rows.clear()
            return batch

        for conv, turns in _conversations(batches):
            output, spans, rewritten = render_incrementally(turns, template)
            said = reader(output)
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in said).encode("utf-8", "surrogatepass")).hexdigest()
            loss = "".join(unescape(output[s[1] : s[2]]) for s, (role, _) in zip(spans, said) if role == loss_role)
            rows.append((conv, len(said), digest, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(output), rewritten >= 0))
            if len(rows) >= 1000:
                yield flush()
        if rows:
            yield flush()

    return _grouped(conversations).mapInArrow(run, DIGEST)
