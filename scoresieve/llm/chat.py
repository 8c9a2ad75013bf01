"""Chat formatting from event logs: fold deltas, edits and regenerations into messages, then render them."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events. message: opens a message with its text. delta: is appended to the turn's message, or opens it.
#: edit: replaces the text that the turn's message has so far. regenerate: the turn's message and all later turns,
#: as logged so far, are void, and the turn starts anew with the text.
EVENTS = ("message", "delta", "edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """A turn is ``open role \\n text close``. Strings in control never occur inside an escaped role or text.

    Escaping doubles backslashes and puts one after the first character of each control string; in roles also one before \\n.
    """

    open: str = "<s>"
    close: str = "</s>\n"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
    learns: str = "assistant"

    def escape(self, s: str) -> str:
        pattern = "(?=" + "|".join(map(re.escape, self.control)) + ")(.)"
        return re.sub(pattern, r"\1\\", s.replace("\\", "\\\\"), flags=re.DOTALL)

    def unescape(self, s: str) -> str:
        return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn, and where its text starts and ends in it."""
        head = self.open + self.escape(role).replace("\n", "\\\n") + "\n"
        body = self.escape(text)
        return head + body + self.close, len(head), len(head) + len(body)

    def parse(self, turn: str) -> tuple[str, str]:
        if not (turn.startswith(self.open) and turn.endswith(self.close)):
            raise ValueError("not a turn of this template")
        inner = turn[len(self.open) : len(turn) - len(self.close)]
        head = re.match(r"(?:\\.|[^\\\n])*", inner, re.DOTALL)[0]
        return self.unescape(head), self.unescape(inner[len(head) + 1 :])


def _turns(template: Template):
    def run(batches):
        """Events sorted by conversation, turn and sequence: fold each message, render it. Memory holds one message."""
        none = object()
        conv = none
        turn = role = None
        parts: list[str] | None = None
        number = at = 0

        def flush():
            nonlocal number, at, parts
            if parts is None:
                return []
            text, a, b = template.render(role or "", "".join(parts))
            mask = [{"start": at + a, "end": at + b}] if role == template.learns else []
            row = {"conv_id": conv, "position": number, "at": at, "formatted": text, "loss": mask}
            number, at, parts = number + 1, at + len(text), None
            return [row]

        out, size = [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("at", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for batch in batches:
            for c, t, r, kind, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if c != conv or conv is none or t != turn or kind in ("message", "regenerate"):
                    done = flush()
                    out += done
                    size += sum(len(x["formatted"]) for x in done)
                    if c != conv or conv is none:
                        number = at = 0
                    conv, turn = c, t
                if parts is None:
                    role, parts = r, []
                if kind == "edit":
                    parts = []
                parts.append(text or "")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        out += flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


TURN = "conv_id long, position long, at long, formatted string, loss array<struct<start:long,end:long>>"


def rendered(events: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each turn of the final conversations; a conversation's text is its turns' by position, joined.

    events: conv_id, turn and seq (integers), role, event (see EVENTS; null is message), text. Returns conv_id,
    position (from 0), at (code points before it in the conversation), formatted, and loss: spans in the
    conversation, in code points, of what an assistant says.

    Events are partitioned by conversation and sorted by sequence; a backward pass drops what a later regeneration
    voids, a forward pass over turns folds and renders. Both stream, so a conversation of any length needs the
    memory of one message. Null texts are empty; null roles are the empty role; rows with a null conv_id are one
    conversation, null turns come first. Events of the same turn and sequence go by role, event and text;
    repeated message events are messages each. Only the named columns are read.
    """
    template = template or Template()
    log = events.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"), F.col("seq").cast("long").alias("s"), "role", F.coalesce("event", F.lit("message")).alias("event"), "text")
    later = Window.partitionBy("c").orderBy(F.desc("s"), F.desc("t"), F.desc("role"), F.desc("event"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("void", F.min(F.when(F.col("event") == "regenerate", F.col("t"))).over(later))
    log = log.where(F.col("void").isNull() | (F.coalesce("t", F.lit(-(2**63))) < F.col("void")))
    log = log.sortWithinPartitions("c", "t", "s", "role", "event", "text").select("c", "t", "role", "event", "text")
    return log.mapInArrow(_turns(template), TURN)


def _digests(template: Template):
    def run(batches):
        none = object()
        conv, out = none, []
        turns = loss = None
        n = learned = chars = 0

        def flush():
            return [] if conv is none else [{"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": learned, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}]

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            for c, at, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv or conv is none:
                    out += flush()
                    conv, turns, loss, n, learned, chars = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, said = template.parse(text)
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans or []:
                    own = template.unescape(text[span["start"] - at : span["end"] - at])
                    learned += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
                n, chars = n + 1, chars + len(text)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        out += flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Read rendered turns back: for each conversation the number of turns, digests of its turns and of what is under the loss mask, and sizes."""
    rows = turns.select("conv_id", "at", "formatted", "loss", "position").repartition("conv_id").sortWithinPartitions("conv_id", "position").drop("position")
    return rows.mapInArrow(_digests(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(turns: DataFrame) -> DataFrame:
    """Rendered turns joined to one row for each conversation: conv_id, formatted, loss. Each must fit into one row."""
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "formatted", "loss"))).alias("p"))
    return parts.select("conv_id", F.array_join("p.formatted", "").alias("formatted"), F.flatten("p.loss").alias("loss"))
