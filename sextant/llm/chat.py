"""Chat formatting from an event log.

A conversation's log is folded into its final messages: streamed deltas are
appended, edits replace, and a regeneration discards a message with all that
followed.  The messages are rendered with a reversible template, in segments of
bounded size, beside the spans that a training loss covers.

The fold is native: one row per message tells up to when regenerations discard
it, then one group per message, so a long conversation is folded by many tasks.
Segments are rendered by many tasks too, since each holds a fixed range of places.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import slices

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; none may stand unescaped in a text.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"
#: Characters after which a segment of a conversation ends, at the next turn.
SEGMENT_CHARS = 1 << 20
#: Places of a conversation that one chunk of segments holds; segments of a chunk.
CHUNK, CHUNK_SEGMENTS = 512, 1 << 20
#: Characters of a streamed delta.
DELTA_CHARS = 48

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: A control string, or one with backslashes after its first character.
_ESCAPABLE = re.compile(rf"([<\[])(\\*)({_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_REST})")


def escape(text: str) -> str:
    """One backslash more after the first character of each control string."""
    return _ESCAPABLE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(log: DataFrame) -> DataFrame:
    """Final messages of every conversation: ``conv_id, place, role, text``.

    log: conv_id, seq (order of events), kind, place (the message's position in
    its conversation), role, text.  In order of seq, ``message`` starts a message
    anew, ``delta`` appends to it, ``edit`` replaces its text, and ``regenerate``
    discards the message at its place and all at later places, as they were at
    that moment.  The role is that of the message's first event that counts.
    Null texts are empty, null roles empty; events of equal seq apply by kind and
    text, null ones first.  An unknown kind counts as ``message``.
    """
    rows = log.select("conv_id", "place", F.coalesce(F.col("seq").cast("bigint"), F.lit(-(1 << 62))).alias("seq"), F.coalesce("kind", F.lit(MESSAGE)).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    again = rows.groupBy("conv_id", "place").agg(F.max(F.when(F.col("kind") == REGENERATE, F.col("seq"))).alias("again"))
    until = F.max("again").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    discarded = again.select(F.col("conv_id").alias("d_conv"), F.col("place").alias("d_place"), until.alias("until")).filter("until is not null")
    same = rows["conv_id"].eqNullSafe(discarded["d_conv"]) & rows["place"].eqNullSafe(discarded["d_place"])
    live = rows.join(discarded, same, "left").filter((F.col("until").isNull() | (F.col("seq") > F.col("until"))) & (F.col("kind") != REGENERATE))
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role")))
    found = live.groupBy("conv_id", "place").agg(events.alias("events"))
    start = F.greatest(F.lit(1), F.array_max(F.transform("events", lambda e, k: F.when(e["kind"] == DELTA, 0).otherwise(k + 1))))  # the last that sets the text anew
    text = F.array_join(F.transform(F.slice("events", start, F.size("events")), lambda e: e["text"]), "")
    return found.select("conv_id", "place", F.col("events")[0]["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame, segment_chars: int = SEGMENT_CHARS, chunk: int = CHUNK) -> DataFrame:
    """Formatted conversations: ``conv_id, segment, text, loss``.

    loss holds the spans (start, end) of each segment's text, in characters, that
    are texts of the assistant.  Segments of a conversation are in order of their
    numbers, which have gaps; a segment ends at a turn's end, after ``chunk`` places
    or segment_chars characters, so however long a conversation is, many tasks
    render it.
    """
    rows = messages.select("conv_id", F.floor(F.coalesce("place", F.lit(0)) / chunk).cast("bigint").alias("chunk"), "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "place")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, segment, parts, size, loss, begun = None, 0, [], 0, [], False
        out: list[tuple] = []
        names = ["conv_id", "segment", "text", "loss"]
        types = [None, pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        held = 0

        def table() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in slices(batches):
            id_type = batch.schema.field("conv_id").type
            for c, number, _, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if begun and ((c, number) != at or size >= segment_chars):
                    out.append((at[0], at[1] * CHUNK_SEGMENTS + segment, "".join(parts), loss))
                    held += size
                    segment = segment + 1 if (c, number) == at else 0
                    parts, size, loss = [], 0, []
                    if len(out) >= 500 or held >= segment_chars:
                        yield table()
                        out, held = [], 0
                at, begun = (c, number), True
                head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
                if role == LEARNED_ROLE:
                    loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
                parts += [head, body, CLOSE, "\n"]
                size += len(head) + len(body) + len(CLOSE) + 1
        if begun:
            out.append((at[0], at[1] * CHUNK_SEGMENTS + segment, "".join(parts), loss))
            yield table()

    return rows.mapInArrow(run, f"conv_id {kind}, segment bigint, text string, loss array<struct<start:bigint,end:bigint>>")


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted text."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("not a formatted conversation")
        line = text.index("\n", at)
        end = text.index(CLOSE, line + 1)
        yield unescape_role(text[at + len(OPEN) : line]), unescape(text[line + 1 : end])
        at = end + len(CLOSE) + 1


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns, digests and lengths of each conversation, parsed from ``render``'s
    output: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_segments``.  A digest runs over a conversation in order, so
    its segments come to one task, sorted, and are parsed one at a time."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        turns = loss = None
        counts = [0, 0, 0, 0]
        out: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_segments"]

        def close() -> tuple:
            return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3]

        for batch in slices(batches):
            id_type = batch.schema.field("conv_id").type
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for c, _, text, spans in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append(close())
                    conv, begun, turns, loss, counts = c, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    counts[0] += 1
                for s in spans:
                    learned = unescape(text[s["start"] : s["end"]])
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                    counts[1] += len(learned)
                counts[2] += len(text)
                counts[3] += 1
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if begun:
            out.append(close())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_segments bigint")


def log_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", streamed: bool = False) -> DataFrame:
    """An event log of a table of turns, in order of turn; rows that repeat a turn
    follow each other by role and text.

    Each turn is one ``message``, or, streamed, what a chat service would log: a
    message and deltas of DELTA_CHARS characters.  Of these, a third of the turns
    is first said otherwise and set right by an ``edit`` after the last turn, and a
    third of the assistant's is said otherwise, regenerated, and said again: half of
    them at once, half after the next turn, which is then said again as well.
    """
    named = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = named.withColumn("place", F.row_number().over(along))
    if not streamed:
        return rows.select("conv_id", F.col("place").alias("seq"), F.lit(MESSAGE).alias("kind"), "place", "role", "text")
    chance = F.pmod(F.xxhash64("conv_id", "place"), F.lit(6))
    learned = F.coalesce(F.col("role") == LEARNED_ROLE, F.lit(False))
    late = learned & (chance == 4)
    rows = rows.withColumn("late", late).withColumn("again", F.coalesce(F.lag("late").over(along), F.lit(False)))
    text, slot = F.coalesce("text", F.lit("")), 1 << 22  # events that a saying has at most
    base = F.col("place").cast("bigint") * (16 * slot)
    own = base + F.when(F.col("again"), 6 * slot).otherwise(0)  # after what the turn before does below

    def said(what: Column, first: Column) -> Column:
        """A message and its deltas, one after another, in time linear in the text."""
        parts = F.regexp_extract_all(what, F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
        parts = F.when(what == "", F.array(F.lit(""))).otherwise(parts)
        return F.transform(parts, lambda x, k: F.struct((first + k).alias("seq"), F.when(k == 0, MESSAGE).otherwise(DELTA).alias("kind"), x.alias("text")))

    def event(seq: Column, name: str, what: Column) -> Column:
        return F.array(F.struct(seq.cast("bigint").alias("seq"), F.lit(name).alias("kind"), what.alias("text")))

    draft = F.concat(F.reverse(text), F.lit(" ..."))
    none = F.lit(None).cast("string")
    log = (
        F.when(chance < 2, F.concat(said(draft, own), event(F.lit(1 << 60) + F.col("place"), EDIT, text)))
        .when(F.col("late"), F.concat(said(draft, own), event(base + 20 * slot, REGENERATE, none), said(text, base + 21 * slot)))
        .when(learned & (chance == 5), F.concat(said(draft, own), event(own + slot, REGENERATE, none), said(text, own + 2 * slot)))
        .otherwise(said(text, own))
    )
    log = F.when(F.col("again"), F.concat(said(draft, base), log)).otherwise(log)  # the first saying, which the turn before discards
    return rows.select("conv_id", "place", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "e.kind", "place", "role", "e.text")
