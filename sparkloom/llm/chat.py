r"""Chat formatting: conversations into token-budgeted, turn-aligned windows with a loss mask.

Template: each turn is ``### role: text</turn>`` and a line end.  Inside roles and
texts a backslash goes before every backslash and ``#``, between the two
characters of ``</``, and (in roles) before ``:`` and line ends, so neither mark
can occur there and unescaping is dropping the backslashes.

Windows: prefix sums of turn tokens (by a byte-level BPE vocabulary) choose the
longest run of new turns that fits the budget beside the system turn (the conversation's first turn, if its role is
system) and the repeated history, the latest earlier turns within its own budget.
A turn that fits no window stands in one alone, over budget, whole.  The mask
covers each assistant text once: in the window where its turn is new.

Rows are dealt by conversation and sorted by turn; Python streams them and holds
one window at a time, however long a conversation is.  Spark's sort spills.  One
conversation is one stream in one task, since its windows follow each other; rows
without a conversation are dealt by their content.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.batches import gathered, rows_of, small_batches
from sparkloom.llm.common import table
from sparkloom.llm.stretches import regrouped

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:\n]|\\[\s\S])*): ((?:[^\\<]|\\[\s\S]|<(?!/))*)</turn>\n")


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and of the history repeated in it."""

    window: int = 1024
    history: int = 256


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def escaped_role(role: str) -> str:
    return escaped(role).replace(":", "\\:").replace("\n", "\\\n")


def unescaped(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


#: Tokens that a turn is charged for its marks, besides those of its role and text.
MARKS = 8


def charges(roles: pa.Array, texts: pa.Array, codec: bpe.Codec) -> list[int]:
    """What each turn is charged: the tokens of its role and its text by a vocabulary, and its marks."""
    return [len(r) + len(t) + MARKS for r, t in zip(codec.ids_of(roles), codec.ids_of(texts), strict=True)]


def render(turns: list[tuple[str, str]], first_new: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of a window and the spans (start, end) of its new assistant texts."""
    out, at, spans = [], 0, []
    for k, (role, text) in enumerate(turns):
        head, body = OPEN + escaped_role(role) + SEP, escaped(text)
        if k >= first_new and role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn, as they were before escaping."""
    at = 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        yield unescaped(m[1]), unescaped(m[2])
        at = m.end()


def windows_of(turns: Iterable[tuple[str, str, int]], b: Budget) -> Iterator[tuple[str, list[tuple[int, int]], int, int]]:
    """(text, loss spans, turns repeated, new turns) of each window of turns (role, text, tokens); holds one window and the history."""
    system: tuple[str, str, int] | None = None
    retained: list[tuple[str, str, int]] = []  # the system turn, from the second window on
    history: list[tuple[str, str, int]] = []
    new: list[tuple[str, str, int]] = []
    # Prefix sums: tokens of what stands before the new turns, and of those so far.
    ahead = total = 0

    def window() -> tuple[str, list[tuple[int, int]], int, int]:
        before = retained + history
        return *render([(r, t) for r, t, _ in before + new], len(before)), len(before), len(new)

    for k, turn in enumerate(turns):
        if k == 0 and turn[0] == "system":
            system = turn
        total += turn[2]
        if new and ahead + total > b.window:
            yield window()
            shown = history + (new[1:] if system and not retained else new)
            retained = [system] if system else []
            ahead = system[2] if system else 0
            room = min(b.history, b.window - ahead - turn[2])
            history, new, total = [], [], turn[2]
            for old in reversed(shown):
                if old[2] > room:
                    break
                history.append(old)
                room -= old[2]
                ahead += old[2]
            history.reverse()
        new.append(turn)
    if new:
        yield window()


_WINDOW = "conv_id long, window long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, n_repeated long, n_new long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("loss_spans", _SPANS), ("n_repeated", pa.int64()), ("n_new", pa.int64())])


def format_windows(conversations: DataFrame, path: str, budget: Budget = Budget()) -> DataFrame:
    """The windows of each conversation, in order within a partition; path is a vocabulary of ranks (.tiktoken).

    Null roles and texts count as empty.  A row with a null conv_id is a
    conversation of its own; null turns come first; turns of one number follow
    each other by role and text; repeated rows are repeated turns.  An empty
    table gives no window.  Other columns are dropped.
    """
    small_batches(conversations.sparkSession)
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def charged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path, bpe.PATTERN)
        for x in regrouped(batches, 3):
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(charges(x.column(2), x.column(3), codec), pa.int64())], names=[*x.schema.names, "n_tokens"])

    c = c.mapInArrow(charged, f"conv_id long, turn {c.schema['turn'].dataType.simpleString()}, role string, text string, n_tokens long")
    c = c.withColumn("deal", F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).repartition(n, "deal").sortWithinPartitions("conv_id", "turn", "role", "text")
    c = c.select("conv_id", "role", "text", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = itertools.count()

        def rows() -> Iterator[tuple]:
            for (conv, _), turns in itertools.groupby(rows_of(batches, "conv_id", "role", "text", "n_tokens"), lambda r: (r[0], next(alone) if r[0] is None else None)):
                for k, (text, spans, repeated, new) in enumerate(windows_of((r[1:] for r in turns), budget)):
                    yield conv, k, text, [{"start": a, "end": e} for a, e in spans], repeated, new

        return gathered(rows(), _SCHEMA, lambda r: len(r[2]))

    return c.mapInArrow(run, _WINDOW)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation's turns and of the text under the mask, parsed from windows in the order format_windows leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.string() if "string" in x else pa.int64()) for x in _DIGEST.split(", ")])

        def rows() -> Iterator[tuple]:
            number = itertools.count(1)
            first = 0  # windows without a conversation: each that is numbered 0 begins another

            def conversation(r: tuple) -> tuple:
                nonlocal first
                if r[0] is None and r[4] == 0:
                    first = next(number)
                return r[0], first if r[0] is None else 0

            for (conv, _), own in itertools.groupby(rows_of(batches, "conv_id", "formatted", "loss_spans", "n_repeated", "window"), conversation):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = chars = total = count = 0
                for _, text, spans, repeated, _ in own:
                    for role, said in itertools.islice(parse(text), repeated, None):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans:
                        under = unescaped(text[s["start"] : s["end"]])
                        loss.update(under.encode())
                        chars += len(under)
                    total += len(text)
                    count += 1
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, count

        return gathered(rows(), schema)

    return windows.mapInArrow(run, _DIGEST)


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    import public_tokenizers

    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_windows(turns, public_tokenizers.path("byte_bpe_50k.tiktoken")))
