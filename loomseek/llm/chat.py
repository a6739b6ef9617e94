"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
trainable. Turns that no assistant turn follows make one last example without a target, so nothing is lost.

A turn reads ``<turn ROLE>TEXT</turn>`` and a newline; inside roles and texts ``\\``, ``<`` and ``>`` get a
``\\`` before them, so no text can open or close a turn, and ``read_turns`` gives back the exact texts.

Turns stand in the order of (turn, role, text), nulls first; a null role or text counts as empty, a null
conv_id as a conversation of its own, and repeated rows are turns of their own. Only the role ``assistant``
is trainable. A conversation streams through one task batch by batch and holds its own formatted text only: an example holds all
turns before it, so one conversation is one ordered stream and cannot be dealt to several tasks, and its output grows with the square of
its turns. Rows with a null conv_id are one conversation likewise. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm import common

ASSISTANT = "assistant"
OPEN, MID, CLOSE = "<turn ", ">", "</turn>\n"
_BODY = r"([^\\<>]*(?:\\.[^\\<>]*)*)"
_TURN = re.compile(rf"{OPEN}{_BODY}{MID}{_BODY}{CLOSE}", re.DOTALL)
EXAMPLE = "conv_id long, example int, context_turns int, formatted string, target_start long, target_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
#: Characters of output after which a batch is passed on.
FLUSH = 4 << 20
#: A conversation whose texts imitate control strings.
PROBE = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", ASSISTANT))]


def escape(text: str) -> str:
    return re.sub(r"([\\<>])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that the formatted text holds; raises ValueError if it is anything else."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _batches(rows: Iterable[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + (len(r[weigh]) if r[weigh] else 0)
        if size > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("context_turns", pa.int32()), ("formatted", pa.string()), ("target_start", pa.int64()), ("target_end", pa.int64())])

    def rows() -> Iterator[tuple]:
        conv, parts, chars, turns, made, loose = object(), [], 0, 0, 0, False
        for b in batches:
            for key, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if key != conv:
                    if loose:
                        yield conv, made, turns, "".join(parts), None, None
                    conv, parts, chars, turns, made = key, [], 0, 0, 0
                head, body = f"{OPEN}{escape(role)}{MID}", escape(text)
                parts.append(head + body + CLOSE)
                loose = role != ASSISTANT
                if not loose:
                    yield conv, made, turns, "".join(parts), chars + len(head), chars + len(head) + len(body)
                    made += 1
                chars, turns = chars + len(parts[-1]), turns + 1
        if loose:
            yield conv, made, turns, "".join(parts), None, None

    yield from _batches(rows(), schema, 3)


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row for each example: its formatted text, the span of the text under the loss mask (code points; null if none), and the number of turns before the target."""
    c = conversations
    turns = c.select(c["conv_id"].cast("long").alias("conv_id"), F.coalesce(c["role"], F.lit("")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"), c["turn"].alias("turn"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLE)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])

    def rows() -> Iterator[tuple]:
        conv, state = object(), None
        for b in batches:
            for key, formatted, start, end in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "formatted", "target_start", "target_end")), strict=True):
                if key != conv:
                    if state:
                        yield _closed(conv, state)
                    conv, state = key, {"turns": 0, "sha": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "before": "", "n": 0}
                # an example starts with the one before it; only what is new has to be read
                new = formatted[len(state["before"]) :] if formatted.startswith(state["before"]) else formatted
                for role, text in read_turns(new):
                    state["turns"] += 1
                    state["sha"].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescape(formatted[start:end])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["all"] += len(formatted)
                state["n"] += 1
                state["before"] = formatted
        if state:
            yield _closed(conv, state)

    yield from _batches(rows(), schema, 2)


def _closed(conv: int | None, s: dict) -> tuple:
    return conv, s["turns"], s["sha"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"], s["n"]


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold. Examples of a conversation must follow each other, as ``prefix_targets`` leaves them."""
    return examples.mapInArrow(_digest, DIGEST)


def op2(spark, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    common.small_batches(spark)
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(prefix_targets(rows.unionByName(probe)))


SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(15 + length(regexp_replace(role, '([\\<>])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<>])', '\\\1', 'g'))) OVER w AS upto
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM turns GROUP BY conv_id
"""
