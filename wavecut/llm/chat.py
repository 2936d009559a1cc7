"""Chat formatting by token-level assembly.

Every turn is encoded by itself and reserved ids, which no text can encode to, are spliced in between:

    <s> [INST] role [/INST] text </s> [INST] role [/INST] text </s> ...

Token offsets and loss spans are prefix sums over the turns of a conversation.  In the rendered string the
control strings are literal, so their occurrences inside a text are escaped: a backslash goes before each, and
backslashes that would touch a control string or the end of the text are doubled.  Encoded texts carry the escapes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (BOS, EOS, OPEN, CLOSE)
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*)({_ANY})|(\\+)\Z")
_READ = re.compile(rf"(\\*)({_ANY})")
_TAIL = re.compile(r"(\\+)\Z")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved_ids(path: str) -> dict[str, int]:
    """Ids of the control strings: the first free ones after the vocabulary."""
    first = encoding(path).n_vocab
    return {c: first + k for k, c in enumerate(CONTROLS)}


def escape(text: str) -> str:
    """Makes a text safe between control strings; ``unescape`` gives it back."""

    def one(m: re.Match) -> str:
        return m[1] * 2 + "\\" + m[2] if m[2] else m[3] * 2

    return _ESCAPE.sub(one, text)


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        return "\\" * (len(m[1]) // 2) + m[2]

    return _READ.sub(one, _TAIL.sub(lambda m: "\\" * (len(m[1]) // 2), text))


def split_rendered(text: str) -> list[str]:
    """Control strings and unescaped texts of a rendered conversation, in order.

    A control string after an even number of backslashes is one of the template.
    """
    out, at = [], 0
    for m in _READ.finditer(text):
        if len(m[1]) % 2 == 0:
            out += [unescape(text[at:m.start(2)]), m[2]]
            at = m.end()
    return [*out, text[at:]]


def format_turns(
    conversations: DataFrame, ranks: str, trained: tuple[str, ...] = ("assistant",), conv: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv_id, turn_no, ids, start, loss_start, loss_end`` of each turn; one conversation is its turns in order.

    ``start``: ids of the conversation before the turn.  ``loss_start`` and ``loss_end``: span of the ids
    that are trained on, an empty one for other roles; only the text is trained on, not the control ids.
    Turns are encoded where they lie, and only their lengths meet in the window of a conversation.
    NULL role and text: empty.  NULL turns come first, equal turns in the order of role and text.  NULL
    conversation ids are one conversation.  Repeated rows are turns of their own.  An empty table gives no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, special = encoding(ranks), reserved_ids(ranks)
        for batch in batches:
            out, before, after = [], [], []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                head = [special[OPEN], *bpe.encode_ordinary(escape(r)), special[CLOSE]]
                body = bpe.encode_ordinary(escape(t))
                out.append([*head, *body, special[EOS]])
                before.append(len(head))
                after.append(len(body) if r in trained else 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.list_(pa.int32())), pa.array(before, pa.int32()), pa.array(after, pa.int32())],
                names=[*batch.schema.names, "ids", "head", "body"],
            )

    rows = conversations.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    coded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, head int, body int")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    first = F.col("turn_no") == 0
    numbered = coded.withColumn("turn_no", F.row_number().over(order).cast("bigint") - 1).withColumn(
        "start", F.coalesce(F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # The opening id belongs to the first turn; later turns are one id further on.
    ids = F.when(first, F.concat(F.array(F.lit(reserved_ids(ranks)[BOS])), "ids")).otherwise(F.col("ids"))
    head = F.col("head") + F.when(first, 1).otherwise(0)
    return numbered.select(
        "conv_id", "turn_no", ids.alias("ids"),
        (F.col("start") + F.when(first, 0).otherwise(1)).alias("start"),
        (F.col("start") + F.when(first, 0).otherwise(1) + head).alias("loss_start"),
        (F.col("start") + F.when(first, 0).otherwise(1) + head + F.col("body")).alias("loss_end"),
    )


def read_back(formatted: DataFrame, ranks: str) -> DataFrame:
    """Digests of each conversation, decoded from the ids and loss spans alone.

    The turns of a conversation pass in order, one by one, and only running digests are kept.
    """
    columns = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_tokens long, loss_tokens long"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, special = encoding(ranks), reserved_ids(ranks)
        state = None

        def row() -> tuple:
            return (state["id"], state["turns"], state["sha"].hexdigest(), state["chars"], state["loss"].hexdigest(),
                    state["rendered"], state["tokens"], state["trained"])

        for batch in batches:
            done = []
            convs, starts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            lo, hi = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for k, conv in enumerate(convs):
                ids = batch.column(1)[k].values.to_numpy()
                if state is None or starts[k] == 0:
                    if state is not None:
                        done.append(row())
                    state = {"id": conv, "turns": 0, "sha": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(),
                             "rendered": 0, "tokens": 0, "trained": 0}
                if state["tokens"] != starts[k]:
                    raise ValueError(f"conversation {conv}: a turn starts at {starts[k]}, not {state['tokens']}")
                marks = np.flatnonzero(ids >= special[BOS])
                opened, closed, ended = (int(marks[ids[marks] == special[c]][0]) for c in (OPEN, CLOSE, EOS))
                role = bpe.decode(ids[opened + 1:closed].tolist())
                body = bpe.decode(ids[closed + 1:ended].tolist())
                state["sha"].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                state["turns"] += 1
                state["rendered"] += len(role) + len(body) + sum(len(CONTROLS[i - special[BOS]]) for i in ids[marks].tolist())
                trained = unescape(bpe.decode(ids[lo[k] - starts[k]:hi[k] - starts[k]].tolist()))
                state["chars"] += len(trained)
                state["loss"].update(trained.encode())
                state["tokens"] += len(ids)
                state["trained"] += hi[k] - lo[k]
            yield _digests(done)
        if state is not None:
            yield _digests([row()])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in columns.split(", ")]
        )

    rows = formatted.select("conv_id", "ids", "start", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(read, columns)


def render(formatted: DataFrame, ranks: str) -> DataFrame:
    """``conv_id, turn_no, rendered``: the string form of each turn, control strings in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, special = encoding(ranks), reserved_ids(ranks)
        names = {v: k for k, v in special.items()}
        for batch in batches:
            out = []
            for ids in batch.column(2).to_pylist():
                cuts = [i for i, x in enumerate(ids) if x in names]
                parts, at = [], 0
                for i in cuts:
                    parts += [bpe.decode(ids[at:i]), names[ids[i]]]
                    at = i + 1
                out.append("".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["conv_id", "turn_no", "rendered"])

    return formatted.select("conv_id", "turn_no", "ids").mapInArrow(run, "conv_id long, turn_no long, rendered string")


def format_and_read_back(conversations: DataFrame, ranks: str, folder: str | None = None) -> DataFrame:
    """Writes the formatted turns and returns the digests read from the written table."""
    folder = folder or run_path(conversations.sparkSession, "chat")
    return read_back(written(format_turns(conversations, ranks), f"{folder}/formatted"), ranks)
