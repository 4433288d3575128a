"""Chat formatting with loss masks that are aligned by offsets.

A conversation's turns are rendered with three control strings, ``<|start|>role<|text|>text<|end|>``, and
the whole rendering is encoded once, with the control strings as tokens of their own, so no token reaches
over an edge of a turn. The spans of the assistant's texts, sorted as they are, are intersected with the
sorted token spans by binary search; tokens inside are under the loss mask.

Inside roles and texts ``<|`` is written ``<\\|``, and ``<\\|`` as ``<\\\\|`` and so on, so no control string
can occur there; reading back takes one backslash off again.

Turns are ordered by (turn, role, text), nulls first; rows that come twice are turns that come twice; null
roles and texts are empty; rows without conversation id form one conversation with a null id. A
conversation is one row and is rendered in one task; other rows of the table do not share it. Texts are rendered
whole, further columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewright.llm.shared import in_python, only
from pacewright.llm.tokens import TextEncoder, gathered

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<\\" in text else text


def rendered(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and the sorted spans of the texts of the role that is learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escaped(role) + TEXT, escaped(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def loss_mask(begins: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the spans (rows of first and one-after-last place); both are sorted."""
    first, last = np.searchsorted(begins, spans[:, 0], side="left"), np.searchsorted(ends, spans[:, 1], side="right")
    some = first < last
    edges = np.zeros(len(begins) + 1, dtype=np.int32)
    edges[first[some]] += 1
    edges[last[some]] -= 1
    return np.cumsum(edges[:-1]) > 0


def _formatted(batches: Iterator[pa.RecordBatch], model: str, learned: str) -> Iterator[pa.RecordBatch]:
    """Batches (conv_id, formatted, ids, begins, ends, loss) of batches (conv_id, roles, texts)."""
    encoder = TextEncoder(model, control=(START, TEXT, END))
    for batch in batches:
        bounds = batch.column(1).offsets.to_numpy().tolist()
        turns = list(zip(batch.column(1).values.to_pylist(), batch.column(2).values.to_pylist(), strict=True))
        done = [rendered(turns[a:b], learned) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        column = pa.array([text for text, _ in done], pa.large_string())
        for s in encoder.slices(column):
            ids, at = gathered(s)
            begins, ends = encoder.offsets(s, ids)
            n = len(s.char_at) - 1
            spans = [(int(start) + a, int(start) + b) for start, (_, own) in zip(s.char_at, done[s.row : s.row + n], strict=False) for a, b in own]
            loss = loss_mask(begins, ends, np.array(spans, dtype=np.int64).reshape(-1, 2))
            own = np.repeat(s.char_at[:-1], np.diff(at))  # places within each conversation's text
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (ids.astype(np.int32), (begins - own).astype(np.int32), (ends - own).astype(np.int32), loss)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.row, n), column.slice(s.row, n).cast(pa.string()), *lists], names=["conv_id", "formatted", "ids", "begins", "ends", "loss"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of digests of formatted ones."""
    for batch in batches:
        begins, ends, loss = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("begins", "ends", "loss"))
        sizes = pc.fill_null(pc.list_value_length(batch.column("loss")), 0).to_numpy()
        # runs of tokens under the mask; every conversation begins with a control string, so none reaches over two
        edges = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        row = np.searchsorted(np.cumsum(sizes), edges[:, 0], side="right")
        runs: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
        for k, a, b in zip(row.tolist(), begins[edges[:, 0]].tolist(), ends[edges[:, 1] - 1].tolist(), strict=True):
            runs[k].append((a, b))
        rows: list[tuple] = []
        for text, own in zip(batch.column("formatted").to_pylist(), runs, strict=True):
            turns = read_back(text)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            learned = "".join(unescaped(text[a:b]) for a, b in own)
            rows.append((len(turns), _sha(said), len(learned), _sha(learned), len(text)))
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


_DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _conversations(df: DataFrame) -> tuple[DataFrame, str]:
    """(conv_id, roles, texts) per conversation, and the type of its id."""
    given = only(df, conv_id="conv_id", turn="turn", role="role", text="text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = given.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts")), given.schema["conv_id"].dataType.simpleString()


def formatted_conversations(df: DataFrame, model: str = "byte_bpe_50k.json", learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, ids, begins, ends, loss) per conversation of (conv_id, turn, role, text) rows:
    the rendering, its token ids, each token's span of code points, and whether it is under the loss mask."""
    whole, kind = _conversations(df)
    return in_python(whole, lambda batches: _formatted(batches, model, learned), f"conv_id {kind}, formatted string, ids array<int>, begins array<int>, ends array<int>, loss array<boolean>")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the output of ``formatted_conversations`` reads back as, in counts and SHA-256 digests."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return in_python(formatted.select("conv_id", "formatted", "begins", "ends", "loss"), _digests, f"conv_id {kind}, {_DIGESTS}")


def formatted_digests(df: DataFrame, model: str = "byte_bpe_50k.json", learned: str = "assistant") -> DataFrame:
    """The digests of ``formatted_conversations``'s output, taken where it is made."""
    whole, kind = _conversations(df)
    return in_python(whole, lambda batches: _digests(_formatted(batches, model, learned)), f"conv_id {kind}, {_DIGESTS}")


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescaped(role), unescaped(body)) for role, body in _TURN.findall(text)]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
