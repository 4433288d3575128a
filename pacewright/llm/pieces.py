"""SentencePiece encoding and decoding by a forward program that words share.

Spaces are written as marks, and no piece has a mark after another character, so a text falls into words
that begin with their marks (and further where two characters stand side by side in no piece) and are
encoded one by one. The different words are sorted, which lays them out
as a trie, and walked depth-first: the forward state of every prefix (its best last piece) is kept on a
stack and reused by all words that begin alike.

The vocabulary at hand ranks pieces by merge order, so the best segmentation of a prefix is the one that
merging gives, not the largest sum of scores; the forward state is therefore the one last piece that can
stand beside the last piece of the prefix before it (see ``merges``). Characters outside the vocabulary are
written as their UTF-8 bytes.

Null and empty texts have no ids. Rows are independent of each other: repeated rows, null ids and further columns
change nothing. Texts are taken whole, in slices at edges of words; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewright.llm.merges import MergeRules
from pacewright.llm.shared import in_python, only
from pacewright.llm.tokens import WordValues, gathered

MARK = "▁"


class PieceRules(MergeRules):
    """The rules of a ranked vocabulary of the ``sentencepiece`` library: two pieces merge if their joint text is one."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        import public_tokenizers
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        every = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(every)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self._order = {every[i]: -model.get_score(i) for i in plain}
        self.tokens = {every[i]: i for i in plain}
        self.longest = max(map(len, self.tokens))
        self.byte_ids = {int(every[i][3:5], 16): i for i in range(len(every)) if model.is_byte(i)}
        self.texts = [b""] * len(every)
        for piece, i in self.tokens.items():
            self.texts[i] = piece.encode()
        for b, i in self.byte_ids.items():
            self.texts[i] = bytes([b])
        self._parts: dict[str, tuple[str, str] | None] = {}

    def apart(self) -> np.ndarray:
        """For code points under 0x24F (the last row and column stand for all others): whether no piece has the two in a row."""
        table = np.ones((0x250, 0x250), dtype=bool)
        table[-1, :] = table[:, -1] = False
        for piece in self.tokens:
            for x, y in zip(piece, piece[1:], strict=False):
                x, y = (0x20 if c == MARK else ord(c) for c in (x, y))
                table[min(x, 0x24F), min(y, 0x24F)] = False
        return table

    def rank(self, left, right):
        return self._order.get(left + right)

    def parts(self, token):
        if len(token) == 1:
            return None
        if token not in self._parts:
            symbols = list(token)
            parts = None
            while len(symbols) > 1:
                ranks = [(r, k) for k in range(len(symbols) - 1) if (r := self.rank(symbols[k], symbols[k + 1])) is not None]
                if not ranks:
                    break
                k = min(ranks)[1]
                parts = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = ["".join(parts)]
            self._parts[token] = parts if len(symbols) == 1 else None
        return self._parts[token]

    def ids(self, words: list[str]) -> list[list[int]]:
        """Each word's ids; a word is given with spaces for marks."""
        out: list[list[int]] = [[]] * len(words)
        marked = [w.replace(" ", MARK) for w in words]
        for k, last, _ in self.shared(marked):
            found: list[int] = []
            end = len(marked[k])
            while end:
                piece = last[end]
                number = self.tokens.get(piece)
                found += [number] if number is not None else [self.byte_ids[b] for b in reversed(piece.encode())]
                end -= len(piece)
            out[k] = found[::-1]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, without the mark that encoding puts before a text."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", errors="replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def piece_values(name: str) -> tuple[PieceRules, WordValues]:
    """The rules of a vocabulary and a cache of words for them."""
    rules = PieceRules(name)
    return rules, WordValues(rules.ids, apart=rules.apart())


def piece_ids(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, ids) per row of ``df``: the text's ids as an array."""
    given = only(df, id=id_column, text=text_column).withColumn("text", F.expr("if(text = '', text, concat(' ', text))"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, values = piece_values(model)
        for batch in batches:
            for s in values.slices(batch.column(1)):
                ids, at = gathered(s)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.row, len(lists)), lists], names=["id", "ids"])

    out = in_python(given, encoded, f"id {given.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_column)


def decoded_pieces(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, text) per row of ``encoded``; null ids give a null text."""
    given = only(encoded, id=id_column, ids=ids_column)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, _ = piece_values(model)
        for batch in batches:
            texts = [None if ids.as_py() is None else rules.decoded(ids.values.to_pylist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    out = in_python(given, decoded, f"id {given.schema['id'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("id", id_column)


def piece_round_trip(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, n_tokens, ids_crc32, decoded_chars, round_trip) per row of ``df``: a text encoded and decoded again.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers.
    """
    given = only(df, id=id_column, text=text_column).withColumn("text", F.expr("if(text = '', text, concat(' ', text))"))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, values = piece_values(model)
        for batch in batches:
            for s in values.slices(batch.column(1)):
                ids, at = gathered(s)
                rows: list[tuple] = []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = ids[a:b]
                    text = rules.decoded(own.tolist())
                    rows.append((b - a, zlib.crc32(own.astype("<u4").tobytes()), len(text), text == s.text(int(s.char_at[k]), int(s.char_at[k + 1]))[1:]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.row, len(rows)), *columns], names=["id", "n_tokens", "ids_crc32", "decoded_chars", "round_trip"])

    out = in_python(given, tried, f"id {given.schema['id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")
    return out.withColumnRenamed("id", id_column)
