"""Token counts by prefix dynamic programming, and the longest prefix that fits a token budget.

Every word's program holds the exact token count at each of its prefixes, so counts of whole texts are
sums over words, and how far a text can go within a budget is read from the sums and from the prefixes
of the word at which the budget ends, without encoding anything again.

Null and empty texts have no bytes and no tokens. Rows are independent of each other: repeated rows,
null ids and further columns change nothing. Texts are counted whole, in slices at edges of words; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pacewright.llm.merges import ByteMerges
from pacewright.llm.shared import in_python, only
from pacewright.llm.tokens import Slice, WordValues


class PrefixCounter:
    """Counts of tokens of texts and of their prefixes for one byte-level vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        import public_tokenizers

        self.rules = ByteMerges(name)
        self.values = WordValues(self.rules.counts, self.rules.special)
        self._parts = regex.compile("(" + "|".join(map(regex.escape, self.rules.special)) + ")").split
        self._words = regex.compile(public_tokenizers.PATTERN).findall

    def tail(self, text: str) -> int:
        """The tokens of a short piece of text that begins where a word begins."""
        return sum(i % 2 or sum(map(self.rules.count, self._words(part))) for i, part in enumerate(self._parts(text)))

    def fitting(self, s: Slice, k: int, running: np.ndarray, limit: int) -> int:
        """The code points of the longest prefix of text ``k`` of the slice with at most ``limit`` tokens.

        ``running`` holds the tokens before each of the slice's words. The budget ends inside one word, and
        the word's own prefixes have their counts. A cut can also change how the text near it is split: a
        space falls to the white space before it, a contraction or a special string falls apart. So cuts
        at the word's beginning, within special strings, and after the first character that follows white
        space are counted from three words before on; those words lie within the budget, so they are short.
        """
        a, b = int(s.word_at[k]), int(s.word_at[k + 1])
        over = a + int(np.searchsorted(running[a + 1 : b + 1] - running[a], limit, side="right"))
        first, last = int(s.char_at[k]), int(s.char_at[k + 1])
        if over >= b:
            return last - first
        begin = [int(x) for x in s.starts[over : min(b, over + 3)]] + [last] * 2
        start, stop, after = begin[0], begin[1], begin[2]

        def tokens(cut: int) -> int:
            j = max(a, a + int(np.searchsorted(s.starts[a:b], cut, side="right")) - 4)
            return int(running[j] - running[a]) + self.tail(s.text(int(s.starts[j]), cut))

        word, following = s.text(start, stop), s.text(stop, after)
        near, best = {*range(start, min(start + 4, last + 1))}, -1
        if word[-1].isspace():
            near.add(min(stop + 1, last))
        if following in self.rules.special:
            near |= {*range(stop + 1, after)}
        if word in self.rules.special:
            near |= {*range(start, stop)}
        elif stop - start > 4:
            left = limit - int(running[over] - running[a])
            best = max((start + i for i, c in enumerate(self.rules.counts_by_character(word)[:-1]) if i > 3 and c <= left), default=-1)
        best = next((cut for cut in sorted(near, reverse=True) if cut > best and tokens(cut) <= limit), best)
        while best < 0:  # even the cut before this word makes the white space there one longer word
            start -= 1
            if tokens(start) <= limit:
                best = start
        return best - first


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """One row per row of ``df``: its id, n_bytes, n_tokens, over_limit and fit_chars.

    ``fit_chars`` is the number of code points of the longest prefix of at most ``limit`` tokens
    (the whole text if it is not over the limit).
    """
    given = only(df, id=id_column, text=text_column)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            for s in counter.values.slices(batch.column(1)):
                running = np.concatenate(([0], np.cumsum(s.store.amount[s.place])))
                tokens = running[s.word_at[1:]] - running[s.word_at[:-1]]
                fit = np.diff(s.char_at)
                for k in np.flatnonzero(tokens > limit).tolist():
                    fit[k] = counter.fitting(s, k, running, limit)
                ids = batch.column(0).slice(s.row, len(tokens))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(s.byte_at)), pa.array(tokens), pa.array(tokens > limit), pa.array(fit)], names=["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    out = in_python(given, counted, f"id {given.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumnRenamed("id", id_column)


def prefix_table(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = "byte_bpe_50k.json") -> DataFrame:
    """For each text where its words end (code points) and the tokens up to there, as two arrays."""
    given = only(df, id=id_column, text=text_column)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            for s in counter.values.slices(batch.column(1)):
                amounts, ends, tokens = s.store.amount[s.place], [], []
                for k in range(len(s.word_at) - 1):
                    a, b = s.word_at[k], s.word_at[k + 1]
                    ends.append(np.append(s.starts[a + 1 : b], s.char_at[k + 1])[: b - a] - s.char_at[k])
                    tokens.append(np.cumsum(amounts[a:b]))
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.row, len(ends)), pa.array(ends, kind), pa.array(tokens, kind)], names=["id", "ends", "tokens"])

    out = in_python(given, counted, f"id {given.schema['id'].dataType.simpleString()}, ends array<long>, tokens array<long>")
    return out.withColumnRenamed("id", id_column)
