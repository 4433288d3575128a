"""Byte-pair encoding as a forward program over prefixes.

The encoding of a prefix is that of a shorter prefix and one more token, and two neighbouring tokens
can stand side by side only if encoding their joint text gives them back. So each prefix has exactly
one last token, found from the last tokens of shorter prefixes; its token count follows. Whether two
tokens can be neighbours depends on the tokens alone and is remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import inf
from os.path import commonprefix

from pacewright.llm.tokens import letters_of_bytes

NEIGHBOURS = 2_000_000


class MergeRules:
    """Tokens (as strings of symbols), the rank of merging two of them, and how each was merged."""

    tokens: dict[str, int]
    longest: int

    def __init__(self):
        self._fits: dict[tuple[str, str], bool] = {}
        self._spines: dict[tuple[str, bool], list] = {}

    def rank(self, left: str, right: str) -> float | None:
        raise NotImplementedError

    def parts(self, token: str) -> tuple[str, str] | None:
        """The two tokens that ``token`` is merged from; None for a single symbol."""
        raise NotImplementedError

    def spine(self, token: str, right: bool) -> list[tuple[str, float, float]]:
        """The tokens that stand at one end of ``token`` while it is built: (token, rank that makes it, rank that uses it up)."""
        key = (token, right)
        found = self._spines.get(key)
        if found is None:
            found, used = [], inf
            while True:
                parts = self.parts(token)
                made = self.rank(*parts) if parts else -1
                found.append((token, made, used))
                if not parts:
                    break
                token, used = parts[right], made
            self._spines[key] = found
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether no merge across the seam comes before the merges that make ``left`` and ``right``.

        Of merges of the same rank the leftmost comes first: inside ``left``, at the seam, inside ``right``.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            known = all(len(t) == 1 or self.parts(t) for t in key)
            for x, x_made, x_used in self.spine(left, True):
                for y, y_made, y_used in self.spine(right, False):
                    if x_made <= y_used and y_made < x_used:
                        r = self.rank(x, y)
                        if r is not None and r < x_used and r <= y_used:
                            known = False
                            break
                if not known:
                    break
            if len(self._fits) >= NEIGHBOURS:
                self._fits.clear()
            self._fits[key] = known
        return known

    def step(self, word: str, end: int, last: list, count: list) -> None:
        """Appends the last token of ``word[:end]`` and its count of tokens, from those of shorter prefixes."""
        tokens, known = self.tokens, self._fits
        for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
            token = word[begin:end]
            if token in tokens:
                if begin:
                    fits = known.get((last[begin], token))
                    if fits is None:
                        fits = self.fits(last[begin], token)
                    if not fits:
                        continue
                elif end > 1 and not self.parts(token):  # listed, but merging never makes it
                    continue
                last.append(token)
                count.append(count[begin] + 1)
                return
        last.append(word[end - 1])  # a symbol outside the vocabulary stands alone
        count.append(count[end - 1] + 1)

    def prefixes(self, word: str) -> tuple[list, list[int]]:
        """The last token and the token count of every prefix of ``word``, the empty one included."""
        last, count = [None], [0]
        for end in range(1, len(word) + 1):
            self.step(word, end, last, count)
        return last, count

    def shared(self, words: list[str]) -> Iterator[tuple[int, list, list[int]]]:
        """``prefixes`` of many words as (number, last, count), in sorted order.

        That is a depth-first walk through the trie of the words: what two neighbours share at
        their beginning is computed once. The lists are valid until the next step.
        """
        last, count = [None], [0]
        before = ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            common = len(before) if word.startswith(before) else len(commonprefix((before, word)))
            del last[common + 1 :], count[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                self.step(word, end, last, count)
            before = word
            yield k, last, count


class ByteMerges(MergeRules):
    """The rules of a byte-level vocabulary file of the ``tokenizers`` library."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        import public_tokenizers

        super().__init__()
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            stored = json.load(f)
        self.special = tuple(t["content"] for t in stored["added_tokens"])
        self.tokens = stored["model"]["vocab"]
        self.longest = max(map(len, self.tokens))
        self._rank = {(a, b): k for k, (a, b) in enumerate(stored["model"]["merges"])}
        self._parts = {a + b: (a, b) for a, b in self._rank}
        self._letters = letters_of_bytes()

    def rank(self, left, right):
        return self._rank.get((left, right))

    def parts(self, token):
        return self._parts.get(token)

    def symbols(self, word: str) -> str:
        """The word's bytes in the vocabulary's letters."""
        return word.encode().decode("latin-1").translate(self._letters)

    def count(self, word: str) -> int:
        return 1 if word in self.special else self.prefixes(self.symbols(word))[1][-1]

    def counts(self, words: list[str]) -> list[int]:
        out = [1] * len(words)
        for k, _, count in self.shared(["" if w in self.special else self.symbols(w) for w in words]):
            if len(count) > 1:
                out[k] = count[-1]
        return out

    def counts_by_character(self, word: str) -> list[int]:
        """The token count of every prefix of whole characters of ``word``, the empty one included."""
        counts = self.prefixes(self.symbols(word))[1]
        at, out = 0, [0]
        for c in word:
            at += len(c.encode())
            out.append(counts[at])
        return out
