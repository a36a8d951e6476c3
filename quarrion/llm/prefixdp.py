"""Prefix dynamic programming over BPE vocabularies.

For a string p of symbols and a BPE vocabulary, the encoding of every prefix p[:i] ends in exactly one token, `last[i]`.
It is the one token t that is a suffix of p[:i] and may stand after last[i - len(t)].  Two tokens may stand side by side
if merging their joined symbols by rank gives back the same two tokens.  The table of last tokens gives the encoding of
any prefix by walking back, grows by appends without touching earlier entries, and after an edit is recomputed only from
the edit to where it agrees with the old table again.

Symbols are the characters of a str; byte-level vocabularies hold their bytes as the characters of latin-1.
"""

from __future__ import annotations

import ahocorasick


class Vocabulary:
    """Tokens with ranks, and which tokens may be neighbours.

    ranks: of each token, by its text.  Tokens are named by their rank; the ranks of single symbols only name them.
    """

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.text = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._left: dict[int, tuple[int, ...]] = {}
        self._right: dict[int, tuple[int, ...]] = {}
        self.width = {r: len(t) for r, t in self.text.items()}
        self.suffixes = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.suffixes.add_word(t, r)
        self.suffixes.make_automaton()
        #: Whether two tokens may be neighbours, by first * step + second; the first is step - 1 at the start of the text.
        self.step = max(self.text) + 2
        self.pairs: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single symbols and for tokens that no merge makes."""
        if token not in self._parts:
            whole, found = self.text[token], None
            for cut in range(1, len(whole)):
                a, b = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if a is None or b is None or cut > 1 and a > token or cut < len(whole) - 1 and b > token:
                    continue
                if self.made(a) and self.made(b) and self._compatible(a, b, True):
                    found = (a, b)
                    break
            self._parts[token] = found
        return self._parts[token]

    def made(self, token: int) -> bool:
        return len(self.text[token]) == 1 or self.parts(token) is not None

    def _spine(self, token: int, side: int) -> tuple[int, ...]:
        """The token, then its part on that side, and so on to a single symbol."""
        known = self._right if side else self._left
        if token not in known:
            out = [token]
            while (parts := self.parts(out[-1])) is not None:
                out.append(parts[side])
            known[token] = tuple(out)
        return known[token]

    def _compatible(self, a: int, b: int, below: bool = False) -> bool:
        """Whether no merge ever crosses the border between a and b; below: the merge of a and b themselves is allowed.

        The pairs that face each other across the border are visited from the last to the first.  A pair (x, y) merges
        if its rank comes before the merges that take x and y away: at equal ranks the one further left goes first.
        """
        left, right, text = self._spine(a, 1), self._spine(b, 0), self.text
        i = j = 0
        endless = 1 << 60
        while True:
            x, y = left[i], right[j]
            rank = self.ranks.get(text[x] + text[y])
            if rank is not None and not (below and not i and not j):
                if rank < (left[i - 1] if i else endless) and rank <= (right[j - 1] if j else endless):
                    return False
            made_x = x if i + 1 < len(left) else -1
            made_y = y if j + 1 < len(right) else -1
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i += 1
            else:
                j += 1

    def neighbours(self, a: int, b: int) -> bool:
        return self.made(b) and self._compatible(a, b)


class PrefixTable:
    """The last token of every prefix of a string, kept through appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: str = ""):
        self.vocabulary, self.data, self.last, self.width = vocabulary, "", [vocabulary.step - 1], [0]
        self.append(data)

    def append(self, more: str) -> None:
        begin = len(self.data)
        self.data += more
        self._extend(begin, len(self.data))

    def _extend(self, begin: int, end: int) -> None:
        """Fill the entries begin + 1 to end."""
        words, last = self.vocabulary, self.last
        pairs, step, size, width = words.pairs, words.step, words.width, self.width
        if len(pairs) > 1_000_000:
            pairs.clear()
        first = max(0, begin - words.longest + 1)
        at, shown = begin, begin - first
        for where, token in words.suffixes.iter(self.data[first:end]):
            if where != shown:
                if where < shown:  # known: before the new part, or its one token is found
                    continue
                break
            start = at + 1 - size[token]
            before = last[start]
            fits = pairs.get(before * step + token)
            if fits is None:
                fits = pairs[before * step + token] = words.neighbours(before, token) if start else words.made(token)
            if fits:
                last.append(token)
                width.append(size[token])
                at += 1
                shown += 1
        if at != end:
            raise ValueError("the vocabulary lacks a single symbol")

    def replace(self, start: int, end: int, new: str) -> int:
        """Put new in place of data[start:end]; returns how many entries were computed anew."""
        old_last, old_width, shift = self.last, self.width, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, self.width = old_last[: start + 1], old_width[: start + 1]
        done, reach, at = 0, self.vocabulary.longest, start
        while at < len(self.data):
            # a block up to the end of the new symbols, then blocks of the reach of one entry
            to = min(len(self.data), max(start + len(new), at) + reach)
            self._extend(at, to)
            done, at, low = done + to - at, to, to - reach
            # an entry depends on the last `reach` symbols and entries: once all of them agree, the rest does
            if low >= start + len(new) and self.last[low + 1 :] == old_last[low + 1 - shift : to + 1 - shift]:
                self.last += old_last[to + 1 - shift :]
                self.width += old_width[to + 1 - shift :]
                break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of data[:end]."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= self.width[at]
        return out[::-1]

    def counts(self) -> list[int]:
        """The number of tokens of every prefix."""
        out = [0] * len(self.last)
        for at in range(1, len(out)):
            out[at] = out[at - self.width[at]] + 1
        return out
