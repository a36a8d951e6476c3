"""Token counts of a sentencepiece BPE model by prefix dynamic programming.

The exact number of tokens of every prefix of a text follows from the last token of that prefix (prefixdp.py).  White
space is a symbol of the model that stands only at the start of its pieces, so a text is cut before each run of it and the
counts of the parts add up; parts that recur come from a bounded cache.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, text_or_empty
from .prefixdp import PrefixTable, Vocabulary

#: The model's mark for a space.
SPACE = "▁"
units_of = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"


class Counter:
    """Counts tokens as the library does: a space is put before the text, unknown characters fall back to bytes."""

    def __init__(self, path: str, cache: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        ranks = {model.id_to_piece(i): n for n, i in enumerate(order)}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in ranks):
            raise ValueError("a piece holds a space after another character")
        self.known = {c for c in ranks if len(c) == 1}
        if set("".join(ranks)) - self.known:
            raise ValueError("a piece holds a character that is no piece")
        if "\n" in self.known or not model.is_byte(model.piece_to_id("<0x0A>")):
            raise ValueError("line ends must fall back to bytes")
        self.vocabulary = Vocabulary(ranks)
        self.units = UnitCache(self._count, cache)
        self.spaced = UnitCache(lambda word: self._count(SPACE + word), cache)
        #: Runs of characters that the model has or has not.
        self.runs = regex.compile(f"[{''.join(map(regex.escape, sorted(self.known)))}]+|(?s:.)").findall

    def prefix_counts(self, unit: str) -> list[int]:
        """The number of tokens of every prefix of a unit, the empty one first."""
        out = [0]
        for run in self.runs(unit):
            if run[0] in self.known:
                base = out[-1]
                out += [base + n for n in PrefixTable(self.vocabulary, run).counts()[1:]]
            else:
                out.append(out[-1] + len(run.encode()))
        return out

    def _count(self, unit: str) -> int:
        return self.prefix_counts(unit)[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " ":
            return sum(map(self.units.__getitem__, units_of(SPACE + text.replace(" ", SPACE))))
        lines = text.split("\n")
        words = lines[0].split(" ")
        total = len(lines) - 1 + sum(map(self.spaced.__getitem__, words))
        for line in lines[1:]:
            words = line.split(" ")
            if words[0]:
                total += self.units[words[0]]
            total += sum(map(self.spaced.__getitem__, words[1:]))
        return total


    def unit(self, unit: str) -> int:
        """The number of tokens of one of a text's units, by the same parts and caches as `count`."""
        head, *rest = unit.split("\n")
        total = len(rest) + sum(self.units[part] for part in rest if part)
        if head[:1] == SPACE and SPACE not in head[1:]:
            return total + self.spaced[head[1:]]
        return total + self.units[head] if head else total


class Budget:
    """Answers for one text: tokens of any prefix, and the longest prefix within a number of tokens."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.units = counter, units_of(SPACE + text.replace(" ", SPACE)) if text else []
        self.starts, self.bases = [0], [0]
        for unit in self.units:
            self.starts.append(self.starts[-1] + len(unit))
            self.bases.append(self.bases[-1] + counter.unit(unit))

    def count(self, end: int) -> int:
        """Tokens of text[:end]."""
        if not end or not self.units:
            return 0
        at = min(end + 1, self.starts[-1])
        k = min(bisect_right(self.starts, at) - 1, len(self.units) - 1)
        return self.bases[k] + self.counter.prefix_counts(self.units[k])[at - self.starts[k]]

    def longest(self, budget: int) -> int:
        """The length of the longest prefix of at most `budget` tokens."""
        if self.bases[-1] <= budget:
            return max(0, self.starts[-1] - 1)
        k = max(0, bisect_right(self.bases, budget - 1) - 1)
        inner = self.counter.prefix_counts(self.units[k])
        fits = [n for n, count in enumerate(inner) if self.bases[k] + count <= budget]
        return max(0, self.starts[k] + (fits[-1] if fits else 0) - 1)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit, and fits_chars, the characters of the longest prefix within limit.

    A null text counts as empty: 0 bytes and tokens.  A null id stays null, repeated rows are counted each, other columns
    are left out whatever their names, and an empty table gives an empty one.
    """

    def run(batches):
        import pyarrow as pa

        tool = counter(path)
        for batch in batches:
            sizes, counts, fits = [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                n = tool.count(text)
                counts.append(n)
                sizes.append(len(text.encode()))
                fits.append(len(text) if n <= limit else Budget(tool, text).longest(limit))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, counts)), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, SCHEMA)
