"""Byte-level BPE by dynamic programming over prefixes.

Text is cut by the tokenizer's pattern and each match is encoded by a table of its prefixes' last tokens (prefixdp.py).
Matches that recur come from a bounded cache.  Decoding joins the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, UnitCache, portions, text_or_empty
from .prefixdp import PrefixTable, Vocabulary

#: Cuts text where no match of the split pattern crosses: a word with the space before it, or white space.
units_of = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall

#: White space other than single spaces and single line ends.
ODD_WHITE = ["  ", "\n\n", " \n", "\n ", *(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)) and chr(c) not in " \n")]

ENCODE_SCHEMA = "doc_id long, n_tokens long, ids array<int>"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    """Encodes and decodes whole texts: each match of the split pattern by its own prefix table."""

    def __init__(self, path: str, pattern: str, cache: int = 150_000):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = Vocabulary(ranks)
        self.pieces_of = regex.compile(pattern).findall
        self.pieces = UnitCache(self.piece, 2 * cache)
        self.units = UnitCache(self._unit, cache // 8)
        self.spaced = UnitCache(lambda word: self._unit(" " + word), cache)
        self.bytes = [self.vocabulary.text.get(i, "").encode("latin-1") for i in range(self.vocabulary.step)]
        self.digits = [str(i) for i in range(len(self.bytes))]

    def piece(self, piece: str) -> tuple[int, ...]:
        """A match that is a token as a whole is that token, as the library has it."""
        data = piece.encode().decode("latin-1")
        whole = self.vocabulary.ranks.get(data)
        return (whole,) if whole is not None else tuple(PrefixTable(self.vocabulary, data).tokens())

    def _unit(self, unit: str) -> tuple[int, ...]:
        found = self.pieces_of(unit)
        if len(found) == 1:
            return self.pieces[unit]
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        units = self.units.__getitem__
        if any(map(text.__contains__, ODD_WHITE)):
            return list(chain.from_iterable(map(units, units_of(text))))
        # single spaces and line ends only: a space goes with the word after it, a line end stands alone
        spaced, out = self.spaced.__getitem__, []
        for n, line in enumerate(text.split("\n")):
            if n:
                out += units("\n")
            words = line.split(" ")
            if words[0]:
                out += units(words[0])
            out += chain.from_iterable(map(spaced, words[1:]))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, pattern)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id, n_tokens, ids.

    A null text counts as empty and has no tokens; a null id stays null; repeated rows are encoded each; other columns
    are left out, whatever their names; an empty table gives an empty one.
    """

    def run(batches):
        import pyarrow as pa

        coder = encoder(path, pattern)
        for some in portions(batches):
            ids = [pa.array(coder.encode(t), pa.int32()) for t in some.column(1).to_pylist()]
            sizes = np.array([0, *map(len, ids)], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.concat_arrays(ids))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes[1:], pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, ENCODE_SCHEMA)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bytes of every row of ids: doc_id, decoded.  Null ids decode to no bytes."""

    def run(batches):
        import pyarrow as pa

        coder = encoder(path, pattern)
        for batch in portions(batches):
            out = [coder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Edge cases as in `encode`.  Both directions run in one pass, so no array of ids leaves the worker.
    """

    def run(batches):
        import pyarrow as pa

        coder = encoder(path, pattern)
        digits, sha = coder.digits, hashlib.sha256
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha(coder.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, DIGEST_SCHEMA)
