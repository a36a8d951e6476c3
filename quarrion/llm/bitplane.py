"""Token ids in binary files of compressed planes.

A file holds the ids of a run of documents in order, cut into blocks of a fixed number of ids.  Each block is transposed
into byte planes (the first bytes of all ids, then the second ones, ...) or bit planes, and each plane is compressed with
zstandard by itself, so the planes of high bytes, which hardly change, nearly vanish.  An index at the end names the place
of every plane of every block and the documents with their lengths, so any block can be read alone.

Layout: MAGIC, planes of the blocks, index (JSON, zstandard), length of the index as 8 bytes, MAGIC.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache, partial

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, open_read, open_write, scratch, text_or_empty

MAGIC = b"QBPLANE1"
BLOCK = 1 << 16
MANIFEST = "part int, uri string, n_docs long, n_ids long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Takes documents one by one; memory holds one block and the index."""

    def __init__(self, out, block: int = BLOCK, kind: str = "byte", level: int = 3):
        import zstandard

        self.out, self.block, self.kind, self.pack = out, block, kind, zstandard.ZstdCompressor(level=level).compress
        self.at, self.buffer, self.blocks, self.docs, self.sizes, self.total = len(MAGIC), bytearray(), [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.buffer += ids
        step = 4 * self.block
        while len(self.buffer) >= step:
            self._flush(bytes(self.buffer[:step]))
            del self.buffer[:step]

    def _flush(self, data: bytes) -> None:
        ids = np.frombuffer(data, "<u4")
        packed = [self.pack(p) if any(p) else b"" for p in to_planes(ids, self.kind)]
        self.blocks.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.buffer:
            self._flush(bytes(self.buffer))
        index = self.pack(json.dumps({"kind": self.kind, "blocks": self.blocks, "docs": self.docs, "sizes": self.sizes}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(0, os.SEEK_END)
        end = file.tell()
        file.seek(end - 16)
        size, magic = struct.unpack("<Q8s", file.read(16))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        file.seek(end - 16 - size)
        self.index = json.loads(self.unpack(file.read(size)))

    def block(self, k: int) -> np.ndarray:
        """The ids of block k alone."""
        at, n, sizes = self.index["blocks"][k]
        self.file.seek(at)
        empty = bytes(n if self.index["kind"] == "byte" else (n + 7) // 8)
        return from_planes([self.unpack(self.file.read(s)) if s else empty for s in sizes], n, self.index["kind"])

    def documents(self):
        """(doc_id, place of its first id in the file, chunks of its ids) in order; one block is held at a time."""
        k, left, place = 0, np.empty(0, "<u4"), 0
        for doc_id, size in zip(self.index["docs"], self.index["sizes"]):
            chunks, need = [], size
            while need:
                if not len(left):
                    left, k = self.block(k), k + 1
                chunks.append(left[:need])
                left = left[need:]
                need -= len(chunks[-1])
            yield doc_id, place, chunks
            place += size


#: The steps before the model for which PLAIN texts can be cut here: fixed values of the format of the file.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: White space, printable ASCII and the Latin letters with one code point each: composing changes none of them, and each is
#: lowered by itself.
PLAIN = re.compile(r"[\t-\r !-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*").fullmatch
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^\t-\r a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+").findall

#: The character that the byte-level step puts for each byte: printable ones of Latin-1 stay, others come from U+0100 on.
_STAY = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_MARKS = {**{b: b for b in _STAY}, **{b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _STAY)}}


def marked(piece: str) -> str:
    """The bytes of a piece of a PLAIN text without white space, as the model's vocabulary writes them."""
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_MARKS)


class Units:
    """Ids by unit of text, from a bounded cache: two generations of about `limit` units, so what recurs stays."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.now, self.old = encode, limit, {}, {}

    def __call__(self, lists: list[list[str]]) -> list[bytes]:
        """The joined ids of each list; units that are missing are encoded with one call."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        missing = set().union(*lists).difference(now)
        new = []
        for unit in missing:
            ids = old.get(unit)
            if ids is None:
                new.append(unit)
            else:
                now[unit] = ids
        if new:
            now.update(zip(new, self.encode(new)))
        return [b"".join(map(now.__getitem__, units)) for units in lists]


class BatchTokenizer:
    """Encodes by parts that the tokenizer never joins.

    Where a file has KNOWN_STEPS, a plain text is lowered and cut to pieces here, and only pieces not seen before go to the
    model, by themselves: all steps before it are done here.  Of other texts the words, which white space parts, go through the whole tokenizer; a text with the beginning of a
    special token goes through it whole.
    """

    #: Texts are encoded together up to so many characters.
    TOGETHER = 500_000

    def __init__(self, path: str, cache: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        steps = json.loads(self.tool.to_str())
        self.special = [t["content"][:2] for t in steps["added_tokens"]]
        self.split = regex.compile(f"[^{WHITE}]+").findall
        self.words, self.pieces = Units(partial(self._ids, self.tool), cache // 4), None
        if all(steps[k] == v for k, v in KNOWN_STEPS.items()) and steps["post_processor"] is None:
            self.pieces = Units(partial(self._model_ids, self.tool.model), 2 * cache)

    @staticmethod
    def _ids(tool, units: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in tool.encode_batch_fast(units, add_special_tokens=False)]

    @staticmethod
    def _model_ids(model, pieces: list[str]) -> list[bytes]:
        tokenize = model.tokenize
        return [array("I", [x.id for x in tokenize(marked(p))]).tobytes() for p in pieces]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        for some in self._portions(texts):
            kinds: dict[str, list[int]] = {"whole": [], "pieces": [], "words": []}
            for k in some:
                special = any(map(texts[k].__contains__, self.special))
                kinds["whole" if special else "pieces" if self.pieces and PLAIN(texts[k]) else "words"].append(k)
            for k in kinds["whole"]:
                out[k] = self._ids(self.tool, [texts[k]])[0]
            for at, units, cut in ((kinds["pieces"], self.pieces, lambda t: PIECES(t.lower())), (kinds["words"], self.words, self.split)):
                if at:
                    for k, ids in zip(at, units([cut(texts[k]) for k in at])):
                        out[k] = ids
        return out

    def _portions(self, texts: list[str]):
        some, size = [], 0
        for k, text in enumerate(texts):
            some.append(k)
            size += len(text)
            if size >= self.TOGETHER:
                yield some
                some, size = [], 0
        if some:
            yield some


@lru_cache(maxsize=4)
def tokenizer(path: str) -> BatchTokenizer:
    return BatchTokenizer(path)


def write_planes(docs: DataFrame, path: str, end_id: int, folder: str, kind: str = "byte", block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id, and write the ids in ascending id order, one file for each range of ids.

    Returns the manifest (part, uri, n_docs, n_ids), one row for each file.  A null text gives end_id alone; rows of a
    null id come first; repeated rows are written each, ties of an id in the order of a hash of their texts; other columns
    are left out, whatever their names; long texts are encoded whole; an empty table writes no file.
    """

    def run(batches):
        import pyarrow as pa

        part, tool, end = TaskContext.get().partitionId(), tokenizer(path), struct.pack("<I", end_id)
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri = f"{folder}/part-{part:06d}.planes"
        with open_write(uri) as out:
            writer, batch = PlaneWriter(out, block, kind), first
            while batch is not None:
                for begin in range(0, batch.num_rows, 256):
                    some = batch.slice(begin, 256)
                    for doc_id, ids in zip(some.column(0).to_pylist(), tool.encode_all(some.column(1).to_pylist())):
                        writer.add(doc_id, ids + end)
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "uri": uri, "n_docs": len(writer.docs), "n_ids": writer.total}],
            schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # the hash keeps rows of one id, or without one, from being one range; the texts order them within it
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    manifest = ordered.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_planes(manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as u32, little endian)."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for uri, base in zip(frame["uri"], frame["base"]):
                with open_read(uri) as file:
                    rows = []
                    for doc_id, place, chunks in PlaneReader(file).documents():
                        crc, size = 0, 0
                        for chunk in chunks:
                            crc = zlib.crc32(chunk.tobytes(), crc)
                            size += len(chunk)
                        rows.append((doc_id, base + place, size, crc))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    spark = manifest.sparkSession
    # one row for each file: as many as there were tasks
    files, placed, base = manifest.orderBy("part").collect(), [], 0
    for f in files:
        placed.append((f.uri, base))
        base += f.n_ids
    if not placed:
        return spark.createDataFrame([], READ_SCHEMA)
    rows = spark.createDataFrame(spark.sparkContext.parallelize(placed, len(placed)), "uri string, base long")
    return rows.mapInPandas(run, READ_SCHEMA)


def store_and_read(docs: DataFrame, path: str, end_id: int, **options) -> DataFrame:
    """write_planes to a fresh shared folder, then read_planes."""
    return read_planes(write_planes(docs, path, end_id, scratch(docs.sparkSession, "planes"), **options))
