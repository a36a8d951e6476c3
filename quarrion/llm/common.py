"""Shared helpers: scratch storage that every executor sees, byte files on any store, and word patterns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"
#: Unicode White_Space, as the tokenizer patterns mean by \s.
WHITE = "\t-\r \x85\xa0  -     　"
words_of = re.compile(WORD).findall


_made: list[str] = []
#: What the innermost `transient` has seen made.
_seen: ContextVar[list[str] | None] = ContextVar("seen", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where it names none, a folder beside the warehouse, which a cluster shares
    too; in local mode, where there is one machine, a temporary one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        alone = re.match(r"local(\[|$)", sc.master)
        named = tempfile.mkdtemp(prefix="quarrion-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared root."""
    _made.append(path := f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    if (seen := _seen.get()) is not None:
        seen.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder.  DataFrames that read it can't be used after this."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def transient(spark: SparkSession):
    """Gives a function that writes a result as `materialize` does.  What else was written within this is deleted at its end,
    so nothing that is used after it may read that."""
    token = _seen.set([])
    kept = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(_seen.get()[-1])
        return out

    try:
        yield keep
    finally:
        made = _seen.get()
        _seen.reset(token)
        for path in made:
            if path in kept:
                if (outer := _seen.get()) is not None:
                    outer.append(path)
                continue
            _delete(spark, path)
            if path in _made:
                _made.remove(path)


def discard(spark: SparkSession, name: str) -> None:
    """Delete what the innermost `transient` has seen written by this name, before its end."""
    seen = _seen.get() or []
    for path in [x for x in seen if re.fullmatch(re.escape(name) + r"-[0-9a-f]{32}", x.rsplit("/", 1)[-1])]:
        _delete(spark, path)
        seen.remove(path)
        if path in _made:
            _made.remove(path)


#: Rows that Spark hands a Python worker at once while an operator writes: whole texts, so ten thousand would be many MB.
BATCH_ROWS, BATCH_OPTION = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Within this, batches for Python have BATCH_ROWS rows at most; the session's setting is put back."""
    before = spark.conf.get(BATCH_OPTION)
    spark.conf.set(BATCH_OPTION, str(min(int(before), BATCH_ROWS)) if int(before) > 0 else str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_OPTION, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a bare path, else None."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def open_write(uri: str):
    """Write bytes under another name and rename at the end, so a task that is tried again replaces its file whole."""
    part = f"{uri}.{uuid.uuid4().hex}.tmp"
    if (path := local_path(part)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            yield out
        os.replace(path, local_path(uri))
        return
    store, at = _store(part)
    with store.open_output_stream(at) as out:
        yield out
    store.move(at, _store(uri)[1])


def open_read(uri: str):
    """A seekable binary file."""
    if (path := local_path(uri)) is not None:
        return open(path, "rb", buffering=1 << 16)
    store, at = _store(uri)
    return store.open_input_file(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def portions(batches, rows: int = 256):
    """Record batches of `rows` rows at most, so what is made of one is small whatever Spark hands over."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


class UnitCache(dict):
    """Values by unit of text, made by `make` where missing.

    Two generations of at most `limit` short units each: what is used stays, and memory is bounded.
    """

    def __init__(self, make, limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, unit):
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        self.put(unit, value)
        return value

    def put(self, unit, value) -> None:
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = value
