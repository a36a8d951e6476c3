"""WARC archives of captures, and their index by an external merge of sorted runs.

Archives are written from pages, a gzip member for each record; a payload that an earlier page has already is written as a
revisit of it.  Reading an archive back gives a run: its captures sorted by URL key and time, in blocks on shared storage.
Runs are merged k ways by a loser tree.  More runs than the fan-in are first merged in groups to longer runs; the last
merge is cut into ranges of keys that tasks work on independently, each reading only the blocks of its range.  A task holds
one block of each run.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, open_read, open_write, scratch
from .graph import join_spread

FAN_IN = 256
BLOCK_ENTRIES = 1000
ARCHIVE_BYTES = 256 << 20
SAMPLES = 20_000
HISTORY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_time string, archive string, record_offset long, range_no int, range_pos long"


def url_key(url: str | None) -> str:
    """A sort key with the host's labels from the right: com,example)/path?query.  Scheme, www, user, port and fragment go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return ")" + quote(url)
    host = host.removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return quote(",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query, safe="/,)?=&%:;@+!*~'(").lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, time: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record.  A revisit has the HTTP header alone, which still names the length of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {time}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(file) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member; one member is held at a time."""
    data, offset = b"", 0
    while True:
        if not data:
            data = file.read(1 << 20)
            if not data:
                return
        unpack, out, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                data = file.read(1 << 20)
                if not data:
                    raise ValueError("the archive is cut off")
            out.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        yield offset, b"".join(out)
        offset += used


def parse(raw: bytes) -> dict:
    """What the index needs of a record; the digest of a payload that is there is computed from it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the record {fields['WARC-Record-ID']} is damaged")
    number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "key": url_key(fields.get("WARC-Target-URI")),
        "time": fields["WARC-Date"],
        "bytes": size,
        "digest": digest,
        "type": fields["WARC-Type"],
        "refers_to": number(refers) if refers else None,
    }


def order_of(entry: list) -> tuple:
    """Entries are [key, time, page_id, ...]; a null id comes first."""
    return (entry[0], entry[1], entry[2] is not None, entry[2] or 0)


class RunWriter:
    """Sorted entries in compressed blocks, with the first entry and place of each block at the end."""

    def __init__(self, out):
        self.out, self.block, self.index, self.at, self.total = out, [], [], 0, 0

    def add(self, entry: list) -> None:
        self.block.append(entry)
        self.total += 1
        if len(self.block) == BLOCK_ENTRIES:
            self._flush()

    def _flush(self) -> None:
        data = zlib.compress(json.dumps(self.block).encode(), 3)
        self.index.append([self.block[0][:3], self.at, len(data)])
        self.out.write(data)
        self.at += len(data)
        self.block = []

    def close(self) -> None:
        if self.block:
            self._flush()
        data = zlib.compress(json.dumps(self.index).encode(), 3)
        self.out.write(data + struct.pack("<Q", len(data)))


def read_run(file, low: tuple | None = None, high: tuple | None = None) -> Iterator[list]:
    """Entries from low on and below high, from the blocks that hold such."""
    file.seek(0, 2)
    end = file.tell()
    file.seek(end - 8)
    size = struct.unpack("<Q", file.read(8))[0]
    file.seek(end - 8 - size)
    index = json.loads(zlib.decompress(file.read(size)))
    for k, (first, at, length) in enumerate(index):
        if high is not None and order_of(first) >= high:
            return
        if low is not None and k + 1 < len(index) and order_of(index[k + 1][0]) <= low:
            continue
        file.seek(at)
        for entry in json.loads(zlib.decompress(file.read(length))):
            place = order_of(entry)
            if (low is None or place >= low) and (high is None or place < high):
                yield entry


def loser_tree(sources: list[Iterable[list]]) -> Iterator[list]:
    """Merge sorted sources.  Inner nodes hold the losers of their matches, so each step replays one path of log k matches."""
    streams = [iter(s) for s in sources]
    k = len(streams)
    heads = [next(s, None) for s in streams]
    # an ended source loses against every other; equal entries come in the order of their sources
    rank = [(h is None, order_of(h) if h is not None else (), n) for n, h in enumerate(heads)]
    losers = [-1] * k
    winner = -1
    for leaf in range(k):
        player, node = leaf, (leaf + k) // 2
        while node and player >= 0:
            if losers[node] < 0:
                losers[node], player = player, -1
            elif rank[losers[node]] < rank[player]:
                losers[node], player = player, losers[node]
            node //= 2
        if player >= 0:
            winner = player
    while k and heads[winner] is not None:
        yield heads[winner]
        head = heads[winner] = next(streams[winner], None)
        rank[winner] = (head is None, order_of(head) if head is not None else (), winner)
        node = (winner + k) // 2
        while node:
            if rank[losers[node]] < rank[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2


def mark_revisits(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, html, time) with refers_to.  Digests travel alone; payloads are shuffled once, by id and digest."""
    digest = F.sha1(F.col("html").cast("binary"))
    keyed = materialize(pages.where(F.octet_length("html") >= least).select("page_id", digest.alias("sha")), "digests")
    groups = keyed.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    found = join_spread(keyed, groups, "sha", "n", keyed.count()).where("page_id IS NULL OR page_id <> refers_to")
    marks = found.select(F.col("page_id").alias("m_id"), F.col("sha").alias("m_sha"), "refers_to").distinct()
    rows = pages.withColumn("sha", digest)
    return rows.join(marks, rows.page_id.eqNullSafe(marks.m_id) & (rows.sha == marks.m_sha), "left").select("page_id", "url", "html", "time", "refers_to")


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the records of each partition; one row (uri, n_records) for each archive."""

    def run(batches):
        import pyarrow as pa

        part, number, batches = TaskContext.get().partitionId(), 0, iter(batches)
        rows = (row for batch in batches for row in zip(*(batch.column(k) for k in range(5))))
        row = next(rows, None)
        while row is not None:
            uri = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
            size = count = 0
            with open_write(uri) as out:
                while row is not None and size < ARCHIVE_BYTES:
                    page_id, url, html, time, refers_to = (x.as_py() for x in row)
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = pack.compress(record(page_id, url, time, html.encode(), refers_to)) + pack.flush()
                    out.write(data)
                    size += len(data)
                    count += 1
                    row = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_pylist([{"uri": uri, "n_records": count}], schema=pa.schema([("uri", pa.string()), ("n_records", pa.int64())]))

    return materialize(marked.mapInArrow(run, "uri string, n_records long"), "archives")


def _each(spark, rows: list[tuple], schema: str) -> DataFrame:
    """One task for each row."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def sorted_runs(archives: list[str], spark, folder: str) -> list:
    """Read every archive and write its captures as a sorted run; rows (uri, n, samples)."""
    per = max(1, min(64, SAMPLES // max(1, len(archives))))

    def run(frames):
        import pandas as pd

        for frame in frames:
            for uri in frame["uri"]:
                entries = []
                with open_read(uri) as file:
                    for offset, raw in members(file):
                        x = parse(raw)
                        entries.append([x["key"], x["time"], x["page_id"], x["bytes"], x["digest"], x["type"], x["refers_to"], uri, offset])
                entries.sort(key=order_of)
                to = f"{folder}/{uri.rsplit('/', 1)[1]}.run"
                with open_write(to) as out:
                    writer = RunWriter(out)
                    for entry in entries:
                        writer.add(entry)
                    writer.close()
                step = max(1, len(entries) // per)
                yield pd.DataFrame({"uri": [to], "n": [len(entries)], "samples": [json.dumps([e[:3] for e in entries[step // 2 :: step]])]})

    return materialize(_each(spark, [(a,) for a in archives], "uri string").mapInPandas(run, "uri string, n long, samples string"), "runs").orderBy("uri").collect()


def merged_runs(runs: list[str], spark, folder: str) -> list[str]:
    """Merge groups of FAN_IN runs to longer ones until one merge takes them all."""
    level = 0
    while len(runs) > FAN_IN:
        groups = [(f"{folder}/level-{level}-{k:06d}.run", runs[k : k + FAN_IN]) for k in range(0, len(runs), FAN_IN)]

        def run(frames):
            import pandas as pd

            for frame in frames:
                for to, parts in zip(frame["to"], frame["parts"]):
                    files = [open_read(p) for p in parts]
                    with open_write(to) as out:
                        writer = RunWriter(out)
                        for entry in loser_tree([read_run(f) for f in files]):
                            writer.add(entry)
                        writer.close()
                    for f in files:
                        f.close()
                    yield pd.DataFrame({"to": [to]})

        made = materialize(_each(spark, groups, "to string, parts array<string>").mapInPandas(run, "to string"), "runs")
        runs, level = sorted(r.to for r in made.collect()), level + 1
    return runs


def merge_ranges(runs: list[str], samples: list[list], spark, ranges: int) -> DataFrame:
    """The merged histories: rows in the order of url_key, capture_time and page_id, by range_no and range_pos."""
    points = sorted(map(order_of, samples))
    cuts = sorted({points[k * len(points) // ranges] for k in range(1, ranges)}) if points else []
    bounds = [None, *cuts, None]
    entry = lambda cut: None if cut is None else json.dumps(cut)
    rows = [(k, entry(bounds[k]), entry(bounds[k + 1])) for k in range(len(bounds) - 1)]
    names = [c.split()[0] for c in HISTORY.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for number, low, high in zip(frame["range_no"], frame["low"], frame["high"]):
                cut = lambda text: tuple(json.loads(text)) if text else None
                files, out, place = [open_read(r) for r in runs], [], 0
                for key, time, page_id, size, digest, kind, refers, uri, offset in loser_tree([read_run(f, cut(low), cut(high)) for f in files]):
                    out.append((page_id, size, digest, kind, refers, key, time, uri, offset, number, place))
                    place += 1
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                for f in files:
                    f.close()

    return _each(spark, rows, "range_no int, low string, high string").mapInPandas(run, HISTORY)


def id_time(page_id: Column) -> Column:
    """A capture time for tables without one: page_id seconds after the start of 2020, in WARC's form."""
    return F.date_format(F.timestamp_seconds(F.coalesce(page_id, F.lit(0)) + 1577836800), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def archive_and_index(pages: DataFrame, least: int = 0, id_col="page_id", url_col="url", html_col="html", time_col: str | None = None, ranges: int | None = None) -> DataFrame:
    """Write pages as WARC archives, read them back, and merge their indexes (columns: HISTORY).

    Of records with equal payloads of `least` bytes or more that with the smallest id is a response and the others revisit
    it; rows that repeat this id are responses too.  A null html is an empty payload.  A null url has the key '' and comes
    first.  A null id is kept, revisits a numbered page of equal payload, and is never revisited.  Other columns are left
    out.  An empty table writes nothing and gives an empty index.
    """
    spark = pages.sparkSession
    number = F.col(id_col).cast("long")
    time = id_time(number) if time_col is None else F.date_format(F.col(time_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(number.alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), time.alias("time"))
    folder = scratch(spark, "warc")
    # a name for each archive, as many as there were tasks
    archives = [r.uri for r in write_archives(mark_revisits(rows, least), folder).orderBy("uri").collect()]
    if not archives:
        return spark.createDataFrame([], HISTORY)
    found = sorted_runs(archives, spark, folder)
    samples = [s for r in found for s in json.loads(r.samples)]
    runs = merged_runs([r.uri for r in found], spark, folder)
    return merge_ranges(runs, samples, spark, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
