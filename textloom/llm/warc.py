"""WARC archives and their capture index by external merge (operator 8).

Archives are WARC 1.1 files written by Spark's text writer in the shared folder: a record is
text, and the two line ends that close a record are the writer's line separator. They are
read back as bytes and parsed by their headers. The index is merged externally: what a task
has read is sorted into a run; runs are cut into blocks along borders in (URL key, time,
key); each range of that order merges its blocks by a loser tree that opens a run's next
block only when the merge reaches it. Ranges in order give one globally ordered history.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import shared_path, shuffle_width, written

#: (payload bytes up to which, records of an archive file at most): rows go to files by the
#: size of their payload, so a file, which is parsed at once, has some 64 MB of payloads at
#: most, or a single larger one.
FILES = ((32 << 10, 2000), (1 << 20, 64), (None, 1))
#: Entries of a block of a run, and how many sampled entries set the borders of a range.
BLOCK, SAMPLED = 512, 32

#: Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_header = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


class LoserTree:
    """Tournament over the heads of sorted inputs; each inner node keeps the loser.

    `pop` gives the least head and replays only its input's path. Inputs can join while the
    merge runs. Ties go to the input that joined first.
    """

    def __init__(self) -> None:
        self.inputs: list[Iterator] = []
        self.heads: list = []  # None: exhausted
        self.tree: list[int] = [0]

    def add(self, items: Iterable) -> None:
        """A further sorted input; the tournament is played anew."""
        self.inputs.append(iter(items))
        self.heads.append(next(self.inputs[-1], None))
        n = len(self.heads)
        self.tree = [0] * n
        winner = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winner[1]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def peek(self):
        return self.heads[self.tree[0]] if self.heads else None

    def pop(self):
        best = self.tree[0]
        item = self.heads[best]
        self.heads[best] = next(self.inputs[best], None)
        node = (best + len(self.heads)) // 2
        while node:
            if self._before(self.tree[node], best):
                best, self.tree[node] = self.tree[node], best
            node //= 2
        self.tree[0] = best
        return item


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The sort key of a URL: host labels from the right, then path and query."""
    low = url.strip().lower()
    try:
        parts = urlsplit(low)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return low
    if not host:
        return low
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    return host + (f":{port}" if port and port != usual else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(key: str, url: str, when: str, payload: str, size: int, digest: str, original: str | None) -> str:
    """A record without the two line ends that close it."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""]
    block = CRLF.join(http) + ("" if original is not None else payload)
    fields = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": f"<urn:capture:{quote(key, safe='')}>",
        "WARC-Date": when,
        "WARC-Target-URI": quote(url, safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if original is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:capture:{quote(original, safe='')}>"}
    fields["Content-Length"] = str(len(block.encode("utf-8", "surrogatepass")))
    return CRLF.join([VERSION, *(f"{k}: {v}" for k, v in fields.items()), "", block])


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        begin = at
        end = data.index(b"\r\n", at)
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        at, fields = end + 2, {}
        while (m := _header.match(data, at)) is not None:
            fields[m[1].decode("latin-1").lower()] = m[2].decode("latin-1")
            at = m.end()
        at += 2
        size = int(fields["content-length"])
        block = data[at : at + size]
        at += size + 4
        yield begin, at - begin, fields, block


def _unquoted(urn: str) -> str:
    return unquote(urn.removeprefix("<urn:capture:").removesuffix(">"))


def entry(path: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    """A line of the capture index. Digest and size of a response are those of what was
    read back; a revisit has those of the payload that it doesn't repeat."""
    head, _, body = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response":
        digest, size = base32_sha1(body), len(body)
        if fields["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"damaged record at byte {offset} of {path}")
        original = None
    else:
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        original = _unquoted(fields["warc-refers-to"])
    key, when = _unquoted(fields["warc-record-id"]), fields["warc-date"]
    return url_key(fields["warc-target-uri"]), when, key, size, digest, kind, original, path, offset, length


ENTRY = pa.schema([("url_key", pa.string()), ("time", pa.string()), ("key", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ENTRY_SQL = "url_key string, time string, key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, archive string, offset bigint, length bigint"


def payloads(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, digest and size of every row's payload, as a table."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    return written(pages.select(F.col(f"`{key}`").alias("key"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")), "payloads")


def assign(rows: DataFrame, least: int) -> DataFrame:
    """key, digest and refers_to of the payloads (`rows`) that another row's response has.

    Of equal payloads of at least `least` bytes the row with the largest key is the
    response. Counting is partly done before the shuffle; only digests travel, and they meet
    a table, so that skew handling can split those that very many rows have.
    """
    rows = rows.where(F.col("size") >= least)
    first = rows.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    again = rows.join(written(first.drop("n"), "responses"), "digest").where(~F.col("key").eqNullSafe(F.col("refers_to")))
    return written(again.select("key", "digest", "refers_to").distinct(), "revisits")


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", time: Column | None = None, least: int = 0, files: tuple = FILES) -> None:
    """Write a record per row of `pages` as WARC files into folders below `path`.

    `time` is a timestamp (default: 2020-01-01). Null payloads are empty, null URLs too; a
    null key is written as an empty one, and rows that repeat a key are records of that key,
    each with its own payload's decision. Line ends, blanks and other unsafe characters of a
    URL are percent-encoded. A payload has to fit into a value of Spark's, under 2 GiB.
    """
    sizes = payloads(pages, key, html)
    again, largest = assign(sizes, least), sizes.agg(F.max("size")).first()[0] or 0
    when = F.date_format(time if time is not None else F.lit("2020-01-01").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), when.alias("time"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                out = []
                for k, u, t, page, original in zip(*(c.to_pylist() for c in batch.columns)):
                    data = page.encode("utf-8", "surrogatepass")
                    out.append(record(k or "", u, t or "1970-01-01T00:00:00Z", page, len(data), base32_sha1(data), original))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    above = -1
    for n, (most, records) in enumerate(files):
        if n and largest <= above:
            break  # no row is that large
        size = F.octet_length("html")
        some = rows.where((size > above) & (size <= most) if most is not None else size > above)
        # A key that comes with several payloads has a decision for each.
        some = some.withColumn("digest", F.sha1("html")).join(again, ["key", "digest"], "left").select(F.col("key").cast("string").alias("key"), "url", "time", "html", F.col("refers_to").cast("string").alias("original"))
        some.mapInArrow(run, "value string").write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(f"{path}/{n}")
        above = most


def read(spark, path: str) -> DataFrame:
    """The capture index of all archives in `path`; each task's part is a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [entry(name, *r) for r in parse(data.as_py())]
                if found:
                    columns = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY)], schema=ENTRY)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, _ENTRY_SQL)


def borders(runs: DataFrame, ranges: int) -> list[tuple[str, str, str]]:
    """At most ranges - 1 borders from a hash sample of bounded size."""
    order = F.xxhash64("url_key", "time", "key", "offset")
    some = runs.select("url_key", "time", "key", order.alias("o")).orderBy("o").limit(ranges * SAMPLED).collect()
    some = sorted((r.url_key, r.time, r.key) for r in some)
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []


def merged(runs: DataFrame, ranges: int) -> DataFrame:
    """The sorted `runs` as one order: their columns, range, and position in the range."""
    cut = borders(runs, ranges)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seq, group, place, before = TaskContext.get().partitionId(), 0, [], -1, None

        def packed() -> pa.RecordBatch:
            table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), ENTRY)], schema=ENTRY)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ENTRY) as out:
                out.write_batch(table)
            values = (place, *group[0][:3], run, seq, sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["range", "url_key", "time", "key", "run", "seq", "block"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                at = bisect_right(cut, row[:3])
                # A block ends at a border, when full, and where a task's next run begins.
                if group and (at != place or len(group) >= BLOCK or row[:3] < before):
                    yield packed()
                    seq, group = seq + 1, []
                place, before = at, row[:3]
                group.append(row)
        if group:
            yield packed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree, at, out = None, LoserTree(), 0, []

        def drain(limit: tuple | None) -> Iterator[pa.RecordBatch]:
            """Give out what comes before `limit`, the first entry of the next block."""
            nonlocal at, out
            while (head := tree.peek()) is not None and (limit is None or head[:3] < limit):
                out.append((*tree.pop(), place, at))
                at += 1
                if len(out) == 4096:
                    yield flush()
            if limit is None and out:
                yield flush()

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns, out = list(zip(*out)), []
            arrays = [pa.array(c, f.type) for c, f in zip(columns, ENTRY)] + [pa.array(c, pa.int64()) for c in columns[-2:]]
            return pa.RecordBatch.from_arrays(arrays, names=[*ENTRY.names, "range", "position"])

        def rows(block: bytes) -> Iterator[tuple]:
            table = pa.ipc.open_stream(block).read_all()
            return zip(*(c.to_pylist() for c in table.columns))

        for batch in batches:
            for r, u, t, k, run, seq, block in zip(*(c.to_pylist() for c in batch.columns)):
                if r != place:
                    yield from drain(None)
                    place, tree, at = r, LoserTree(), 0
                yield from drain((u, t, k))
                tree.add(rows(block))  # blocks come by their first entry, each opened in time
                if len(tree.heads) > 64:
                    tree = _alive(tree)
        yield from drain(None)

    kept = runs.select(*ENTRY.names).mapInArrow(blocks, "range bigint, url_key string, time string, key string, run bigint, seq bigint, block binary")
    ranged = kept.repartition(max(1, len(cut) + 1), "range").sortWithinPartitions("range", "url_key", "time", "key", "run", "seq")
    return ranged.mapInArrow(merge, f"{_ENTRY_SQL}, range bigint, position bigint")


def _alive(tree: LoserTree) -> LoserTree:
    """The same merge without exhausted inputs."""
    if sum(h is None for h in tree.heads) * 2 < len(tree.heads):
        return tree
    new = LoserTree()
    for head, rest in zip(tree.heads, tree.inputs):
        if head is not None:
            new.add(chain([head], rest))
    return new


def capture_history(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", time: Column | None = None, least: int = 0) -> DataFrame:
    """Write archives of `pages`, read them back, and merge their index.

    One row per row of `pages`: key, payload_bytes, payload_digest, record_type, refers_to,
    then url_key, time, archive, offset, length, range and position (ordered by range and
    position, the whole is ordered by URL key, time and key). Empty tables give an empty
    result; extra columns play no part.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "archives")
    write(pages, path, key=key, url=url, html=html, time=time, least=least)
    captures = read(spark, path)
    runs = written(captures.sortWithinPartitions("url_key", "time", "key", "offset"), "runs")
    kind = pages.schema[key].dataType
    typed = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    order = merged(runs, max(1, shuffle_width(spark)))
    return order.select(typed("key").alias(key), "payload_bytes", "payload_digest", "record_type", typed("refers_to").alias("refers_to"), "url_key", "time", "archive", "offset", "length", "range", "position")
