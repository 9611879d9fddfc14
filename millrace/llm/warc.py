"""WARC: a writer of gzip members with revisit records, and a salvage reader.

``write`` decides over all pages which payloads repeat (by SHA-1 and length, in Spark), deals the pages to
files of about ``file_bytes``, and writes each file under a temporary name before it is moved into place, so
that a task that is run again replaces its own file. Files go to the shared folder through pyarrow's
file systems. ``read`` reads each file as a stream in a task and salvages: where a member's checks fail (gzip CRC, version line,
header, length, end mark, block digest), it searches for the next member or version line that passes, whichever
is nearer, recovers what follows, and reports the bytes between as a gap. A member may hold several records.

Results. A null payload is empty. Of pages with equal payloads of at least ``least_bytes`` the largest id is the
response, the others revisit it. Rows that repeat that id are responses too; a null id is written without
a number and refers to nothing. An empty table writes no file that has records. Very long payloads and urls count
whole. Only id, url and payload are stored: further columns of pages are dropped, and their names cannot clash.
Which pages revisit one that very many share is decided from counts by digest and a join that Spark splits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import cut, new_folder, quoted

_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CHUNK = 1 << 16
_WINDOW = 4 << 20
_RECORD = "offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit whose block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def plan(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """(id, refers_to) of the revisits."""
    body = F.coalesce(F.col(quoted(payload_col)).cast("string"), F.lit(""))
    keys = pages.select(F.col(quoted(id_col)).cast("long").alias("id"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("n")).where(F.col("n") >= least_bytes)
    groups = keys.groupBy("sha1", "n").agg(F.max("id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return keys.join(groups, ["sha1", "n"]).where("id <> refers_to").groupBy("id", "sha1").agg(F.max("refers_to").alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Writes the archives; returns (path, records, bytes) of each file."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col(quoted(payload_col)).cast("string"), F.lit(""))
    revisits = plan(pages, id_col, payload_col, least_bytes).select(F.col("id").alias("i"), F.col("sha1").alias("s"), "refers_to")
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(url_col)).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    n = max(1, total // file_bytes + 1, min(rows.rdd.getNumPartitions(), total >> 20))
    # One shuffle of the payloads: the join's partitions become the files.
    keyed = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary"))).withColumn("key", F.coalesce("id", F.xxhash64("url", "sha")))
    dealt = keyed.repartition(int(n), "key", "sha").join(revisits, (F.col("key") == F.col("i")) & (F.col("sha") == F.col("s")) & F.col("id").isNotNull(), "left").select("id", "url", "payload", "refers_to")

    def put(batches):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        context = TaskContext.get()
        path = f"{base}/part-{context.partitionId():06d}.warc.gz"
        trial = f"{path}.{context.taskAttemptId()}.tmp"
        records = size = 0
        with files.open_output_stream(trial, compression=None) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for i, u, p, r in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        made = record(i, u, p.encode(), r)
                        out.write(made)
                        records, size = records + 1, size + len(made)
        files.move(trial, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    done = dealt.mapInArrow(put, "path string, records long, bytes long")
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else "file://"
    return cut(done.select(F.concat(F.lit(scheme), "path").alias("path"), "records", "bytes"))


def _parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | None:
    """Headers, block and length of the record that starts there, if its checks pass."""
    start = _VERSION.match(data, at)
    if not start:
        return None
    head, line = {}, start.end()
    while not data.startswith(b"\r\n", line):  # a damaged header ends at its first bad line, however far the next blank one is
        stop = data.find(b"\r\n", line)
        key, colon, value = data[line : max(stop, line)].partition(b":")
        if not colon:
            return None
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        line = stop + 2
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")) or "warc-type" not in head:
        return None
    n, line = int(head["content-length"]), line + 2
    if data[line + n : line + n + 4] != b"\r\n\r\n":
        return None
    block = data[line : line + n]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != _digest(block):
        return None
    return head, block, line + n + 4 - at


def _unpack(data: bytes, at: int) -> tuple[list[tuple], list[tuple], int, str]:
    """Records and bad spans inside the gzip member there, its length (0 if its own checks fail), and what is wrong."""
    z, parts, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(data):
            parts.append(z.decompress(data[end : end + _CHUNK]))
            end += _CHUNK
    except zlib.error as e:
        return [], [], 0, f"member: {e}"
    if not z.eof:
        return [], [], 0, "member is cut off"
    raw = b"".join(parts)
    found, bad, i = [], [], 0
    while i < len(raw):
        got = _parse(raw, i)
        if got:
            found.append(got[:2])
            i += got[2]
            continue
        j = i
        while (m := _VERSION.search(raw, j + 1)) and not _parse(raw, m.start()):
            j = m.start()
        bad.append((i, m.start() if m else len(raw)))
        i = bad[-1][1]
    return found, bad, min(end, len(data)) - at - len(z.unused_data), "record in member fails its checks"


class _Window:
    """A stretch of an archive that grows and moves on: what is read and not yet done with."""

    def __init__(self, read):
        self.read, self.data, self.at, self.base, self.ended = read, b"", 0, 0, False

    def more(self) -> bool:
        """Reads on, as much again as is held at least; whether there was anything."""
        left = self.data[self.at :]
        new = b"" if self.ended else self.read(max(_WINDOW, len(left)))
        self.base, self.at, self.ended, self.data = self.place, 0, not new, left + new
        return bool(new)

    @property
    def place(self) -> int:
        return self.base + self.at

    @property
    def left(self) -> int:
        return len(self.data) - self.at


def _at(data: bytes, i: int) -> tuple[list[tuple], int, str, bool]:
    """Records of the member or plain record that starts there, its length, what is wrong, and whether bad bytes are beside them."""
    if data.startswith(_MEMBER, i):
        found, spans, step, reason = _unpack(data, i)
        return found, step, reason, bool(spans)
    if _VERSION.match(data, i):
        got = _parse(data, i)
        return ([got[:2]], got[2], "", False) if got else ([], 0, "record fails its checks", False)
    return [], 0, "no member", False


def salvage(read):
    """Yields ("record", offset, headers, block) and ("gap", offset, length, reason) over a whole archive.

    read is bytes, or a function that gives so many of the next bytes. Only the record at hand is held; a start whose
    checks fail is looked at again with more bytes, so damage costs memory up to the next bytes that pass.
    Members and plain records may be mixed. The offset of a record in a member is the member's; a member
    that holds bad bytes beside valid records is also a gap, one that holds none is part of the gap around it.
    """
    w = _Window(io.BytesIO(read).read if isinstance(read, bytes) else read)
    bad, why = None, ""  # where the gap at hand began
    while w.left > 0 or w.more():
        found, step, reason, hurt = _at(w.data, w.at)
        while not found and (reason in ("member is cut off", "record fails its checks") or w.left < 16) and w.more():
            found, step, reason, hurt = _at(w.data, w.at)
        if found:
            if bad is not None:
                yield "gap", bad, w.place - bad, why
                bad = None
            for head, block in found:
                yield "record", w.place, head, block
            if hurt:
                yield "gap", w.place, step, reason
            w.at += step
            continue
        if bad is None:
            bad, why = w.place, reason
        while True:  # on to the nearer of the next member and version line
            member, line = w.data.find(_MEMBER, w.at + 1), _VERSION.search(w.data, w.at + 1)
            places = [x for x in (member, line.start() if line else -1) if x >= 0]
            if places:
                w.at = min(places)
                break
            w.at = max(len(w.data) - 16, w.at)  # a mark may lie across the end
            if not w.more():
                w.at = len(w.data)
                break
    if bad is not None:
        yield "gap", bad, w.place - bad, why


def _number(uri: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri)
    return int(m[1]) if m else None


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the archives that the column path names; gaps: path, offset, length, reason."""

    def each(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as f:
                    yield path, salvage(f.read)

    def records(batches):
        for _, parts in each(batches):
            rows = []
            for part in parts:
                if part[0] == "record" and part[2]["warc-type"] in ("response", "revisit"):
                    head, block = part[2], part[3]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                    size = int(m[1]) if m else len(payload)
                    revisit = head["warc-type"] == "revisit"
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else _digest(payload)
                    rows.append((part[1], _number(head.get("warc-record-id", "")), head.get("warc-target-uri"), head["warc-type"], size if revisit else len(payload), digest, _number(head.get("warc-refers-to", "")), None if revisit else payload))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def gaps(batches):
        for path, parts in each(batches):
            rows = [(path, *p[1:]) for p in parts if p[0] == "gap"]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "offset", "length", "reason"])

    paths = files.select("path")
    return paths.mapInArrow(records, _RECORD), paths.mapInArrow(gaps, "path string, offset long, length long, reason string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
