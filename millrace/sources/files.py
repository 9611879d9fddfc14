"""Files and connectors as far as they need no network: text files, globs, listings, request signing."""

from __future__ import annotations

import hashlib
import posixpath

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import kept


def inside(base: str, path: str) -> str:
    """The normalised path, which must not leave base."""
    whole = posixpath.normpath(posixpath.join(base, path))
    root = posixpath.normpath(base)
    if whole != root and not whole.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} leaves {base}")
    return whole


def read_files(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """(path, content): one row for each text file."""
    rows = spark.read.text(inside(base, path) if base else path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def write_lines(df: DataFrame, column: str, path: str, base: str | None = None) -> None:
    """A text column as lines of text files in a folder."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(inside(base, path) if base else path)


def write_files(df: DataFrame, path: str, content: str, base: str) -> DataFrame:
    """(path, bytes_written): one file for each row, below base; written once, under a temporary name first. Paths that leave base are an error."""
    rows = df.select(F.col(path).cast("string").alias("path"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))

    def put(batches):
        for batch in batches:
            names, sizes = [], []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, root = fs.FileSystem.from_uri(base)
                whole, data = inside(root, name), text.encode()
                store.create_dir(posixpath.dirname(whole), recursive=True)
                trial = f"{whole}.{TaskContext.get().taskAttemptId()}.tmp"
                with store.open_output_stream(trial, compression=None) as out:
                    out.write(data)
                store.move(trial, whole)
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes_written"])

    return kept(rows.mapInArrow(put, "path string, bytes_written long"))


def glob(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files that match, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text that begin an object, others left out."""
    return spark.read.text(path).where(F.ltrim("value").startswith("{"))


def canonical_request(method: Column, path: Column, headers: Column, body: Column) -> Column:
    """Method, path, the headers name:value sorted by name, and the body's SHA-256, in lines: what a signature covers."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(F.lower(e.getField("key")), F.lit(":"), F.trim(e.getField("value")))), "\n")
    return F.concat_ws("\n", F.upper(method), path, lines, F.sha2(F.coalesce(body, F.lit("")), 256))


def domain_matches(host: Column, domain: Column) -> Column:
    """Whether a cookie of that domain goes to the host: the same, or below it; ports don't count, addresses match whole."""
    h = F.lower(F.regexp_replace(host, r":\d+$", ""))
    d = F.lower(F.ltrim(domain, F.lit(".")))
    return (h == d) | (F.endswith(h, F.concat(F.lit("."), d)) & ~h.rlike(r"^[0-9.]+$"))


def static_header(name: Column, value: Column) -> Column:
    """One header as struct(name, value), both rendered templates."""
    return F.struct(F.lower(name).alias("name"), value.alias("value"))


def bearer(token: Column, scheme: str = "Bearer", header: str = "authorization") -> Column:
    """The header with scheme and token; without a scheme the bare token."""
    return static_header(F.lit(header), F.concat(F.lit(f"{scheme} "), token) if scheme else token)


def hmac(message: Column, key: bytes, bits: int = 256) -> Column:
    """The HMAC (SHA-256 or SHA-512) of a text as lowercase hex, by SQL functions alone; the key is the driver's."""
    block = 64 if bits == 256 else 128
    key = hashlib.new(f"sha{bits}", key).digest() if len(key) > block else key
    pads = [bytes(x ^ pad for x in key.ljust(block, b"\0")) for pad in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(F.lit(pads[0]), F.coalesce(message, F.lit("")).cast("binary")), bits))
    return F.sha2(F.concat(F.lit(pads[1]), inner), bits)


def cookie_headers(requests: DataFrame, jar: DataFrame, host: str, csrf: tuple[str, str] | None = None) -> DataFrame:
    """requests with cookie (``a=1; b=2``, names sorted) from a jar (run, name, value, domain, seq): of a name the latest value that the host may see.

    requests has a column run. csrf (cookie name, header name) adds that cookie's value as a column of the header's name."""
    asked = requests.select("run", F.col(host).alias("_host")).distinct()
    seen = asked.join(jar, "run").where(domain_matches(F.col("_host"), F.col("domain")))
    last = seen.groupBy("run", "_host", "name").agg(F.max_by("value", "seq").alias("value"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda c: F.concat(c.getField("name"), F.lit("="), c.getField("value")))
    extra = [F.max(F.when(F.col("name") == csrf[0], F.col("value"))).alias(csrf[1])] if csrf else []
    sent = last.groupBy("run", "_host").agg(F.array_join(pairs, "; ").alias("cookie"), *extra).withColumnRenamed("_host", host)
    return requests.join(sent, ["run", host], "left")
