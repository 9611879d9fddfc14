"""Line dedup behind two Bloom filters, for keys seen once and keys seen twice.

A line's key is the line without the bytes 0x20, 0x09-0x0D at both ends, A-Z lower-cased. A first pass
adds each document's distinct keys to a pair of filters per task: a key that the first filter holds
already goes to the second. The pairs are merged slice by slice in Spark (second: either second, or both
firsts). A second pass lets only keys that the second filter holds (suspects) into the shuffle, as
128-bit cryptographic digests; counting their documents confirms the repeats exactly, whatever the filters
let through, and the document with the largest id keeps the line. A third pass drops the others.

The filters follow the input's bytes up to ``most_bits`` each (32 MB unless given: what a worker holds at once). Where
there are more than 16 bytes of text for each bit, more lines pass as suspects: at worst each line's digest and id (24 bytes) are shuffled once.
That changes no result, as suspects are counted exactly. Filters spread over the cluster would save nothing there:
each line would have to travel to its part of the filter to be asked for. A line that very many documents share is counted and confirmed in ``SALTS`` tasks.

Results. A null or empty text is one empty line. Keys shorter than ``least_chars`` code points always
stay. Rows that share an id are one document. A null id is one document that comes before all others.
An empty table gives no rows; other columns pass through, and a clashing one gives way to the result.
Very long texts count whole; of equal lines of a document all go or all stay.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.workspace import cut, fresh, quoted

MOST_BITS = 1 << 28
LEAST_BITS = 1 << 20
_SLICE = 1 << 14
_PROBES = 4
SALTS = 16
_STRIP = b" \t\n\x0b\x0c\r"


def _digest(line: bytes, least_chars: int) -> bytes | None:
    key = line.strip(_STRIP).lower()
    if len(key) < least_chars or not key.isascii() and len(key.decode()) < least_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array):
    return (x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist())


def _probes(digests: list[bytes], bits: int) -> np.ndarray:
    """The bit numbers of each digest."""
    h = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    step = h[:, 1] | np.uint64(1)
    return np.array([(h[:, 0] + step * np.uint64(i)) & np.uint64(bits - 1) for i in range(_PROBES)], np.int64)


def _has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.all((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1, axis=0) if at.size else np.zeros(at.shape[1], bool)


def _add(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())


def seen_twice(texts: DataFrame, least_chars: int, bits: int) -> np.ndarray:
    """The second filter over all rows of a single text column."""

    def build(batches):
        once, twice, none = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8), True
        for batch in batches:
            count: dict[bytes, int] = {}
            for text in _texts(batch.column(0)):
                for d in {_digest(line, least_chars) for line in text.split(b"\n")} - {None}:
                    count[d] = count.get(d, 0) + 1
            if count:
                none, at = False, _probes(list(count), bits)
                again = np.fromiter(count.values(), np.int64) > 1
                _add(twice, at[:, again | _has(once, at)])
                _add(once, at)
        if not none:
            for i in range(0, bits >> 3, _SLICE):
                if once[i : i + _SLICE].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // _SLICE], pa.int32()), pa.array([once[i : i + _SLICE].tobytes()], pa.binary()), pa.array([twice[i : i + _SLICE].tobytes()], pa.binary())], names=["slice", "once", "twice"])

    def merge(batches):
        now, once, twice = None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["slice", "twice"])
        for batch in batches:
            for k, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if k == now:
                    twice |= t | once & o
                    once |= o
                else:
                    if now is not None:
                        yield out()
                    now, once, twice = k, o.copy(), t.copy()
        if now is not None:
            yield out()

    spark = texts.sparkSession
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)  # a pair of filters for each, however many files there are
    parts = texts.coalesce(tasks).mapInArrow(build, "slice int, once binary, twice binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(bits >> 3, np.uint8)
    for row in merged.toLocalIterator():
        out[row.slice * _SLICE : row.slice * _SLICE + len(row.twice)] = np.frombuffer(row.twice, np.uint8)
    return out


def filter_bits(n_bytes: int, most_bits: int = MOST_BITS) -> int:
    """A power of two near n_bytes / 16 between the bounds."""
    return min(most_bits, max(LEAST_BITS, 1 << max(0, (n_bytes // 16).bit_length())))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with its text column rewritten, and n_lines (before), n_dropped. most_bits: a power of two, the size of either filter."""
    ident, text = F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string")
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = filter_bits(n_bytes, most_bits)
    twice = seen_twice(docs.select(text.alias("text")), least_chars, bits)

    def suspects(batches):
        for batch in batches:
            rows, found = [], []
            for i, body in enumerate(_texts(batch.column(1))):
                own = list({_digest(line, least_chars) for line in body.split(b"\n")} - {None})
                if own:
                    hit = [d for d, yes in zip(own, _has(twice, _probes(own, bits)).tolist(), strict=True) if yes]
                    rows += [i] * len(hit)
                    found += hit
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(found, pa.binary())], names=["id", "key"])

    kind = docs.schema[id_col].dataType
    pairs = docs.select(ident.alias("id"), text.alias("text")).mapInArrow(suspects, T.StructType([T.StructField("id", kind), T.StructField("key", T.BinaryType())]))
    # A key's documents are dealt to SALTS tasks by their ids: counted there, then summed; the answer goes back to each.
    held = cut(pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    n_docs = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    counted = held.groupBy("key", "salt").agg(n_docs.alias("n"), F.max("id").alias("last"))
    repeated = counted.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_list("salt").alias("salts")).where(F.col("n") >= least_docs)
    lost = held.join(repeated.select("key", "last", F.explode("salts").alias("salt")), ["key", "salt"]).where(F.col("id").isNull() | (F.col("id") < F.col("last"))).groupBy("id").agg(F.collect_set("key").alias("keys"))

    gone, at = fresh(docs.columns, "__gone", "__at")
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    joined = docs.select(*[F.col(quoted(c)) for c in keep]).join(lost.select(F.col("id").alias(at), F.col("keys").alias(gone)), F.col(quoted(id_col)).eqNullSafe(F.col(at)), "left").drop(at)
    place = keep.index(next(c for c in keep if c.lower() == text_col.lower()))
    fields = [T.StructField(f.name, T.StringType()) if i == place else f for i, f in enumerate(joined.schema.fields[:-1])]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    joined = joined.withColumn(joined.columns[place], F.col(quoted(joined.columns[place])).cast("string"))

    def drop(batches):
        for batch in batches:
            kept, before, dropped = [], [], []
            for body, keys in zip(_texts(batch.column(place)), batch.column(len(keep)).to_pylist(), strict=True):
                lines = body.split(b"\n")
                before.append(len(lines))
                if keys:
                    keys = set(keys)
                    lines = [x for x in lines if _digest(x, least_chars) not in keys]
                    body = b"\n".join(lines)
                dropped.append(before[-1] - len(lines))
                kept.append(body)
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], kept, *batch.columns[place + 1 : len(keep)], pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return joined.mapInArrow(drop, schema)
