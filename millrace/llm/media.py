"""Media columns: 8-bit WAV by the wave module, and spectral-peak pair fingerprints of what is read back.

``store`` turns bytes into a WAV column, ``features`` reads it back, transforms frames of ``FRAME`` samples at
half-frame steps, takes the strongest bin of two bands in each frame, and pairs each low peak
with the high peaks one and two frames later. A fingerprint is (t, code): frame number, and
low bin * 2**16 + high bin * 2**4 + distance. Each text is transformed by itself from its start, in slices
of frames, so equal texts have equal features and memory stays bounded by one medium.

Results. A null text is empty; an empty payload is padded to one frame. Of equally strong bins the lowest is the
peak. Each row has its own result, repeated rows the same; a very long text is one medium, as a whole. An empty
table gives no rows. Other columns pass through; one named like a result gives way to it.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.workspace import fresh, quoted

FRAME = 576
RATE = 8000
_HOP = FRAME // 2
_WINDOW = np.hanning(FRAME).astype(np.float32)
_SPLIT = FRAME // 8
_SLICE = 1024
_BLOCK = 1 << 20


def _extended(docs: DataFrame, added: list[T.StructField], source: str, make, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with columns that make(list of bytes) gives as Arrow arrays; the source column comes last."""
    names = {f.name.lower() for f in added}
    keep = [c for c in docs.columns if c.lower() not in names and c not in drop]
    (name,) = fresh(docs.columns, "__source")
    rows = docs.select(*[F.col(quoted(c)) for c in keep], F.coalesce(F.col(quoted(source)).cast("binary"), F.lit(b"")).alias(name))
    schema = T.StructType([*rows.schema.fields[:-1], *added])

    def run(batches):
        for batch in batches:
            upto = np.cumsum(np.asarray(pc.binary_length(batch.column(len(keep)))), dtype=np.int64)
            at = 0
            while at < batch.num_rows:  # about _BLOCK bytes at once; a longer medium is a block by itself
                end = max(at + 1, int(np.searchsorted(upto, (int(upto[at - 1]) if at else 0) + _BLOCK, "right")))
                part, at = batch.slice(at, end - at), end
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column(len(keep)).to_pylist())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def _samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Frames x 2: the strongest bin below and above the split."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = max(1, (len(x) - FRAME) // _HOP + 1)
    x = np.pad(x, (0, max(0, FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::_HOP]
    out = np.zeros((n, 2), np.int64)
    for at in range(0, n, _SLICE):
        z = np.fft.rfft(frames[at : at + _SLICE] * _WINDOW, axis=1)
        power = z.real**2 + z.imag**2
        out[at : at + _SLICE, 0] = 1 + np.argmax(power[:, 1:_SPLIT], axis=1)
        out[at : at + _SLICE, 1] = _SPLIT + np.argmax(power[:, _SPLIT:], axis=1)
    return out


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes, in time order; a medium of one frame pairs its own two peaks at distance 0."""
    p = peaks(samples)
    if len(p) == 1:
        return np.zeros(1, np.int64), p[:1, 0] << 16 | p[:1, 1] << 4
    t, code = [], []
    for d in (1, 2):
        t.append(np.arange(len(p) - d))
        code.append(p[: len(p) - d, 0] << 16 | p[d:, 1] << 4 | d)
    t, code = np.concatenate(t), np.concatenate(code)
    order = np.lexsort((code, t))
    return t[order], code[order]


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_bytes and media: its text as UTF-8, bytes 255 up to a positive multiple of FRAME, as WAV."""

    def make(texts):
        media = [_wav(x + b"\xff" * (-len(x) % FRAME or (0 if x else FRAME))) for x in texts]
        return [pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())]

    return _extended(docs, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], text_col, make)


def features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with payload (its samples as read back), times and codes of its fingerprints, and tail_crc32 of the last 32 bytes."""
    import zlib

    from millrace.llm.bytescan import lists

    def make(stored):
        payload = [_samples(m) for m in stored]
        found = [fingerprints(p) for p in payload]
        return [pa.array(payload, pa.binary()), pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()), lists([x[0] for x in found]), lists([x[1] for x in found])]

    added = [T.StructField("payload", T.BinaryType()), T.StructField("tail_crc32", T.LongType()), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("codes", T.ArrayType(T.LongType()))]
    return _extended(media, added, media_col, make)
