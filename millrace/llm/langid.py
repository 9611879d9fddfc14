"""Language ID by nearest centroid: normalised TF-IDF vectors of byte n-grams, several centroids per language.

Features are the 2- and 3-byte grams of the lower-cased text (ASCII bytes that are no letters count as
one kind of space), hashed to ``DIMS`` slots; weight (1 + log tf) * idf, then unit length. Document
frequencies come from all learning rows. The centroids come from a bounded sample of them,
``per_language`` rows for each language (by hash of the id, the same in each run), clustered by
spherical k-means within one task per language. A prediction sees the text alone: the language of
the centroid with the largest cosine.

Results. A text that is null, empty or without any letter: ``und``, score 0, rejected. Otherwise a
learned language; score is the cosine, cut to 0..1; rejected (distance 1 - cosine too large) if it
is below ``reject_below`` or below the language's own limit for texts of that length. The limits are fitted:
each half of a language's sample is scored, whole and in slices of 8, 16, .. 4096 bytes, against centroids
of the other half; a limit is ``_SLACK`` times the ``_LOW`` quantile. Slices stand for short texts, which
score low however clean they are. A language with fewer than ``_FEW`` sampled rows has no limits. Ties go to the smaller language name. Rows with a null label or text are
not learned from; with nothing to learn from, everything is ``und`` and rejected. Very long texts
are counted slice by slice. Rows that share id and label stand for one row of the sample (the smallest text);
each counts for document frequencies, and each has its prediction. An empty table to identify gives no rows.
An input column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bytescan
from millrace.llm.workspace import cut, fresh, quoted

DIMS = 4096
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[:128] = 32
_LETTER[97:123] = np.arange(97, 123)
_SHORTEST, _LONGEST = 3, 12  #: powers of two: text lengths that have limits of their own
_LOW, _SLACK, _FEW = 0.02, 0.8, 20
_SALTS = 8


@dataclass
class Model:
    languages: list[str]  #: of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray  #: least cosine, by centroid and power of two of the text's bytes


def _grams(b: np.ndarray, skip: int) -> np.ndarray:
    """Slots of the grams that end after position skip."""
    c = _LETTER[b]
    two = (c[:-1] << 8) | c[1:]
    three = (two[:-1] << 8) | c[2:]
    out = [x[max(0, skip - n) :][:, None] for n, x in ((1, two), (2, three))]
    two, three = out[0][:, 0], out[1][:, 0]
    two, three = two[two != 0x2020], three[three != 0x202020]
    slot = lambda x, m: ((x * np.uint32(m)) >> np.uint32(20)).astype(np.int64)
    return np.concatenate([slot(two + np.uint32(1 << 24), 2654435769), slot(three, 2246822519)])


def _counts(column):
    """Yields (first row, matrix of gram counts) for blocks of rows."""
    for i, j, data, offsets in bytescan.text_blocks(column, 1 << 19):
        out = np.zeros((j - i, DIMS), np.float32)
        if len(data) > 2 << 20:  # one long text
            for at in range(0, len(data), 1 << 19):
                out[0] += np.bincount(_grams(data[max(0, at - 2) : at + (1 << 19)], min(at, 2)), minlength=DIMS)
        else:
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if b - a > 1:
                    out[row] = np.bincount(_grams(data[a:b], 0), minlength=DIMS)
        yield i, out


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros_like(counts)
    np.log(counts, out=v, where=counts > 0)
    v[counts > 0] += 1
    v *= idf
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.where(length > 0, length, 1)[:, None]
    return v


def _cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    total = v.sum(axis=0)
    seeds = [v[int(np.argmax(v @ total))]]
    while len(seeds) < min(k, len(v)):
        near = np.max(v @ np.array(seeds).T, axis=1)
        if near.min() > 1 - 1e-6:
            break
        seeds.append(v[int(np.argmin(near))])
    c = np.array(seeds)
    for _ in range(12):
        own = np.argmax(v @ c.T, axis=1)
        c = np.array([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    return c.astype(np.float32)


def _power(n_bytes) -> np.ndarray:
    """Which of the limits holds for texts of so many bytes."""
    return np.clip(np.log2(np.maximum(n_bytes, 1)).astype(np.int64), _SHORTEST, _LONGEST) - _SHORTEST


def _limits(v: np.ndarray, n_bytes: np.ndarray, heads: list[bytes], idf: np.ndarray, k: int) -> np.ndarray:
    """The limits of one language: low quantiles of the cosines that each half has to the other's centroids."""
    out = np.zeros(_LONGEST - _SHORTEST + 1, np.float32)
    if len(v) < _FEW:
        return out
    found: list[list] = [[] for _ in out]
    for half in (0, 1):
        c = _cluster(v[1 - half :: 2], k)
        for p, cos in zip(_power(n_bytes[half::2]).tolist(), (v[half::2] @ c.T).max(axis=1).tolist(), strict=True):
            found[p].append(cos)
        for p, cosines in enumerate(found):
            n = 1 << (p + _SHORTEST)
            slices = [h[at : at + n] for h in heads[half::2] for at in {0, h.rfind(b" ", 0, max(0, len(h) - n)) + 1} if len(h) >= at + n]
            for _, counts in _counts(pa.array(slices, pa.binary())):
                cosines += (_unit(counts, idf) @ c.T).max(axis=1).tolist()
    for p, cosines in enumerate(found):
        out[p] = _SLACK * np.quantile(cosines, _LOW) if len(cosines) >= _FEW else out[p - 1] if p else 0
    return np.maximum.accumulate(out)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 400, clusters: int = 3) -> Model:
    """Learns from all rows of docs that have a text and a label."""
    rows = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.lower(F.col(quoted(text_col)).cast("string")).alias("text"), F.col(quoted(label_col)).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")

    def frequencies(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, counts in _counts(batch.column(0)):
                df += (counts > 0).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], names=["slot", "n"])

    df = dict(rows.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect())
    n = df.get(-1, 0)
    if not n:
        return Model([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros((0, 1), np.float32))
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))).astype(np.float32)

    # The first ids of each label by hash, found among the first of each of _SALTS parts of it; texts are fetched afterwards.
    keys = rows.select("label", "id", F.xxhash64("id").alias("h")).withColumn("salt", F.pmod(F.hash("id"), F.lit(_SALTS)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))
    some = keys.withColumn("nth", first("label", "salt")).where(F.col("nth") <= per_language)
    chosen = some.withColumn("nth", first("label")).where(F.col("nth") <= per_language).groupBy("label", "id").agg(F.min("nth").alias("nth"))
    # At most per_language ids for each language, fewer than the model has numbers.
    sample = rows.join(F.broadcast(chosen), ["label", "id"]).groupBy("label", "id", "nth").agg(F.min("text").alias("text"))

    def vectors(batches):
        for batch in batches:
            for i, counts in _counts(batch.column(2)):
                rows = batch.slice(i, len(counts))
                sizes, heads = pc.binary_length(rows.column(2)).cast(pa.int64()), pc.binary_slice(rows.column(2).cast(pa.binary()), 0, 2 << _LONGEST)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), bytescan.lists(list(_unit(counts, idf)), pa.float32()), sizes, heads], names=["label", "nth", "v", "n_bytes", "head"])

    def centroids(table):
        t = table.sort_by("nth")
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(-1, DIMS)
        some = (v != 0).any(axis=1) | ~v.any()
        c = _cluster(v[some], clusters)
        limits = _limits(v[some], np.array(t.column("n_bytes"))[some], t.column("head").filter(pa.array(some)).to_pylist(), idf, clusters)
        return pa.table({"label": pa.array([t.column("label")[0].as_py()] * len(c), pa.string()), "c": bytescan.lists(list(c), pa.float32()), "limits": bytescan.lists([limits] * len(c), pa.float32())})

    found = cut(sample.select("label", "nth", "text")).mapInArrow(vectors, "label string, nth int, v array<float>, n_bytes long, head binary").groupBy("label").applyInArrow(centroids, "label string, c array<float>, limits array<float>").collect()
    found.sort(key=lambda r: r.label)
    return Model([r.label for r in found], idf, np.array([r.c for r in found], np.float32).reshape(-1, DIMS), np.array([r.limits for r in found], np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, reject_below: float = 0.02) -> DataFrame:
    """The columns ``keep`` of docs (default all) and lang_pred, score, rejected."""
    results = ("lang_pred", "score", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    low, has = fresh(docs.columns, "__low", "__has")
    source = docs.select(*[F.col(quoted(c)) for c in keep], F.lower(F.col(quoted(text_col)).cast("string")).alias(low), F.coalesce(F.col(quoted(text_col)).cast("string").rlike(r"\p{L}"), F.lit(False)).alias(has))
    schema = T.StructType([*source.schema.fields[:-2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            best, name, least = np.zeros(n), np.zeros(n, np.int64), np.full(n, float(reject_below))
            if model.languages:
                for i, counts in _counts(batch.column(len(keep))):
                    cos = _unit(counts, model.idf) @ model.centroids.T
                    name[i : i + len(cos)] = np.argmax(cos, axis=1)
                    best[i : i + len(cos)] = np.clip(cos.max(axis=1), 0, 1)
                power = _power(np.asarray(pc.fill_null(pc.binary_length(batch.column(len(keep))), 0)))
                least = np.maximum(least, model.limits[name, power])
            has = np.array(batch.column(len(keep) + 1)) & bool(model.languages)
            best = np.where(has, best, 0.0)
            said = [model.languages[k] if ok else "und" for k, ok in zip(name.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(said, pa.string()), pa.array(best), pa.array(best < least)], names=schema.names)

    return source.mapInArrow(run, schema)
