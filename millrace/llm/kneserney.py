"""Interpolated modified Kneser-Ney model of any order: counted in Spark, sorted hash arrays in files, memory-mapped.

Counting: a pair is a context (the ``order - 1`` tokens before, from as many beginnings on) and its next token. Each task
aggregates the pairs of its texts; Spark shuffles them by a part number that comes from the context's hash (from
the pair's where the context is very frequent), and each part writes its pairs as one sorted array. There is a part for
every ``_PART_BYTES`` of text at least. Tasks keep pairs as they come, about 24 bytes each, and sum them slice by slice. The same pass gives each context's total and how many next tokens follow it
once, twice and more often, and hands on the pairs of the next lower order: the context without its oldest token, counted
by how many different tokens stand before it (continuation counts). They are shuffled and merged in the same way, down to single
tokens. Each order has its own discounts, from its counts of counts; the highest uses raw counts, all lower ones
continuation counts, down to the uniform distribution over the vocabulary and one unknown word.

Words are 64-bit hashes; files are numpy arrays sorted by hash, written under a temporary name and then
moved, so that repeated tasks are harmless. The shared folder must be mounted as a file system, as it is memory-mapped.
Discounts need entries that were counted once, twice and three times; without them each is 0.5.

Results. A null or empty text is one end token. Texts count whole; rows that share an id each count. With an
empty training table each token has the probability of the uniform distribution (1). Other columns pass
through; a clashing one gives way to the result. Ids are not looked at: null ids are rows like others. An empty
table to score gives no rows.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bytescan
from millrace.llm.workspace import fresh, new_folder, quoted, table

BOS = np.uint64(0x1B873593CC9E2D51)
EOS = np.uint64(0x85EBCA6BC2B2AE35)
_CHUNK = 1 << 19
_PART_BYTES = 32 << 20
#: Pairs that a task counts before it deals them out, that it sums at once, and in a row of a block at most.
_HELD, _SLICE, _ROW = 1 << 20, 1 << 18, 1 << 13


@dataclass(frozen=True)
class Model:
    folder: str
    parts: int
    tokens: int  #: N, training tokens
    vocabulary: int  #: V, distinct training tokens
    discounts: tuple[tuple[float, float, float], ...]  #: of the second order, the third and so on
    lower_rest: float  #: probability of any single word at the lowest order before its own count
    hot: tuple[tuple[int, ...], ...]  #: by order, contexts whose pairs are dealt to all parts


def _local(folder: str) -> str:
    u = urlparse(folder)
    if u.scheme not in ("", "file"):
        raise ValueError(f"{folder}: the model is memory-mapped, so the shared folder must be a mounted file system")
    return u.path


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end after each text, the token before each (BOS first), and where each text begins."""
    words, at = bytescan.word_hashes(data, offsets, bytescan.FOLDED)
    n = len(at) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = at[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words
    out[ends] = EOS
    before = np.empty_like(out)
    before[1:] = out[:-1]
    starts = at[:-1] + np.arange(n)
    before[starts] = BOS
    return out, before, starts


def _contexts(before: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the last one, two, ... order - 1 tokens before each token."""
    out = [before]
    oldest = before
    for _ in range(order - 2):
        oldest = np.r_[BOS, oldest[:-1]]
        oldest[starts] = BOS
        out.append(_pair(oldest, out[-1]))
    return out


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return bytescan.mix(u * np.uint64(0x9E3779B97F4A7C15) + v)


def _part(u: np.ndarray, parts: int) -> np.ndarray:
    return ((bytescan.mix(u) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _pair_part(u: np.ndarray, key: np.ndarray, parts: int, hot: tuple[int, ...]) -> np.ndarray:
    """The part of each pair: that of its context, or its own if the context is hot."""
    out = _part(u, parts)
    if hot:
        spread = np.isin(u, np.array(hot, np.uint64))
        out[spread] = _part(key[spread], parts)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _summed(u, v, n, chain):
    """Distinct pairs in the order of their keys, with summed counts; chain: a row of shorter contexts for each pair."""
    key = _pair(u, v)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    some = order[first]
    return key[first], u[some], v[some], np.add.reduceat(n[order], first) if len(key) else n, chain[some]


def _dealt(key, u, v, n, chain, parts: int, hot: tuple[int, ...]):
    """For each part its number and, as bytes, its pairs, in rows of at most _ROW: each context once with its shorter ones, then next
    tokens and counts. Contexts ascend in a row."""
    where = _pair_part(u, key, parts, hot)
    order = np.lexsort((u, where))
    u, v, n, chain, where = u[order], v[order], n[order], chain[order], where[order]
    edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else np.zeros(1, np.int64)
    rows = [(a, min(a + _ROW, end)) for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for a in range(start, end, _ROW)]
    for a, b in rows:
        first = np.flatnonzero(np.r_[True, u[a + 1 : b] != u[a : b - 1]])
        cols = (u[a:b][first], np.diff(np.r_[first, b - a]).astype(np.uint32), chain[a:b][first], v[a:b], n[a:b].astype(np.uint32))
        yield [pa.array(where[a : a + 1]), *[pa.array([c.tobytes()], pa.binary()) for c in cols]]


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    for what, a in arrays.items():
        trial = f"{folder}/{name}.{what}.{TaskContext.get().taskAttemptId()}.tmp"
        with open(trial, "wb") as f:
            np.save(f, a)
        os.replace(trial, f"{folder}/{name}.{what}.npy")


def _load(folder: str, name: str, *what: str) -> list[np.ndarray]:
    """Memory-mapped; a part without any row has no file."""
    if not os.path.exists(f"{folder}/{name}.{what[0]}.npy"):
        return [np.zeros(0, np.uint64)] * len(what)
    return [np.load(f"{folder}/{name}.{w}.npy", mmap_mode="r") for w in what]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """From the numbers of entries counted once to four times; without enough of them 0.5 each."""
    if not all(n[:3]):
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


_BLOCKS = "part int, u binary, runs binary, chain binary, v binary, n binary"
_SUMS = ["h", "c", "kinds", "total", "one", "two", "more", "n1", "n2", "n3", "n4"]


def train(docs: DataFrame, text_col: str = "text", parts: int | None = None, order: int = 2) -> Model:
    """Learns from all rows of docs; order is the length of the longest n-grams, 2 at least."""
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    folder = _local(new_folder(spark, "ngrams"))
    texts = docs.select(F.col(quoted(text_col)).cast("string").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes * (order - 1) // _PART_BYTES, 1)
    hot = _hot_contexts(texts, parts, order)

    blocks = texts.mapInArrow(_count(parts, order, hot[-1]), _BLOCKS)
    counted, discounts = [], []
    for level in range(order, 1, -1):
        kept = ", ".join(f"{x} long" for x in _SUMS) + (f", level int, {_BLOCKS}" if level > 2 else "")
        rows = table(blocks.repartitionById(parts, "part").mapInArrow(_merge(folder, level, order, parts, hot), kept), "word-counts")
        discounts.append(_discounts(list(rows.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in _SUMS[-4:]]).first())))
        if level > 2:
            blocks = rows.where("part IS NOT NULL").select("part", "u", "runs", "chain", "v", "n")
        counted.append(rows.where("h IS NOT NULL").select(*_SUMS[:7], F.col("level") if level > 2 else F.lit(2).alias("level")))
    d = tuple(discounts[::-1])
    sums = counted[0]
    for more in counted[1:]:
        sums = sums.union(more)
    words = sums.groupBy("level", "h").agg(*[F.sum(x).alias(x) for x in _SUMS[1:7]])
    low_kinds = [F.count_if(F.col("kinds") == i) for i in (1, 2, 3, 4)]
    stats = words.where("level = 2").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("kinds"), F.lit(0)), *low_kinds, F.count_if(F.col("kinds") > 2)).first()
    n, size, types, low = stats[0], stats[1], stats[2], list(stats[3:7])
    e = _discounts(low)
    rest = (e[0] * low[0] + e[1] * low[1] + e[2] * stats[7]) / types / (size + 1) if types else 1.0

    def finish(batches):
        by: dict[tuple[int, int], list] = {}
        for batch in batches:
            level, *cols = (np.asarray(c) for c in batch.columns)
            p = _part(cols[0].view(np.uint64), parts)
            for at in np.unique(level).tolist():
                for k in np.unique(p[level == at]).tolist():
                    own = (level == at) & (p == k)
                    by.setdefault((at, k), []).append([c[own] for c in cols])
        for level, k in sorted(by):
            h, c, kinds, total, one, two, more = (np.concatenate(x) for x in zip(*by.pop((level, k)), strict=True))
            h = h.view(np.uint64)
            o = np.argsort(h)
            x = d[level - 2]
            gamma = np.where(total > 0, (x[0] * one + x[1] * two + x[2] * more) / np.maximum(total, 1), 1.0)
            stands = o[total[o] > 0]
            _save(folder, f"context-{level}-{k}", key=h[stands], total=total[stands], gamma=gamma[stands])
            if level == 2:
                o = o[kinds[o] > 0]
                p1 = np.maximum(kinds - np.choose(np.minimum(kinds, 3), (0.0, *e)), 0) / max(types, 1) + rest
                _save(folder, f"word-{k}", key=h[o], c=c[o], p=p1[o])
            yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64())], names=["n"])

    placed = words.select("level", "h", *_SUMS[1:7]).mapInArrow(_with_part(parts), "part int, level int, " + ", ".join(f"{x} long" for x in _SUMS[:7])).repartitionById(parts, "part").drop("part")
    placed.mapInArrow(finish, "n long").agg(F.sum("n")).collect()
    return Model(folder, parts, int(n), int(size), d, float(rest), hot)


def _count(parts: int, order: int, hot: tuple[int, ...]):
    """The pairs of the highest order, in blocks for their parts."""

    def run(batches):
        held, size = [], 0

        def out():
            groups = min(parts, 8)  # of parts, one after the other: only a group is sorted at once
            for g in range(groups):
                own = [[x[where % groups == g] for x in pairs] for where, *pairs in held]
                pairs = _summed(*(np.concatenate(x) for x in zip(*own, strict=True)))
                del own
                for cols in _dealt(*pairs, parts, hot):
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "u", "runs", "chain", "v", "n"])

        for batch in batches:
            for _, _, data, offsets in bytescan.text_blocks(batch.column(0)):
                token, before, starts = _tokens(data, offsets)
                *shorter, context = _contexts(before, starts, order)
                chain = np.stack(shorter[::-1], 1) if shorter else np.zeros((len(token), 0), np.uint64)
                key, u, v, n, chain = _summed(context, token, np.ones(len(token), np.int64), chain)
                held.append((_pair_part(u, key, parts, hot), u, v, n.astype(np.uint32), chain))
                size += len(key)
                if size > _HELD:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


def _slices(blocks: list[tuple]):
    """Pairs of the blocks by ranges of their contexts, so that all pairs of a context come together; about _SLICE at once."""
    steps = max(1, -(-sum(len(v) for _, _, _, v, _ in blocks) // _SLICE))
    cuts = np.array([(i << 64) // steps for i in range(1, steps)], np.uint64)
    at = [np.r_[0, np.searchsorted(u, cuts), len(u)] for u, *_ in blocks]
    ends = [np.r_[0, np.cumsum(runs.astype(np.int64))] for _, runs, *_ in blocks]
    for i in range(steps):
        own = []
        for (u, runs, chain, v, n), a, e in zip(blocks, at, ends, strict=True):
            some, pairs = slice(a[i], a[i + 1]), slice(e[a[i]], e[a[i + 1]])
            own.append((np.repeat(u[some], runs[some]), v[pairs], n[pairs].astype(np.int64), np.repeat(chain[some], runs[some], 0)))
        yield [np.concatenate(x) for x in zip(*own, strict=True)]


def _merge(folder: str, level: int, order: int, parts: int, hot: tuple[tuple[int, ...], ...]):
    """Saves each part's pairs of an order. Rows: sums of contexts and of single words, the pairs of the next lower order in
    blocks, and the order's counts of counts."""

    def sums(at, words, **given):
        for a in range(0, len(words), 1 << 15):
            s = slice(a, a + (1 << 15))
            cols = {"h": pa.array(_signed(words)[s])} | {x: pa.array(given[x][s].astype(np.int64)) if x in given else pa.array(np.zeros(len(words[s]), np.int64)) for x in _SUMS[1:7]}
            yield row({**cols, "level": pa.array(np.full(len(words[s]), at, np.int32))}, len(words[s]))

    def row(cols, n):
        kinds = [(x, pa.int64()) for x in _SUMS] + ([("level", pa.int32()), ("part", pa.int32())] + [(x, pa.binary()) for x in ("u", "runs", "chain", "v", "n")] if level > 2 else [])
        return pa.RecordBatch.from_arrays([cols[x] if x in cols else pa.nulls(n, kind) for x, kind in kinds], names=[x for x, _ in kinds])

    def block(batch, i):
        u, runs, chain, v, n = (np.frombuffer(batch.column(x)[i].as_buffer(), kind) if batch.column(x)[i].as_buffer().size else np.zeros(0, kind) for x, kind in zip(("u", "runs", "chain", "v", "n"), (np.uint64, np.uint32, np.uint64, np.uint64, np.uint32), strict=True))
        return u, runs, chain.reshape(len(u), level - 2), v, n

    def run(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for i, k in enumerate(batch.column("part").to_pylist()):
                by.setdefault(k, []).append(block(batch, i))
        for k in sorted(by):
            keys, counts, words, some = [], [], [], np.zeros(4, np.int64)
            add = lambda x, at: np.add.reduceat(x.astype(np.int64), at)
            for pairs in _slices(by.pop(k)):
                if not len(pairs[0]):
                    continue
                key, u, v, n, chain = _summed(*pairs)
                del pairs
                keys.append(key)
                counts.append(n.astype(np.min_scalar_type(int(n.max()))))
                some += [(n == i).sum() for i in (1, 2, 3, 4)]
                o = np.argsort(u)
                c = n[o]
                first = np.flatnonzero(np.r_[True, u[o][1:] != u[o][:-1]])
                yield from sums(level, u[o][first], total=add(c, first), one=add(c == 1, first), two=add(c == 2, first), more=add(c > 2, first))
                if level in (2, order):
                    o = np.argsort(v)
                    first = np.flatnonzero(np.r_[True, v[o][1:] != v[o][:-1]])
                    words.append((v[o][first], add(n[o], first), np.diff(np.r_[first, len(v)])))
                if level > 2:
                    lower = _summed(chain[:, 0], v, np.ones(len(v), np.int64), chain[:, 1:])
                    for cols in _dealt(*lower, parts, hot[level - 3]):
                        yield row(dict(zip(("part", "u", "runs", "chain", "v", "n"), cols, strict=True)), 1)
            key, n = np.concatenate(keys), np.concatenate(counts)
            del keys, counts
            o = np.argsort(key)
            _save(folder, f"pair-{level}-{k}", key=key[o], n=n[o])
            del key, n, o
            if words:
                v, c, kinds = (np.concatenate(x) for x in zip(*words, strict=True))
                o = np.argsort(v)
                first = np.flatnonzero(np.r_[True, v[o][1:] != v[o][:-1]])
                yield from sums(2, v[o][first], **({"c": add(c[o], first)} if level == order else {}), **({"kinds": add(kinds[o], first)} if level == 2 else {}))
            yield row({x: pa.array([y], pa.int64()) for x, y in zip(_SUMS[-4:], some.tolist(), strict=True)}, 1)

    return run


def _hot_contexts(texts: DataFrame, parts: int, order: int) -> tuple[tuple[int, ...], ...]:
    """By order, contexts that hold more than half a part's mean share of the tokens, at most 2 * parts of them; found in every
    64th text by hash. They decide only where pairs are counted, so a context that is missed changes no result."""
    least = 1 / (2 * parts)

    def run(batches):
        held: dict[tuple[int, int], int] = {}
        n = 0
        for batch in batches:
            for _, _, data, offsets in bytescan.text_blocks(batch.column(0)):
                token, before, starts = _tokens(data, offsets)
                n += len(token)
                for level, context in enumerate(_contexts(before, starts, order), 2):
                    u, k = np.unique(context, return_counts=True)
                    often = k >= least * len(token) / 8
                    for x, c in zip(u[often].tolist(), k[often].tolist(), strict=True):
                        held[level, x] = held.get((level, x), 0) + c
        if n:
            levels, contexts = [0, *(x for x, _ in held)], np.array([0, *(x for _, x in held)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(_signed(contexts)), pa.array([n, *held.values()], pa.int64())], names=["level", "u", "n"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).mapInArrow(run, "level int, u long, n long").groupBy("level", "u").agg(F.sum("n").alias("n"))
    total = some.where("level = 0").agg(F.sum("n")).first()[0]
    found = some.where((F.col("level") > 0) & (F.col("n") >= least * total)).select("level", "u").collect() if total else []
    return tuple(tuple(sorted(r.u % (1 << 64) for r in found if r.level == level)) for level in range(2, order + 1))


def _with_part(parts: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_part(np.asarray(batch.column("h")).view(np.uint64), parts)), *batch.columns], names=["part", *batch.schema.names])

    return run


def _lookup(keys: np.ndarray, where: np.ndarray, folder: str, kind: str, *what: str, defaults: tuple) -> list[np.ndarray]:
    """For each key its values in the part that it belongs to; queries go part by part, in order of the keys."""
    out = [np.full(len(keys), d) for d in defaults]
    order = np.lexsort((keys, where))
    edges = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        table, *values = _load(folder, f"{kind}-{int(where[order[a]])}", "key", *what)
        if len(table):
            own = order[a:b]
            at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
            hit = table[at] == keys[own]
            for o, v in zip(out, values, strict=True):
                o[own[hit]] = v[at[hit]]
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (default all), n_tokens, n_known, base_score, score (log10 probabilities)."""
    added = ["n_tokens", "n_known", "base_score", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    (text,) = fresh(docs.columns, "__text")
    rows = docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col)).cast("string").alias(text))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(x, T.LongType()) for x in added[:2]], *[T.StructField(x, T.DoubleType()) for x in added[2:]]])
    m = model

    def block(token, contexts):
        """Per token: known, log10 of the base and of the model."""
        words, at = np.unique(token, return_inverse=True)
        c, p = _lookup(words, _part(words, m.parts), m.folder, "word", "c", "p", defaults=(0, m.lower_rest))
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        p = p[at]
        for level, (context, d, hot) in enumerate(zip(contexts, m.discounts, m.hot, strict=True), 2):
            each, ctx = np.unique(context, return_inverse=True)
            total, gamma = _lookup(each, _part(each, m.parts), m.folder, f"context-{level}", "total", "gamma", defaults=(0, 1.0))
            key = _pair(context, token)
            (n,) = _lookup(key, _pair_part(context, key, m.parts, hot), m.folder, f"pair-{level}", "n", defaults=(0,))
            high = np.maximum(n - np.choose(np.minimum(n, 3), (0.0, *d)), 0) / np.maximum(total[ctx], 1)
            p = high + gamma[ctx] * p
        return c[at] > 0, base[at], np.log10(p)

    def run(batches):
        for batch in batches:
            sums = [[], [], [], []]
            for _, _, data, offsets in bytescan.text_blocks(batch.column(len(keep)), 2 << 20):
                token, before, starts = _tokens(data, offsets)
                contexts = _contexts(before, starts, len(m.discounts) + 1)
                parts = [block(token[a : a + _CHUNK], [c[a : a + _CHUNK] for c in contexts]) for a in range(0, len(token), _CHUNK)]
                known, base, own = (np.concatenate(x) for x in zip(*parts, strict=True))
                sums[0].append(np.diff(np.r_[starts, len(token)]))
                for s, x in zip(sums[1:], (known.astype(np.int64), base, own), strict=True):
                    s.append(np.add.reduceat(x, starts))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(np.concatenate(s)) for s in sums]], names=schema.names)

    return rows.mapInArrow(run, schema)
