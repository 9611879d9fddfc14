"""MinHash near-duplicates over word shingles: bottom-k sketches from one hash function.

1. Every text becomes the set of its distinct shingle hashes (64 bits); its sketch is the k least.
   Texts with equal sets collapse to one representative at once (smallest id).
2. Inverted lists of the retained values. A value that only one set retains links nothing. Two sets
   that reach the threshold share at least ``c`` retained values (``required_overlap``), so of each
   sketch, ordered by how rare its values are, the first ``size - c + 1`` must hold a shared one: only
   those postings are kept. Passages that very many texts share stand last in that order.
3. A list is not expanded into pairs. Each of its sets meets the list's smallest member (linear); what that
   links is one component. In lists where several components remain, pairs across components are left.
   Lists of up to ``_SHORT`` sets give them as pairs (linear, too). Longer ones are dealt to blocks of ``_BLOCK``
   sets, and each pair of blocks is compared in one task by one matrix product over sketches of ``_WIDE``
   values: no pair is a row unless it passes. A list is never capped: its work is split, not dropped.
4. A pair passes if the union sketch estimates enough similarity (five standard deviations of slack). Where both
   wide sketches hold their whole sets, the comparison is exact, and a task returns only links that join
   two components; all other pairs are confirmed on the full shingle sets, recomputed for listed texts only.
   A set that very many pairs share is salted there.
5. Components by star contraction; only counts and checksums come to the driver.

Results. A null or empty text, or one of spaces, has an empty set: linked with nothing. A text with
fewer words than a window is one shingle. Rows that share an id are one document: links of any of its
texts are its links, and all its rows stay or go. A null id takes part in nothing: component null, kept. An
empty table gives no rows. ``near_duplicates`` returns its four columns alone, one row for each row of docs;
``drop_near_duplicates`` keeps all columns of docs, whatever their names. Ids must be whole numbers.

Misses: sets no larger than the sketch are handled exactly; for larger ones at the very threshold, the
chance that a pair shares fewer than ``c`` values is below 1e-6.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bytescan
from millrace.llm.components import components
from millrace.llm.workspace import cut, fresh, quoted, settled

SKETCH = 64
_SIGMAS = 5.2
_SHORT, _BLOCK, _WIDE, _HUB = 16, 512, 256, 2000


def _sets(column, width: int):
    """The sorted distinct shingle hashes of each text, as signed 64-bit numbers."""
    for _, _, data, offsets in bytescan.text_blocks(column):
        words, at = bytescan.word_hashes(data, offsets, bytescan.FOLDED)
        windows = bytescan.shingles(words, width).view(np.int64)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:
                yield bytescan.whole(words[a:b]).view(np.int64)
            else:
                yield windows[:0]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n, p1, p2, sketch): set size, a 128-bit fingerprint of the set, its k least hashes."""

    def run(batches):
        for batch in batches:
            n, p1, p2, least = [], [], [], []
            for s in _sets(batch.column(1), width):
                u = s.view(np.uint64)
                n.append(len(s))
                p1.append(int(np.bitwise_xor.reduce(bytescan.mix(u ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0)
                p2.append(int(bytescan.mix(u).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                least.append(s[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), bytescan.lists(least)], names=["id", "n", "p1", "p2", "sketch"])

    source = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n long, p1 long, p2 long, sketch array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles): the whole sets."""

    def run(batches):
        for batch in batches:
            done = 0
            block: list = []
            for s in _sets(batch.column(1), width):
                block.append(s)
                if sum(map(len, block[-64:])) > 1 << 18 or len(block) >= 2000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(block)), bytescan.lists(block)], names=["id", "shingles"])
                    done += len(block)
                    block = []
            if block:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(block)), bytescan.lists(block)], names=["id", "shingles"])

    source = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, shingles array<long>")


def required_overlap(k: int, percent: int) -> int:
    """How many values two k-sketches of similar sets share at least: the least c with a binomial tail
    P(X < c) above 1e-6 for X of k draws that hit with the threshold's probability."""
    p, tail = percent / 100, 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if tail > 1e-6:
            return max(c, 1)
    return k


def _overlap_column(k: int, percent: int):
    """c for a set of n shingles: exact while both sets of a pair fit into their sketches."""
    exact = F.floor((F.col("n") * percent + 99) / 100)
    return F.when(F.col("n") <= k * percent // 100, exact).otherwise(F.lit(required_overlap(k, percent))).cast("int")


def _postings(sets: DataFrame, needed) -> DataFrame:
    """(id, v): of each set's retained values, rarest first, those that a partner with ``needed`` common values
    cannot all miss. Values of one set alone are left out."""
    values = sets.select("id", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(common, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by_rarity"))
    kept = shared.where(F.size("by_rarity") >= needed)
    first = F.slice(F.col("by_rarity"), F.lit(1), F.size("by_rarity") - needed + 1)
    return kept.select("id", F.explode(first).alias("x")).select("id", F.col("x.v").alias("v"))


def _with(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with the columns of both sets; an ``a`` of more than ``_HUB`` pairs is spread over several tasks."""
    side = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / _HUB).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    spread = side("a").join(hubs, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    salted = pairs.join(side("b"), "b").join(hubs, "a", "left").withColumn("salt", F.pmod(F.hash("b"), parts)).drop("parts")
    return salted.join(spread, ["a", "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, whole: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the threshold."""
    slack = _SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    both = _with(pairs, sets, "n", "sketch").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    likely = settled(both.where(shared >= F.size(union) * (percent / 100 - slack)).select("a", "b"))
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    met = _with(likely, whole, "shingles")
    return met.where(common * 100 >= (F.size("shingles_a") + F.size("shingles_b") - common) * percent).select("a", "b").distinct()


def _compare(sets: list[np.ndarray], component: np.ndarray, n: np.ndarray, block: np.ndarray, percent: int, most: int) -> list[tuple[int, int, bool]]:
    """(row, row, exact) of the sets of a list, or of two blocks of it, that reach the threshold across components.

    Overlaps of all of them at once: the product of the set-by-value matrix with its transpose. A set of more than ``most``
    values is known up to the last of them; a pair is compared below the smaller of the two ends."""
    slack = _SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / most)
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    place = (np.cumsum(often) - 1)[place]
    row, place = row[often[np.searchsorted(values, flat)]], place[often[np.searchsorted(values, flat)]]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(often.sum()), 4096):
        part = (place >= at) & (place < at + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[part], place[part] - at] = 1
        overlap += m @ m.T
    exact = n == size
    end = np.array([np.iinfo(np.int64).max if e else s[-1] for e, s in zip(exact, sets, strict=True)])
    mine = np.broadcast_to(size[:, None], overlap.shape)  # [x, y]: values of x below both ends
    if not exact.all():
        mine = np.where(end[:, None] <= end[None, :], mine, np.array([np.searchsorted(s, end, "right") for s in sets]))
    union = mine + mine.T - overlap
    sure = exact[:, None] & exact[None, :]
    ok = np.where(sure, 100 * overlap >= percent * union, overlap >= (percent / 100 - slack) * union)
    ok &= (component[:, None] != component[None, :]) & (np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * percent)
    if block.any() and not block.all():
        ok &= block[:, None] != block[None, :]
    up = {int(c): int(c) for c in np.unique(component)}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    found = []
    x, y = np.nonzero(np.triu(ok & sure, 1))
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = top(int(component[i])), top(int(component[j]))
        if a != b:
            up[a] = b
            found.append((i, j, True))
    root = np.array([top(int(c)) for c in component])
    x, y = np.nonzero(np.triu(ok & ~sure & (root[:, None] != root[None, :]), 1))
    return found + [(i, j, False) for i, j in zip(x.tolist(), y.tolist(), strict=True)]


def _across(long: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """(a, b, exact) of the pairs across components that pass, from lists (v, id, c) in blocks and sets (id, n, wide)."""
    sizes = long.groupBy("v").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    placed = long.join(sizes, "v").withColumn("own", F.pmod(F.hash("id", "v"), "blocks"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    tasks = placed.select("v", "id", "c", "own", F.explode(others).alias("t")).select("v", "t.i", "t.j", "id", "c", (F.col("own") == F.col("t.j")).alias("second"))
    rows = tasks.join(wide, "id").select("v", "i", "j", "second", "id", "c", "n", "wide")

    most = _WIDE

    def run(batches):
        key, held = None, []

        def done():
            if len(held) > 1:
                ids = [h[1] for h in held]
                got = _compare([h[4] for h in held], *(np.array([h[k] for h in held], np.int64) for k in (2, 3, 0)), percent, most)
                yield pa.RecordBatch.from_arrays([pa.array([min(ids[i], ids[j]) for i, j, _ in got], pa.int64()), pa.array([max(ids[i], ids[j]) for i, j, _ in got], pa.int64()), pa.array([e for *_, e in got], pa.bool_())], names=["a", "b", "exact"])

        for batch in batches:
            v, i, j, second, ident, c, n = (x.to_pylist() for x in batch.columns[:7])
            wide = batch.column(7)
            flat, off = np.asarray(wide.values), np.asarray(wide.offsets)
            for r in range(batch.num_rows):
                if (v[r], i[r], j[r]) != key:
                    yield from done()
                    key, held = (v[r], i[r], j[r]), []
                held.append((second[r], ident[r], c[r], n[r], flat[off[r] : off[r + 1]]))
        yield from done()

    return rows.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j").mapInArrow(run, "a long, b long, exact boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; percent is the least Jaccard similarity of a link."""
    made = cut(sketches(docs, id_col, text_col, width, k))
    usable = made.where("n > 0 AND id IS NOT NULL")
    groups = usable.groupBy("p1", "p2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = settled(groups, 4000)
    reps = sets.select(F.col("rep").alias("id"), "n", "sketch")

    listed = settled(_postings(reps, _overlap_column(k, percent)))
    first = listed.groupBy("v").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1")
    stars = settled(listed.join(first, "v").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    wanted = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).join(wanted, "id", "left_semi")
    whole = settled(full_sets(texts, "id", "text", width), 4000)
    label = settled(components(_verified(stars, reps, whole, k, percent)))

    # Where several components are left in a list, its sets meet across components.
    named = listed.join(label, "id", "left").select("v", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("v").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("size")).where("least <> most").select("v", "size")
    left = settled(named.join(mixed, "v"))
    short = left.where(F.col("size") <= _SHORT).select("v", "id", "c")
    x, y = short.toDF("v", "a", "ca"), short.toDF("v", "b", "cb")
    few = x.join(y, "v").where("a < b AND ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    wide = whole.select("id", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, _WIDE).alias("wide"))
    passed = settled(_across(left.where(F.col("size") > _SHORT).select("v", "id", "c"), wide, percent))
    unsure = passed.where("NOT exact").select("a", "b")
    more = passed.where("exact").select("a", "b").union(_verified(few.union(unsure).distinct(), reps, whole, k, percent))

    copies = usable.join(sets.select("p1", "p2", "rep"), ["p1", "p2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    final = components(label.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more).union(copies))
    out = made.join(final, "id", "left")
    found = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """docs without those rows whose group of near-duplicates has a smaller id."""
    (gone,) = fresh(docs.columns, "__gone")
    found = near_duplicates(docs, id_col, text_col, width, percent, k).where(~F.col("kept")).select(F.col(quoted(id_col)).alias(gone)).distinct()
    return docs.join(found, F.col(quoted(id_col)).cast("long") == F.col(gone), "left_anti")
