"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

A text is cut where no piece can reach across (between characters that stand side by side in no piece, as before a
run of U+2581 and around line ends). The distinct cuts of a batch are concatenated and indexed by a suffix array (prefix doubling, as deep as the longest piece);
every piece of the vocabulary is searched in it at once by binary search, which gives its range of
occurrences. The occurrences are the edges of a lattice; sorted by end position they are relaxed from
left to right: at each position exactly one edge ends that is compatible with the last piece of the prefix
that it extends. Two pieces are compatible if merging by priority never joins across their border; a
sequence in which all neighbours are compatible is the merge result itself, so the relaxed path equals
SentencePiece's output; ties of score, as in runs of U+2581, go to the left. Should a cut have no such sequence or
more than one, it is merged one by one instead.

The model file is read here (pieces, scores, kinds); nothing is trained. Characters without a piece become
byte pieces. Results are kept for cuts and piece pairs in bounded tables of each Python worker.

Results. A null or empty text has no ids and decodes to "". Texts round-trip but for U+2581, which decodes as a
space. Ids outside the vocabulary and control ids decode to nothing; invalid byte runs to U+FFFD. Other
columns pass through; a clashing one gives way to the result.
"""

from __future__ import annotations

import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.workspace import fresh, quoted

SPACE = "▁"
_CHARS = 1 << 18
_BLOCK = 1 << 20
_MOST_CUTS = 400_000
_MOST_PAIRS = 1_500_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            x |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return x

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            at += n
            yield key >> 3, data[at - n : at]


class Vocabulary:
    """The pieces of a model file: BPE with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        self.text, self.score, self.kind = [], [], []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                self.score.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                self.kind.append(piece.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2 or not trainer.get(35):
                    raise ValueError("only BPE models with byte fallback are supported")
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(1) != b"identity" or norm.get(4, 1):
                    raise ValueError("only models that leave the text as it is are supported")
        self.id = {t: i for i, t in enumerate(self.text) if self.kind[i] in (1, 4)}
        self.joined = np.zeros((256, 256), bool)  # bytes that some piece holds side by side, or one character (blanks for U+2581)
        self.joined[:, 128:192] = True
        for t in self.id:
            b = np.frombuffer(t.replace(SPACE, " ").encode(), np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.bytes = [0] * 256
        for i, t in enumerate(self.text):
            if self.kind[i] == 6:
                self.bytes[int(t[1:-1], 16)] = i
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", t, re.S) for t in self.id):
            raise ValueError("pieces that reach over the start of a word or a line end are not supported")
        self.raw = [b"" if k in (2, 3) else bytes([int(t[1:-1], 16)]) if k == 6 else t.encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.shown = pa.array([x.replace(SPACE.encode(), b" ") for x in self.raw] + [b""], pa.large_binary())  # the last: ids outside the vocabulary
        order = sorted(self.id, key=lambda t: [ord(c) for c in t])
        self.longest = max(map(len, order), default=1)
        self.sorted_ids = np.array([self.id[t] for t in order], np.int64)
        self.lengths = np.array([len(t) for t in order], np.int64)
        self.codes = np.full((len(order), self.longest), -1, np.int64)
        for i, t in enumerate(order):
            self.codes[i, : len(t)] = [ord(c) + 1 for c in t]
        self.single = {t for t in self.id if len(t) == 1}
        self._sides: dict[int, tuple] = {}
        self.cuts: dict[str, bytes] = {}
        self.pair_keys, self.pair_fit = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge(self, text: str, record: list | None = None) -> list[str]:
        """Merging by score, leftmost first among equals; record gets (score, first, last symbol) after each merge."""
        sym = list(text)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        queue: list = []

        def offer(i):
            j = after[i]
            if j < len(sym) and (k := self.id.get(sym[i] + sym[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i)
        end = len(sym) - 1
        while queue:
            s, i, x, y = heapq.heappop(queue)
            j = after[i] if sym[i] is not None else len(sym)
            if j >= len(sym) or sym[i] != x or sym[j] != y:
                continue
            sym[i], sym[j], after[i] = x + y, None, after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            end = i if j == end else end
            if record is not None:
                record.append((-s, sym[0], sym[end]))
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in sym if s is not None]

    def _side(self, k: int) -> tuple:
        """The piece's first and last symbol at the start, and its merges."""
        if k not in self._sides:
            steps: list = []
            t = self.text[k]
            self._sides[k] = (t[0], t[-1], steps, len(self.merge(t, steps)) == 1)
        return self._sides[k]

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: no merge across the border is ever the next one."""
        _, last, left, whole = self._side(a)
        first, _, right, whole_b = self._side(b)
        if not (whole and whole_b):
            return False
        i = j = 0
        while True:
            k = self.id.get(last + first)
            x = left[i][0] if i < len(left) else -np.inf
            y = right[j][0] if j < len(right) else -np.inf
            if k is not None and self.score[k] > x and self.score[k] >= y:
                return False
            if i == len(left) and j == len(right):
                return True
            if x >= y:
                last, i = left[i][2], i + 1
            else:
                first, j = right[j][1], j + 1

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits for arrays of ids, through the table of known pairs."""
        keys = a << 32 | b
        need = np.unique(keys)
        at = np.searchsorted(self.pair_keys, need)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == need[known]
        new = need[~known]
        if len(new):
            fit = np.fromiter((self.fits(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))
            where = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_fit = np.insert(self.pair_keys, where, new), np.insert(self.pair_fit, where, fit)
        return self.pair_fit[np.searchsorted(self.pair_keys, keys)]

    def _emit(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for t in parts:
            k = self.id.get(t)
            out += [k] if k is not None else [self.bytes[x] for x in t.encode()]
        return np.array(out, np.int32).tobytes()

    def encode_cuts(self, cuts: list[str]) -> None:
        """Adds the ids of new distinct cuts to the table."""
        if len(self.pair_keys) > _MOST_PAIRS:
            self.pair_keys, self.pair_fit = np.zeros(0, np.int64), np.zeros(0, bool)
        block: list[str] = []
        size = 0
        for c in cuts:
            block.append(c)
            size += len(c) + 1
            if size > _CHARS:
                self._relax(block)
                block, size = [], 0
        if block:
            self._relax(block)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of a piece in the text with those codes (0: a border)."""
        n = len(codes)
        dense = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        bits = int(dense.max()).bit_length() or 1
        step, rank = 1, dense
        while step < self.longest and (step + 1) * bits < 48:  # as many characters as fit into a number
            rank = rank << bits
            rank[: max(0, n - step)] |= dense[step:]  # a block may be shorter than a piece
            step += 1
        if step < self.longest:
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        while True:  # suffixes by their first `step` characters
            if step >= self.longest:
                order = np.argsort(rank, kind="stable")
                break
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - step)] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64)
            step *= 2
        padded = np.concatenate([codes, np.zeros(self.longest + 1, np.int64)])

        def search(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.codes), np.int64), np.full(len(self.codes), n, np.int64)
            while (open_ := low < high).any():
                mid = (low + high) >> 1
                at = order[np.minimum(mid, n - 1)]
                less, same = np.zeros(len(at), bool), open_.copy()
                for k in range(self.longest):
                    same &= self.lengths > k
                    if not same.any():
                        break
                    c = padded[at + k]
                    less |= same & (c < self.codes[:, k])
                    same &= c == self.codes[:, k]
                    ended = same & (self.lengths == k + 1)
                    if after:
                        less |= ended
                low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
            return low

        first, last = search(False), search(True)
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[piece]]
        return at, self.lengths[piece], self.sorted_ids[piece]

    def _relax(self, cuts: list[str]) -> None:
        codes = np.array([0, *np.frombuffer("\0".join(cuts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1, 0])
        size = np.array([len(c) for c in cuts], np.int64)
        begin = np.cumsum(size + 1) - size
        border = np.ones(len(codes), bool)
        border[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())] = False
        codes[border] = 0
        start, length, piece = self.edges(codes)
        known = np.zeros(len(codes), bool)
        known[start[length == 1]] = True
        odd = np.flatnonzero(~known & ~border)  # characters without a piece
        start, length, piece = np.r_[start, odd], np.r_[length, np.ones(len(odd), np.int64)], np.r_[piece, np.full(len(odd), -1)]
        offset = np.arange(len(codes)) - np.maximum.accumulate(np.where(border, np.arange(len(codes)), 0)) - 1
        end = start + length
        depth = offset[start] + length
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        steps = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(depth) else np.zeros(1, np.int64)
        last = np.full(len(codes) + 1, -3, np.int64)  # piece that ends before a position; -1 no piece, -2 start, -3 none
        last[begin] = -2
        back = np.zeros(len(codes) + 1, np.int64)
        twice = np.zeros(len(codes) + 1, bool)
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            s, p, e = start[a:b], piece[a:b], end[a:b]
            x = last[s]
            ok = (x == -2) | (x != -3) & ((x == -1) | (p == -1))
            test = np.flatnonzero((x >= 0) & (p >= 0))
            ok[test] = self._fit(x[test], p[test])
            alone = np.flatnonzero((x == -2) & (p >= 0))
            ok[alone] = [self._side(k)[3] for k in p[alone].tolist()]
            s, p, e = s[ok], p[ok], e[ok]
            twice[e] |= last[e] != -3
            last[e], back[e] = p, s
            if len(np.unique(e)) != len(e):
                seen, n = np.unique(e, return_counts=True)
                twice[seen[n > 1]] = True
        bad_upto = np.cumsum(twice)
        at, path = begin + size, []
        alive = np.flatnonzero((last[begin + size] != -3) & (bad_upto[begin + size] == bad_upto[begin]))
        row, pos = alive, at[alive]
        while len(row):  # all paths backwards, one piece a round
            path.append((row, back[pos], last[pos]))
            pos = back[pos]
            more = pos > begin[row]
            row, pos = row[more], pos[more]
        rows, starts, ids = (np.concatenate(x) for x in zip(*path, strict=True)) if path else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((starts, rows))
        rows, starts, ids = rows[order], starts[order], ids[order].astype(np.int32)
        bounds = np.searchsorted(rows, np.arange(len(cuts) + 1)).tolist()
        lost = (np.cumsum(ids == -1) - (ids == -1)).tolist() + [int((ids == -1).sum())]
        good = set(alive.tolist())
        for i, c in enumerate(cuts):
            a, b = bounds[i], bounds[i + 1]
            name = c.replace(SPACE, " ")
            if i not in good:
                self.cuts[name] = self._emit(self.merge(c))
            elif lost[b] > lost[a]:
                out: list[int] = []
                for k, s in zip(ids[a:b].tolist(), starts[a:b].tolist(), strict=True):
                    out += [k] if k >= 0 else [self.bytes[x] for x in chr(int(codes[s]) - 1).encode()]
                self.cuts[name] = np.array(out, np.int32).tobytes()
            else:
                self.cuts[name] = ids[a:b].tobytes()

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and where each text's ids begin and end."""
        cuts, first = _cuts(column, self.joined)
        coded = cuts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.cuts) > _MOST_CUTS:  # frequent cuts came early: the later half goes, but for what is asked for now
            asked = set(names)
            for c in list(self.cuts)[_MOST_CUTS // 2 :]:
                if c not in asked:
                    del self.cuts[c]
        if new := [c for c in names if c not in self.cuts]:
            self.encode_cuts(sorted(c.replace(" ", SPACE) for c in new))
        offsets, data = _gathered(pa.array(map(self.cuts.__getitem__, names), pa.large_binary()), coded.indices)
        return np.frombuffer(data, np.int32), offsets[first] >> 2

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[int]]:
        """The ids of each text, as 32-bit numbers, and how many."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.diff(at).tolist()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids between two offsets."""
        ids = np.where((ids >= 0) & (ids < len(self.raw)), ids, len(self.raw))
        at, data = _gathered(self.shown, pa.array(ids))
        at = at[offsets].tolist()
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            text = str(data[a:b], "utf-8", "replace").replace(SPACE, " ")  # U+2581 from byte pieces
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def _gathered(values: pa.Array, indices: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of the binary values at those indices."""
    got = values.take(indices)
    offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    return offsets, memoryview(got.buffers()[2] or b"")[: int(offsets[-1])]


def _cuts(column: pa.Array, joined: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The cuts of all texts, with blanks for U+2581, and the place of each text's first one (at the end their number).

    A cut begins at each text, and between two bytes that no piece holds side by side: no merge reaches across."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    texts = pc.replace_substring(texts, SPACE, " ")
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    texts = pc.if_else(pc.equal(texts, nothing), texts, pc.binary_join_element_wise(blank, texts, nothing))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    low, high = int(bounds[0]), int(bounds[-1])
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(low, high - low)
    raw = np.frombuffer(data, np.uint8)
    begins = np.ones(len(raw), bool)
    begins[1:] = ~joined.ravel()[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
    bounds = bounds - low
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(begins)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), data), np.searchsorted(starts, bounds)


@cache
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def read_model(path: str) -> bytes:
    """The model file (read by the driver; tasks get its bytes, under a megabyte for 32,000 pieces)."""
    with open(path, "rb") as f:
        return f.read()


def _blocks(column: pa.Array):
    """(first row, rows) of runs of about ``_BLOCK`` bytes or ids; a longer value is a run by itself."""
    sizes = pc.list_value_length(column) if pa.types.is_nested(column.type) else pc.binary_length(column)
    upto = np.cumsum(np.asarray(pc.fill_null(sizes, 0)), dtype=np.int64)
    at = 0
    while at < len(column):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + _BLOCK, "right")))
        yield at, end - at
        at = end


def _ids(column: pa.Array, model: bytes) -> pa.Array:
    ids, offsets = _vocabulary(model).encode_column(column)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _texts(column: pa.Array, model: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))]).astype(np.int64)
    ids = np.asarray(pc.fill_null(column.flatten(), -1))  # null lists hold nothing here
    return pa.array(_vocabulary(model).decode(ids, offsets), pa.string())


_IDS, _TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def _mapped(docs: DataFrame, source: str, kind_of_source: str, made: dict[str, T.DataType], make, keep: list[str] | None) -> DataFrame:
    """The kept columns of docs and those that make gives for a block of its source column."""
    taken = {name.lower() for name in made}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    (name,) = fresh(docs.columns, "__source")
    rows = docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(source)).cast(kind_of_source).alias(name))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(name, kind) for name, kind in made.items())])

    def run(batches):
        for batch in batches:
            for at, n in _blocks(batch.column(len(keep))):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column(len(keep)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (default all) and the ids of its text, array<int>."""
    return _mapped(docs, text_col, "string", {out: _IDS}, lambda column: [_ids(column, model)], keep)


def decode(docs: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (default all) and the text of its ids."""
    return _mapped(docs, ids_col, "array<int>", {out: _TEXT}, lambda column: [_texts(column, model)], keep)


def round_trip(docs: DataFrame, model: bytes, text_col: str = "text", out: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encode, then decode of its ids, in one pass: the ids go through one Python worker, not two."""

    def make(column):
        ids = _ids(column, model)
        return [ids, _texts(ids, model)]

    return _mapped(docs, text_col, "string", {out: _IDS, decoded: _TEXT}, make, keep)
