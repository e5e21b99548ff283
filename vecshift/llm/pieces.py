"""SentencePiece (BPE model) encoding and decoding by suffix-array matching.

A batch's distinct words are concatenated and indexed by a suffix array over the first LONGEST characters; every piece
of the vocabulary is found by binary search as one range of it, the ranges become edges (start, end, piece), the edges are
sorted by end, and the best path is relaxed from left to right.

What an edge may follow is what makes the path the BPE one: a sequence of pieces is the model's encoding of its text
if and only if each piece, and each two neighbours, encode to themselves (merges inside a piece never see beyond it
until some merge crosses a border, and that merge would cross it in the two pieces alone as well). So an edge extends
the path that ends at its start only if the two pieces are such neighbours; at each end exactly one edge is left. The
answers for pairs of pieces are kept, those that come by most lately. Characters outside the vocabulary become byte pieces.

Edge cases: null and empty texts have no ids; words of any length and repeated rows are fine; the text's own lower
one-eighth block (U+2581) stands for a space, as in the model's own escaping, and decodes to one. NUL is a character like any other. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

SPACE = "▁"
#: Bytes of words and ids that a worker keeps, with what Python adds to each; and places for pairs of pieces, as a power of two.
CACHE_BYTES, PAIR_BITS, ENTRY = 160 << 20, 22, 200
#: Characters of distinct words that one suffix array indexes at most (one word at least), and rows taken at a time.
INDEX_CHARS, ROWS = 150_000, 400
#: Characters that one 64-bit number holds for comparison, and the bits of each.
PACK, BITS = 3, 21
_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_HELD: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix:
            raise ValueError("a BPE model with identity normalisation and a dummy prefix is needed")
        self.score = {p.piece: p.score for p in m.pieces if p.type in (1, 4)}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        self.n = len(m.pieces)
        self.raw = [b""] * self.n
        for p, i in self.id.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        # only pieces that encode to themselves can be part of an encoding
        self.live = sorted((p for p in self.id if self.merged(p) == [p]), key=len)
        self.longest = max(map(len, self.live), default=1)
        self.text = [""] * self.n
        for p in self.live:
            self.text[self.id[p]] = p
        self.length = np.array([len(t) for t in self.text], np.int32)
        lens = np.array([len(p) for p in self.live], np.int64)
        low = np.zeros((len(self.live), -(-self.longest // PACK) * PACK), np.int64)
        flat = np.frombuffer("".join(self.live).encode("utf-32-le"), np.uint32)
        low[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat.astype(np.int64) + 1
        high = np.where(low == 0, (1 << BITS) - 1, low)  # any characters after the piece
        packed = lambda x: sum(x[:, i::PACK] << BITS * (PACK - 1 - i) for i in range(PACK))
        self.table = lens, packed(low), packed(high), np.array([self.id[p] for p in self.live], np.int64)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int32 if 2 * self.n**2 < 1 << 31 else np.int64)
        self.traces: dict[int, tuple] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = 0

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text: always the best-scored adjacent pair, the leftmost of equals."""
        x, score = list(text), self.score
        while len(x) > 1:
            best, at = None, -1
            for i in range(len(x) - 1):
                s = score.get(x[i] + x[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            x[at : at + 2] = [x[at] + x[at + 1]]
        return x

    def trace(self, piece: int) -> tuple[list, list, list]:
        """The scores of a piece's merges in their order (and one below all others), its first and its last part after each number of them."""
        out = self.traces.get(piece)
        if out is None:
            x, score = list(self.text[piece]), self.score
            out = self.traces[piece] = [], [x[0]], [x[-1]]
            while len(x) > 1:
                s, i = max(((score.get(x[i] + x[i + 1], -np.inf), -i) for i in range(len(x) - 1)))
                x[-i : 2 - i] = [x[-i] + x[1 - i]]
                for had, new in zip(out, (s, x[0], x[-1]), strict=True):
                    had.append(new)
            out[0].append(-np.inf)
        return out

    def beside(self, a: int, b: int) -> bool:
        """Whether the text of two live pieces encodes to these two. Until a merge crosses the border each makes its own merges; the better
        one comes first, the left one of equals."""
        score, (left, _, ends), (right, begins, _) = self.score, self.trace(a), self.trace(b)
        i = j = 0
        while True:
            across = score.get(ends[i] + begins[j], -np.inf)
            end, begin = ends[i], begins[j]
            while ends[i] is end and begins[j] is begin:
                x, y = left[i], right[j]
                if across > x and across >= y:
                    return False
                if x >= y:
                    if i + 1 == len(left):
                        return True
                    i += 1
                else:
                    j += 1

    def neighbours(self, key: np.ndarray) -> np.ndarray:
        """Whether a * n + b is a pair of pieces that stand side by side in the encoding of their text."""
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pairs[slot]  # each pair has one place, where the last one that was asked for stays
        value = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != key)
        if len(miss):
            new, at = np.unique(key[miss], return_inverse=True)
            beside = self.beside
            value[miss] = np.array([beside(a, b) for a, b in zip(*(x.tolist() for x in np.divmod(new, self.n)), strict=True)])[at]
            self.pairs[slot[miss]] = 2 * key[miss] + value[miss]
        return value

    def ranges(self, packed: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids with their ranges of the suffix array, by binary search a few characters (PACK) at a time."""
        lens, low, high, ids = self.table
        first = packed[order]
        lo, hi = np.searchsorted(first, low[:, 0], "left"), np.searchsorted(first, high[:, 0], "right")
        some = np.arange(len(ids))
        for g in range(1, low.shape[1]):
            some = some[(lens[some] > PACK * g) & (lo[some] < hi[some])]
            if not len(some):
                break
            edges = []
            for right, want in ((False, low[some, g]), (True, high[some, g])):
                a, b = lo[some].copy(), hi[some].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    c = packed[np.minimum(order[np.minimum(mid, len(order) - 1)] + PACK * g, len(packed) - 1)]
                    go = open_ & ((c <= want) if right else (c < want))
                    a = np.where(go, mid + 1, a)
                    b = np.where(open_ & ~go, mid, b)
                edges.append(a)
            lo[some], hi[some] = edges
        hit = lo < hi
        return ids[hit], lo[hit], hi[hit]

    def learn(self, words: list[str]) -> None:
        """Encodings of distinct non-empty words into the cache."""
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size + 1) - size - 1
        codes[begin + size] = -1
        # suffix array over the first characters: ranks of doubled prefixes
        wide = np.zeros(len(codes) + PACK - 1, np.int64)
        wide[: len(codes)] = codes + 1
        packed = sum(wide[i : i + len(codes)] << BITS * (PACK - 1 - i) for i in range(PACK))
        rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
        k = PACK
        while k < self.longest:
            nxt = np.zeros_like(rank)
            nxt[:-k] = rank[k:] + 1
            rank = np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)[1].astype(np.int64)
            k *= 2
        order = np.argsort(rank, kind="stable").astype(np.int32)
        del rank
        ids, lo, hi = self.ranges(packed, order)
        n = hi - lo
        start = order[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
        piece = np.repeat(ids.astype(np.int32), n)
        end = start + self.length[piece]
        # characters that no piece matches stand alone
        single = np.zeros(len(codes) + 1, bool)
        single[start[end - start == 1]] = True
        lone = np.flatnonzero(~single[:-1] & (codes >= 0))
        start, end, piece = np.concatenate([start, lone.astype(np.int32)]), np.concatenate([end, lone.astype(np.int32) + 1]), np.concatenate([piece, np.full(len(lone), -2, np.int32)])
        word = np.repeat(np.arange(len(words)), size + 1)[start]
        place = end - begin[word]
        place = np.argsort(place.astype(np.uint16) if size.max() < 65_000 else place, kind="stable")  # a radix sort where it fits
        start, end, piece, word = start[place], end[place], piece[place], word[place]
        step = (end - begin[word]).astype(np.int64)
        cut = np.flatnonzero(np.diff(step)) + 1
        last = np.full(len(codes) + 1, -1, np.int64)  # piece that ends here; -1: no path, -2: a lone character, -3: a word's start
        back = np.zeros(len(codes) + 1, np.int64)
        last[begin] = -3
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(start)], strict=True):
            own = np.arange(a, b)
            left = last[start[own]]
            own, left = own[left != -1], left[left != -1]
            if not len(own):
                continue
            ok = np.ones(len(own), bool)
            test = np.flatnonzero((left >= 0) & (piece[own] >= 0))
            if len(test):
                ok[test] = self.neighbours(left[test].astype(np.int64) * self.n + piece[own[test]])
            own = own[ok]
            last[end[own]] = piece[own]
            back[end[own]] = start[own]
        at, live, steps = (begin + size).copy(), np.arange(len(words)), []
        while len(live):
            steps.append((live, last[at[live]], at[live] - 1))
            at[live] = back[at[live]]
            live = live[at[live] > begin[live]]
        w = np.concatenate([s[0] for s in steps])
        p, c = np.concatenate([s[1] for s in steps]), np.concatenate([s[2] for s in steps])
        turn = np.concatenate([np.full(len(s[0]), -i) for i, s in enumerate(steps)])
        o = np.lexsort((turn, w))
        w, p, c = w[o], p[o], c[o]
        edge = np.searchsorted(w, np.arange(len(words) + 1))
        flat, odd = p.astype("<u4").tobytes(), set(np.unique(w[p < 0]).tolist())
        for i, x in enumerate(words):
            a, b = edge[i], edge[i + 1]
            if i in odd:
                ids = [y for k in range(a, b) for y in (self.bytes_of(chr(codes[c[k]])) if p[k] < 0 else [p[k]])]
                self.cache[x] = np.array(ids, "<u4").tobytes()
            else:
                self.cache[x] = flat[4 * a : 4 * b]

    def bytes_of(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "replace")
        return [self.byte[b] for b in raw] if self.byte else [self.unknown]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        parts = [_PARTS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        used = set().union(*parts) if parts else set()
        size = lambda some: sum(map(len, some)) * 5 + ENTRY * len(some)
        missing = used - self.cache.keys()
        if self.cached + (more := size(missing)) > CACHE_BYTES // 2:  # the words so far become the older half, out of which those in use come back
            self.older, self.cache, self.cached = self.cache, {}, 0
            missing, more = used, size(used)
            if more > CACHE_BYTES // 2:
                self.older = {k: self.older[k] for k in used & self.older.keys()}
        self.cached += more
        back = missing & self.older.keys()
        self.cache.update(zip(back, map(self.older.__getitem__, back), strict=True))
        missing = missing - back
        group, n = [], 0
        for w in sorted(missing):
            if n + len(w) > INDEX_CHARS and group:
                self.learn(group)
                group, n = [], 0
            group.append(w)
            n += len(w) + 1
        if group:
            self.learn(group)
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _pieces(path: str) -> Pieces:
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Pieces(path)
    return _HELD[path]


def _encoded(path: str, batches: Iterator[pa.RecordBatch], at: int, also_decode: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    m = _pieces(path)
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            texts = part.column(at).to_pylist()
            ids = [None if t is None else x for t, x in zip(texts, m.encode(texts), strict=True)]
            more = [pa.array(map(m.decode, ids), pa.string())] if also_decode else []
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), *more], names)


def _two(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    ready(docs.sparkSession)
    one = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return one, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, text string, ids binary"


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, ids: the ids as little-endian uint32 bytes (null for a null text)."""
    path = model or default_model()
    one, schema = _two(docs, key, text)
    return one.mapInArrow(lambda batches: _encoded(path, batches, 1, False, ["doc_id", "text", "ids"]), schema)


def round_trip(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, ids, decoded: both ways in one worker, which holds the model once."""
    path = model or default_model()
    one, schema = _two(docs, key, text)
    return one.mapInArrow(lambda batches: _encoded(path, batches, 1, True, ["doc_id", "text", "ids", "decoded"]), schema + ", decoded string")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded with a column decoded."""
    path = model or default_model()
    ready(encoded.sparkSession)
    at, names = encoded.columns.index("ids"), [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _pieces(path)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m.decode(x) for x in part.column(at).to_pylist()], pa.string())], names)

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string")
