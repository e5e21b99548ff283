"""Best-fit packing of token sequences by the sum-of-squares rule.

Each document becomes token ids plus one end id; only longer ones are cut, into full-capacity pieces. Pieces are dealt
by the hash of a row number into groups of about GROUP_PIECES (the count of groups follows the input, so a group always
fits in one task, however many rows are equal), and within a group every piece, longest first, goes where the sum over residual gaps of the squared number of
open bins with that gap becomes smallest. A group leaves at most a bin or two badly filled.

Edge cases: a null or empty text is the end id alone; repeated rows and ids are separate pieces; an empty table gives
an empty result; extra columns are ignored. Opening a bin counts one more than its squares, so that few are opened; ties
between gaps go to the tightest one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, hashes, kept, materialize, release, spans, tidy
from .common import pieces as split

CAPACITY, END_ID, GROUP_PIECES = 4096, 1, 8192
#: Words that a worker keeps the ids of, about 40 bytes each; new words that the tokenizer gets at a time; bytes of text looked up at a time.
CACHE_WORDS, NEW_WORDS, LOOKUP_BYTES = 1_500_000, 1 << 15, 1 << 20
_TAIL = b".,;:!?#*$%&|<>()[]{}-_=+/\"@~^"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of the words met so far, by a 64-bit hash of the word: sorted hashes, and each word's place in one array of ids.

    The tokenizer drops white space and never joins across it, and it lower-cases; so each distinct word is encoded once, and
    trailing punctuation apart from it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. What several words have in common is encoded once."""
        known: dict[bytes, int] = {b"": 0}
        number, last = known.setdefault, frozenset(_TAIL)
        core, tail = [0] * len(words), [0] * len(words)
        for i, w in enumerate(words):
            if w[-1] in last and (c := w.rstrip(_TAIL)) and b"<|" not in w and (64 < c[-1] < 128 or c.decode()[-1].isalpha()):
                tail[i] = number(w[len(c) :], len(known))
                w = c
            core[i] = number(w, len(known))
        text, sizes, flats = list(map(bytes.decode, known)), [], []
        for lo in range(0, len(text), NEW_WORDS):
            found = [e.ids for e in self.tok.encode_batch_fast(text[lo : lo + NEW_WORDS], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flats.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        part = np.stack([core, tail], 1).ravel()
        n = size[part]
        ids = flat[np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[part] - np.cumsum(n) + n, n)]
        return ids, n.reshape(-1, 2).sum(1)

    def learn(self, key: np.ndarray, words: list[bytes]) -> None:
        """New distinct words with their hashes, in ascending order of the hashes."""
        flat, size = self._encode(words)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used // 4), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        where = np.searchsorted(self.key, key)
        self.at = np.insert(self.at, where, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.key = np.insert(self.key, where, key)
        self.used += len(flat)
        release()

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of some UTF-8 texts, and where each row's begin (one entry more)."""
        raw = data.tobytes()
        starts, ends, first = spans(data, off)
        own, where, inverse = np.unique(hashes(data, starts, ends, lower=b"<|" not in raw), return_index=True, return_inverse=True)
        place = np.searchsorted(self.key, own)
        new = np.flatnonzero(self.key[np.minimum(place, len(self.key) - 1)] != own) if len(self.key) else np.arange(len(own))
        if len(self.key) + len(new) > CACHE_WORDS and len(self.key):
            self.reset()
            new = np.arange(len(own))
        if len(new):
            s, e = starts[where[new]].tolist(), ends[where[new]].tolist()
            self.learn(own[new], [raw[a:b] for a, b in zip(s, e, strict=True)])
            place = np.searchsorted(self.key, own)
        at, size = (x[place].astype(np.int64)[inverse] for x in (self.at, self.size))
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.arange(total) + np.repeat(at - end + size, size)]
        return ids, np.concatenate([[0], end])[first]


def encode_texts(data: np.ndarray, off: np.ndarray, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some rows at a time: number of the first, their ids, and where each row's begin (one entry more)."""
    words = kept("packing")
    if path not in words:
        words[path] = Words(path)
    for lo, _, d, o in split(data, off, LOOKUP_BYTES):
        yield lo, *words[path](d, o)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    schema = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([] if end_id is None else [end_id], np.uint32)
        for b in batches:
            for lo, ids, edge in encode_texts(*buffers(b.column(1)), path):
                rows: list[tuple] = []
                for i, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True), lo):
                    n = y - x + len(last)
                    if n <= capacity:
                        if n:
                            rows.append((i, 0, 0, n, zlib.crc32(end, zlib.crc32(ids[x:y]))))
                        continue
                    own = np.concatenate([ids[x:y], last])
                    for k, s in enumerate(range(0, n, capacity)):
                        part = own[s : s + capacity]
                        rows.append((i, k, s, len(part), zlib.crc32(part)))
                if rows:
                    at, k, s, n, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
                    )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {schema}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item; items in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins per residual gap; a full bin is closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offs, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    far = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]
        # change of the sum of squares, less 2: a bin goes from one gap to another, is closed, or is new (which counts one more)
        change = np.where(here > 0, 2 * (count[: capacity + 1 - s] - here), far)
        change[0] = -2 * here[0] - 1 if here[0] else far
        change[-1] = 2 * count[capacity - s] if s < capacity else -2
        g = s + int(change.argmin())
        if g == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        bins[i], offs[i] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return bins, offs


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (doc_id, piece, ..., length in 1..capacity) with sequence_id and offset."""
    names = pieces.columns
    pieces = materialize(pieces.withColumn("__n", F.monotonically_increasing_id()), "pieces")  # equal rows go to different groups
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("__n", "ascending")])
        b, o = sum_of_squares(t["length"].to_numpy(), capacity)
        g = t["__g"].to_numpy()
        return t.select(names).append_column("sequence_id", pa.array(g.astype(np.int64) * (1 << 32) + b)).append_column("offset", pa.array(o))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "__n") + ", sequence_id long, offset long"
    dealt = pieces.withColumn("__g", F.pmod(F.xxhash64("__n"), F.lit(groups)))
    return dealt.groupBy("__g").applyInArrow(pack, out)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    return best_fit(token_pieces(docs, tokenizer, capacity, key=key, text=text), capacity)
