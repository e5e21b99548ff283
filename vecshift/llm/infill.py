"""Fill-in-middle: each text is cut at two token boundaries into prefix, middle and suffix and written in another order.

A token is a run of ASCII letters or one other character; so a token begins at each character that is not a letter following a
letter. Texts are taken apart into chunks of CHUNK bytes that overlap by one byte, which is all that this predicate of adjacent
characters needs. Every chunk counts its boundaries and characters by itself; prefix sums over a text's chunks say which
chunk owns the boundary of a given rank, and only the two owning chunks are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, pieces, tidy

CHUNK = 4096
#: Names of prefix, suffix and middle in a written text; a text that contains one stays as it is.
MARKS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def boundaries(data: np.ndarray, before: int = 0) -> np.ndarray:
    """Where a token begins in some UTF-8 bytes that follow the byte `before` of the same text (0: the text begins here)."""
    letter = _LETTER[data]
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] &= bool(_LETTER[before])
    return ((data & 0xC0) != 0x80) & ~inside


class Chunks:
    """Texts in one buffer (UTF-8 bytes, row offsets), in chunks: how many tokens and characters begin before each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        size = np.diff(off)
        n = -(-size // CHUNK)
        self.first = np.concatenate([[0], np.cumsum(n)])  # number of each text's first chunk
        owner = np.repeat(np.arange(len(size)), n)
        self.start = off[owner] + (np.arange(len(owner)) - self.first[owner]) * CHUNK
        self.tokens, self.chars = (np.zeros(len(owner) + 1, np.int64) for _ in range(2))
        # texts one after the other or a long text's chunks: some chunks of a batch at a time
        for lo in range(0, len(owner), 256):
            at = self.start[lo : lo + 256]
            stop = int(self.start[lo + 256]) if lo + 256 < len(owner) else len(data)
            part = data[at[0] : stop]
            begin = boundaries(part, int(data[at[0] - 1]) if at[0] else 0)
            whole = at[at == off[owner[lo : lo + 256]]] - at[0]
            begin[whole] = True
            self.tokens[lo + 1 : lo + len(at) + 1] = np.add.reduceat(begin, at - at[0], dtype=np.int64)
            self.chars[lo + 1 : lo + len(at) + 1] = np.add.reduceat((part & 0xC0) != 0x80, at - at[0], dtype=np.int64)
        np.cumsum(self.tokens, out=self.tokens)
        np.cumsum(self.chars, out=self.chars)
        self.n = self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def cut(self, row: int, rank: int) -> tuple[int, int]:
        """Byte in the buffer and character in the text where the token of this rank begins; the text's end for rank n."""
        lo, hi = int(self.first[row]), int(self.first[row + 1])
        if rank == self.n[row]:
            return int(self.off[row + 1]), int(self.chars[hi] - self.chars[lo])
        goal = int(self.tokens[lo]) + rank
        c = lo + int(np.searchsorted(self.tokens[lo + 1 : hi + 1], goal, "right"))
        s = int(self.start[c])
        part = self.data[s : min(s + CHUNK, int(self.off[row + 1]))]
        begin = boundaries(part, 0 if c == lo else int(self.data[s - 1]))
        k = int(np.flatnonzero(begin)[goal - int(self.tokens[c])])
        return s + k, int(self.chars[c] - self.chars[lo]) + int(np.count_nonzero((part[:k] & 0xC0) != 0x80))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the id: the first 8-digit groups of sha256 of `seed:id` in hexadecimal. A null id reads as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """For each row its id, n (tokens), form, prefix_chars, middle_chars (code points; null for plain) and output.

    rate percent of the texts are cut, of these spm_rate percent in the form suffix, prefix, middle (spm), the others as prefix, suffix,
    middle (psm). Empty and null texts and texts that contain a mark are plain: output is the text, for null the empty one. Cuts
    and forms follow from id and seed alone; repeated rows give equal results. Other columns of docs are not carried on."""
    p, s, m = (x.encode() for x in marks)
    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    h = draws(F.col(key), seed)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    free = ~(body.contains(marks[0]) | body.contains(marks[1]) | body.contains(marks[2]))
    form = F.when((body == "") | ~free | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in pieces(*buffers(b.column(1))):
                texts, raw = Chunks(data, off), memoryview(data)
                forms = b.column(2).slice(lo, hi - lo).to_pylist()
                draw = np.stack([b.column(i).slice(lo, hi - lo).to_numpy() for i in (3, 4)]) % (texts.n + 1)
                ranks = np.sort(draw, 0).T.tolist()
                prefix, middle, size, out = [None] * (hi - lo), [None] * (hi - lo), [], []
                for i, (f, (r1, r2)) in enumerate(zip(forms, ranks, strict=True)):
                    x, y = int(off[i]), int(off[i + 1])
                    if f == "plain":
                        parts = [raw[x:y]]
                    else:
                        (u, cu), (v, cv) = texts.cut(i, r1), texts.cut(i, r2)
                        prefix[i], middle[i] = cu, cv - cu
                        parts = [p, raw[x:u], s, raw[v:y], m, raw[u:v]] if f == "psm" else [s, raw[v:y], p, raw[x:u], m, raw[u:v]]
                    size.append(sum(map(len, parts)))
                    out += parts
                ends = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                made = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, ends, pa.py_buffer(b"".join(out))]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(texts.n), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).alias("doc_id"), body.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle wrote as output in this form. The marks must differ and have one first character, which they hold
    nowhere else; then no mark arises where a part meets a mark."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = output.substr(F.lit(len(first) + 1), F.length(output))
        a = F.substring_index(body, second, 1)
        rest = body.substr(F.length(a) + len(second) + 1, F.length(body))
        b = F.substring_index(rest, m, 1)
        return a, b, rest.substr(F.length(b) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))
