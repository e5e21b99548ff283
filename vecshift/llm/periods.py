"""Periodic runs: maximal stretches of a text's words that repeat with a period, found by a suffix tree.

After Stoye and Gusfield: a tandem repeat (a root twice in a row) is branching if the word after it differs from the one that would
carry it on. Its two halves then begin in different children of the tree's node whose depth is the root's length. So each
node looks at the leaves of all children but the largest (smaller halves: a leaf is looked at once for each doubling of its node,
O(n log n) in all), and asks whether the position one root further, or one root before, is a leaf of the same node. Every maximal run
has just one branching tandem repeat of its period, at its end. Rotating that to the left as long as words agree gives the
run's start, and repeats that end up with the same stretch are merged under the smallest period.

The tree is kept as a suffix array with longest common prefixes: nodes are its intervals. Both come from doubling: the ranks of all
blocks of 1, 2, 4, ... words, computed for many texts at once, also tell how far two positions agree to the right or to the left.
A run of at least four periods holds each of its words four times, so words that are rarer in their text part it into stretches that
can be looked at by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, pieces, spans, tidy

#: Bytes of text looked at together; a longer text is looked at by itself.
SLAB_BYTES = 1 << 20


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.arange(off[-1]) + np.repeat(starts - off[:-1], size)]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts key, and for each sorted place where its group of equals begins."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: ranks of the blocks of 2^k words that begin at each place, equal for equal blocks, until all differ. Blocks
    that reach beyond a place whose id occurs once are equal to no other."""
    n = len(ids)
    order, group = _runs_of(ids)
    rank = np.empty(n, np.int64)
    rank[order] = group
    out, width = [rank], 1
    size = np.bincount(group, minlength=n)
    live = order[size[group] > 1]
    while len(live):
        head = rank[live]
        step, group = _runs_of(head * np.int64(n) + rank[np.minimum(live + width, n - 1)])
        live, head = live[step], head[step]
        # live is sorted by head; a group's rank is its head's, plus its place among those of the same head
        first = np.maximum.accumulate(np.where(np.concatenate([[True], head[1:] != head[:-1]]), np.arange(len(head)), 0))
        rank = rank.copy()
        rank[live] = head + group - first
        out.append(rank)
        size = np.bincount(group, minlength=len(live))
        live = live[size[group] > 1]
        width *= 2
    return out


def common_prefixes(levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """How many words each suffix shares with the one before it in suffix order at."""
    n = len(at)
    out = np.zeros(n, np.int64)
    some = np.flatnonzero(levels[0][at[1:]] == levels[0][at[:-1]]) + 1
    a, b, length = at[some - 1], at[some], np.zeros(len(some), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + length, n - 1)] == levels[k][np.minimum(b + length, n - 1)]
        length[same] += 1 << k
    out[some] = length
    return out


def _smaller(values: np.ndarray, some: np.ndarray, step: int) -> np.ndarray:
    """For each place of some, the nearest place in the direction of step whose value is smaller. values is 0 at both ends and at all
    places that are not in some. Pointers jump over what they point at, all at once."""
    out = np.arange(len(values)) + step
    live = some
    while len(live):
        to = out[live]
        live, to = (x[values[to] >= values[live]] for x in (live, to))
        out[live] = out[to]
    return out[some]


def branching_repeats(ids: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and root length of all branching tandem repeats. ids ends with one that occurs once."""
    n = len(ids)
    rank = levels[-1]
    at = np.empty(n, np.int64)
    at[rank] = np.arange(n)
    depth = np.append(common_prefixes(levels, at), 0)  # between the leaves i - 1 and i
    some = np.flatnonzero(depth)
    if not len(some):
        return some, some
    left, right = _smaller(depth, some, -1), _smaller(depth, some, 1)  # a node holds the leaves left .. right - 1
    order = np.lexsort((some, left, right))
    some, left, right = some[order], left[order], right[order]
    new = np.ones(len(some), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    last = np.append(new[1:], True)
    # children: from each of a node's divisions to its next one or its end, and from its beginning to the first
    lo = np.concatenate([some, left[new]])
    hi = np.concatenate([np.where(last, right, np.append(some[1:], 0)), some[new]])
    number = np.cumsum(new) - 1
    node = np.concatenate([number, number[new]])
    low, high, length = left[new], right[new], depth[some[new]]
    big = np.lexsort((hi - lo, node))
    largest = big[np.append(node[big][1:] != node[big][:-1], True)]
    small = np.ones(len(node), bool)
    small[largest] = False
    lo, hi, node = lo[small], hi[small], node[small]
    starts, roots = [], []
    ends = np.cumsum(hi - lo)
    for part in np.split(np.arange(len(lo)), np.searchsorted(ends, np.arange(4 * n, ends[-1], 4 * n))):
        size = hi[part] - lo[part]
        total = np.cumsum(size)
        if not len(total) or not total[-1]:
            continue
        own = np.repeat(node[part], size)
        leaf = at[np.arange(total[-1]) + np.repeat(lo[part] - total + size, size)]
        d = length[own]
        for first, second, inside in ((leaf, leaf + d, leaf + d), (leaf - d, leaf, leaf - d)):
            ok = (inside >= 0) & (inside < n)
            r = rank[np.where(ok, inside, 0)]
            ok &= (r >= low[own]) & (r < high[own])
            a, b, q = first[ok], second[ok], d[ok]
            ok = (b + q >= n) | (ids[a + q] != ids[np.minimum(b + q, n - 1)])
            starts.append(a[ok])
            roots.append(q[ok])
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(roots)]), axis=1) if starts else np.zeros((2, 0), np.int64)
    return found[0], found[1]


def maximal_runs(ids: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all maximal runs of at least exponent periods and least words, by start, then period.
    Ids that occur once part texts; the last one is such."""
    levels = ranks(ids)
    start, q = branching_repeats(ids, levels)
    end = start + 2 * q
    for k in range(len(levels) - 1, -1, -1):  # no two places agree for longer than the levels tell
        a = start - (1 << k)
        same = a >= 0
        same[same] = levels[k][a[same]] == levels[k][a[same] + q[same]]
        start[same] -= 1 << k
    ok = end - start >= np.maximum(exponent * q, least)
    start, end, q = start[ok], end[ok], q[ok]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def text_runs(ids: np.ndarray, first: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of many texts at once: place of their first word among all, length and period. first: number of each text's first word."""
    n = len(ids)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order, group = _runs_of(text * np.int64(ids.max() + 1) + ids) if n else (ids, ids)
    often = np.zeros(n, bool)
    often[order] = np.bincount(group, minlength=n)[group] >= exponent if n else False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)) | np.isin(np.arange(n + 1), first))
    lo, hi = edge[:-1], edge[1:]
    ok = (hi - lo >= least) & often[np.minimum(lo, max(n - 1, 0))] if n else np.zeros(len(lo), bool)
    lo, size = lo[ok], (hi - lo)[ok]
    if not len(lo):
        return (np.zeros(0, np.int64),) * 3
    number = np.empty(n, np.int64)
    number[order] = group
    ends = np.cumsum(size + 1)
    place = np.arange(ends[-1]) + np.repeat(lo - ends + size + 1, size + 1)  # each stretch and one place more
    packed = np.append(number, 0)[place]
    packed[ends - 1] = n + np.arange(len(lo))
    start, length, q = maximal_runs(packed, exponent, least)
    return place[start], length, q


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These words (numbers of spans), joined by one space within each text: bytes and row offsets. first: number of each text's
    first one among them."""
    size = (ends - starts)[words] + 1
    size[first[1:][first[1:] > first[:-1]] - 1] -= 1  # no space after a text's last word
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.full(off[-1], 32, np.uint8)
    own = (ends - starts)[words]
    inner = np.cumsum(own)
    shift = np.arange(inner[-1] if len(inner) else 0)
    out[shift + np.repeat(off[:-1] - inner + own, own)] = data[shift + np.repeat(starts[words] - inner + own, own)]
    return out, off[first]


Words = tuple[np.ndarray, np.ndarray]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6, order: Callable[[pa.Array, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """For each row its id, runs (array of start, length, period in words, by start, then period) and collapsed (the words, joined by
    one space, without what any run repeats after its first period).

    A run has a smallest period q, max(least, exponent * q) words at least (exponent >= 4, or words that occur less often than exponent
    times; any number from 2 on is exact), and no neighbour that carries its period on. Texts that are null, empty or without words have
    no runs and collapse to the empty text. Rows are judged one by one, so repeated rows give equal results; other columns are not
    carried on. order(ids, counts), if given, names for each word of the texts, in place of it, another word of the same texts, by its number
    among all words of the batch; counts has each text's words."""
    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in pieces(*buffers(b.column(1)), SLAB_BYTES):
                starts, ends, first = spans(data, off)
                ids, words = word_ids(data, starts, ends), np.arange(len(starts))
                if order is not None:
                    words = order(b.column(0).slice(lo, hi - lo), np.diff(first))
                start, length, q = text_runs(ids[words], first, exponent, least)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start + q, 1)
                np.add.at(cover, start + length, -1)
                kept = np.cumsum(cover[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(kept)])[first]
                out, edge = _joined(data, starts, ends, words[kept], left)
                texts = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
                at = np.searchsorted(start, first)
                own = first[np.searchsorted(first, start, "right") - 1]
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(start - own), pa.array(length), pa.array(q)], fields=list(run_type)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), runs, texts], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest_exponent(runs: Column) -> Column:
    """The run with the greatest length by period, the first of several; compared in whole numbers."""
    none = F.struct(*(F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")))
    return F.aggregate(runs, none, lambda best, r: F.when(best["start"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
