"""Words and stretches of words that a polynomial modulo a power of two can't tell apart."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vecshift.llm import packing, substrings
from vecshift.llm.common import CHUNK_BYTES, buffers, hashes, spans
from vecshift.llm.jaccard import similarity_classes
from vecshift.llm.lm import score_texts


def mirrored(k, a="a", b="b"):
    """A Thue-Morse string of 2^k letters, and the one with its letters exchanged."""
    x, y = [a], [b]
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


A, B = ("".join(x) for x in mirrored(11))


def of(texts, **options):
    data, off = buffers(pa.array(texts))
    s, e, first = spans(data, off)
    return hashes(data, s, e, **options), first


def test_hashes_tell_words_apart_and_equal_ones_agree():
    rng = random.Random(1)
    words = [A, B, A[:512], B[:512], A[:64], B[:64], A[:16], B[:16], "a", "b", "ab", "a" * 8, "a" * 9, "a" * 16, "\0", "\0\0", "é", "a" * 513, "a" * 514]
    words += ["".join(rng.choice("ab") for _ in range(rng.choice([3, 7, 8, 9, 17, 700]))) for _ in range(500)]
    h, _ = of([" ".join(words), " ".join(reversed(words))])
    assert dict(zip(words, h[: len(words)].tolist(), strict=True)) == dict(zip(reversed(words), h[len(words) :].tolist(), strict=True))
    assert len(set(h.tolist())) == len(set(words))
    assert (of(["ABC É"])[0] == of(["abc É"])[0]).all() and (of(["ABC"], lower=False)[0] != of(["abc"], lower=False)[0]).all()
    assert len(of([""])[0]) == 0 and CHUNK_BYTES > 0


def test_products_and_stretches():
    rng = np.random.default_rng(2)
    m = int(substrings._M)
    a, b = (rng.integers(0, m, 1000, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = (m - 1, 0, 1), (m - 1, m - 1, m - 1)
    assert [int(x) for x in substrings._product(a, b)] == [int(x) * int(y) % m for x, y in zip(a, b, strict=True)]
    x, y = mirrored(10, "one", "two")
    h, first = of([" ".join(["start", *x, "mid", *y, "end", *x])])
    run, n = substrings.running(h), len(x)
    lo = np.array([1, n + 2, 2 * n + 3])
    k = substrings.stretch_hash(run, lo, lo + n).tolist()
    assert k[0] == k[2] != k[1]
    assert first.tolist() == [0, 3 * n + 3]


def test_near_duplicates_and_scores(spark):
    df = spark.createDataFrame([(1, A), (2, B), (3, A)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similarity_classes(df, n=3, percent=90).collect()} == {1: 1, 2: 2, 3: 1}
    rows = [(i, A if i % 2 else f"{B} {B}") for i in range(40)]
    got = {r.doc_id: r.base_score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    tokens = [w for t in train for w in [*t.lower().split(), "\n"]]
    score = lambda t: sum(np.log10((tokens.count(w) + 0.1) / (len(tokens) + 0.1 * (len(set(tokens)) + 1))) for w in [*t.lower().split(), "\n"])
    assert all(got[i] == pytest.approx(score(t)) for i, t in rows)


def test_packed_ids(spark):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = [f"{A} {B}", f"{B} {A}", A, B]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], np.uint32)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own] and sum(r.length for r in own) == len(ids)


def test_spans_of_mirrored_words(spark):
    x, y = mirrored(6, "one", "two")
    rows = [(1, f"First of all {' '.join(x)}. It ends here now."), (2, f"First of all {' '.join(y)}. It ends here now.")]
    out = {r.doc_id: r.text for r in substrings.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2].split().count("one") >= 20  # another passage: it stays
