import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from vecshift.llm import periods as P
from vecshift.llm.queries import op13_periodic_runs


def brute(w, exponent=4, least=6):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def make(rng):
    k, t, n = rng.choice([1, 2, 3, 5]), [], rng.choice([0, 3, 20, 60])
    while len(t) < n:
        some = [rng.randint(1, k) for _ in range(rng.randint(1, 5))] * rng.randint(1, 7)
        t += some if rng.random() < 0.5 else [rng.randint(1, 9) for _ in range(rng.randint(1, 5))]
    return t


@pytest.mark.parametrize("exponent,least", [(4, 6), (3, 1), (2, 2)])
def test_runs_equal_brute_force(exponent, least):
    rng = random.Random(5)
    for _ in range(150):
        texts = [make(rng) for _ in range(rng.randint(1, 8))]
        ids = np.array([x for t in texts for x in t], np.int64)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = list(zip(*(x.tolist() for x in P.text_runs(ids, first, exponent, least)), strict=True))
        assert got == [(a + int(f), n, q) for t, f in zip(texts, first, strict=False) for a, n, q in brute(t, exponent, least)]


def test_one_repeat_for_each_run():
    """Branching tandem repeats of a b a b a b c: one for each end of a period, at the run's end."""
    ids = np.array([1, 2, 1, 2, 1, 2, 3, 9], np.int64)
    start, root = P.branching_repeats(ids, P.ranks(ids))
    assert list(zip(start.tolist(), root.tolist(), strict=True)) == [(2, 2)]


def test_periodic_and_fibonacci_words_are_fast():
    x = np.tile(np.arange(7), 40_000)
    assert [v.tolist() for v in P.text_runs(x, np.array([0, len(x)]), 4, 6)] == [[0], [280_000], [7]]
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert len(P.text_runs(np.array(b), np.array([0, len(b)]), 2, 2)[0]) > 50_000


def test_frames(spark):
    rng = random.Random(6)
    rows = [(i, (rng.choice([" ", "\n", " \t "])).join(f"é{x}" for x in make(rng)), []) for i in range(200)]
    rows += [(None, "a a a a a a", []), (500, None, []), (501, "", []), (502, " \n ", []), (3, rows[3][1], []), (503, "x y " * 300_000, []), (504, "ab a b ab a b ab a b ab a b\xa0", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>").repartition(3)
    got = P.periodic_runs(df).collect()
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = brute(w) if i != 503 else [(0, 600_000, 2)]
        want.append((i, r, collapse(w, r)))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op13_periodic_runs(spark, d).collect()
    assert len(out) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in out:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
        assert tuple(r) == (r.doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(w, runs)))
    assert sum(r.n_runs > 0 for r in out) > 3


def test_greatest_exponent(spark):
    df = spark.createDataFrame([([(0, 8, 2), (5, 12, 3), (30, 41, 10), (50, 40, 10)],), ([],), ([(1, 33, 8), (40, 9, 2)],)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r.b and r.b.start for r in df.select(P.longest_exponent(df.runs).alias("b")).collect()] == [30, None, 40]
