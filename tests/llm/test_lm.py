import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.llm import lm

W = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def toks(t):
    return [*W.findall(lower(t or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    odd = [None, "", "  \n", "zzz unseen", "The THE the", "é É", "a " * 3000]
    return real + [(5000 + i, t) for i, t in enumerate(odd)] + [(None, "null id text"), real[0], real[1]] + [(6000 + i, " ".join(rng.choice("abcdefgh") for _ in range(50))) for i in range(60)]


def test_base_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("c", F.lit(2)).repartition(3)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_texts(df).collect())
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t in rows)
    assert got == want


def test_score_beats_base_where_pairs_tell(spark):
    rng = random.Random(5)
    chain = {k: [rng.randrange(200) for _ in range(2)] for k in range(200)}

    def text():
        k, out = rng.randrange(200), []
        for _ in range(120):
            out.append(f"t{k}")
            k = rng.choice(chain[k])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    r = lm.score_texts(df).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n > 1.0  # more than a decimal order for each token


def test_not_worse_than_base_on_prose(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score_texts(df).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_levels_come_back_from_the_filter():
    rng = np.random.default_rng(8)
    key = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    q = np.minimum(rng.geometric(0.5, 20_000), 30)
    s = lm.Segment.of(key[:20_000], q)
    got = s.levels(key)
    assert (got[:20_000] >= q).all() and (got[:20_000] > q).mean() < 0.03 and (got[20_000:] > 0).mean() < 0.03
    assert (lm.Segment.of(key[:20_000], q, 60).levels(key) == np.append(q, np.zeros(20_000, int))).all()
    assert (lm.Segment.of(key[:0], q[:0]).levels(key) == 0).all()
    c = np.arange(1, 5000)
    assert (lm.low(lm.level(c)) <= c).all() and (lm.low(lm.level(c) + 1) > c).all()


def test_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert lm.score_texts(df).count() == df.count()
    assert lm.score_texts(df.limit(0)).count() == 0
    r = lm.score_texts(df.limit(3), train_on=F.lit(False)).first()
    assert r.train_tokens == 0 and r.base_score == 0 and r.score == 0


def test_score_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in lm.score_texts(df, bits=60).collect())  # so many bits that no probe is false
    learn = [toks(t) for i, t in rows if not held(i)]
    begin = ("begin",)
    c = Counter(w for t in learn for w in t)
    both = Counter(p for t in learn for p in zip([begin, *t], t))
    ctx = lambda u: len(learn) if u == begin else c[u]
    norm = sum(c.values()) + 0.1 * (len(c) + 1)
    down = lambda n: float(lm.low(lm.level(n))) if n else 0.0
    q = lambda n: int(lm.level(n)) if n else 0
    win, all_ = Counter(), Counter()
    for t in learn:
        for u, w in zip([begin, *t], t):
            up = ctx(u) - 1
            a, b = max(min(down(both[u, w]), up + 1) - 1, 0) / max(up, 1), (c[w] - 0.9) / norm
            win[q(up)] += a / (a + b)
            all_[q(up)] += 1
    weight = {k: min(win[k] / all_[k], 0.99) if k else 0.0 for k in all_}

    def score(t):
        total = 0.0
        for u, w in zip([begin, *t], t):
            m = weight.get(q(ctx(u)), 0.0)
            total += math.log10((1 - m) * (c[w] + 0.1) / norm + m * down(both[u, w]) / max(ctx(u), 1))
        return total

    assert got == Counter((i, len(toks(t)), round(score(toks(t)), 5)) for i, t in rows)


def test_every_pair_counts(spark, monkeypatch):
    """A held-out copy of one training text has its pairs known, though each was seen once."""
    rng = random.Random(11)
    held_id = next(i for i in range(100) if held(i))
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(40)]
    mixed = " ".join(rng.sample(texts[7].split(), 150))
    ids = [i for i in range(200) if not held(i)][:40]
    rows = [*zip(ids, texts, strict=True), (held_id, texts[7]), (next(i for i in range(held_id + 1, 300) if held(i)), mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def scores():
        return {r.doc_id: (round(r.base_score, 6), round(r.score, 6)) for r in lm.score_texts(df, bits=60).collect()}

    want = scores()
    copy, shuffled = want[held_id], want[rows[-1][0]]
    assert copy[1] > shuffled[1] + 10 and copy[1] > copy[0] + 10
    monkeypatch.setattr(lm, "CHUNK", 2000)
    assert scores() == want


def test_score_depends_neither_on_partitions_nor_on_the_way(spark, rows, monkeypatch):
    """The same rows in 1, 3 and 16 partitions, with the filter broadcast and probed where it lies."""
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def scores(parts):
        return sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_texts(df.repartition(parts)).collect())

    monkeypatch.setattr(lm, "SEGMENT", 20_000)
    want = scores(1)
    assert scores(3) == want and scores(16) == want
    monkeypatch.setattr(lm, "SHIPPED", 0)
    assert scores(1) == want and scores(16) == want
