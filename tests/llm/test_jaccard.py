import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.llm import jaccard as J

W = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, percent=90):
    sets, low = [], {}
    for i, t in rows:
        w = W.findall(lower(t or ""))
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            if sets[a] and sets[b] and i is not None and rows[b][0] is not None:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    comp[find(a)] = find(b)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return sorted((str(i), len(sets[a]), str(low[find(a)] if sets[a] and i is not None else i)) for a, (i, _) in enumerate(rows))


def family(rng, words, copies, edits):
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(copies):
        x = list(base)
        for _ in range(rng.randint(0, edits)):
            x[rng.randrange(len(x))] = rng.choice(words)
        out.append(" ".join(x))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    texts = family(rng, words, 60, 6) + family(rng, words, 40, 3) + [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 50, 80)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", "  \n", "one", "ONE ", "a b", "a  b", "a b c", "A b C\n", "b a c", "x " * 500, "x " * 700, "é ü ß", "É ü ß"] + texts[:5] * 4
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = list(zip(rng.sample(range(5000), len(texts) + len(real)), texts + real))
    return out + [(None, texts[0]), (out[0][0], texts[0]), (out[1][0], texts[-1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)


@pytest.mark.parametrize("group,queries,big", [(256, 1024, 64), (64, 512, 10**9), (4, 8, 2), (16, 8, 6)])
def test_equals_brute_force(spark, rows, monkeypatch, group, queries, big):
    monkeypatch.setattr(J, "BIG", big)
    monkeypatch.setattr(J, "GROUP", group)
    monkeypatch.setattr(J, "QUERIES", queries)
    monkeypatch.setattr(J, "FAN", 2)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.similarity_classes(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_empty(spark, rows):
    assert J.similarity_classes(frame(spark, rows).limit(0)).count() == 0


def test_overlaps_in_slices():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, n).astype(np.uint64)) for n in (0, 1, 30, 90, 150)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]
    for cells in (1, 50, 1 << 20):
        assert J.overlaps(sets, sets[1:], cells).tolist() == want


def test_two_thousand_near_copies(spark):
    """One cluster: its members meet as a unit, so the opening join stays far below members times groups."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(3000)]
    texts = family(rng, words, 2000, 4)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in J.similarity_classes(frame(spark, rows)).collect()}
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if find(a) != find(b) and 100 * (n := len(sets[a] & sets[b])) >= 90 * (len(sets[a]) + len(sets[b]) - n):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in range(len(sets))}
