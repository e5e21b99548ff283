import random
import re

import pytest
from pyspark.sql import functions as F

from vecshift.llm import substrings as S

W = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(t):
    return [(m.start(), m.end()) for m in W.finditer(t or "")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    """(id, text) -> text after dedup, by the rules of the module docstring; the cut hash is taken from the module."""
    import numpy as np

    from vecshift.llm.common import hashes

    cuts, seen = [], {}
    for _, t in rows:
        w, starts = words_of(t), []
        for k, (a, b) in enumerate(w):
            body = t[a:b]
            if k == 0 or "\n" in t[w[k - 1][1] : a]:
                starts.append(k)
            else:
                x = t[w[k - 1][0] : w[k - 1][1]]
                while len(x) > 1 and x[-1] in "\"')]}*#$%&|<>,;:":
                    x = x[:-1]
                if x[-1] in ".!?":
                    starts.append(k)
        full = []
        for a, b in zip(starts, starts[1:] + [len(w)]):
            full.append(a)
            if b - a > S.LONG:
                for k in range(a + 1, b):
                    raw = np.frombuffer(t[w[k][0] : w[k][1]].encode(), np.uint8)
                    if int(hashes(raw, np.array([0]), np.array([len(raw)]))[0]) % S.CUT == 0:
                        full.append(k)
        cuts.append(full)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    out, drop = {}, {i: set() for i in range(len(rows))}
    for i in order:
        t, w, c = rows[i][1], words_of(rows[i][1]), cuts[i]
        edge = c + [len(w)]
        for k in range(len(c)):
            end = next((j for j in range(k + S.SPAN, len(edge)) if edge[j] - edge[k] >= S.LEAST), None)
            if end is None:
                continue
            key = tuple(lower(t[a:b]) for a, b in w[edge[k] : edge[end]])
            if key in seen:
                drop[i].update(range(k, end))
            seen.setdefault(key, i)
    for i in range(len(rows)):
        t, w, c = rows[i][1], words_of(rows[i][1]), cuts[i]
        kept = [k for s, k in zip(range(len(c)), range(len(c))) if s not in drop[i]]
        edge = c + [len(w)]
        out[i] = (drop[i], [lower(t[a:b]) for s in kept for a, b in w[edge[s] : edge[s + 1]]])
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    v = [f"word{k}" for k in range(300)]
    free = lambda n: " ".join(rng.choice(v) + (rng.choice([".", "!!", ".***", "?", ".)))\"\"***"]) if rng.random() < 0.1 else "") for _ in range(n))
    passage, plain = free(70), " ".join(rng.choice(v) for _ in range(70))
    texts = [free(rng.randint(5, 200)) for _ in range(40)]
    texts += [free(rng.randint(1, 80)) + rng.choice([" ", "\n", ".\n"]) + passage + rng.choice([" ", "\n"]) + free(rng.randint(1, 80)) for _ in range(12)]
    texts += [free(rng.randint(1, 80)) + " " + plain + " " + free(rng.randint(1, 80)) for _ in range(12)]
    texts += [None, "", " \n ", "a", "a b c.", (free(30) + "\n") * 4, texts[0], texts[0].upper(), "é ü. " * 40, passage]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids = rng.sample(range(-3000, 3000), len(texts))
    return list(zip(ids, texts)), passage, plain


def test_equals_brute_force(spark, rows):
    rows, passage, plain = rows
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("rid", F.col("doc_id") * 2).repartition(4)
    out = S.dedup_spans(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        drop, words = want[i]
        if not drop:
            assert got[k].text == t
        else:
            assert W.findall(lower(got[k].text)) == words, (k, t, got[k].text)
        assert got[k].rid == 2 * k and got[k].h == "clash"
    for p in (passage, plain):
        body = " ".join(W.findall(p)[15:-15])
        assert sum(body in " ".join(W.findall(r.text or "")) for r in got.values()) == 1


def test_clean_texts_stay(spark):
    rng = random.Random(9)
    texts = [" ".join(f"u{i}x{rng.randrange(10**6)}" + ("." if j % 9 == 8 else "") for j in range(100)) for i in range(20)]
    texts = [t + "\nLicensed under the Apache License, Version 2.0." for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.text for r in S.dedup_spans(df).collect()} == set(texts)


def test_empty_null_and_repeated(spark):
    s = "doc_id long, text string, extra int"
    assert S.dedup_spans(spark.createDataFrame([], s)).count() == 0
    t = " ".join(f"v{k}." for k in range(40))
    got = S.dedup_spans(spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 3), (6, None, 4), (None, None, 5)], s)).collect()
    assert sorted((r.extra, r.text == t) for r in got if r.text) == [(1, True)]
    assert len(got) == 5


def test_of_equal_rows_one_stays(spark):
    s = "doc_id long, text string, extra int, __rid string"
    t, u = (" ".join(f"{c}{k}." for k in range(40)) for c in "vw")
    rows = [(5, t, 1, "a"), (5, t, 2, "b"), (5, t, 3, "c"), (6, u, 4, "d"), (None, None, 5, "e"), (None, None, 6, "f"), (7, "", 7, "g"), (7, "", 8, "h"), (8, "one two.", 9, "i"), (8, "one two.", 10, "j")]
    got = S.dedup_spans(spark.createDataFrame(rows, s).repartition(3))
    assert got.columns == ["doc_id", "text", "extra", "__rid"]
    got = got.collect()
    assert len(got) == 10 and sorted(r.text for r in got if r.doc_id == 5) == ["", "", t]
    assert all(r.text == rows[r.extra - 1][1] for r in got if r.doc_id != 5) and all(r["__rid"] == rows[r.extra - 1][3] for r in got)


def test_any_number_of_closing_symbols_and_short_runs(spark):
    """A mark behind nine symbols ends a sentence, and a run of two sentences with sixteen words goes."""
    rng = random.Random(4)
    own = lambda k: " ".join(f"o{rng.randrange(10**6)}" for _ in range(k))
    run = "a1 a2 a3 a4 a5 a6 a7 a8.)))))*** b1 b2 b3 b4 b5 b6 b7 b8.)))))***"
    rows = [(i, f"{own(5)}. {run} {own(6)}.") for i in range(3)]
    got = {r.doc_id: r.text for r in S.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all("a1" not in got[i] and "b8" not in got[i] and len(got[i].split()) == 11 for i in (1, 2))
