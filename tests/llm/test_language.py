import random
import zlib

from pyspark.sql import functions as F

from vecshift.llm.language import keep_identified, language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_unseen_words_back_off(spark):
    rng = random.Random(1)
    make = lambda syl: " ".join("".join(rng.choice(syl) for _ in range(4)) for _ in range(30))
    a, b = ["ka", "ro", "mi", "tu"], ["sch", "ein", "ung", "ver"]
    rows = [(i, make(a if i % 2 else b), "aa" if i % 2 else "bb") for i in range(120)]
    out = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in out)


def test_edge_cases(spark):
    s = "doc_id long, text string, lang string, n int, held_out string"
    rows = [(1, "the cat", "en", 1, "x"), (2, "der hund", "de", 1, "x"), (3, None, "en", 1, "x"), (4, "", None, 1, "x"), (5, "123 ½ --- _", "en", 1, "x"), (6, "Ωμέγα", None, 1, "x"), (None, "the dog", None, 1, "x"), (8, "THE " * 20000, "en", 1, "x"), (9, "the cat", "en", 1, "x"), (9, "the cat", "en", 1, "x")]
    df = spark.createDataFrame(rows, s).repartition(2)
    got = language_id(df, train=F.lit(True)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[k].lang_pred for k in (1, 2, 3, 4, 5, 8, 9)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert by[3].score == by[5].score == 0 and by[6].lang_pred == "en" and abs(by[6].score - 0.5) < 1e-9
    assert by[None].lang_pred == "en" and by[None].held_out is False
    kept = keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, None, 8, 9}
    assert language_id(df.limit(0)).count() == 0 and keep_identified(df.limit(0)).count() == 0
    alone = language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in alone} == {"und"}


def test_equals_an_independent_scorer(spark):
    """Word-first backoff, written out text by text from the module docstring; every word and n-gram of the sample counts."""
    import math
    import re
    from collections import Counter, defaultdict

    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rare = [(900 + i, f"zq{i}zq unseenish blib{i} " + real[i][1][:200], "xx") for i in range(4)]
    rows = real + rare + [(950, "Ωμέγα ψ", "en"), (951, "qzqzq xyxyx", None)]
    word, grams = re.compile(r"[^\W\d_]+"), lambda w, n: [(f"<{w}>" if n > 1 else w)[i : i + n] for i in range(len(f"<{w}>" if n > 1 else w) - n + 1)]
    count, docs = [defaultdict(Counter) for _ in range(5)], Counter()
    for i, t, x in rows:
        if x is None or zlib.crc32(str(i).encode()) % 3 == 1 or t is None:
            continue
        docs[x] += 1
        for w in word.findall(t.lower()):
            count[0][w][x] += 1
            for n in range(1, 5):
                for g in grams(w, n):
                    count[n][g][x] += 1
    langs = sorted(docs)
    total = [{x: sum(c[x] for c in count[n].values()) for x in langs} for n in range(5)]
    log = lambda n, g, x: math.log10((count[n][g][x] + 0.5) / (total[n][x] + 0.5e5))

    def one(w):
        if w in count[0]:
            return {x: log(0, w, x) for x in langs}
        for n in range(4, 0, -1):
            known = [g for g in grams(w, n) if g in count[n]]
            if known:
                return {x: sum(log(n, g, x) for g in known) / len(known) for x in langs}
        return dict.fromkeys(langs, 0.0)

    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in rows:
        words = word.findall((t or "").lower())
        if not any(any(map(str.isalpha, w)) for w in words):
            assert got[i] == ("und", 0.0)
            continue
        s, letters = Counter(dict.fromkeys(langs, 0.0)), 0
        for w in words:
            letters += any(map(str.isalpha, w))
            for x, y in one(w).items():
                s[x] += y
        s = {x: y * min(1.0, 12 / max(letters, 1)) for x, y in s.items()}
        top = max(s.values())
        p = {x: 10 ** (y - top) for x, y in s.items()}
        best = max(langs, key=lambda x: (p[x], -langs.index(x))) if any(s.values()) else docs.most_common(1)[0][0]
        assert got[i][0] == best and abs(got[i][1] - p[best] / sum(p.values())) < 1e-9, i
