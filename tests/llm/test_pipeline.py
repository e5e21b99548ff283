import re

import corpus_pipeline as P
from pyspark.sql import functions as F

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert 4 <= len(P.STAGES) <= 5
    seen = [docs]
    for name, f in P.STAGES:
        out = P.materialize(f(spark, seen[-1], d), "t")
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(out)
    good, lang, uniq, cut, packed = seen[1:]
    clean = labels.where("quality = 1").join(docs.where(F.size(F.split("text", r"\s+")) >= 10), "doc_id")
    assert clean.join(good, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    assert labels.where("quality = 0").join(good, "doc_id").count() == 0
    assert lang.count() >= 0.99 * good.count()
    texts = [r.text for r in uniq.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (W.findall(t.lower()) for t in texts)]
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for x in by.values() if len(x) < 40 for a in x for b in x if a < b}
    assert not [1 for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert uniq.count() < lang.count()
    assert cut.count() == uniq.count() and cut.agg(F.sum(F.length("text"))).first()[0] < uniq.agg(F.sum(F.length("text"))).first()[0]
    assert packed.select("doc_id").distinct().count() == cut.count()


def test_run_equals_stages(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_repeated_ids_are_removed_by_row(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(0, a), (1, a), (1, b), (2, c), (2, c), (3, c), (4, "x y z"), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, df, "").collect()), key=str)
    assert out == sorted([(0, a), (1, b), (2, c), (4, "x y z"), (None, a), (None, a)], key=str)


def test_odd_rows_go_through_all_stages(spark):
    """Null ids and texts, empty and very long texts, exact repeats, ids with two texts, and columns named like inner ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fine = docs.join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").where("lang = 'en' AND n_chars BETWEEN 800 AND 4000")
    texts = [r.text for r in fine.dropDuplicates(["text"]).orderBy("doc_id").limit(120).collect()]
    a, b, c, long = *texts[:3], "\n".join(texts[3:] * 3)
    rows = [(None, None), (None, ""), (None, a), (None, a), (1, a), (2, a), (2, b), (3, c), (3, c), (4, None), (5, ""), (6, long), (7, " \n\t ")]
    real = [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or ""), k, "x", 0) for k, (i, t) in enumerate(rows + real)], "doc_id long, text string, lang string, source string, n_chars long, n_words int, cid string, piece int")
    for data in (df.repartition(3), df.limit(0)):
        seen = [data]
        for name, f in P.STAGES:
            seen.append(P.materialize(f(spark, seen[-1], ""), "odd"))
            if name != P.STAGES[-1][0]:
                assert seen[-1].columns == data.columns
                assert seen[-1].count() <= seen[-2].count()
        if data is not df and data.isEmpty():
            assert all(x.count() == 0 for x in seen)
            continue
        good, lang, uniq, cut, packed = seen[1:]
        ids = {(r.doc_id, r.text) for r in uniq.collect()}
        assert (1, a) in ids and (2, a) not in ids and (2, b) in ids and (3, c) in ids and (None, a) in ids
        assert uniq.where("doc_id = 3").count() == 1 and uniq.where("doc_id IS NULL").count() == lang.where("doc_id IS NULL").count()
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}
        assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
