import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.llm.packing import best_fit, pack_documents, sum_of_squares, token_pieces
from vecshift.llm.quality import keep_quality, quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ["", None, "one", "a b c d e a b c d e", "x " * 30, "The cat\n\nThe cat\n the cat \nThe cat", "é ß & # $ x\x0b\x0cy", "w" * 5000 + " " + "v " * 3000, "the " * 9 + "end.", "tab\tsep | a * b"]


def brute(text):
    t = text or ""
    w = W.findall(t)
    g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = real + [(1000 + i, t) for i, t in enumerate(EDGE)] + [(None, "null id " * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("votes", F.lit(1)).repartition(3)


def test_counts_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(out) == docs.count()
    for k, r in out.items():
        b = brute(texts[k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, k
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)


def test_keep_quality_keeps_columns_and_rows(docs):
    kept = keep_quality(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert quality_rules(docs.limit(0)).count() == 0 and keep_quality(docs.limit(0)).count() == 0


def test_labels_agree(spark):
    d = "/root/testdata/sf0.01"
    x = quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    got = {(r.quality, r.kept): r.n for r in x.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    good = got.get((1, True), 0) / (got.get((1, True), 0) + got.get((1, False), 0))
    bad = got.get((0, False), 0) / (got.get((0, True), 0) + got.get((0, False), 0))
    assert good > 0.97 and bad > 0.8, got


def test_sum_of_squares_fills_bins():
    rng = np.random.default_rng(3)
    n = np.sort(np.minimum(4096, rng.lognormal(7, 0.9, 6000).astype(int) + 1))[::-1]
    b, o = sum_of_squares(n, 4096)
    end = o + n
    assert end.max() <= 4096
    for k in range(b.max() + 1):
        x = np.flatnonzero(b == k)
        x = x[np.argsort(o[x])]
        assert (o[x] == np.concatenate([[0], end[x][:-1]])).all()
    assert b.max() + 1 <= math.ceil(n.sum() / 4096) * 1.01 + 2


def test_placement_equals_brute_force():
    """Every item goes where the sum of squares of the open bins' counts by gap becomes smallest, a new bin counting one more, ties to the tightest gap."""
    rng = np.random.default_rng(9)
    for capacity in (10, 37):
        sizes = np.sort(rng.integers(1, capacity + 1, 300))[::-1]
        if capacity == 10:
            rng.shuffle(sizes)
        bins: list[int] = []  # what is left in each
        want = []
        for s in sizes.tolist():
            def cost(gap, s=s):
                n = Counter(g for g in bins if g)
                if gap is not None:
                    n[gap] -= 1
                n[(capacity if gap is None else gap) - s] += 1
                return sum(v * v for g, v in n.items() if g) + (gap is None)

            choices = [*sorted({g for g in bins if g >= s}), None]
            gap = min(choices, key=lambda g: (cost(g), capacity if g is None else g))
            want.append(capacity if gap is None else gap)
            if gap is None:
                bins.append(capacity - s)
            else:
                bins[bins.index(gap)] -= s
        b, o = sum_of_squares(sizes, capacity)
        assert (capacity - o).tolist() == want and b.max() + 1 == len(bins)


def test_equal_rows_are_dealt_apart(spark):
    """Null ids and empty texts, all alike: no group gets them all, and every row comes out."""
    df = spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string")
    out = best_fit(token_pieces(df), 4096, group_pieces=100)
    assert out.count() == 3000
    groups = [r.n for r in out.groupBy((F.col("sequence_id") / F.lit(1 << 32)).cast("long").alias("g")).agg(F.count("*").alias("n")).collect()]
    assert len(groups) > 20 and max(groups) < 200


def test_tokens_equal_the_tokenizer(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "It's <|endoftext|> THE End. <|ENDOFTEXT|> we'll.<|startoftext|>x"), (2, "é́ Å 12,5%   x ###'s 'S x's. don't! İstanbul"), (3, "")]
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter()
    for r in odd.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            p = np.array(ids[k : k + 64], "<u4")
            want[(r.doc_id, k // 64, k, len(p), zlib.crc32(p.tobytes()))] += 1
    assert want == Counter(tuple(r) for r in token_pieces(odd, capacity=64).collect())


def test_packing_is_gapless(docs):
    out = pack_documents(docs, capacity=256).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 256
    total = sum(r.length for r in out)
    assert len(seqs) <= math.ceil(total / 256) * 1.02 + 2
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
    assert pack_documents(docs.limit(0)).count() == 0


def test_group_count_follows_rows(spark):
    p = spark.range(1000).selectExpr("id doc_id", "0 piece", "id ids_crc32", "1 + id % 100 length")
    out = best_fit(p, 100, group_pieces=100)
    assert out.count() == 1000 and out.selectExpr("count(distinct sequence_id >> 32)").first()[0] > 5
