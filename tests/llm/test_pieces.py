import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from vecshift.llm import pieces as P
from vecshift.llm.queries import op2_sentencepiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = ["  a ", " ", "a\tb　c \xa0d", "Hello  World é\n😀 ñuerr  a\n\n x", "▁▁▁a▁b", " " * 37 + "x" + " " * 5, "日本語のテキスト mixed ελληνικά", "\0a\0", "<s> </s> <0x0A> <unk>", "ab" * 4000, "\n"]
    return odd + ["".join(rng.choice("abcdehilnorst.,  \n") for _ in range(rng.randint(1, 60))) for _ in range(800)]


@pytest.mark.parametrize("chars,cache", [(1_500_000, 500_000), (50, 40)])
def test_ids_equal_the_library(library, texts, monkeypatch, chars, cache):
    monkeypatch.setattr(P, "INDEX_CHARS", chars)
    monkeypatch.setattr(P, "CACHE_BYTES", cache)
    m = P.Pieces(P.default_model())
    some = texts if chars > 50 else texts[:40]
    for t, ids in zip(some, [x for i in range(0, len(some), 30) for x in m.encode(some[i : i + 30])], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t
        assert m.decode(ids) == t.replace("▁", " ")


def test_frames(spark, library, texts):
    rows = [(i, t) for i, t in enumerate([*texts[:50], "", None])] + [(None, "x"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    out = P.decode(P.encode(df)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.ids is None) == (r.text is None)
        if r.text is not None:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(r.text) and r.decoded == r.text.replace("▁", " ")
    assert P.decode(P.encode(df.limit(0))).count() == 0


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op2_sentencepiece(spark, d).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = np.array(library.encode(texts[r.doc_id]), "<u4")
        assert (r.n_ids, r.ids_crc32, r.decodes) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_pairs_equal_whole_merges(monkeypatch):
    """The walk along two pieces' merges says what merging their whole text says, and so does the table, however few places it has."""
    monkeypatch.setattr(P, "PAIR_BITS", 4)
    m, rng = P.Pieces(P.default_model()), random.Random(2)
    short, live, pairs = [p for p in m.live if len(p) < 5], set(m.live), []
    while len(pairs) < 6000:  # the text of two pieces, cut anywhere
        both = rng.choice(short) + rng.choice(short)
        at = rng.randrange(1, len(both))
        if both[:at] in live and both[at:] in live:
            pairs.append((m.id[both[:at]], m.id[both[at:]]))
    want = [m.merged(m.text[a] + m.text[b]) == [m.text[a], m.text[b]] for a, b in pairs]
    assert 0.1 < np.mean(want) < 0.97
    key = np.array([a * m.n + b for a, b in pairs])
    assert [m.beside(a, b) for a, b in pairs] == want
    assert m.neighbours(key).tolist() == want and m.neighbours(key[::-1]).tolist() == want[::-1]


def test_words_in_use_are_not_learned_again(library, monkeypatch):
    """A full cache gives up words that were not used of late, not all of them."""
    monkeypatch.setattr(P, "CACHE_BYTES", 60_000)
    m, learned = P.Pieces(P.default_model()), []
    learn = P.Pieces.learn
    monkeypatch.setattr(P.Pieces, "learn", lambda self, words: (learned.extend(words), learn(self, words)))
    for i in range(60):
        texts = ["a hot word stays", " ".join(f"cold{i}x{j}" for j in range(20))]
        for t, ids in zip(texts, m.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t)
        assert len(m.cache) + len(m.older) < 60_000 // P.ENTRY + 30
    assert learned.count(f"{P.SPACE}hot") == 1 and len(learned) == 4 + 60 * 20
