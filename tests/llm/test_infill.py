import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from vecshift.llm import infill as I
from vecshift.llm.common import buffers


def make(rng, n):
    return "".join(rng.choice("abZé1 \n😀_<") for _ in range(n))


def tokens(t):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", t)


def test_cuts_of_chunks(monkeypatch):
    monkeypatch.setattr(I, "CHUNK", 16)
    rng = random.Random(3)
    texts = [make(rng, rng.choice([0, 1, 5, 50, 9000])) for _ in range(200)] + ["a" * 5000, "é" * 5000]
    data, off = buffers(pa.array(texts))
    c = I.Chunks(data, off)
    for i, t in enumerate(texts):
        w = tokens(t)
        assert len(w) == c.n[i]
        for r in {0, len(w), len(w) // 2, len(w) // 3, max(0, len(w) - 1)}:
            byte, char = c.cut(i, r)
            assert (byte - off[i], char) == (len("".join(w[:r]).encode()), len("".join(w[:r])))


def expected(i, text, rate=90, spm=20):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    w = tokens(text)
    n = len(w)
    if not text or any(m in text for m in I.MARKS) or h[2] % 100 >= rate:
        return (i, n, "plain", None, None, text)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(w[:x]), "".join(w[x:y]), "".join(w[y:])
    if h[3] % 100 < spm:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_frames(spark):
    rng = random.Random(4)
    rows = [(i, make(rng, rng.choice([0, 1, 2, 30, 400])), "x") for i in range(300)]
    rows += [(None, "no id", "x"), (1000, None, "x"), (1001, "has <M> in it", "x"), (1002, "<" * 40 + "<S", "x"), (5, rows[5][1], "x"), (1003, make(rng, 3_000_000), "x")]
    rows += [(i, "P>S>M><<" * 9, "x") for i in range(2000, 2040)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    out = I.fill_in_middle(df)
    out = out.withColumn("back", I.restored(out.form, out.output)).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
    texts = {(i, t or "") for i, t, _ in rows}
    assert all((r.doc_id, r.back) in texts for r in out)
    assert I.fill_in_middle(df.limit(0)).count() == 0
    assert {r.form for r in I.fill_in_middle(df, rate=0).collect()} == {"plain"}


def test_other_marks(spark):
    df = spark.createDataFrame([(i, "some text, with 7 words in it") for i in range(50)], "doc_id string, text string")
    marks = ("<prefix>", "<suf>", "<middle-part>")
    out = I.fill_in_middle(df, rate=100, spm_rate=50, marks=marks)
    got = out.withColumn("back", I.restored(out.form, out.output, marks)).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.back == "some text, with 7 words in it" for r in got)


def test_boundaries_are_of_adjacent_characters():
    assert np.flatnonzero(I.boundaries(np.frombuffer(b"ab 1c", np.uint8))).tolist() == [0, 2, 3, 4]
    assert np.flatnonzero(I.boundaries(np.frombuffer(b"ab", np.uint8), ord("x"))).tolist() == []
