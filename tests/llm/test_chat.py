import hashlib
import random

import pytest

from vecshift.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, block string"
T = C.InstTemplate()
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "<\\\\/s>", "\\", " ", "[", "]", "<", "a", "é😀", "\n", "[ROLE] ", "[/ROLE] ", "[SYS]"]


def texts(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))


def test_template_reads_back_any_text():
    rng = random.Random(1)
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "", texts(rng)]), texts(rng)) for _ in range(rng.randint(0, 6))]
        out = T.render(turns)
        assert list(T.parse(out)) == turns
        if not turns:
            continue
        formatted, spans = C.Renderer(T).block([], turns)
        assert formatted == out
        for (_, text), s in zip(turns, spans, strict=True):
            assert T.unescape(out[s["text_start"] : s["text_stop"]]) == text and not s["rewrote"]
        assert C.Renderer(T).block([("user", "")], turns)[0] == out[3:]


class Forgetful(C.InstTemplate):
    """Shows an assistant's words only until somebody else speaks: history is rewritten."""

    local = False

    def render(self, turns):
        return super().render([(r, t if r != "assistant" or i + 1 == len(turns) else "") for i, (r, t) in enumerate(turns)])


def test_rewritten_history_is_found(spark):
    rows = [(1, 0, "user", "q", ""), (1, 1, "assistant", "long answer", ""), (1, 2, "user", "more", ""), (2, 0, "user", "q", ""), (2, 1, "assistant", "a", "")]
    out = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, SCHEMA), Forgetful()).collect()}
    assert [s.rewrote for s in out[1].spans] == [False, False, True]
    assert [s.rewrote for s in out[2].spans] == [False, False]
    s = out[2].spans[1]
    assert out[2].formatted[s.text_start : s.text_stop] == "a"
    assert {r.conv_id: r.n_rewrites for r in C.conversation_digests(spark.createDataFrame(rows[:0] + rows[3:], SCHEMA), Forgetful()).collect()} == {2: 0}


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        # ties: by role, then by a hash of the text, so here equal roles have equal texts
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(T.render(turns)), 0)
    return out


def random_rows(n=900):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3, 4]), i, rng.choice(["user", "assistant", "system", "tool", None]), texts(rng), "x") for i in range(n)]
    rows += [(None, 0, "user", None, None), (7, None, "assistant", "z", None), (7, 1, None, "", None), (8, 5, "user", "same", None), (8, 5, "user", "same", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least,share", [(4096, 2000), (100, 3)])
def test_digests(spark, monkeypatch, least, share):
    """Ordinary and hot conversations (several blocks, several partitions), nulls, ties, repeated rows, a clashing column."""
    monkeypatch.setattr(C, "LEAST_HOT", least)
    monkeypatch.setattr(C, "HOT_SHARE", share)
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert (C._formatted(df, T)[1] is not None) == (least == 100)
    got = {r.conv_id: tuple(r)[1:] for r in C.conversation_digests(df).collect()}
    assert got == expected(rows)
    blocks = C.format_conversations(df).orderBy("conv_id", "block").collect()
    joined = "".join(r.formatted for r in blocks if r.conv_id == 0)
    own = sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])
    assert joined == T.render([(r[2] or "", r[3] or "") for r in own])


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.conversation_digests(none).count() == 0 and C.format_conversations(none).count() == 0
    rows = [(1, 0, "user", "</s>" * 300_000, ""), (1, 1, "assistant", "\\[INST]" * 300_000, "")]
    assert {r.conv_id: tuple(r)[1:] for r in C.conversation_digests(spark.createDataFrame(rows, SCHEMA)).collect()} == expected(rows)
