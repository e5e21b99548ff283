"""Chat formatting by a template that is a black box: it gets turns and gives a text.

Where a turn lies in the text, and which part of it is the turn's own words, is found by rendering alone. A turn's span is what
its prefix of the conversation adds to the text of the prefix before it; a template whose earlier text isn't kept
has rewritten history, which is reported. The words of a turn lie between what two renderings with other words have in common
at both ends of the span.

Conversations are streamed in the order of their turns, BLOCK turns at a time, so a task holds one block. A block is rendered
after the turn before it, so work is linear in the turns; a template that looks further back says so (`local = False`) and
gets whole conversations as one block. Conversations that hold a large share of all rows are dealt out by ranges of turns
if the template is local.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, tidy

#: Turns rendered as successive prefixes of one block.
BLOCK = 32
#: A conversation is hot with more than so many turns that are also more than a HOT_SHARE-th of all rows.
LEAST_HOT = 4096

Turn = tuple[str, str]


class InstTemplate:
    """Users between [INST] and [/INST], system turns between [SYS] and [/SYS], assistants up to </s>, other roles named between
    [ROLE] and [/ROLE]; <s> begins a conversation. In texts and names each control string gets a backslash after its first
    character, one more if it has some already; so the output can be read back and no text can open or close a turn."""

    #: What a turn adds depends only on itself and on being the first.
    local = True
    _CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE)\]))")
    _ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|(?:INST|SYS|ROLE)\]))")
    _AROUND = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", " </s>")}

    def escape(self, text: str) -> str:
        return self._CONTROL.sub(r"\1\2\\\3", text) if "<" in text or "[" in text else text

    def unescape(self, text: str) -> str:
        return self._ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text

    def render(self, turns: list[Turn]) -> str:
        out = ["<s>"]
        for role, text in turns:
            if role in self._AROUND:
                a, b = self._AROUND[role]
            else:
                a, b = f"[ROLE] {self.escape(role)} [/ROLE] ", " </s>"
            out += [a, self.escape(text), b]
        return "".join(out)

    def parse(self, output: str, at: int = 0) -> Iterator[Turn]:
        """The turns of an output, or of a part of one that begins with a turn."""
        at += 3 if output.startswith("<s>", at) else 0
        while at < len(output):
            role = next((r for r, (a, _) in self._AROUND.items() if output.startswith(a, at)), None)
            if role is None:
                stop = output.index(" [/ROLE] ", at + 7)
                role, at, close = self.unescape(output[at + 7 : stop]), stop + 9, " </s>"
            else:
                at, close = at + len(self._AROUND[role][0]), self._AROUND[role][1]
            stop = output.index(close, at)
            yield role, self.unescape(output[at:stop])
            at = stop + len(close)


def _common(a: str, b: str, end: bool = False) -> int:
    """How many characters two texts share at their beginning, or at their end; by halving, so that Python compares whole slices."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if (a.endswith(b[len(b) - mid :]) if end else a.startswith(b[:mid])):
            lo = mid
        else:
            hi = mid - 1
    return lo


class Renderer:
    """Spans of turns in a black-box template's output."""

    def __init__(self, template):
        self.template, self._edges = template, {}

    def edges(self, context: list[Turn], role: str, before: str) -> tuple[int, int]:
        """How many characters a turn of this role adds before and after its text."""
        kind = (role, bool(context))
        if self.template.local and kind in self._edges:
            return self._edges[kind]
        a, b = (self.template.render([*context, (role, x)]) for x in ("x", "yy"))
        shared = min(_common(a, before), _common(b, before))
        a, b = a[shared:], b[shared:]
        found = _common(a, b), _common(a, b, end=True)
        if self.template.local:
            self._edges = {**self._edges, kind: found} if len(self._edges) < 1000 else {kind: found}
        return found

    def block(self, context: list[Turn], turns: list[Turn]) -> tuple[str, list[dict]]:
        """What these turns add to the output after the context, and for each of them its span in that, the span of its text, and
        whether rendering it changed what had been rendered before."""
        before = self.template.render(context) if context else ""
        base, spans, done = len(before), [], list(context)
        for role, text in turns:
            out = self.template.render([*done, (role, text)])
            rewrote = not out.startswith(before)
            start = _common(out, before) if rewrote else len(before)
            head, tail = self.edges(done, role, before)
            spans.append({"start": start - base, "stop": len(out) - base, "text_start": start + head - base, "text_stop": len(out) - tail - base, "rewrote": rewrote})
            done.append((role, text))
            before = out
        return before[base:], spans


_SPAN = "struct<start: int, stop: int, text_start: int, text_stop: int, rewrote: boolean>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text_start", pa.int32()), ("text_stop", pa.int32()), ("rewrote", pa.bool_())]))
#: Characters of formatted text that a task hands on at a time.
BATCH = 4 << 20


def _stream(batches: Iterator[pa.RecordBatch], seen: list) -> Iterator[tuple]:
    """Rows as tuples; seen gets the type of the first column."""
    for b in batches:
        seen[:] = [b.schema.field(0).type]
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _blocks(rows: DataFrame, template, kind: str) -> DataFrame:
    """Blocks of rows (conv_id, role, text, later, part) that are sorted by turn within a conversation. later: a conversation that begins
    with this row in this task has turns before it; part: where this task's blocks stand among those of other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer, ids, out, size = Renderer(template), [], [], 0

        def flush() -> pa.RecordBatch:
            types = [*ids, pa.int64(), pa.string(), _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "block", "formatted", "spans"])

        for conv, rows in groupby(_stream(batches, ids), key=lambda r: r[0]):
            context, block, number = None, [], 0
            for _, role, text, later, part in rows:
                if context is None:
                    context, number = [("user", "")] if later else [], part << 40
                block.append((role, text))
                if template.local and len(block) == BLOCK:
                    out.append((conv, number, *renderer.block(context, block)))
                    size += len(out[-1][2])
                    context, block, number = block[-1:], [], number + 1
                    if size > BATCH:
                        yield flush()
                        out, size = [], 0
            if block:
                out.append((conv, number, *renderer.block(context, block)))
                size += len(out[-1][2])
            if size > BATCH:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return rows.mapInArrow(tidy(run), f"conv_id {kind}, block long, formatted string, spans array<{_SPAN}>")


def _formatted(turns: DataFrame, template) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of conversations that lie whole and in order in one partition, and blocks of hot conversations, in any order."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    columns = ["conv_id", "role", "text", "later", "part"]

    def cold(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("conv_id").sortWithinPartitions(*order)
        return _blocks(dealt.withColumns({"later": F.lit(False), "part": F.lit(0).cast("long")}).select(columns), template, kind)

    if not template.local:
        return cold(rows), None
    counts = rows.groupBy(F.col("conv_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("turn", "role", F.xxhash64("text"))).alias("__first"))
    total = turns.count()
    hot = counts.where(F.col("__n") > max(LEAST_HOT, total // HOT_SHARE))  # fewer than HOT_SHARE rows
    if hot.isEmpty():
        return cold(rows), None
    same, hot = F.col("conv_id").eqNullSafe(F.col("__id")), F.broadcast(hot)
    dealt = rows.join(hot, same).repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    later = ~F.struct("turn", "role", F.xxhash64("text")).eqNullSafe(F.col("__first"))
    dealt = dealt.withColumns({"later": later, "part": F.spark_partition_id().cast("long")}).select(columns)
    return cold(rows.join(hot, same, "left_anti")), _blocks(dealt, template, kind)


def format_conversations(turns: DataFrame, template=None) -> DataFrame:
    """turns (conv_id, turn, role, text) as text: conv_id, block, formatted, spans (in characters of formatted).

    The blocks of a conversation, joined in their order, are its output; every span is one turn, with the place of its text, which is
    what a loss mask takes of assistants. Turns are ordered by turn (nulls first), then role, then text by hash; repeated rows are
    turns of their own. Null texts and roles read as empty, a null conv_id is a conversation of its own, other columns
    are not carried on; an empty table gives an empty one. rewrote marks a turn that changed what was rendered before it; what a block
    then holds is its last rendering, and earlier spans are those of the rendering in which they were found."""
    whole, hot = _formatted(turns, template or InstTemplate())
    return whole if hot is None else whole.unionByName(hot)


def read_back(blocks: DataFrame, template) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from blocks in the order of their conversation. SHA-256 takes bytes in
    order, so a conversation's bytes pass one task, a block at a time."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = [], []

        def flush() -> pa.RecordBatch:
            types = [*ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for conv, rows in groupby(_stream(batches, ids), key=lambda r: r[0]):
            turns, loss, n, chars, masked, rewrites = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for _, _, formatted, spans in rows:
                for (role, text), at in zip(template.parse(formatted), spans, strict=True):
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        own = template.unescape(formatted[at["text_start"] : at["text_stop"]])
                        loss.update(own.encode())
                        masked += len(own)
                    rewrites += at["rewrote"]
                n += len(spans)
                chars += len(formatted)
            out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars, rewrites))
            if len(out) == 10_000:
                yield flush()
                out = []
        if out:
            yield flush()

    return blocks.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")


def conversation_digests(turns: DataFrame, template=None) -> DataFrame:
    """Formats all conversations and reads them back: a row for each."""
    template = template or InstTemplate()
    whole, hot = _formatted(turns, template)
    out = read_back(whole, template)
    if hot is not None:
        out = out.unionByName(read_back(hot.repartition("conv_id").sortWithinPartitions("conv_id", "block"), template))
    return out
