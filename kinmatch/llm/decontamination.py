"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-cased words with one space between
them. An item of n characters may differ in e = floor(BUDGET * n) edits: it is
cut into e + 1 pieces, of which one must stand unchanged in any passage within
the budget. An item of fewer than SHORT characters says too little to be found
inside words or with edits: it must stand as it is, as whole words. All pieces are found in one pass by an Aho-Corasick
automaton, and the window around each hit is verified by Myers' bit-parallel
edit distance. The automaton is built from the whole test set, in blocks of at
most BLOCK characters of items, so a task's memory does not grow with it.

Nulls and empty texts hold no item; null or empty items are held by nothing.
Of several places of an item in a document the first with the smallest
distance is told. Repeated rows and ties are each judged by themselves; rows of
the test set that are equal in id and text are one item.
Empty tables give no row. Further columns are kept by `decontaminate` and
passed by otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, lean, table

BUDGET, BLOCK, SHORT = 0.08, 4_000_000, 20


@dataclass(frozen=True)
class Item:
    item_id: int | None
    text: str
    budget: int


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of near equal length."""
    n = min(budget + 1, len(text))
    cut = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of `pattern` to a substring of `text`, and the end of the first such substring."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    pv, mv, score = full, 0, len(pattern)
    best, end = score, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv, xh = eq | mv, ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best, end


class Matcher:
    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items, found = items, {}
        for k, item in enumerate(items):
            for at, piece in pieces(item.text, item.budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item that stands in `text`: (distance, start, end) in the normalised text."""
        windows: dict[int, list[list[int]]] = {}
        for last, (n, where) in self.automaton.iter(text):
            for k, at in where:
                item = self.items[k]
                if len(item.text) < SHORT and (text[last - n : last - n + 1].strip() if last >= n else "") + text[last + 1 : last + 2].strip():
                    continue
                a = last + 1 - n - at - item.budget
                b = last + 1 - n - at + len(item.text) + item.budget
                spans = windows.setdefault(k, [])
                if spans and a <= spans[-1][1]:  # hits of one item come nearly in order
                    spans[-1][0], spans[-1][1] = min(a, spans[-1][0]), max(b, spans[-1][1])
                else:
                    spans.append([a, b])
        out = {}
        for k, spans in windows.items():
            item = self.items[k]
            for a, b in sorted(spans):
                a = max(0, a)
                distance, end = myers(item.text, text[a:b])
                if distance <= item.budget and (k not in out or distance < out[k][0]):
                    _, length = myers(item.text[::-1], text[a : a + end][::-1])
                    out[k] = (distance, a + end - length, a + end)
        return out


def items_of(benchmark: DataFrame, budget: float = BUDGET) -> list[list[Item]]:
    """The test items in blocks of at most BLOCK characters; a test set is small by nature."""
    blocks, size = [[]], 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if text := normal(r.text):
            if size + len(text) > BLOCK and blocks[-1]:
                blocks.append([])
                size = 0
            size += len(text)
            blocks[-1].append(Item(r.item_id, text, 0 if len(text) < SHORT else int(budget * len(text))))
    return [b for b in blocks if b]


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(items: tuple[Item, ...]) -> Matcher:
    """The last automaton built in a Python worker, by its items."""
    if items not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[items] = Matcher(list(items))
    return _MATCHERS[items]


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of `text` that stand at start:end of its normalised form (to the word where letters change length)."""
    at, firsts, words = 0, [], []
    for m in re.finditer(r"\S+", text):
        firsts.append(at)
        words.append(m)
        at += len(m[0].lower()) + 1
    a, b = bisect_right(firsts, start) - 1, bisect_right(firsts, max(start, end - 1)) - 1
    return min(words[a].start() + start - firsts[a], words[a].end()), min(words[b].start() + end - firsts[b], words[b].end())


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), distance: a row for each item that a document holds."""
    arrow_batches(docs.sparkSession)
    out = None
    for block in items_of(benchmark, budget) or [[]]:
        items = tuple(block)

        def find(batches, items=items):
            m = matcher(items) if items else None
            for batch in batches:
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if t and m:
                        for k, (distance, a, b) in sorted(m.find(normal(t)).items()):
                            rows.append((d, items[k].item_id, *original_span(t, a, b), distance))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "distance"])

        part = docs.select("doc_id", "text").mapInArrow(lean(find), "doc_id long, item_id long, start long, end long, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """`docs` without the rows whose text holds a test item; all columns stay."""
    arrow_batches(docs.sparkSession)
    shape, at = docs.schema, docs.columns.index("text")
    for block in items_of(benchmark, budget):
        items = tuple(block)

        def keep(batches, items=items):
            m = matcher(items)
            for batch in batches:
                clean = [not (t and m.find(normal(t))) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(lean(keep), shape)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
