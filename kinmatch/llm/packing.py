"""Best-fit packing by large-item matching.

Pieces above a third of the capacity go at most two to a sequence: each, from
the longest down, is matched with the longest other that still fits. Pieces up
to a third then fill the smallest gap that takes them, from the longest down.
Lengths are whole numbers up to the capacity, so the plan is made on the
driver from the count of each length (at most `capacity` rows): a step places
`n` pieces of one length, by rank, at one offset of `n` consecutive sequences.
There are at most as many steps as pairs of a length and a gap. Pieces are
numbered within their length in parallel and look their place up in the plan.

Nulls: a null text is empty and its document is the end id alone; a null
doc_id is kept. Repeated rows are packed each by itself. Ties between equal
lengths are broken by a hash of doc_id and piece. An empty table gives no
piece. Further columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, gapless, lean, staged, table
from .tokens import encoder, tokenizer_path

CAPACITY, END_ID = 2048, 0
Step = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Steps (length, first rank, n, first sequence, offset) and the number of sequences."""
    left = {k: n for k, n in counts.items() if n}
    steps: list[Step] = []
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        steps.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else 0
        if b == a and left[a] < 2:
            at -= 1
            b = large[at] if at >= 0 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, n, sequences, 0)
        if b:
            put(b, n, sequences, a)
        gaps[capacity - a - b].append((sequences, n))
        sequences += n
        for k in {a, b} - {0}:
            if not left[k]:
                large.remove(k)

    open_gaps = sorted(gaps)
    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length
                n = left[length] // each or 1
                gaps[capacity].append((sequences, n))
                sequences += n
                insort(open_gaps, capacity)
                at = len(open_gaps) - 1
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            each = min(gap // length, left[length])
            full = min(n, left[length] // each)
            if full < n:
                gaps[gap].append((first + full, n - full))
            for k in range(each):
                put(length, full, first, capacity - gap + k * length)
            if not gaps[gap]:
                del open_gaps[at], gaps[gap]
            rest = gap - each * length
            if rest:
                if rest not in gaps:
                    insort(open_gaps, rest)
                gaps[rest].append((first, full))
    return steps, sequences


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit): pieces of at most `capacity` ids."""
    arrow_batches(docs.sparkSession)
    path = path or tokenizer_path()
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            doc, piece, start, length, ids = [], [], [], [], []
            for d, data in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                data += end
                for k, i in enumerate(range(0, len(data), step)):
                    part = data[i : i + step]
                    doc.append(d)
                    piece.append(k)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids binary")


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to staged `pieces` (doc_id, piece, length and any others)."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    steps = np.array(sorted(plan(counts, capacity)[0]), dtype=np.int64).reshape(-1, 5)
    # one sorted key for (length, first rank); ranks stay below 2**50
    keys = (steps[:, 0] << 50) + steps[:, 1]
    sequence, offset = steps[:, 3] - steps[:, 1], steps[:, 4]
    ranked = gapless(pieces, "length", ("doc_id", "piece"), "_rank")
    shape = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("_rank").dtypes)

    def look_up(batches):
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("_rank", "length"))
            at = np.searchsorted(keys, (length << 50) + rank, "right") - 1
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence[at] + rank), pa.array(offset[at])], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(lean(look_up), f"{shape}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of `docs` with their ids, each with the sequence and offset where it stands."""
    return assign_sequences(staged(tokenize_pieces(docs, path, capacity, end_id), "pieces"), capacity)


def pack_digests(docs: DataFrame) -> DataFrame:
    """As pack_documents, with the crc32 of the ids in place of the ids."""
    pieces = tokenize_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = assign_sequences(staged(pieces, "pieces"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_digests(table(spark, sf_dir, "documents"))
