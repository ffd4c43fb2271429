"""Content-addressed store of token ids.

Layout below one folder, Parquet files as containers:

    packs/     a row a document, in ascending doc_id order, one pack a file:
               pack, place (of the document in its pack), doc_id, row_key,
               start, n_tokens, width (bytes an id: 2 or 4), lengths (ids of
               each chunk), hashes (16 bytes each, in order), foreign (chunks
               whose ids another document holds), shared (own chunks that
               others refer to), payload (little-endian ids of all but the
               foreign chunks), root (Merkle root). Lists of numbers are
               little-endian unsigned 32-bit ones.
    manifest/  pack, documents, root: a tree of hashes over the pack's documents,
               FAN to a node

Documents are cut where a rolling hash of the last 16 ids has its low 9 bits
clear, so equal passages give equal chunks. A chunk is stored once, in the
first document (by doc_id) that holds it; others name its hash. Reading joins the named chunks only, rebuilds every document, and checks each chunk
hash, each document root and each pack root against the manifest.

Nulls: a null text is empty and its document is the end id alone. Repeated
rows and ids are documents of their own (row_key tells them apart). An empty
table gives an empty store. Further columns are not looked at.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, drop_staged, forget, lean, partitions, running_start, shared_dir, staged, table
from .tokens import encoder, tokenizer_path

END_ID, LEAST, MOST, MASK = 1, 64, 4096, 511
HASH = 16
#: Documents under one node of a pack's tree.
FAN = 4096


def _gear(n: int = 1 << 16) -> np.ndarray:
    """A fixed random number for each id modulo n (splitmix)."""
    x = (np.arange(n, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)


GEAR = _gear()


PAD = 16


def _hits(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last 16 ids allows a cut; PAD ids of nothing stand before each of `starts`."""
    h = GEAR[ids & 0xFFFF]
    for k in range(1, PAD + 1):
        h[starts - k] = 0
    for k in (1, 2, 4, 8):  # doubling: after k, h covers a window of 2k ids
        moved = np.zeros_like(h)
        moved[k:] = h[:-k] << np.uint32(k)
        h += moved
    return np.flatnonzero((h & MASK) == 0) + 1


def _cut(hits: list[int], n: int) -> list[int]:
    """Lengths of the chunks of n ids: cuts at `hits`, between LEAST and MOST ids apart."""
    out, at = [], 0
    for cut in hits:
        while cut - at > MOST:
            out.append(MOST)
            at += MOST
        if cut - at >= LEAST:
            out.append(cut - at)
            at = cut
    while n - at > MOST:
        out.append(MOST)
        at += MOST
    if at < n:
        out.append(n - at)
    return out


def batch_lengths(texts: list[bytes]) -> list[list[int]]:
    """The lengths of the chunks of each list of ids (as bytes), all hashed together."""
    pad = bytes(4 * PAD)
    ids = np.frombuffer(pad + pad.join(texts), "<u4")
    n = np.array([len(t) // 4 for t in texts], np.int64)
    starts = PAD + np.cumsum(n + PAD) - (n + PAD)
    hits = _hits(ids, starts)
    a, b = np.searchsorted(hits, starts, "right"), np.searchsorted(hits, starts + n, "right")
    return [_cut((hits[i:j] - s).tolist(), k) for i, j, s, k in zip(a.tolist(), b.tolist(), starts.tolist(), n.tolist(), strict=True)]


def chunk_lengths(ids: np.ndarray) -> list[int]:
    """Lengths of the chunks of `ids`: cuts where the hash of the last 16 ids allows, between LEAST and MOST ids apart."""
    return batch_lengths([ids.astype("<u4").tobytes()])[0]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over `leaves`; an odd node moves up."""
    while len(leaves) > 1:
        pairs = [blake2b(a + b, digest_size=HASH).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(leaves) & ~1 :]
    return leaves[0] if leaves else b""


ENCODED = "doc_id long, row_key long, n_tokens long, width int, lengths binary, hashes binary, payload binary, root binary"
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(columns: list, shape: str) -> pa.RecordBatch:
    """Columns (lists or Arrow arrays) as a batch of the shape."""
    fields = [x.split() for x in shape.split(", ")]
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _transposed(rows: list[tuple], shape: str) -> pa.RecordBatch:
    return _batch(list(zip(*rows, strict=True)) or [()] * (shape.count(",") + 1), shape)


def _numbers(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def _bounds(lengths: bytes) -> list[int]:
    return [0, *np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()]


def encode_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    arrow_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path, 64 << 20)
        for batch in batches:
            rows, every = [], [ids + end for ids in enc.encode_all(batch.column(2).to_pylist())]
            for d, k, x, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), every, batch_lengths(every), strict=True):
                ids = np.frombuffer(x, "<u4")
                width = 2 if ids.max() < 65536 else 4
                data = ids.astype(f"<u{width}").tobytes()
                at = [0, *accumulate(cut)]
                hashes = [blake2b(data[width * a : width * b], digest_size=HASH).digest() for a, b in zip(at, at[1:], strict=False)]
                rows.append((d, k, len(ids), width, np.array(cut, "<u4").tobytes(), b"".join(hashes), data, merkle(hashes)))
            yield _transposed(rows, ENCODED)

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text").mapInArrow(lean(run), ENCODED)


def _chunks(encoded: DataFrame) -> DataFrame:
    """A row a chunk: ord (from 0) and hash."""
    places = F.sequence(F.lit(0), (F.length("hashes") / HASH).cast("int") - 1)
    return encoded.select("doc_id", "row_key", F.posexplode(F.transform(places, lambda i: F.substring("hashes", i * HASH + 1, F.lit(HASH)))).alias("ord", "hash"))


PACKED = "pack int, place long, doc_id long, row_key long, start long, n_tokens long, width int, lengths binary, hashes binary, foreign binary, shared binary, payload binary, root binary"
KEPT = ("doc_id", "row_key", "n_tokens", "width", "lengths", "hashes", "root")


def _settle(batches):
    """Keeps in `payload` what a document stores itself. A document's note (start, foreign, shared) comes just before its ids."""
    note, place = None, 0
    listed = lambda x: np.array(sorted(x or ()), "<u4").tobytes()
    for batch in batches:
        of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        is_doc = of["payload"].is_valid().to_numpy(zero_copy_only=False)
        keys, starts = of["row_key"].to_pylist(), of["start"].to_pylist()
        foreign, shared, told = of["foreign"].to_pylist(), of["shared"].to_pylist(), []
        at = np.flatnonzero(is_doc)
        for i in at.tolist():
            if i:
                note = (keys[i - 1], starts[i - 1], foreign[i - 1], shared[i - 1])
            if note is None or note[0] != keys[i] or i and is_doc[i - 1]:
                raise ValueError("a document has no note")
            told.append(note)
        if len(is_doc) and not is_doc[-1]:
            note = (keys[-1], starts[-1], foreign[-1], shared[-1])
        take = pa.array(at)
        docs = {n: of[n].take(take) for n in ("pack", "payload", *KEPT)}
        if any(n[2] for n in told):
            payload = docs["payload"].to_pylist()
            for k, n in enumerate(told):
                if n[2]:
                    away, cut, w = set(n[2]), _bounds(docs["lengths"][k].as_py()), docs["width"][k].as_py()
                    payload[k] = b"".join(payload[k][w * cut[i] : w * cut[i + 1]] for i in range(len(cut) - 1) if i not in away)
            docs["payload"] = payload
        more = {"place": range(place, place + len(at)), "start": [n[1] for n in told], "foreign": [listed(n[2]) for n in told], "shared": [listed(n[3]) for n in told]}
        place += len(at)
        yield _batch([(docs | more)[x.split()[0]] for x in PACKED.split(", ")], PACKED)


def _pack_roots(packs: DataFrame) -> DataFrame:
    """documents and root of each pack: nodes of FAN documents first, then the pack over its nodes."""

    def over(order: str) -> list:
        ordered = F.array_sort(F.collect_list(F.struct(order, "root")))
        return F.sha2(F.array_join(F.transform(ordered, lambda x: x["root"]), ""), 256).alias("root")

    nodes = packs.select("pack", "place", F.hex("root").alias("root")).groupBy("pack", F.expr(f"place div {FAN}").alias("node")).agg(F.count("*").alias("documents"), over("place"))
    return nodes.groupBy("pack").agg(F.sum("documents").alias("documents"), over("node"))


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encodes `docs` and writes the store to `folder`."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    encode_documents(docs, path or tokenizer_path(), end_id).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    encoded = spark.read.schema(ENCODED).parquet(f"{folder}/encoded")

    chunks = _chunks(encoded)
    place = F.struct("doc_id", "row_key", "ord")
    # staged, so that Spark can split the chunks of a hash that very many documents hold
    owners = staged(chunks.groupBy("hash").agg(F.min(place).alias("owner"), F.count("*").alias("n")).where("n > 1").select("hash", "owner"), "owners")
    marked = chunks.join(owners, "hash").withColumn("own", place == F.col("owner"))
    notes = marked.groupBy("row_key").agg(
        F.collect_list(F.when(~F.col("own"), F.col("ord"))).alias("foreign"),
        F.collect_list(F.when(F.col("own"), F.col("ord"))).alias("shared"),
    )
    starts = running_start(encoded.select("doc_id", "row_key", "n_tokens"), "doc_id", "n_tokens")
    notes = staged(starts.select("doc_id", "row_key", "start").join(notes, "row_key", "left"), "notes")  # read twice: for ranges, and to be sent
    both = notes.unionByName(encoded, allowMissingColumns=True)
    ranged = both.repartitionByRange(partitions(spark), "doc_id").withColumn("pack", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions("doc_id", "row_key", F.col("payload").isNotNull())
    ranged.mapInArrow(lean(_settle), PACKED).write.option("compression", "zstd").parquet(f"{folder}/packs")
    forget(spark, f"{folder}/encoded")
    for t in (owners, notes):
        drop_staged(t)
    _pack_roots(spark.read.schema(PACKED).parquet(f"{folder}/packs")).write.parquet(f"{folder}/manifest")


DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"
READ = ("doc_id", "start", "n_tokens", "width", "lengths", "hashes", "foreign", "payload", "root")


def _document(doc_id, start, n_tokens, width, lengths, hashes, foreign, payload, root, parts: dict[int, bytes]) -> tuple:
    """A document rebuilt from its payload and the parts that others hold, checked against its hashes and root."""
    at = _bounds(lengths)
    if foreign:
        own, chunks = 0, []
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if i in parts:
                chunks.append(parts[i])
            else:
                chunks.append(payload[own : own + width * (b - a)])
                own += width * (b - a)
        payload = b"".join(chunks)
    found = [blake2b(payload[width * a : width * b], digest_size=HASH).digest() for a, b in zip(at, at[1:], strict=False)]
    if b"".join(found) != hashes or merkle(found) != root or width * at[-1] != len(payload):
        raise ValueError("a chunk or a document differs from its hash")
    return doc_id, start, n_tokens, payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()


def _alone(batches):
    for batch in batches:
        yield _transposed([_document(*r, {}) for r in zip(*(batch.column(i).to_pylist() for i in range(len(READ))), strict=True)], DOCUMENT)


NAMED, GIVEN = "row_key long, ord int, hash binary", "hash binary, part binary"


def _name(batches):
    """The chunks that documents refer to."""
    for batch in batches:
        rows = [(k, i, h[HASH * i : HASH * (i + 1)]) for k, f, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for i in _numbers(f)]
        yield _transposed(rows, NAMED)


def _give(batches):
    """The shared chunks of each document: hash and ids."""
    for batch in batches:
        rows = []
        for width, lengths, hashes, foreign, shared, payload in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            away, n, at = set(_numbers(foreign)), np.frombuffer(lengths, "<u4").tolist(), {}
            own = 0
            for i, k in enumerate(n):
                if i not in away:
                    at[i] = own
                    own += width * k
            rows += [(hashes[HASH * i : HASH * (i + 1)], payload[at[i] : at[i] + width * n[i]]) for i in _numbers(shared)]
        yield _transposed(rows, GIVEN)


def _together(batches):
    """Documents and the chunks they name, sorted by row: chunks come before their document."""
    key, parts = None, {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["row_key"] != key:
                key, parts = r["row_key"], {}
            if r["root"] is None:
                parts[r["ord"]] = r["part"]
            else:
                rows.append(_document(*(r[c] for c in READ), parts))
        yield _transposed(rows, DOCUMENT)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _digested(run):
    """`run` with the crc32 of the ids in their place."""

    def inner(batches):
        for b in run(batches):
            yield _batch([*b.columns[:3], [crc32(x) for x in b.column(3).to_pylist()]], DIGEST)

    return inner


def read_store(spark, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit; with `digest` their ids_crc32 instead) of every document, each rebuilt and verified."""
    shape, told = (DIGEST, _digested) if digest else (DOCUMENT, lambda run: run)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    packs = spark.read.schema(PACKED).parquet(f"{folder}/packs")
    manifest = spark.read.parquet(f"{folder}/manifest")
    found = _pack_roots(packs).withColumnRenamed("root", "found")
    if not manifest.join(found, ["pack", "documents"], "full").where(~F.col("root").eqNullSafe(F.col("found"))).isEmpty():
        raise ValueError("a pack differs from the manifest")
    whole = F.length("foreign") == 0
    alone = packs.where(whole).select(*READ).mapInArrow(lean(told(_alone)), shape)
    rest = packs.where(~whole)
    named = rest.select("row_key", "foreign", "hashes").mapInArrow(lean(_name), NAMED)
    given = packs.where(F.length("shared") > 0).select("width", "lengths", "hashes", "foreign", "shared", "payload").mapInArrow(lean(_give), GIVEN)
    parts = named.join(given, "hash").select("row_key", "ord", "part")
    both = parts.unionByName(rest.select("row_key", *READ), allowMissingColumns=True).repartition("row_key").sortWithinPartitions("row_key", F.col("root").isNotNull())
    return alone.unionByName(both.mapInArrow(lean(told(_together)), shape))


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/kinmatch/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), folder)
    return read_store(spark, folder, digest=True)
