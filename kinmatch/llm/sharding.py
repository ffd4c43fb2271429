"""K-d tree sharding: units of equal text are split at distributed weighted medians.

A unit is all copies of one text. Only where they outweigh GRAIN of a shard,
more than near equal shards allow, they are dealt over pieces by doc_id. Its metadata dimensions are the logarithm of its size, a code of its
language and one of its source, each on a grid of 4096 steps. A node that must
hold k shards is cut at the weight floor(k/2)/k along its widest dimension
until it holds one; ties along the dimension are ordered by a hash, so that
every cut falls within one unit of its target. Medians are found by radix
refinement: aggregates over at most 65,536 bins a node, and only the cut of
each node (at most `shards` rows) comes to the driver.

Nulls: a null text weighs 8 bytes, and null languages and sources are a value
of their own. Repeated rows are units of one text. An empty table gives no
row. Further columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_text, gapless, staged, table

DIMS = ("k_size", "k_lang", "k_source")
#: A cut is a number of 44 bits: 12 of the dimension, 32 of the tie-breaking hash.
RADIX = ((28, 16), (14, 14), (0, 14))
#: Copies of one text weighing more than this share of a shard are dealt over pieces.
GRAIN = 0.1


@dataclass
class Node:
    first: int
    shards: int
    total: int
    path: list[tuple[str, bool, int]] = field(default_factory=list)

    def where(self) -> Column:
        cond = F.lit(True)
        for dim, left, cut in self.path:
            cond = cond & ((F.col(dim) < cut) if left else (F.col(dim) >= cut))
        return cond


def _numbered(nodes: list[Node]) -> Column:
    out = F.lit(None).cast("int")
    for i, node in reversed(list(enumerate(nodes))):
        out = F.when(node.where(), i).otherwise(out)
    return out


def _cuts(units: DataFrame, nodes: list[Node]) -> list[tuple[str, int, int]]:
    """For each node its widest dimension, the cut along it, and the weight left of the cut."""
    units = units.withColumn("node", _numbered(nodes)).where("node is not null")
    grid = [F.max(F.shiftright(d, 32)) - F.min(F.shiftright(d, 32)) for d in DIMS]
    wide = units.groupBy("node").agg(*[g.alias(f"w{i}") for i, g in enumerate(grid)]).collect()
    dims = {r.node: DIMS[max(range(len(DIMS)), key=lambda i: (r[f"w{i}"], -i))] for r in wide}
    key = F.lit(None).cast("long")
    for i, d in dims.items():
        key = F.when(F.col("node") == i, F.col(d)).otherwise(key)
    keyed = units.select("node", key.alias("key"), "weight")
    target = {i: n.total * (n.shards // 2) / n.shards for i, n in enumerate(nodes)}
    goal = F.create_map(*[x for i, t in target.items() for x in (F.lit(i), F.lit(float(t)))])
    prefix, before, chosen = dict.fromkeys(dims, 0), dict.fromkeys(dims, 0), {}
    for shift, bits in RADIX:
        inside, base = F.lit(False), F.lit(0).cast("long")
        for i in dims:
            if shift + bits < 44:
                inside = inside | ((F.col("node") == i) & (F.shiftright("key", shift + bits) == prefix[i]))
            else:
                inside = F.lit(True)
            base = F.when(F.col("node") == i, F.lit(before[i]).cast("long")).otherwise(base)
        bins = keyed.where(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("weight").alias("weight"))
        w = Window.partitionBy("node").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("weight").over(w) + base)
        hit = bins.where(F.col("upto") >= goal[F.col("node")])
        for r in hit.groupBy("node").agg(F.min(F.struct("bin", "upto", "weight")).alias("m")).select("node", "m.*").collect():
            prefix[r.node], before[r.node], chosen[r.node] = r.bin, r.upto - r.weight, r
    out = []
    for i in range(len(nodes)):
        if i not in dims:
            out.append((DIMS[0], 0, 0))
            continue
        r = chosen[i]
        over = r.upto - target[i] <= target[i] - (r.upto - r.weight)
        out.append((dims[i], r.bin + 1 if over else r.bin, r.upto if over else r.upto - r.weight))
    return out


def kd_leaves(units: DataFrame, shards: int) -> list[Node]:
    """The leaves, one for each shard, of the tree over `units` (weight and the columns of DIMS)."""
    total = units.agg(F.sum("weight")).first()[0] or 0
    level, leaves = [Node(0, shards, total)], []
    while level:
        leaves += [n for n in level if n.shards == 1]
        split = [n for n in level if n.shards > 1]
        level = []
        for n, (dim, cut, weight) in zip(split, _cuts(units, split) if split else [], strict=True):
            half = n.shards // 2
            level.append(Node(n.first, half, weight, [*n.path, (dim, True, cut)]))
            level.append(Node(n.first + half, n.shards - half, n.total - weight, [*n.path, (dim, False, cut)]))
    return leaves


def shard_documents(docs: DataFrame, shards: int = 24, grain: float = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of `docs`; shards are near equal in bytes."""
    text, code = clean_text("text"), lambda c: F.pmod(F.crc32(F.encode(F.coalesce(F.col(c), F.lit("\0")), "UTF-8")), F.lit(4096))
    base = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            code("lang").alias("lang"),
            code("source").alias("source"),
        ),
        "shard-base",
    )
    same = ["text_hash", "text_crc32", "size"]
    total = base.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, grain * total / shards)
    # at most shards / grain texts are that heavy, whatever the input: a bounded broadcast
    heavy = base.groupBy(*same).agg(F.sum("size").alias("all")).where(F.col("all") > most)
    heavy = heavy.select(*same, F.ceil(F.col("all") / most).alias("pieces"))
    base = base.join(F.broadcast(heavy), same, "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), "pieces"))).drop("pieces")
    unit = [*same, "piece"]
    tie = F.shiftrightunsigned(F.xxhash64(*unit), 32)
    grid = F.least(F.floor(F.log2("size") * 100), F.lit(4095))
    units = base.groupBy(*unit).agg(F.sum("size").alias("weight"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    units = staged(
        units.select(*unit, "weight", *[(F.shiftleft(d.cast("long"), 32) + tie).alias(k) for k, d in zip(DIMS, (grid, F.col("lang"), F.col("source")), strict=True)]),
        "shard-units",
    )
    shard = F.lit(None).cast("int")
    for leaf in kd_leaves(units, shards):
        shard = F.when(leaf.where(), leaf.first).otherwise(shard)
    placed = base.join(units.select(*unit, shard.alias("shard")), unit).select("doc_id", "size", "text_crc32", "shard")
    return gapless(staged(placed, "shard-placed"), "shard", ("doc_id", "text_crc32"), "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
