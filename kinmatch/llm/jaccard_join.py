"""N-gram Jaccard join by PartEnum signatures; exact at every size.

A document's set holds its distinct 5-word shingles. Sets A and B link when
their Jaccard similarity is at least 3/4, so that they differ in at most
K = floor((|A| + |B|) / 7) shingles. K is dealt over a grid of size bands; two
sets that can link both emit signatures in the band of their K.

Signatures are PartEnum's. Within a band of at most k differences the shingle
domain is split by hashing into G groups (a little more than k / 2) of three
partitions, and in each group every subset of two partitions is enumerated: a
signature is what a set holds in the two. A group with at most one spoiled
partition keeps a signature common to both sets, and k differences cannot
spoil two partitions of every group. D differences take away at most
2 D signatures while D <= G, and G + D beyond, so what two sets must share is
known from the number that each emits (empty ones are not emitted): fewer
shared ones, no candidate.

Signatures travel as packed arrays (7 bytes each) and meet in buckets, whose
number follows the data. At most COLD sets share a cold signature; more make it
hot. A set that shares with every partner more signatures than it has hot ones
is found by cold ones alone. All others (sets among many near copies, sets
built on much shared passages, and sets with so many empty signatures that
nothing is sure) are left to a second stage: they meet by prefixes of their
shingles, ordered from the rarest, and dealt over ranges of |A| + |B|, which
tell how many shingles a link must share. No group of a shingle is expanded
into all its pairs: its members are compared with its smallest one (a star),
the links found are merged into components, and only members of another
component than the smallest's meet the rest of the group.

Candidates are verified on the whole texts. Exact copies are reduced to one
representative first and get its component.

Nulls: null and empty texts, and texts without words, have an empty set and
link with nothing; rows with a null doc_id are told with a null component.
Rows of one doc_id are one vertex. Ties at exactly 3/4 link. An empty table
gives no row. Further columns are passed by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, clean_text, counted, drop_staged, give_back, lean, only, partitions, staged, table
from .components import components

WORDS = 5
COLD = 8
#: A band's k is this multiple of the one before.
RATIO = 1.4
#: Partitions of a group, and the subsets of them that are enumerated: any but one.
EACH, SUBSETS = 3, ((0, 1), (0, 2), (1, 2))
#: Ranges of |A| + |B| for prefixes end at this multiple of their start.
SUM_RATIO = 1.03
#: Signatures that meet in a bucket, about.
BUCKET = 500_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_STIR = np.uint64(0xFF51AFD7ED558CCD)


def _grid(most: int = 1 << 28) -> np.ndarray:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out)


GRID = _grid()


def shingles(text: str) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes of its shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64) if words else np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for j in range(WORDS):
        out += h[j : j + n] * _MULT[j]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return n, len(a) + len(b) - n


def bands(n: int) -> range:
    """Numbers of the bands in which a set of n shingles may meet another."""
    low, high = (n + (3 * n + 3) // 4) // 7, (n + 4 * n // 3) // 7
    return range(int(np.searchsorted(GRID, max(low, 1))), int(np.searchsorted(GRID, max(high, 1))) + 1)


def groups(k: int) -> int:
    """Groups of a band of at most k differences: k // 2 + 1 would do but for empty signatures."""
    return int(1.05 * (k // 2 + 1)) + 1


def lost(differences: int, k: int) -> int:
    """The most signatures that so many differences can take from a set in the band of k: two by a first one in a group, the last by a second."""
    return min(2 * differences, groups(k) + differences)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _STIR
    return x ^ (x >> np.uint64(29))


def signatures(s: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(band, signatures) of a set, for each of its bands; signatures of nothing are left out."""
    out = []
    for band in bands(len(s)):
        many = groups(int(GRID[band]))
        place = (((s >> np.uint64(32)) * np.uint64(many * EACH)) >> np.uint64(32)).astype(np.int64)  # ascending, as s is
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        held = np.zeros(many * EACH, np.uint64)
        held[place[first]] = np.add.reduceat(_stir(s + np.uint64(band)), first)
        full = np.zeros(many * EACH, bool)
        full[place[first]] = True
        held, full = held.reshape(many, EACH), full.reshape(many, EACH)
        value = np.stack([held[:, i] * _MULT[i] + held[:, j] * _MULT[j] for i, j in SUBSETS], 1)
        some = np.stack([full[:, i] | full[:, j] for i, j in SUBSETS], 1)
        tag = np.arange(value.size, dtype=np.uint64).reshape(value.shape) + np.uint64(band << 40)
        out.append((band, _stir(value + tag * _MULT[0])[some]))
    return out


PACKED = "bucket int, block long, sigs binary, entries binary, docs binary"
#: A set in a band: `most` is the band's k, `before` the one below it, `emitted` the number of its signatures.
ENTRY = np.dtype([("doc", "<i8"), ("h", "<i8"), ("c", "<i8"), ("l", "<i4"), ("n", "<i4"), ("before", "<i4"), ("most", "<i4"), ("groups", "<i4"), ("emitted", "<i4")])


def _pack(buckets: int):
    """Documents to packed signatures: rows by bucket, and the entries (document and band) of each block."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        entries, sigs, owner, size = [], [], [], 0

        def flush():
            nonlocal number, entries, sigs, owner, size
            block = (part << 24) + number
            number += 1
            sig, own = np.concatenate(sigs), np.repeat(np.arange(len(entries), dtype=np.uint16), owner)
            bucket = ((sig >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low = sig[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            own = own[order].astype("<u2")
            rows = [(b, block, low[i:j].tobytes(), own[i:j].tobytes(), None) for b, (i, j) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)) if i < j]
            rows.append((-1 - block % buckets, block, None, None, np.array(entries, ENTRY).tobytes()))
            entries, sigs, owner, size = [], [], [], 0
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for *key, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s = shingles(t)
                for band, found in signatures(s) if len(s) else ():
                    k = int(GRID[band])
                    entries.append((*key, len(s), int(GRID[band - 1]) if band else -1, k, groups(k), len(found)))
                    sigs.append(found)
                    owner.append(len(found))
                    size += len(found)
                    if size > 600_000 or len(entries) > 60_000:
                        yield flush()
        if entries:
            yield flush()

    return run


MET = "kind int, a long, b long, shared long, doc long, h long, c long, l int, n int, before int, most int, groups int, emitted int"
ENTRIES, PAIRS, HOT = range(3)


def _meet(cold: int):
    """One bucket: pairs of entries that share cold signatures, and the number of hot ones of each entry; or the entries of blocks."""
    names = dict(x.split() for x in MET.split(", "))
    arrow = {"int": pa.int32(), "long": pa.int64()}

    def table_of(kind: int, **cols) -> pa.Table:
        n = len(next(iter(cols.values())))
        cols["kind"] = np.full(n, kind)
        return pa.Table.from_arrays([pa.array(cols[c], arrow[t]) if c in cols else pa.nulls(n, arrow[t]) for c, t in names.items()], list(names))

    def run(tbl: pa.Table) -> pa.Table:
        bucket, block = tbl.column("bucket")[0].as_py(), tbl.column("block").to_numpy() << 16
        if bucket < 0:
            parts = [np.frombuffer(x, ENTRY) for x in tbl.column("docs").to_pylist()]
            e = np.concatenate(parts)
            entry = np.concatenate([np.arange(len(x)) for x in parts]) + np.repeat(block, [len(x) for x in parts])
            return table_of(ENTRIES, a=entry, **{c: e[c] for c in ENTRY.names})
        sig = np.zeros((sum(len(x) for x in tbl.column("sigs").to_pylist()) // 5, 8), np.uint8)
        sig[:, :5] = np.frombuffer(b"".join(tbl.column("sigs").to_pylist()), np.uint8).reshape(-1, 5)
        sig = sig.view("<u8").ravel()
        parts = [np.frombuffer(x, "<u2") for x in tbl.column("entries").to_pylist()]
        entry = np.concatenate(parts).astype(np.int64) + np.repeat(block, [len(x) for x in parts])
        order = np.argsort(sig, kind="stable")
        sig, entry = sig[order], entry[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        counts = np.diff(np.append(first, len(sig)))
        hot = np.repeat(counts > cold, counts)
        left, right = [], []
        for step in range(1, cold):
            same = np.flatnonzero((sig[step:] == sig[:-step]) & ~hot[step:])
            left.append(np.minimum(entry[same], entry[same + step]))
            right.append(np.maximum(entry[same], entry[same + step]))
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = table_of(PAIRS, a=a, b=b, shared=np.ones(len(a), np.int64))
        spoiled, many = np.unique(entry[hot], return_counts=True)
        del sig, entry, order, left, right
        give_back()
        return pa.concat_tables([pairs, table_of(HOT, a=spoiled, shared=many)])

    return run


KEY = ["h", "c", "l"]


def met(reps: DataFrame, cold: int = COLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b) by cold signatures, the sets (doc, h, c, l) left to the second stage, and the size n of each set (h, c, l). All staged."""
    arrow_batches(reps.sparkSession)
    chars = reps.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(4 * partitions(reps.sparkSession), int(chars) // 6 // BUCKET)  # about a signature a word
    packed = reps.select("doc_id", *KEY, "text").mapInArrow(lean(_pack(buckets)), PACKED)
    every = staged(packed.groupBy("bucket").applyInArrow(_meet(cold), MET), "partenum")
    entries = every.where(F.col("kind") == ENTRIES).select(F.col("a").alias("entry"), *ENTRY.names)
    spoiled = every.where(F.col("kind") == HOT).groupBy(F.col("a").alias("entry")).agg(F.sum("shared").alias("hot"))
    entries = staged(entries.join(spoiled, "entry", "left").na.fill(0, ["hot"]), "entries")

    shared = every.where(F.col("kind") == PAIRS).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("doc", "n", "emitted", "hot")]
    told = shared.join(entries.select(F.col("entry").alias("a"), "before", "most", "groups", *side("a")), "a")
    told = told.join(entries.select(F.col("entry").alias("b"), *side("b")), "b").withColumn("k", F.expr("(n_a + n_b) div 7"))
    told = told.where("before < k and k <= most and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    told = told.where("shared >= greatest(emitted_a - hot_a, emitted_b - hot_b) - least(2 * k, groups + k)")
    pairs = staged(told.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).where("a < b").distinct(), "cold-pairs")

    most = F.expr("least(most, (n + 4 * n div 3) div 7)")
    unsure = F.col("emitted") - F.col("hot") - F.least(2 * most, F.col("groups") + most) < 1
    left = staged(entries.where(unsure).select("doc", *KEY).distinct(), "left-over")
    sizes = staged(entries.groupBy(*KEY).agg(F.max("n").alias("n")), "sizes")
    for t in (every, entries):
        drop_staged(t)
    return pairs, left, sizes


def verify(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, inter, joint: the sizes of intersection and union of each of the staged pairs (a, b). Staged."""
    ids = staged(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = staged(only(reps, ids, ["doc_id"]).select("doc_id", "text"), "texts")
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    both = counted(pairs.select("a", "b")).join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, kept = None, None
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ta != last:
                    last, kept = ta, shingles(ta)
                rows.append((a, b, *linked(kept, shingles(tb))))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "inter", "joint"])

    out = staged(both.mapInArrow(lean(run), "a long, b long, inter long, joint long"), "verified")
    for t in (texts, ids):
        drop_staged(t)
    return out


LINK = "100 * inter >= 75 * joint"


def _range(total: Column) -> Column:
    """The number of the range that holds a sum |A| + |B|."""
    return F.floor(F.log(total) / float(np.log(SUM_RATIO)))


def prefixes(left: DataFrame, reps: DataFrame) -> DataFrame:
    """doc, n, token, range: the shingles by which the sets `left` over must meet, for each range of |A| + |B|.

    Two sets of S shingles together link if they share 3 S / 7 at least. With
    the shingles of either in one order, a link of sets of n shingles has one
    of the first n - 3 S / 7 + 1 in common.
    """

    def run(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            many = [len(s) for s in found]
            per = lambda c: np.repeat(batch.column(c).to_numpy(), many)
            token = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            for i in range(0, len(token), 500_000):
                cut = slice(i, i + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(per("doc_id")[cut], pa.int64()), pa.array(per("h")[cut], pa.int64()), pa.array(np.repeat(many, many)[cut], pa.int32()), pa.array(token[cut], pa.int64())],
                    ["doc", "h", "n", "token"],
                )

    sets = only(reps, left.withColumnRenamed("doc", "doc_id"), ["doc_id", *KEY]).select("doc_id", "h", "text")
    tokens = staged(sets.mapInArrow(lean(run), "doc long, h long, n int, token long"), "tokens")
    often = staged(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "often")
    # the shingles of a set from this one on, in the order: as many as it can still share; those of one set alone come first
    placed = tokens.join(often, "token").withColumn("later", F.row_number().over(Window.partitionBy("doc", "h").orderBy(F.desc("sets"), F.desc("token"))))
    least, most = F.expr("n + (3 * n + 3) div 4"), F.expr("least(n + 4 * n div 3, 7 * later div 3)")
    placed = placed.where(least <= most).withColumn("range", F.explode(F.sequence(_range(least), _range(most))))
    found = staged(placed.select("doc", "n", "token", "range"), "prefixes")
    for t in (tokens, often):
        drop_staged(t)
    return found


def set_links(cold: DataFrame, left: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links between sets, from what `met` returns. Staged."""
    rare = prefixes(left, reps)
    group = ["token", "range"]
    pivots = staged(rare.groupBy(group).agg(F.min(F.struct("doc", "n")).alias("p"), F.count("*").alias("sets")).where("sets > 1").select(*group, F.col("p.doc").alias("p"), F.col("p.n").alias("n_p")), "pivots")
    stars = rare.join(pivots, group).where("doc <> p and 4 * least(n, n_p) >= 3 * greatest(n, n_p)").select(F.col("p").alias("a"), F.col("doc").alias("b"))
    pairs = staged(cold.unionByName(stars).distinct(), "pairs")
    first = verify(pairs, reps)
    for t in (pairs, pivots):
        drop_staged(t)
    merged = components(first.where(LINK).select("a", "b"))

    labels = merged.select(F.col("vertex").alias("doc"), F.col("component").alias("label"))
    told = staged(rare.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc")), "told")
    homes = staged(told.groupBy(group).agg(F.min_by("label", "doc").alias("home"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(*group, "home"), "homes")
    mixed = staged(told.join(homes, group).select(*group, "doc", "n", "label", (F.col("label") != F.col("home")).alias("away")), "mixed")
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("doc", "n", "label", "away")]
    more = mixed.where("away").select(*group, *side("x")).join(mixed.select(*group, *side("y")), group)
    more = more.where(_range(F.col("n_x") + F.col("n_y")) == F.col("range")).where("label_x <> label_y and (not away_y or doc_x < doc_y) and 4 * least(n_x, n_y) >= 3 * greatest(n_x, n_y)")
    more = more.select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).distinct()
    more = staged(more.join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    second = verify(more, reps)
    out = staged(first.where(LINK).select("a", "b").unionByName(second.where(LINK).select("a", "b")), "links")
    for t in (rare, told, homes, mixed, more, first, second, merged):
        drop_staged(t)
    return out


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`."""
    text = clean_text("text")
    keyed = docs.select("doc_id", F.xxhash64(text).alias("h"), F.crc32(F.encode(text, "UTF-8")).alias("c"), F.length(text).alias("l"), text.alias("text"))
    base = staged(keyed.drop("text"), "texts-by-hash")
    same = staged(base.where("doc_id is not null and l > 0").groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "same")
    again = staged(base.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    repeated = not again.isEmpty()
    if repeated:
        keyed = reps = keyed.join(same.select(F.col("rep").alias("doc_id"), *KEY), ["doc_id", *KEY], "left_semi").dropDuplicates(["doc_id", *KEY])
    else:
        reps = only(keyed, same.select(F.col("rep").alias("doc_id")), ["doc_id"])
    cold, left, sizes = met(reps)
    links = set_links(cold, left, keyed)  # ids are of representatives from here on: no need to keep to their rows
    for t in (cold, left):
        drop_staged(t)
    if repeated:  # the texts of one id are one vertex
        links = links.unionByName(base.join(again, "doc_id").join(same.join(sizes, KEY), KEY).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b"))
    found = components(links).withColumnRenamed("component", "component_id")
    known = same.join(sizes, KEY).join(found.withColumnRenamed("vertex", "rep"), "rep", "left")
    known = staged(known.select(*KEY, "rows", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id")), "known")

    # texts that more rows hold than a partition should: fewer than there are partitions, so that they can be broadcast
    most = (same.agg(F.sum("rows")).first()[0] or 0) // partitions(docs.sparkSession)
    hot, others = F.broadcast(known.where(F.col("rows") > most).drop("rows")), known.where(F.col("rows") <= most).drop("rows")
    rows = base.where("doc_id is not null")
    out = rows.join(hot, KEY).unionByName(rows.join(hot, KEY, "left_anti").join(others, KEY, "left"), allowMissingColumns=True)
    out = out.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if repeated:
        own = found.join(again.withColumnRenamed("doc_id", "vertex"), "vertex").select(F.col("vertex").alias("doc_id"), F.col("component_id").alias("own"))
        out = out.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    return out.unionByName(count_shingles(docs.where("doc_id is null")).withColumn("component_id", F.lit(None).cast("long")))


def count_shingles(docs: DataFrame) -> DataFrame:
    """doc_id and n_shingles of every row of `docs`."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n = [len(shingles(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of linked documents, that of the smallest doc_id; all columns stay.

    Where ids are null or repeated, rows are joined by numbers of their own: then a row without an id is compared like
    any other (one with an id is kept before it), and of repeated rows one stays. Texts without words link with none;
    of these, equal ones of one doc_id are one.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        found = join_documents(docs)
        first = staged(found.where("doc_id = component_id").select("doc_id"), "firsts")
        return only(docs, first, ["doc_id"]).select(docs.columns)
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = join_documents(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnsRenamed({"doc_id": "_row", "component_id": "_group"})
    known = rows.select("_row", "doc_id", F.sha2("text", 256).alias("_text"))
    bare = F.expr("n_shingles = 0 and doc_id is not null")
    groups = found.join(known, "_row").groupBy(F.when(~bare, F.col("_group")), F.when(bare, F.struct("doc_id", "_text")))
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_first")).select("_first._row")
    return only(rows, staged(first, "firsts"), ["_row"]).select(docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
