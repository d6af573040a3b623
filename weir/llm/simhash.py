"""SimHash near-duplicate groups, linked through BK-trees.

1. Every whole text becomes one 64-bit fingerprint (Arrow batches, xxHash in C,
   bit counts in numpy).
2. Distinct fingerprints, not documents, are linked: a group of exact copies is one row.
3. Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1``
   bit blocks, so each (block, value) bucket is searched by itself and no pair is lost.
   A bucket's fingerprints form a BK-tree whose children are keyed by their integer
   Hamming distance to the parent; a query follows only edges whose key lies within
   the radius of its own distance to the node.
4. Broadcasting every tree to every executor would grow with the data. Trees are sent
   only where they are asked for: a bucket of more than ``shard_size`` fingerprints is cut
   into shard trees of at most about that size, and the bucket's queries are sent to each of them.
   Before that, a crowded bucket is cut by the bits outside its block, again without losing a pair.
5. A bucket gives a spanning forest of its links (fewer links than fingerprints), never
   all pairs. Components come from checkpointed star rounds.

``dedup(..., similarity=s)`` joins texts whose sets of shingles have a Jaccard similarity of ``s`` or more. Such pairs lie too many
bits apart for bit blocks, so texts that share a band of least shingle hashes are put in one cluster, a cluster's fingerprints are
linked through a BK-tree of a wide radius, and each link is confirmed on the whole shingle sets before it counts.

Defined results: a null text counts as empty; empty texts have fingerprint 0 and link
with each other; a null ``doc_id`` keeps its row and fingerprint and takes its group's
least id, null if the group has none; repeated rows keep one output row each; empty tables give
empty results; columns of the input with clashing names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import PIECE, durable, give_back_driver, lean_batches, texts
from weir.llm.graph import components
from weir.session import ship

SEED = 42
WORDS_A_SHINGLE = 3
RADIUS = 2
SHARD_SIZE = 16_384
#: Bands of least hashes: a pair of Jaccard similarity j shares none of them with probability (1 - j ** BAND_ROWS) ** BANDS, 0.0002 at 0.8.
BANDS, BAND_ROWS = 36, 7
WIDE_RADIUS = 24  #: bits; pairs of similarity 0.8 lie 10 apart on average, with a deviation of 3
CLUSTER_SIZE = 2048  #: members of a tree of a cluster


def fingerprint(text: bytes, size: int = WORDS_A_SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean_batches(batches, limit=PIECE):
            fps = np.array([fingerprint(t, size) for t in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return run


class BKTree:
    """A BK-tree over 64-bit fingerprints; ``kids[node, distance]`` is a child or -1."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = np.empty(n, dtype=np.uint64)
        self.items = np.empty(n, dtype=np.int64)
        self.kids = np.full((n, 65), -1, dtype=np.int32)
        made, todo = 0, [(-1, 0, np.arange(n))]
        while todo:
            parent, edge, members = todo.pop()
            if not len(members):
                continue
            node, made = made, made + 1
            self.values[node], self.items[node] = values[members[0]], members[0]
            if parent >= 0:
                self.kids[parent, edge] = node
            rest = members[1:]
            far = np.bitwise_count(values[rest] ^ values[members[0]])
            for d in np.unique(far):
                todo.append((node, int(d), rest[far == d]))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) index pairs at most ``radius`` apart, in blocks of bounded size."""
        if not len(self.values):
            return
        step = max(16, 4_000_000 // len(self.values))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            node = np.zeros(len(q), dtype=np.int32)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int32)
                hit = d <= radius
                if hit.any():
                    yield q[hit], self.items[node[hit]]
                qs, ns = [], []
                for k in range(-radius, radius + 1):
                    e = d + k
                    ok = (e >= 0) & (e <= 64)
                    kid = self.kids[node[ok], e[ok]]
                    there = kid >= 0
                    qs.append(q[ok][there])
                    ns.append(kid[there])
                q, node = np.concatenate(qs), np.concatenate(ns)


def merge_labels(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by least index, in place: ``root`` stays a forest of pointers to smaller indexes."""
    while len(a):
        while True:  # both ends to their roots
            ra, rb = root[a], root[b]
            if (ra == a).all() and (rb == b).all():
                break
            a, b = ra, rb
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def forest(values: np.ndarray, members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among ``values`` found by querying all of them in the tree of ``members``."""
    root = np.arange(len(values))
    tree = BKTree(values[members])
    for q, item in tree.within(values, radius):
        item = members[item]
        new = q != item
        merge_labels(root, q[new], item[new])
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket, shard and fp; only the bucket at hand is held."""

        def links(cols, whole):
            bucket, shard, fp, member = cols
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (shard[1:] != shard[:-1])])
            last = len(bucket) if whole else starts[-1]
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for s, e in zip(starts, np.r_[starts[1:], len(bucket)]):
                if e <= last and e - s > 1:
                    x, y = forest(fp[s:e], np.flatnonzero(member[s:e]), radius)
                    a.append(x)
                    b.append(y)
            rest = [c[last:] for c in cols]
            return rest, pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[2] = cols[2].view(np.uint64)
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            held, found = links(held, False)
            yield found
        if held is not None and len(held[0]):
            yield links(held, True)[1]

    return run


def _blocks_of(value: Column, bits: int, parts: int) -> list[Column]:
    """The bits of a value in ``parts`` blocks."""
    out, at = [], 0
    for i in range(parts):
        width = bits // parts + (i < bits % parts)
        out.append(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Spanning links (a, b) of the graph that joins distinct fingerprints ``fp`` within ``radius`` bits.

    A bucket is one value of one bit block. The bits outside the block of a crowded bucket are cut into blocks again: two of its fingerprints within
    the radius agree on one of those too, so the bucket falls into smaller ones and no pair is lost. What is crowded even then is cut into shard trees.
    """
    parts, at = radius + 1, 0
    buckets = []
    for i, value in enumerate(_blocks_of(F.col("fp"), 64, parts)):
        width = 64 // parts + (i < 64 % parts)
        high = F.shiftleft(F.shiftrightunsigned("fp", at + width), at) if at + width < 64 else F.lit(0).cast("long")
        rest = high.bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << at) - 1)))
        bucket = F.xxhash64(F.lit(i), value)
        inner = [F.xxhash64(F.lit(i), value, F.lit(j), v) for j, v in enumerate(_blocks_of(rest, 64 - width, parts))]
        buckets.append(F.struct(bucket.alias("bucket"), F.array(*inner).alias("inner")))
        at += width
    rows = fps.select("fp", F.explode(F.array(*buckets)).alias("b")).select("fp", "b.*")

    def crowded(some):
        many = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_size)
        return many.select(F.col("bucket").alias("hot"), F.ceil(F.col("n") / shard_size).cast("int").alias("shards"))

    rows = rows.join(crowded(rows).select("hot"), F.col("bucket") == F.col("hot"), "left")
    rows = rows.select("fp", F.explode(F.when(F.col("hot").isNull(), F.array("bucket")).otherwise(F.col("inner"))).alias("bucket"))
    put = rows.join(crowded(rows), F.col("bucket") == F.col("hot"), "left").select("bucket", "fp", F.coalesce("shards", F.lit(1)).alias("shards"))
    put = put.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    put = put.select("bucket", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "fp", "own")
    put = put.select("bucket", "shard", "fp", (F.col("own") == F.col("shard")).alias("member"))
    return put.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard", "fp").mapInArrow(_bucket_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shard_size: int = SHARD_SIZE, size: int = WORDS_A_SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_fp and component_id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = durable(rows.mapInArrow(_fingerprints(size), "doc_id long, fp long"))
    firsts = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(fingerprint_links(firsts.select("fp"), radius, shard_size))
    classes = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("component_fp"))
    least = classes.groupBy("component_fp").agg(F.min("first_id").alias("component_id")).withColumnRenamed("component_fp", "least_fp")
    classes = classes.join(least, F.col("component_fp") == F.col("least_fp")).select(F.col("fp").alias("class_fp"), "component_fp", "component_id")
    return marked.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_fp", "component_id")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; a shorter text is one shingle."""
    import xxhash

    words = text.lower().split()
    shingles = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles)))


def set_key(hashes: np.ndarray) -> int:
    """One signed 64-bit key of a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED)).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes."""
    import xxhash

    odd = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(low), 4096):
        here = (low[at : at + 4096, None] * odd).min(axis=0)
        least = here if least is None else np.minimum(least, here)
    return np.array([xxhash.xxh64_intdigest(least[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), seed=k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def _marks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean_batches(batches, limit=PIECE):
            sets = [shingle_hashes(t, size) for t in texts(batch.column(1))]
            bands = pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([set_key(h) for h in sets], pa.int64()), bands], names=["doc_id", "print", "key", "bands"])

    return run


def _confirmed(size: int, radius: int, similarity: float):
    """Sorted rows (cluster, shard, key, member, text) -> spanning links (a, b) of each cluster's shard whose similarity was computed."""

    def links(keys: list[int], prints: list[int], sets: list[np.ndarray], member: list[bool]) -> tuple[list[int], list[int]]:
        fps = np.array(prints, dtype=np.uint64)
        root, a, b = list(range(len(keys))), [], []

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        members = np.flatnonzero(member)
        for qs, items in BKTree(fps[members]).within(fps, radius):
            for q, i in zip(qs.tolist(), members[items].tolist()):
                x, y = len(sets[q]), len(sets[i])
                if min(x, y) < similarity * max(x, y) or (p := find(q)) == (r := find(i)):
                    continue
                both = len(np.intersect1d(sets[q], sets[i], assume_unique=True))
                if both >= similarity * (x + y - both):
                    root[max(p, r)] = min(p, r)
                    a.append(keys[q])
                    b.append(keys[i])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            a, b = links(*map(list, zip(*rows.values()))) if len(rows) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        now, rows = None, {}
        for batch in lean_batches(batches, 4, PIECE):
            for cluster, shard, key, member, text in zip(*(c.to_pylist() for c in batch.columns[:4]), texts(batch.column(4))):  # a text is held as its hashes
                if (cluster, shard) != now:
                    yield flush(rows)
                    now, rows = (cluster, shard), {}
                rows[key] = (key, fingerprint(text, size), shingle_hashes(text, size), member)
        yield flush(rows)

    return run


def similar_groups(docs: DataFrame, similarity: float, size: int, radius: int = WIDE_RADIUS, cluster_size: int = CLUSTER_SIZE) -> DataFrame:
    """As ``simhash_groups``, with the key of the shingle set as ``fp``: groups of texts joined by a Jaccard similarity of ``similarity`` or more."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))
    marked = durable(rows.mapInArrow(_marks(size), "doc_id long, print long, key long, bands array<long>"))
    firsts = durable(marked.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("print", "doc_id")).alias("of")))
    banded = marked.dropDuplicates(["key"]).select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select(F.col("band").alias("shared"), "least")
    near = banded.join(shared, F.col("band") == F.col("shared")).where("key <> least").select("key", "least").distinct()
    clusters = durable(components(near).select(F.col("node").alias("key"), F.col("root").alias("cluster")))
    give_back_driver(docs.sparkSession)  # the rounds' plans were many
    shards = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / cluster_size).cast("int").alias("shards")).withColumnRenamed("cluster", "c")
    want = clusters.join(shards, F.col("cluster") == F.col("c")).join(firsts.select(F.col("key").alias("k"), "of"), F.col("key") == F.col("k"))
    want = want.select("cluster", "shards", "key", F.col("of.print").alias("p"), F.col("of.doc_id").alias("d"))
    put = rows.join(want, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")))
    put = put.select("cluster", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "key", (F.pmod(F.xxhash64("key"), F.col("shards"))).cast("int").alias("own"), "text")
    put = put.select("cluster", "shard", "key", (F.col("own") == F.col("shard")).alias("member"), "text")
    links = put.repartition("cluster", "shard").sortWithinPartitions("cluster", "shard").mapInArrow(_confirmed(size, radius, similarity), "a long, b long")
    roots = components(links)
    classes = firsts.join(roots, F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("root", "key").alias("component_fp"))
    least = classes.groupBy("component_fp").agg(F.min("first_id").alias("component_id")).withColumnRenamed("component_fp", "least_fp")
    classes = classes.join(least, F.col("component_fp") == F.col("least_fp")).select(F.col("key").alias("class_fp"), "component_fp", "component_id")
    return marked.join(classes, F.col("key") == F.col("class_fp")).select("doc_id", F.col("key").alias("fp"), "component_fp", "component_id")


def dedup(docs: DataFrame, radius: int | None = None, size: int = WORDS_A_SHINGLE, similarity: float | None = None) -> DataFrame:
    """The documents with one row of each group left: that of the least id (of such rows, that of the least fingerprint or key).

    With ``similarity``, groups are those of ``similar_groups`` over shingles of ``size`` words; else fingerprints of ``size`` words within ``radius`` bits.
    Rows are told apart by id and text, so unrelated texts that share an id, or have none, each stay.
    """
    if similarity is None:
        groups, mark = simhash_groups(docs, RADIUS if radius is None else radius, size=size), lambda t: fingerprint(t, size)
    else:
        groups, mark = similar_groups(docs, similarity, size, WIDE_RADIUS if radius is None else radius), lambda t: set_key(shingle_hashes(t, size)) & (1 << 64) - 1
    groups = durable(groups.select("doc_id", "fp", "component_fp", "component_id"))
    chosen = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_fp").agg(F.min("component_id").alias("__id"), F.min("fp").alias("__fp"))
    # an id whose rows lie in several groups says too little; those rows are found by their texts
    several = groups.groupBy("doc_id").agg(F.min("component_fp").alias("__a"), F.max("component_fp").alias("__b")).where("doc_id is null or __a <> __b")
    several = durable(several.select(F.col("doc_id").alias("__several")))
    plain = chosen.join(several, F.col("__id").eqNullSafe(F.col("__several")), "left_anti").select("__id")
    kept = docs.join(plain, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    if several.isEmpty():
        return kept
    body = docs.join(several, F.col("doc_id").eqNullSafe(F.col("__several")), "left_semi").select(F.struct(*docs.columns).alias("__row"), F.col("text").cast("string").alias("__text"))
    found = body.mapInArrow(_rows_with_mark(mark), body.select("__row").schema.add("fp", "long"))
    one = found.join(chosen, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left_semi")
    one = one.withColumn("__i", F.col("__row.doc_id")).dropDuplicates(["__i", "fp"])
    return kept.unionByName(one.select("__row.*"))


def _rows_with_mark(mark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean_batches(batches, limit=PIECE):
            fps = np.array([mark(t) for t in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["__row", "fp"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """op1: fingerprints and components of all documents."""
    from weir.session import table

    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
