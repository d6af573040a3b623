"""Embedding near-duplicates by an epsilon grid order join.

1. Equal vectors of a label form one class with a count, so a very common vector is one row.
2. Unit vectors are projected on leading principal directions (fitted on a bounded sample; they steer
   pruning only, never results). A cosine of ``threshold`` is a distance of epsilon = sqrt(2 - 2 threshold), and
   a projection never lengthens a distance.
3. Classes are sorted by label and grid cells (side epsilon) of the projections and cut into blocks, the sequence
   intervals. A pair of blocks is joined only if their boxes lie within epsilon; pairs are found by strips of the first
   direction, not by trying all.
4. Inside a pair the intervals are halved recursively, provably distant halves are skipped, and leaves are compared
   exactly in double precision. A pair of blocks gives link counts and a spanning forest, never all pairs.
5. Components come from checkpointed star rounds.

Defined results: only vectors of equal label and length are compared; a vector that is null, empty, zero or holds null
or non-finite components, or has a null label, links with nothing, is its own component and is kept; a null ``vec_id`` keeps its
row and counts as a partner, and takes the component's least id; repeated rows link with each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import durable
from weir.llm.graph import components
from weir.llm.simhash import merge_labels
from weir.session import ship

THRESHOLD = 0.93
DIRECTIONS = 8
BLOCK = 1024
LEAF = 128
SAMPLE = 4_000  #: vectors that the directions are fitted on, at most
_SLACK = 1e-9


def _valid() -> F.Column:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    v = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def directions(classes: DataFrame, most: int = SAMPLE, k: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """Leading principal directions for each vector length, from at most ``most`` vectors in hashed order."""
    got = classes.select("width", "vector").orderBy(F.xxhash64("cid"), "cid").limit(most).toArrow()
    out = {}
    widths = got.column("width").to_numpy()
    for w in np.unique(widths):
        u = _matrix(got.column("vector").filter(pa.array(widths == w)).combine_chunks(), int(w))
        centred = u - u.mean(axis=0)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        out[int(w)] = np.ascontiguousarray(vectors[:, ::-1][:, :k])
    return out


def _basis(held: dict[int, np.ndarray], width: int) -> np.ndarray:
    return held[width] if width in held else np.eye(width)[:, :DIRECTIONS]


def _project(basis, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for w in np.unique(widths):
                some = batch.filter(pa.array(widths == w))
                cells = np.floor(_matrix(some.column(4), int(w)) @ _basis(basis.value, int(w)) / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=["cid", "label", "width", "n", "vector", "cell"])

    return run


def _blocks(basis, size: int):
    names = ["block", "label", "width", "lo", "hi", "cids", "ns", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, key = TaskContext.get().partitionId() << 32, [], None

        def block():
            nonlocal made
            cids, ns, vectors = zip(*held)
            u = np.stack(vectors)
            y = u @ _basis(basis.value, key[1])
            made += 1
            row = [[made], [key[0]], [key[1]], [y.min(axis=0)], [y.max(axis=0)], [np.array(cids, "<i8").tobytes()], [np.array(ns, "<i8").tobytes()], [u.astype("<f8").tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            cids, labels, widths, ns = (batch.column(i).to_pylist() for i in range(4))
            flat, at = batch.column(4).flatten().to_numpy(zero_copy_only=False), 0
            for cid, label, width, n in zip(cids, labels, widths, ns):
                v = np.asarray(flat[at : at + width], dtype=np.float64)
                at += width
                if held and ((label, width) != key or len(held) >= size):
                    yield block()
                    held = []
                key = (label, width)
                v = v / np.abs(v).max()
                held.append((cid, n, v / np.sqrt(v @ v)))
        if held:
            yield block()

    return run


def _join(a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, same: bool, threshold: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b at or above the threshold; with ``same``, each pair once and none with itself."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        gap = np.maximum(0.0, np.maximum(ya[a0:a1].min(axis=0) - yb[b0:b1].max(axis=0), yb[b0:b1].min(axis=0) - ya[a0:a1].max(axis=0)))
        if gap @ gap > eps * eps + _SLACK:
            continue
        if max(a1 - a0, b1 - b0) <= LEAF:
            i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= threshold)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            todo += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
        else:
            mid = (b0 + b1) // 2
            todo += [(a0, a1, b0, mid), (a0, a1, mid, b1)]


def _pair_links(basis, threshold: float, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_block, b_block, width, a_ids, a_ns, a_vec, b_ids, b_ns, b_vec in zip(*(c.to_pylist() for c in batch.columns)):
                same = a_block == b_block
                a, b = (np.frombuffer(v, "<f8").reshape(-1, width) for v in (a_vec, b_vec))
                ids = [np.frombuffer(v, "<i8") for v in (a_ids, b_ids)]
                ns = [np.frombuffer(v, "<i8") for v in (a_ns, b_ns)]
                p = _basis(basis.value, width)
                shift = 0 if same else len(a)
                root = np.arange(len(a) + (0 if same else len(b)))
                links = np.zeros(len(root), dtype=np.int64)
                for i, j in _join(a, b, a @ p, b @ p, same, threshold, eps):
                    np.add.at(links, i, ns[1][j])
                    np.add.at(links, j + shift, ns[0][i])
                    merge_labels(root, i, j + shift)
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
                every = ids[0] if same else np.concatenate(ids)
                tied, counted = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[every[tied], every[counted]]),
                        pa.array([*every[root[tied]].tolist(), *[None] * len(counted)], pa.int64()),
                        pa.array([*[None] * len(tied), *links[counted].tolist()], pa.int64()),
                    ],
                    names=["a", "b", "n"],
                )

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label)."""
    spark = ship(embeddings.sparkSession)
    eps = float(np.sqrt(2 - 2 * threshold))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").withColumn("ok", _valid())
    classes = rows.where("ok").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = durable(classes.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("embedding").alias("width"), "n", F.col("embedding").alias("vector"), "least"))
    basis = spark.sparkContext.broadcast(directions(classes))
    base = "cid long, label long, width int, n long, vector {}".format(classes.schema["vector"].dataType.simpleString())
    placed = classes.select("cid", "label", "width", "n", "vector").mapInArrow(_project(basis, eps), base + ", cell array<int>")
    ordered = placed.repartitionByRange("label", "width", "cell").sortWithinPartitions("label", "width", "cell", "cid").drop("cell")
    blocks = durable(ordered.mapInArrow(_blocks(basis, block), "block long, label long, width int, lo array<double>, hi array<double>, cids binary, ns binary, vectors binary"))

    ends = blocks.select("block", "label", "width", "lo", "hi", F.floor(F.col("lo")[0] / eps).alias("first"), F.floor(F.col("hi")[0] / eps).alias("last"))
    left = ends.withColumn("strip", F.explode(F.sequence("first", "last"))).alias("l")
    right = ends.withColumn("strip", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1))).alias("r")
    gap = F.expr(
        "aggregate(zip_with(zip_with(l.lo, r.hi, (x, y) -> x - y), zip_with(r.lo, l.hi, (x, y) -> x - y), (x, y) -> greatest(0.0D, x, y)), 0.0D, (s, g) -> s + g * g)"
    )
    near = (
        (F.col("l.label") == F.col("r.label")) & (F.col("l.width") == F.col("r.width")) & (F.col("l.strip") == F.col("r.strip"))
        & (F.col("l.block") <= F.col("r.block"))
        & (F.col("l.strip") == F.greatest(F.col("l.first"), F.col("r.first") - 1))
        & (gap <= eps * eps + _SLACK)
    )
    pairs = left.join(right, near).select(F.col("l.block").alias("pa"), F.col("r.block").alias("pb"))
    a = blocks.select(F.col("block").alias("pa"), "width", F.col("cids").alias("a_ids"), F.col("ns").alias("a_ns"), F.col("vectors").alias("a_vec"))
    b = blocks.select(F.col("block").alias("pb"), F.col("cids").alias("b_ids"), F.col("ns").alias("b_ns"), F.col("vectors").alias("b_vec"))
    joined = pairs.join(a, "pa").join(b, "pb").select("pa", "pb", "width", "a_ids", "a_ns", "a_vec", "b_ids", "b_ns", "b_vec")
    found = durable(joined.mapInArrow(_pair_links(basis, threshold, eps), "a long, b long, n long"))

    links = found.where("n is not null").groupBy(F.col("a").alias("counted")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = classes.join(links, F.col("cid") == F.col("counted"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    known = known.select("label", F.col("vector").alias("embedding"), "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("label", "embedding", "n_links", "component_id")
    linked = rows.where("ok").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: links and components of all embeddings."""
    from weir.session import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
