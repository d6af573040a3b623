"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\\x20\\x09-\\x0D]+"  #: a word of the contracts, as a SQL string literal


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weir-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` clashes with it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | Column) -> Column:
    """Number of words in a text; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_remainder(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


PIECE = 2 << 20  #: bytes of text that become Python objects at once; words of a text take more than ten times its size


def lean_batches(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where the text column passes ``limit`` bytes, so a task holds a bounded piece; free memory goes back after each full piece and at the end."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = offsets(batch.column(column))
        at = 0
        while at < n:
            to = at + 1
            if ends is not None:
                to = max(to, int(ends.searchsorted(ends[at] + limit, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at)
            if to < n:
                give_back()
            at = to
        del batch, ends
    give_back()


def give_back() -> None:
    """Hand memory that Arrow and the C library hold but don't use back to the system: Python workers live on from task to task and stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """``give_back`` on the driver, for its Python and its JVM: compilers and many threads leave the JVM's C heap in pieces that are free, but stay with the process."""
    from py4j.protocol import Py4JError

    give_back()
    jvm = spark.sparkContext._jvm
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        (invoke,) = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]  # the server's own class is closed to Py4J
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(beans, given)
    except Py4JError:  # a JVM without that command keeps its memory
        pass


def offsets(array: pa.Array):
    """Offsets of a string, binary or list array as numpy, honouring its slice."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) or pa.types.is_large_list(array.type) else np.int32
    buf = array.buffers()[1]
    if buf is None:
        return np.zeros(len(array) + 1, dtype=kind)
    return np.frombuffer(buf, dtype=kind)[array.offset : array.offset + len(array) + 1]


def texts(array: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null gives the empty text."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so reused workers keep what they learned."""
    home = sys.modules.setdefault("_weir_worker_cache", types.ModuleType("_weir_worker_cache"))
    return home.__dict__.setdefault(name, {})


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    """Join condition on equal columns, nulls equal too."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def with_prefix(
    df: DataFrame,
    groups: list[str],
    spread: Column,
    order: list[Column],
    amount: Column,
    name: str,
    total: str | None = None,
    rows_a_bucket: int = 2_000,
) -> DataFrame:
    """Add the exclusive running sum of ``amount`` inside each group, without one task for a hot group.

    Rows of a group are ordered by (bucket of ``spread``, ``order``). A group gets
    one bucket for every ``rows_a_bucket`` rows; buckets are summed first
    with a map-side combine, their sums are accumulated over the short bucket
    table, and only rows of one bucket are sorted together. The input is read
    three times, so callers pass a checkpointed table.
    ``total``: name of a further column with the group's sum.
    """
    g = [f"__g{i}" for i in range(len(groups))]
    base = df.withColumns({a: F.col(b) for a, b in zip(g, groups)} | {"__a": amount, "__s": spread})
    counts = base.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.sum("__a").alias("__t"))
    counts = counts.select(*[F.col(x).alias(x + "k") for x in g], F.ceil(F.col("__n") / rows_a_bucket).cast("long").alias("__b"), "__t")
    put = base.join(counts, null_safe([(F.col(x), F.col(x + "k")) for x in g]), "inner").drop(*[x + "k" for x in g])
    put = put.withColumn("__k", F.pmod(F.col("__s"), F.col("__b")))
    from pyspark.sql import Window as W

    sums = put.groupBy(*g, "__k").agg(F.sum("__a").alias("__c"))
    before = F.sum("__c").over(W.partitionBy(*g).orderBy("__k").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(x).alias(x + "k") for x in g], F.col("__k").alias("__kk"), F.coalesce(before, F.lit(0)).alias("__o"))
    on = null_safe([(F.col(x), F.col(x + "k")) for x in g]) & (F.col("__k") == F.col("__kk"))
    inner = F.sum("__a").over(W.partitionBy(*g, "__k").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    out = put.join(sums, on, "inner").withColumn(name, F.col("__o") + F.coalesce(inner, F.lit(0)))
    if total:
        out = out.withColumn(total, F.col("__t"))
    return out.select(*df.columns, name, *([total] if total else []))


def add_text_columns(docs: DataFrame, fn: Callable[[list[bytes]], dict], fields: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus those that ``fn`` computes from a list of whole texts.

    ``fields`` is a DDL list of new columns, none of which clashes with the input's. The
    rows pass through Arrow in bounded pieces, so nothing has to be joined back.
    """
    from pyspark.sql.types import StructType

    from weir.session import ship

    ship(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(fields).fields])
    at = docs.columns.index(text_col)
    new = schema.names[len(docs.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean_batches(batches, at, PIECE):
            got = fn(texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(got[n]) for n in new]], names=schema.names)

    return docs.mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, label: str, k: int, held: int, most: int) -> DataFrame:
    """At most ``most`` labelled ids whose crc32 remainder modulo ``k`` isn't ``held``, in hashed order; one label an id."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder("doc_id", k) != held))
    one = rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    one = one.select(F.col("doc_id").alias("label_id"), "y")
    return one.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(y, text, label_id) of the sampled ids, one row each (of repeated ids the least text); the sample's size is a parameter, so it may be broadcast."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    return rows.groupBy("label_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text", "label_id")


MIXINGS, BAND = 64, 2  #: least hashes of a text, and how many of them a band joins
ALIKE = 0.8  #: share of equal least hashes (an estimate of Jaccard similarity) from which a text counts as a near copy


def least_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """The least of a text's shingle hashes under each of several mixings."""
    import xxhash

    w = text.lower().split()
    shingles = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles), dtype=np.uint64, count=len(shingles))
    odd = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 | 1 for k in range(MIXINGS)], dtype=np.uint64)
    out = np.full(MIXINGS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192] ^ (h[at : at + 8192] >> np.uint64(29))
        np.minimum(out, (part[:, None] * odd).min(axis=0), out=out)
    return out


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean_batches(batches):
        keys = [least_hashes(t).view(np.int64) for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["copy_id", "y", "keys"])


def unlike(ids: list[int], y: list[int], keys: np.ndarray) -> list[int]:
    """The ids that stay: in order, each that isn't a near copy of one that stays with the same label."""
    bands: dict[tuple, list[int]] = {}
    kept = []
    for i in range(len(ids)):
        mine = [(y[i], k, keys[i, k : k + BAND].tobytes()) for k in range(0, keys.shape[1], BAND)]
        near = np.unique([j for b in mine for j in bands.get(b, ())]).astype(np.int64)
        if len(near) and ((keys[near] == keys[i]).mean(axis=1) >= ALIKE).any():
            continue
        kept.append(ids[i])
        for b in mine:
            bands.setdefault(b, []).append(i)
    return kept


def first_of_copies(rows: DataFrame) -> DataFrame:
    """Rows of a labelled sample (y, text, label_id) without near copies of a row that stays and has the same label.

    Only for learning: otherwise the words of a text that is copied a thousand times would look like words of its class.
    Candidates share a band of least hashes of three-word shingles and count from an estimated similarity of ``ALIKE``. The sample is bounded by a parameter,
    so its hashes (``MIXINGS`` numbers a row) are compared on the driver, in the order of hashed ids.
    """
    got = rows.select("label_id", "text", "y").mapInArrow(_hash_rows, "copy_id long, y int, keys array<long>")
    got = got.orderBy(F.xxhash64("copy_id"), "copy_id").toArrow()
    keys = got.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, MIXINGS)
    kept = unlike(got.column("copy_id").to_pylist(), got.column("y").to_pylist(), keys)
    stay = rows.sparkSession.createDataFrame(pa.table({"stay_id": pa.array(kept, pa.int64())}))
    return rows.join(F.broadcast(stay), F.col("label_id") == F.col("stay_id"), "left_semi")
