"""Token-ID output: Parquet files with a list column of ids, in ascending document order.

Texts are dealt out by ranges of ``doc_id``, sorted and encoded in place, and written by Spark's own Parquet
writer: dictionary pages for ids (delta encoding, format version 2, where the dictionary grows too large), row groups
of a set size, small pages, and the page indexes the writer adds. ``n_tokens`` and the offset in the part lie
in columns of their own, so metadata are read without ids, and a filter on ``doc_id`` reads only the pages
that hold it. Spark's commit protocol keeps each attempt of a task apart, so a lost executor leaves no half-written part.

Every document's ids end with ``END``. Defined results: null text counts as empty and gives the end id alone; rows with
equal or null ids are kept (nulls first, equal ids in the order of their texts); an empty table gives no rows.
The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm._shared import give_back, lean_batches, offsets, scratch_path, worker_cache
from weir.llm.segments import CachedEncoder, ColumnEncoder
from weir.session import ship

END = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 2_000
PIECE = 4 << 20  #: bytes of text that are encoded at once; a piece takes some thirty times that while it is numbered
#: Fixed value: where byte-level tokenizers of this family cut a text before they merge.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _kind(tokenizer) -> str:
    """The narrowest type that holds all ids."""
    return "<u2" if tokenizer.get_vocab_size() <= 65_536 else "<u4"


def _encoder(path: str) -> CachedEncoder:
    held = worker_cache("tokenizers")
    if path not in held:
        from tokenizers import Tokenizer

        held[path] = Tokenizer.from_file(path)
    tokenizer = held[path]

    size = held.get((path, "sizes"))
    if size is None:  # in the byte-level alphabet a character stands for a byte
        size = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in tokenizer.get_vocab().items():
            size[i] = len(token)
        held[path, "sizes"] = size

    kind = _kind(tokenizer)

    def alone(some: list[str]) -> list[bytes]:
        parts = (some[at : at + 1000] for at in range(0, len(some), 1000))
        return [np.array(e.ids, dtype=kind).tobytes() for part in parts for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def encode(some: list[str]) -> list[bytes]:
        """Segments that begin with a space and end without one are encoded as one text and cut by their lengths in bytes."""
        joined = [i for i, s in enumerate(some) if s[0] == " " and not s[-1].isspace()]
        out = [b""] * len(some)
        for at in range(0, len(joined), 500):
            part = [some[i] for i in joined[at : at + 500]]
            ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=kind)
            ends = np.cumsum(size[ids])
            want = np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in part])
            cuts = np.searchsorted(ends, want)
            if cuts[-1] >= len(ends) or (ends[cuts] != want).any():
                got = alone(part)
            else:
                packed, to = ids.tobytes(), ((cuts + 1) * ids.itemsize).tolist()
                got = [packed[a:b] for a, b in zip([0, *to], to)]
            for i, ids_of in zip(joined[at : at + 500], got):
                out[i] = ids_of
        bare = [i for i, s in enumerate(some) if s.isalpha()]
        for at in range(0, len(bare), 500):  # words without a space before them, kept apart by a full stop each
            part = [some[i] for i in bare[at : at + 500]]
            ids = np.array(tokenizer.encode_batch_fast(["." + ".".join(part)], add_special_tokens=False)[0].ids, dtype=kind)
            ends = np.cumsum(size[ids])
            want = np.cumsum([1 + (len(s) if s.isascii() else len(s.encode())) for s in part])
            cuts, begins = np.searchsorted(ends, want), np.searchsorted(ends, np.r_[1, want[:-1] + 1])
            if cuts[-1] >= len(ends) or (ends[cuts] != want).any() or (ends[begins] != np.r_[1, want[:-1] + 1]).any():
                continue
            packed, width = ids.tobytes(), ids.itemsize
            for i, a, b in zip(bare[at : at + 500], (begins + 1).tolist(), (cuts + 1).tolist()):
                out[i] = packed[a * width : b * width]
        rest = [i for i, x in enumerate(out) if not x]
        for i, ids_of in zip(rest, alone([some[i] for i in rest])):
            out[i] = ids_of
        return out

    return CachedEncoder(f"ids of {path}", encode)


def _column_encoder(path: str) -> ColumnEncoder:
    whole, held = _encoder(path), worker_cache("tokenizers")
    tokenizer, size, kind = held[path], held[path, "sizes"], _kind(held[path])

    def joined(part: list[str], mark: str) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of some texts with ``mark`` before each, encoded as one and cut at their lengths in bytes; None where a token spans a cut."""
        text = mark + mark.join(part)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        begins = np.flatnonzero(raw == ord(mark))
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=kind)
        ends, want = np.cumsum(size[ids]), np.r_[begins[1:], len(raw)]
        cuts = np.searchsorted(ends, want)
        if len(begins) != len(part) or cuts[-1] >= len(ends) or (ends[cuts] != want).any():
            return None
        cuts = np.r_[0, cuts + 1]
        if mark == " ":  # belongs to the text
            return ids, np.diff(cuts)
        if (ends[cuts[:-1]] != begins + 1).any():
            return None
        return np.delete(ids, cuts[:-1]), np.diff(cuts) - 1

    def encode(keys: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words with a space before them are encoded as one text, words without one are kept apart by a full stop each."""
        spaced = [x for x in keys if x[0] != " " and not x[-1].isspace()]
        bare = [x for x in keys if x[0] == " " and x[1:].isalpha()]
        rest = [x for x in keys if x[0] != " " and x[-1].isspace() or x[0] == " " and not x[1:].isalpha()]
        for some, mark in ((spaced, " "), (bare, ".")):
            for at in range(0, len(some), 1000):
                part = some[at : at + 1000]
                got = joined(part if mark == " " else [x[1:] for x in part], mark)
                if got is None:
                    rest.extend(part)
                else:
                    yield part, *got
        if rest:
            got = whole.encode([x[1:] if x[0] == " " else " " + x for x in rest])
            yield rest, np.frombuffer(b"".join(got), dtype=kind), np.array([len(x) for x in got]) // np.dtype(kind).itemsize

    return ColumnEncoder(f"pieces of {path}", encode, _PARTS.findall, whole, kind)


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _column_encoder(path or vocabulary())
        part, start = TaskContext.get().partitionId(), 0
        for batch in lean_batches(batches, limit=PIECE):
            values, ends = encode(batch.column(1), END)
            n = np.diff(ends).astype(np.int64)
            starts = start + ends[:-1].astype(np.int64)
            start += int(ends[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(starts), pa.array(n), ids], names=["doc_id", "part", "part_start", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, out: str, path: str | None = None, row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES) -> str:
    """Encode all texts and write them to the folder ``out``; ``path`` is the tokenizer's file."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    laid = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = laid.mapInArrow(_encode(path), "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    options = {
        "compression": "zstd",
        "parquet.enable.dictionary": "true",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }
    coded.write.options(**options).mode("errorifexists").parquet(out)
    return out


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, part, part_start, n_tokens, ids. Select what is needed and filter on doc_id: both reach the files."""
    return spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").parquet(out)


def starts(files: DataFrame) -> DataFrame:
    """(part, before): ids of all parts before each; reads only the metadata columns."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return sums.select(F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        at = offsets(ids).astype(np.int64)
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])
    give_back()


def query(spark, sf_dir: str) -> DataFrame:
    """op4: write all documents as token files and describe each from the files."""
    from weir.session import table

    out = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))
    files = read_tokens(spark, out)
    rows = files.select("doc_id", "part", "part_start", "ids").mapInArrow(_checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    placed = rows.join(starts(files), F.col("part") == F.col("of_part"))
    return placed.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
