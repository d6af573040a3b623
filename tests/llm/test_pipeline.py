"""The pipeline's stages take effect one after the other."""

import ctypes
import re
from pathlib import Path

import corpus_pipeline
from conftest import SF

from weir.llm import simhash


def test_odd_rows_in_every_stage(spark):
    """Nulls, empty, repeated and very long texts, clashing columns and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in corpus_pipeline.keep_good(spark, docs.limit(40), SF).limit(6).collect()]
    assert len(good) == 6
    rows = [(None, good[0], None), (1, good[0], "a"), (2, None, "a"), (2, None, "a"), (3, "", None), (4, good[1], "b"), (4, good[2], "b"), (4, good[2], "b"), (5, good[3] + " and so on" * 30_000, "b"), (6, good[4], "c")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "'en' AS lang", "length(text) AS n_chars", "1.5D AS score", "'x' AS quality_score", "'x' AS toxicity_score", "7L AS fp", "8 AS size", "9 AS shard", "array(1) AS pieces", "'k' AS __fp"
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if stage is not corpus_pipeline.to_pieces:
            assert out.columns == odd.columns, name
        got = out.collect()
        if name == "simhash near-dedup":
            assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, good[0]), (2, ""), (4, good[1]), (4, good[2]), (5, rows[8][1]), (6, good[4])])
        if name == "mixing sources":
            assert {r.text for r in got} <= {r[1] for r in rows if r[1]} and all(r.fp == 7 and r.pieces == [1] for r in got)
        if name == "sentencepiece":
            assert len(got) == len(rows) and all(r.exact for r in got)
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_pipeline(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == first.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if name.startswith("simhash"):
            again = simhash.simhash_groups(docs)
            assert again.select("component_id").distinct().count() == again.count()
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] == counts[5]
    assert docs.where("not exact").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == counts[5]
    assert corpus_pipeline.ORACLE_SQL is None


def test_driver_hands_back_unused_memory(spark):
    """What is freed in pieces stays with the process; a stage hands it back, in the driver's Python and in its JVM."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.to_pieces(spark, docs, SF)
    size, n, sparse = 100_000, 2_000, 100
    jvm = spark._jvm
    held = lambda pid: int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) * 1024

    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)

    def touched(take, fill):
        out = [take(size) for _ in range(n)]
        for x in out:
            fill(x)
        return out

    mine = touched(libc.malloc, lambda x: ctypes.memset(x, 1, size))
    theirs = touched(unsafe.allocateMemory, lambda x: unsafe.setMemory(x, size, 1))
    for i in range(n):
        if i % sparse:
            libc.free(mine[i])
            unsafe.freeMemory(theirs[i])
    pids = ["self", jvm.java.lang.ProcessHandle.current().pid()]
    before = [held(p) for p in pids]
    corpus_pipeline.to_pieces(spark, docs, SF)
    after = [held(p) for p in pids]
    for i in range(0, n, sparse):
        libc.free(mine[i])
        unsafe.freeMemory(theirs[i])
    assert all(b - a > size * n // 2 for b, a in zip(before, after)), (before, after)
