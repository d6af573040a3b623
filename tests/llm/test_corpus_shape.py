"""Mixing and sharding: exact totals, laws and reruns."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from weir.llm import mixing, sharding


def water(sizes, weights, cap):
    """Targets by resharing the excess until none is above."""
    total, out, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / w for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def corpus(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        src = "hot" if i % 3 == 0 else None if i % 50 == 1 else "s%d" % (i % 5)
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 29 else None, src))
    rows += [(3, rows[3][1], rows[3][2])] * 2 + [(None, "a b c", "s1"), (900, "only", "tiny")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark):
    rows, df = corpus(spark)
    got = mixing.mix(df, shards=8, blocks=200).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, water([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], 3)))
    taken, held = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        for p in r.pieces:
            held[p.shard] += p.last - p.first
            assert 0 <= p.first < p.last <= r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    assert len(held) == 8 and max(held.values()) - min(held.values()) <= 0.1 * sum(held.values()) / 8 + 50
    again = mixing.mix(df, shards=8, blocks=200).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    pieces = mixing.mix_pieces(mixing.mix(df, shards=8, blocks=200))
    assert pieces.agg(F.sum(F.col("last") - F.col("first"))).first()[0] == sum(taken.values())


def hashes(spark, form, rows):
    """Spark's xxhash64 of small tuples; the only thing the plain mix takes from Spark."""
    names = [f"c{i}" for i in range(len(form))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, form)))
    return {tuple(r)[:-1]: r.h for r in df.select(*names, F.xxhash64(*names).alias("h")).collect()}


def plain_tree(spark, counts, levels, seed):
    """The splitting tree by exact fractions."""
    from fractions import Fraction
    from math import comb

    at = hashes(spark, ["long", "int", "int", "int"], [(seed, lv, sh, i) for lv in range(levels) for sh in range(1 << lv) for i in range(len(counts))])
    nodes = {0: counts}
    for level in range(levels):
        grown = {}
        for shard, c in nodes.items():
            left, n, d = [], sum(c), sum(c) // 2
            for i, m in enumerate(c):
                u = Fraction((at[seed, level, shard, i] & 9007199254740991) * 2 + 1, 2 * 9007199254740992)
                k, below = max(0, d - (n - m)), Fraction(0)
                while True:
                    below += Fraction(comb(m, k) * comb(n - m, d - k), comb(n, d))
                    if below >= u or k == min(m, d):
                        break
                    k += 1
                left.append(k)
                n, d = n - m, d - k
            grown[2 * shard], grown[2 * shard + 1] = left, [x - y for x, y in zip(c, left)]
        nodes = grown
    return nodes


def plain_mix(spark, rows, shards, blocks, seed, whole):
    """(doc_id, size, taken, shards of its pieces) of every row, by loops."""
    size = [len((t or "").split()) for _, t, _ in rows]
    h = hashes(spark, ["int", "long", "string"], [(seed, i, t) for i, t, _ in rows])
    sizes = Counter()
    for k, (_, _, s) in zip(size, rows):
        sizes[s] += k
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = water([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], 3)
    most = max(1, -(-sum(sizes.values()) // blocks))
    info = []
    for rank, s in enumerate(order):
        quota, width = min(round(target[rank]), 3 * sizes[s]), max(1, -(-sizes[s] // max(1, -(-sizes[s] // most))))
        mine = sorted((h[seed, rows[i][0], rows[i][1]], rows[i][0] is not None, rows[i][0] or 0, size[i], i) for i in range(len(rows)) if rows[i][2] == s)
        start, cut = 0, {}
        for *_, i in mine:
            if size[i] and whole:
                cut.setdefault(start // width, []).append((i, size[i]))
            else:
                for b in range(start, start + size[i]):
                    part = cut.setdefault(b // width, [])
                    if part and part[-1][0] == i:
                        part[-1] = (i, part[-1][1] + 1)
                    else:
                        part.append((i, 1))
            start += size[i]
        passes, n = (quota // sizes[s] if sizes[s] else 0), len(cut)
        rest = quota - passes * sizes[s]
        want = min(n, -(-rest * n // sizes[s])) if sizes[s] else 0
        info.append((passes, rest, cut, n, want))
    levels = shards.bit_length() - 1
    dealt = plain_tree(spark, [x[0] * x[3] for x in info] + [x[4] for x in info], levels, seed)
    spared = plain_tree(spark, [x[3] - x[4] for x in info], levels, seed + 1)
    out = [[0, []] for _ in rows]
    for rank, (passes, rest, cut, n, want) in enumerate(info):
        if not n:
            continue
        key = hashes(spark, ["int", "int", "int", "int", "long"], [(seed, 0, rank, t, b) for t in range(passes) for b in cut] or [(seed, 0, 0, 0, 0)])
        pairs = sorted(((t, b) for t in range(passes) for b in cut), key=lambda x: (key[seed, 0, rank, *x], x))
        for s in range(shards):
            mine, pairs = pairs[: dealt[s][rank]], pairs[dealt[s][rank] :]
            for _, b in mine:
                for i, k in cut[b]:
                    out[i][0] += k
                    out[i][1].append(s)
        assert not pairs
        key = hashes(spark, ["int", "int", "int", "long"], [(seed, 1, rank, b) for b in cut])
        pool, drawn = sorted(cut, key=lambda b: (key[seed, 1, rank, b], b)), []
        key = hashes(spark, ["int", "int", "int", "int", "long"], [(seed, 2, rank, s, b) for s in range(shards) for b in cut])
        for s in range(shards):
            c = dealt[s][len(info) + rank]
            mine, pool = pool[: c + spared[s][rank]], pool[c + spared[s][rank] :]
            mine.sort(key=lambda b: (key[seed, 2, rank, s, b], b))
            drawn += [(k >= c, k, s, b) for k, b in enumerate(mine)]
        assert not pool
        for _, _, s, b in sorted(drawn):
            for i, n in cut[b]:
                k = min(n, rest)
                rest -= k
                if k:
                    out[i][0] += k
                    out[i][1].append(s)
        assert rest == 0
    return Counter((rows[i][0], size[i], out[i][0], tuple(sorted(out[i][1]))) for i in range(len(rows)))


@pytest.mark.parametrize(("shards", "blocks", "seed", "whole"), [(8, 60, mixing.SEED, False), (2, 60, mixing.SEED, True), (4, 400, 5, False), (4, 400, 5, True)])
def test_mix_equals_a_plain_tree(spark, shards, blocks, seed, whole):
    rows, df = corpus(spark)
    got = mixing.mix(df, shards=shards, blocks=blocks, seed=seed, whole=whole).collect()
    assert Counter((r.doc_id, r["size"], r.taken, tuple(sorted(p.shard for p in r.pieces))) for r in got) == plain_mix(spark, rows, shards, blocks, seed, whole)


def test_seed_and_tree_decide_what_is_taken(spark):
    _, df = corpus(spark)
    took = lambda **o: Counter((r.doc_id, r.taken) for r in mixing.mix(df, **o).collect())
    one = took(shards=8, blocks=200)
    for other in (took(shards=2, blocks=200), took(shards=8, blocks=60), took(shards=8, blocks=200, seed=3)):
        assert other != one and sum(k * n for (_, k), n in other.items()) == sum(k * n for (_, k), n in one.items())


def test_mixed_documents_lie_by_shard(spark):
    rows, df = corpus(spark)
    df = df.where("doc_id <> 3").withColumn("doc_id", F.col("doc_id"))
    shard = {(r.doc_id, p.turn): p.shard for r in mixing.mix(df, shards=4, blocks=100, whole=True).collect() for p in r.pieces}
    of = {}
    for (i, _), s in shard.items():
        of.setdefault(i, set()).add(s)
    parts = {}
    for r in mixing.mixed_documents(df, whole=True, shards=4, blocks=100).withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r.part, []).append(r.doc_id)
    single = [[min(of[i]) for i in ids if len(of[i]) == 1] for ids in parts.values()]
    assert any(ids != sorted(ids) for ids in parts.values()) and all(s == sorted(s) for s in single)


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(corpus(spark)[1])


def test_tree_keeps_exact_counts(spark):
    root = spark.createDataFrame([([70, 0, 31, 1, 26],)], "counts array<bigint>")
    got = [r.counts for r in mixing.split_tree(root, 3).collect()]
    assert np.array(got).sum(axis=0).tolist() == [70, 0, 31, 1, 26] and {sum(c) for c in got} == {16}
    big = spark.createDataFrame([(list(range(400, 440)),)], "counts array<bigint>")
    left = [r.counts for r in mixing.split_tree(big, 1).collect()][0]
    assert sum(left) == sum(range(400, 440)) // 2 and abs(np.array(left) - np.arange(400, 440) / 2).max() < 60


def test_hypergeometric_draws_follow_the_distribution(spark):
    m, n, d = 6, 20, 9
    u = [(i + 0.5) / 2000 for i in range(2000)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    got = Counter(r.k for r in df.select(F.expr(mixing._draw(f"named_struct('m', {m}L, 'n', {n}L, 'd', {d}L, 'u', u)")).alias("k")).collect())
    from math import comb

    for k in range(m + 1):
        assert abs(got[k] / 2000 - comb(m, k) * comb(n - m, d - k) / comb(n, d)) < 2e-3


def test_mixed_documents_keep_columns(spark):
    rows, df = corpus(spark)
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit("clash"))
    out = mixing.mixed_documents(df, shards=4, blocks=100)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and r["size"] == "clash"
    plan = Counter()
    for r in mixing.mix(df, shards=4, blocks=100).collect():
        plan[r.source] += r.taken
    assert words == +plan


def test_pipeline_mixes_whole_texts_near_the_quota(spark):
    import corpus_pipeline

    rows = [(i, "\n".join(f"w{i}\t{k}" for k in range(5 + i % 40)), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.mix_sources(spark, df, None).collect()
    assert {(r.doc_id, r.text) for r in out} <= {(i, t) for i, t, _ in rows}
    cut = {(r.doc_id, r.text) for r in mixing.mixed_documents(df).collect()} - {(i, t) for i, t, _ in rows}
    assert cut
    words, plan, largest = Counter(), Counter(), Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    for r in mixing.mix(df).collect():
        plan[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(words[k] - plan[k]) <= largest[k] / 2 for k in plan)


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], none.schema)
    assert [(r.taken, r.target) for r in mixing.mix(empty).collect()] == [(0, 0.0)] * 2


def test_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(i if i % 3 else 7, "x" * int(rng.integers(0, 400)), "hot" if i % 2 else None, "en") for i in range(3000)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.kd_shards(df).collect()
    assert len(got) == len(rows)
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(size.values()) / 24
    assert max(abs(v - mean) for v in size.values()) < 500
    again = sharding.kd_shards(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_little(spark):
    schema = "doc_id long, text string, source string, lang string"
    assert sharding.kd_shards(spark.createDataFrame([], schema)).count() == 0
    one = sharding.kd_shards(spark.createDataFrame([(1, None, None, None)] * 3, schema)).collect()
    assert len(one) == 3 and all(r.size == 8 and r.text_crc32 == 0 for r in one)


def test_shards_of_extreme_ids_and_clashing_columns(spark):
    rows = [(i, "text %d" % (k % 7) * (k % 5), "mine", 1.0) for k, i in enumerate([-(2**63), 2**63 - 1, 0, None, -5] * 40)] + [(9, "long " * 400_000, "mine", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, weight double")
    for dims in (None, {"id": F.col("doc_id")}):
        got = sharding.kd_shards(df, 4, dims).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)


def test_splits_equal_plain_medians(spark):
    """Every split lies along the widest dimension and parts the bytes as wanted; equal texts are parted only where they weigh too much."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["ab", "cde", "éé", "f"], int(rng.integers(1, 80)))) for _ in range(700)]
    texts += [texts[int(i)] for i in rng.integers(0, 700, 900)] + ["hot " * 30] * 800
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scaled = sharding.scaled_rows(df)
    rows = [(r.xs, r.weight, r.u, texts[r.doc_id]) for r in scaled.collect()]
    tree, shard_of, _ = sharding.grow_tree(scaled, 4, 6)
    cut = set()

    def walk(node, some, k):
        if k == 1:
            return [(node, sum(w for _, w, _, _ in some))]
        dim, low, high, u = tree[node]
        extent = [max(x[d] for x, *_ in some) - min(x[d] for x, *_ in some) for d in range(4)]
        assert extent[dim] == max(extent)
        right = [x[dim] >= high or x[dim] >= low and v >= u for x, _, v, _ in some]
        left, rest = [r for r, b in zip(some, right) if not b], [r for r, b in zip(some, right) if b]
        want, has = sum(w for _, w, _, _ in some) * (k // 2) / k, sum(w for _, w, _, _ in left)
        assert abs(want - has) <= 0.011 * sum(w for _, w, _, _ in some) / k + 500
        cut.update({t for *_, t in left} & {t for *_, t in rest})
        return walk(2 * node, left, k // 2) + walk(2 * node + 1, rest, k - k // 2)

    leaves = walk(1, rows, 6)
    assert [shard_of[n] for n, _ in leaves] == list(range(6)) and "hot " * 30 in cut and len(cut) <= 5
    got = {r.doc_id: r.shard for r in sharding.kd_shards(df, 6).collect()}
    size = Counter()
    for i, t in enumerate(texts):
        size[got[i]] += len(t.encode()) + 8
    assert [size[i] for i in range(6)] == [w for _, w in leaves]


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (mixing.mix(docs), sharding.kd_shards(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
