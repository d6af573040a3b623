"""SimHash and embedding groups against brute force, with empty, null, repeated and clashing input."""

import numpy as np
import pytest
import xxhash
from conftest import SF, same

from weir.llm import embeddings, registry, simhash
from weir.llm.graph import components


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


TEXTS = ["", None, "one", "one two", "One  TWO", "a b c d e f g", "A b c\td e f g", "\xa0é ü ß", "x " * 5000]


def test_fingerprints_and_groups(spark):
    rng = np.random.default_rng(1)
    words = ["w%d" % i for i in range(50)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(12)]
    docs = TEXTS + base + [b + " w1" for b in base] + base[:3]
    rows = list(enumerate(docs))
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [slow_fingerprint(t) for t in docs]
    assert [got[i].fp & (2**64 - 1) for i in range(len(docs))] == fps
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert [got[i].component_id for i in range(len(docs))] == classes(len(docs), links)


@pytest.mark.parametrize("shard", [4, 16_384])
def test_links_of_crowded_fingerprints(spark, shard):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 5)
    fps = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (40, 2))} | {0, 2**62 + 5})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(df, 2, shard)).collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = classes(len(fps), links)
    assert [roots.get(f, f) for f in fps] == [fps[w] for w in want]


def test_bk_tree_keys_and_radius():
    values = np.array(np.random.default_rng(3).integers(0, 2**16, 300), dtype=np.uint64)
    tree = simhash.BKTree(values)
    for node in range(300):
        for d, kid in enumerate(tree.kids[node]):
            assert kid < 0 or (int(tree.values[node]) ^ int(tree.values[kid])).bit_count() == d
    got = {(int(a), int(b)) for q, i in tree.within(values, 3) for a, b in zip(q, i)}
    assert got == {(a, b) for a in range(300) for b in range(300) if (int(values[a]) ^ int(values[b])).bit_count() <= 3}


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(1, "a b c d", "x"), (2, "A b c d", "y"), (3, "other text here now", "z"), (3, "other text here now", "z"), (None, "a b c d", "n"), (None, "lonely words of none", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.dedup(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "lonely words of none"), (1, "a b c d"), (3, "other text here now")]


def test_dedup_keeps_unrelated_texts_of_one_id(spark):
    texts = {"one": "alpha beta gamma delta epsilon zeta", "two": "red orange yellow green blue indigo violet", "three": "do re mi fa so la ti do"}
    rows = [(7, texts["one"], 1), (7, texts["two"], 2), (2, texts["two"], 3), (7, texts["three"], 4), (7, texts["three"], 5), (None, texts["one"].upper(), 6), (None, "nobody's own words stand here", 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for how in ({}, {"size": 5, "similarity": 0.8}):
        got = sorted((r.doc_id or 0, r.text or "") for r in simhash.dedup(df, **how).collect())
        assert got == sorted([(7, texts["one"]), (2, texts["two"]), (7, texts["three"]), (0, "nobody's own words stand here"), (0, "")])


def test_empty_tables(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(101)}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(scale=0.25, size=16)
        rows.append([i, [float(np.float32(x)) for x in v], i % 2])
    rows[5][1], rows[11][1], rows[17][1] = rows[3][1], rows[3][1], [x * 2 for x in rows[3][1]]
    rows[3][2] = rows[5][2] = rows[11][2] = rows[17][2] = 1
    odd = [[300, None, 1], [301, [0.0] * 16, 1], [302, [1.0, None] + [0.0] * 14, 1], [303, [float("nan")] * 16, 1], [304, rows[3][1], None], [305, [1.0, 2.0], 1], [306, [2.0, 4.0], 1], [307, [float("inf")] * 16, 0], [308, [], 0]]
    rows += odd
    ok = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links.append((i, j))
    want = classes(len(rows), links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=16).collect()}
    assert len(got) == len(rows) and links
    for k, r in enumerate(rows):
        g = got[r[0]]
        assert (g.n_links, g.component_id, g.kept) == (sum(k in pair for pair in links), rows[want[k]][0], want[k] == k), r[0]


def test_repeated_vec_ids_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]


def test_queries_with_sql(spark, duck):
    for name, sql in registry.oracle_sql().items():
        assert same(registry.queries()[name](spark, SF), duck, sql) > 0


def test_similar_texts_of_five_words_equal_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    docs = [" ".join("w%d" % x for x in rng.integers(0, 400, int(rng.integers(30, 300)))) for _ in range(40)]
    for text in docs[:30]:
        w = text.split()
        for _ in range(3):
            at = int(rng.integers(0, len(w)))
            w[at : at + 1] = ["edit%d" % at] * int(rng.integers(0, 3))
        docs.append(" ".join(w))
    docs += ["", None, "one two", "One  two", docs[0].upper(), docs[0]]
    words = [(t or "").lower().split() for t in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = classes(len(docs), links)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for size in (2048, 1):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, 0.8, 5, cluster_size=size).collect()}
        assert [got[i] for i in range(len(docs))] == want
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect())
    assert kept == sorted(set(want)) and len(kept) < simhash.dedup(df).count()
    nameless = spark.createDataFrame([(None, docs[0]), (None, docs[0].upper()), (None, "lonely"), (5, docs[1])], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, nameless, SF).count() == 3


def test_clusters_hold_hashes_and_texts_come_in_small_pieces():
    import pyarrow as pa

    from weir.llm import simhash

    words = [f"w{i}" for i in range(30_000)]
    long = " ".join(words)
    rows = {"cluster": [1, 1, 1, 2], "shard": [0] * 4, "key": [5, 6, 7, 8], "member": [True] * 4, "text": [long, long + " more", " ".join(words[::-1]), "alone"]}
    got = [r for b in simhash._confirmed(5, 24, 0.8)(iter([pa.RecordBatch.from_pydict(rows)])) for r in b.to_pylist()]
    assert [sorted(r.values()) for r in got] == [[5, 6]]

    seen, many = [], pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [long] * 40})  # 7 MB
    for batch in simhash._fingerprints(3)(iter([many])):
        seen.append(batch.num_rows)
    assert sum(seen) == 40 and max(seen) * len(long) <= 2 << 20
