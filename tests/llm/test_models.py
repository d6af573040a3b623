"""Classifiers and the language model: held-out accuracy, exact counts, odd input."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from weir.llm import language_model, quality, toxicity

SF1 = SF.replace("0.001", "0.1")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF1}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "k", "held", "least"), [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 3, 1, 0.97)])
def test_held_out_accuracy(spark, tables, module, label, k, held, least):
    docs, labels = tables
    model = module.train(docs, labels)
    got = module.score(docs.join(labels, "doc_id"), model).select("doc_id", label, "score").collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % k == held]
    assert all(0 <= r.score <= 1 for r in got)
    right = sum((r.score >= module.THRESHOLD) == (r[label] == 1) for r in out) / len(out)
    assert right >= least and len(out) > 300


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, tables, module):
    docs, labels = tables
    model = module.train(docs.limit(300), labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "word " * 200_000, 3.0)], "doc_id long, text string, extra double")
    got = module.score(odd, model).collect()
    assert len(got) == 4 and len({r.score for r in got if not r.text}) == 1
    assert module.score(odd.limit(0), model).count() == 0
    none = module.train(docs.limit(10), labels.where("doc_id < 0"))
    assert all(0 <= r.score <= 1 for r in module.score(odd, none).collect())


def test_filters_keep_columns(spark, tables):
    docs, labels = tables
    few = docs.where("doc_id < 400").selectExpr("*", "'mine' AS quality_score", "'mine' AS toxicity_score")
    for got in (quality.keep_good(few, labels), toxicity.keep_civil(few, labels)):
        assert got.columns == few.columns
        rows = got.collect()
        assert 0 < len(rows) < 400 and {r.quality_score for r in rows} == {"mine"}


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 500, 60)) for _ in range(200)]
    y = np.array([int((r < 20).sum() > (r > 480).sum()) for r in rows])
    model = quality.fit(rows, y)
    margin = np.array([model["wr"][r].sum() / np.sqrt(model["rr"][r].sum()) + model["bias"] for r in rows])
    assert ((margin > 0) == (y == 1)).mean() > 0.9 and model["slope"] > 0


def test_ngrams_of_long_texts_are_whole():
    mark = np.zeros(quality.DIMS, dtype=bool)
    a = quality.marked(b"ab" * 900_000 + b"zq!", mark)
    assert not mark.any()
    assert 256 + (ord("z") << 8 | ord("q")) in a and len(a) == len(quality.marked(b"ababab" + b"zq!", mark))


def features(text):
    arcs = {w: 3.0 for w in toxicity.INSULTS}
    return toxicity.clause_features(text, arcs, {"flib": 2.0}, toxicity.grammar())


def test_grammar():
    plain, aimed, negated, told = (features(t)[2] for t in ("an idiot here", "you are an idiot", "you are not an idiot", "he said the word idiot"))
    assert aimed > plain > negated > 0 and told < plain * 1.5
    assert features("we kill you now")[2] == toxicity.THREAT_WEIGHT and features("kill the lights")[2] == 0
    assert features('"idiot" he')[2] < plain and features("")[1] == features("idiotic")[1] == 0
    assert features("flibby")[2] == 2.0 and features("idiot. idiot. idiot")[0] > features("idiot")[0]


def plain_weights(text, reach=4):
    """Weights of the matches in one clause by plain rules, without automata."""
    words = text.split()
    out = []
    for i, w in enumerate(words):
        before = lambda kind, n: any(x in kind for x in words[max(0, i - n) : i])  # noqa: E731, B023
        weight = 0.0
        if w in toxicity.INSULTS:
            weight = 3.0 * (1.5 if before(toxicity.TARGETS, reach) else 1.0)
        elif w in toxicity.TARGETS and before(toxicity.THREATS, reach):
            weight = toxicity.THREAT_WEIGHT
        if weight:
            out.append(weight * (0.3 if before(toxicity.NEGATIONS, 4) else 1.0) * (0.5 if before(toxicity.REPORTS, 12) else 1.0))
    return out


def test_composition_equals_plain_rules():
    rng = np.random.default_rng(3)
    for _ in range(400):
        words = ["the", "lamp", "is", "a"] * 3
        # at most one insult or threat, so that no match uses up another's target
        for kind in rng.choice(["idiot", "kill", "not", "said", "you"], int(rng.integers(1, 4)), replace=False):
            words.insert(int(rng.integers(0, len(words))), str(kind))
        if "idiot" in words and "kill" in words:
            continue
        got, want = features(" ".join(words)), plain_weights(" ".join(words))
        late = "idiot" in words and "you" in words and 0 < words.index("you") - words.index("idiot") <= 4
        assert late or got[2] == pytest.approx(sum(want)), words


def test_paths_of_several_words_and_both_sides():
    machine = toxicity.grammar()
    score = lambda t, pairs=None: toxicity.clause_features(t, {w: 3.0 for w in toxicity.INSULTS}, {}, machine, toxicity.lexicon(pairs or {}))[2]
    assert score("you will be killed") == score("we kill you") == toxicity.THREAT_WEIGHT and score("the lights will be killed") == 0
    assert score("what a waste of space") == 3.0 and score("you are a waste of space") == 4.5 and score("waste of the space") == 0
    assert score("idiot that you are") == 3.0 + toxicity.AIM_WEIGHT and score("an idiot with a lamp and a chair and you") == 3.0
    assert score("flib flob", {("flib", "flob"): 2.0}) == 2.0 and score("flib a flob", {("flib", "flob"): 2.0}) == 0
    assert score("we will tear apart you all") == toxicity.THREAT_WEIGHT and score("we never kill you") == pytest.approx(0.3 * toxicity.THREAT_WEIGHT)
    assert score('"idiot. idiot" idiot') == 3.0 + 1.5  # quotation spans clauses, negation doesn't
    assert score("not. idiot") == 3.0


def test_near_copies_of_a_label_only():
    from weir.llm import _shared

    rng = np.random.default_rng(5)
    base = [rng.choice(4000, 400).astype(str) for _ in range(6)]
    half = [np.r_[b[:200], rng.choice(4000, 200).astype(str)] for b in base]  # half of the text is shared: not a near copy
    near = [np.r_[b[:390], rng.choice(4000, 10).astype(str)] for b in base]
    rows = [" ".join(t).encode() for t in base + half + near + near]
    keys = np.array([_shared.least_hashes(t).view(np.int64) for t in rows])
    kept = _shared.unlike(list(range(24)), [0] * 18 + [1] * 6, keys)
    assert kept == [*range(12), *range(18, 24)]


def test_repeated_labelled_ids_are_one_row(spark):
    from weir.llm import _shared

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "c")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0), (2, 1)], "label_id long, y int")
    assert sorted(map(tuple, _shared.sampled_texts(docs, sample).collect())) == [(0, "a", 1), (1, None, 2)]


def test_scores_refuse_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 2.0)], "doc_id long, text string, Score double")
    for module in (quality, toxicity):
        with pytest.raises(ValueError, match="score"):
            module.score(docs, {"share": 0.5})


def test_hinge_loss_is_the_least(spark):
    """Dual coordinate descent reaches the optimum that plain subgradient steps come near to."""
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.array([int(3 in r or 7 in r) for r in rows])
    values = [np.full(len(r), 1 / np.sqrt(len(r))) for r in rows]
    s, c = np.where(y == 1, 1.0, -1.0), np.where(y == 1, 30 / (y == 1).sum(), 30 / (y == 0).sum())
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = values[i], 1.0

    def loss(w):
        return 0.5 * w @ w + (c * np.maximum(0, 1 - s * (x @ w))).sum()

    w, bias = quality.dual_coordinate_descent(rows, values, y, epochs=300)
    found = loss(np.r_[w[:30], bias])
    v, best = np.zeros(31), np.inf
    for k in range(1, 60_000):
        live = s * (x @ v) < 1
        v = v - 2 / (k + 100) * (v - (c * s * live) @ x)
        best = min(best, loss(v)) if k % 50 == 0 else best
    assert found <= best * (1 + 1e-6) and best <= found * 1.02


def test_language_model_counts(spark):
    rng = np.random.default_rng(0)
    words = ["w%d" % i for i in range(40)] + ["the"] * 30
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(150)]
    docs += [(200, None), (201, "THE the\x0bThe"), (3, docs[3][1]), (None, "the unseen"), (5, "other text of id five"), (202, "never-seen-anywhere " * 3)]
    out = language_model.score_texts(spark.createDataFrame(docs, "doc_id long, text string"))
    got = out.collect()
    assert len(got) == len(docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in docs]
    for i, w in tokens:
        if not held(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_model.score_texts(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_of_nothing(spark):
    assert language_model.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_rows(two, one, softmax):
    """Weight rows of one factor, with Python integers."""
    mask = (1 << 64) - 1

    def scatter(x):
        x = ((x ^ x >> 31) * 0x9E3779B97F4A7C15) & mask
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & mask
        return x ^ x >> 32

    last, skipped, which = scatter(one + (1 << 33)), scatter(two + (2 << 33)), scatter(softmax + (3 << 33))
    return [scatter(f ^ which) % language_model.ROWS for f in (last, skipped, scatter((last * 3 + skipped) & mask))]


def plain_factors(two, one, word):
    """(softmax, outcome, rows) of one word."""
    m = language_model
    c, g, s = word % m.WIDTH, word // m.WIDTH % m.WIDTH, word // m.WIDTH**2 % m.WIDTH
    steps = [(0, c)] + ([(1 + c, g), (1 + m.WIDTH + c * m.WIDTH + g, s)] if c > m.END else [])
    return [(k, out, plain_rows(two, one, k)) for k, out in steps]


def test_words_hashes_and_order_by_columns():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    odd = [None, "", " ", "a", "  É a\tB\x0b\x0cé\r\n", "x\x1cy\x1fz \x00 \x85 \xa0 中文 🙂", "x" * 3000 + " Ab", "\n"]
    odd += ["".join(rng.choice(list("aB é\n\t'中🙂"), 30)) for _ in range(200)]
    for column in (pa.array(odd), pa.array(["skipped text", *odd]).slice(1), pa.array(odd, pa.large_string())):
        words, sizes = language_model._words(column)
        plain = [(t or "").encode().lower().split() for t in odd]
        flat = [w for t in plain for w in t]
        assert words.cast(pa.large_binary()).to_pylist() == flat and sizes.tolist() == [len(t) for t in plain]
        assert language_model.word_hashes(words).tolist() == [language_model.word_hash(w) for w in flat]
        assert language_model.word_hashes(words.slice(3, 20)).tolist() == [language_model.word_hash(w) for w in flat[3:23]]
    assert len(language_model.word_hashes(pa.array([], pa.binary()))) == 0 and language_model._words(pa.array([None], pa.string()))[1].tolist() == [0]
    for most in (3, 70_000, 1 << 32):
        x = rng.integers(0, most, 5000)
        assert (language_model._order(x) == np.argsort(x, kind="stable")).all()


def test_sequences_name_frequent_words_and_end_each_text():
    import pyarrow as pa

    texts = ["The b the", None, "", "c"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts), *[pa.array([0] * 4)] * 3], names=["doc_id", "text", "print", "held_out", "slice"])
    h, end = language_model.word_hash, language_model.END
    for heads, the in (([b"x", b"the"], 1), ([], h(b"the"))):
        (got,) = language_model._sequences(heads)(iter([batch]))
        assert [np.frombuffer(x, "<u4").tolist() for x in got.column("seq").to_pylist()] == [[the, h(b"b"), the, end], [end], [end], [h(b"c"), end]]


def plain_softmax(bias, w, softmax, rows):
    z = bias[softmax].astype(float) + sum(w[r].astype(float) for r in rows)
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(1)
    m = language_model
    bias = m.unigram_bias(rng.integers(0, 50, m.LEAVES).astype(float))
    w = rng.normal(size=(m.ROWS, m.WIDTH)).astype(np.float32)
    words = [m.word_hash(b"w%d" % i) for i in range(60)] + [0, 1, 2] * 5
    seqs = [np.array([*rng.choice(words, n), m.END], dtype="<u4").tobytes() for n in (0, 1, 2, 30, 400)]
    return bias, w, seqs


def contexts(seq):
    words = [language_model.START] * 2 + np.frombuffer(seq, "<u4").tolist()
    return list(zip(words, words[1:], words[2:]))


def test_scores_are_those_of_a_plain_walk(small_model, monkeypatch):
    bias, w, seqs = small_model
    monkeypatch.setattr(language_model, "PIECE", 7)
    extra = np.random.default_rng(2).normal(size=language_model.LEAVES)
    each, starts = language_model.log_probabilities(bias, w, extra, seqs)
    want = []
    for seq in seqs:
        for two, one, word in contexts(seq):
            p = [plain_softmax(bias, w, k, rows)[out] for k, out, rows in plain_factors(two, one, word)]
            want.append(sum(np.log10(p)) + extra[language_model.leaf(np.array([word]))[0]])
    assert np.allclose(each, want, atol=1e-4) and starts.tolist() == [0, 1, 3, 6, 37]


def test_an_update_is_that_of_plain_sums(spark, small_model):
    bias, w, seqs = small_model
    m = language_model
    seen, expected = np.zeros((m.ROWS, m.WIDTH)), np.zeros((m.ROWS, m.WIDTH))
    for seq in seqs:
        for two, one, word in contexts(seq):
            for k, out, rows in plain_factors(two, one, word):
                for r in rows:
                    seen[r, out] += 1
                    expected[r] += plain_softmax(bias, w, k, rows)
    df = m.ship(spark).createDataFrame([(bytearray(s),) for s in seqs], "seq binary").coalesce(1)
    got = {r.block: np.frombuffer(bytes(r.w), "<f4").reshape(m.BLOCK, m.WIDTH) for r in update(spark, df, bias, w).collect()}
    x = (seen - expected - m.RIDGE * w) / (expected + 2 * m.RIDGE)
    want = w + np.where(expected.any(axis=1)[:, None], np.where(x > 0, np.log1p(np.maximum(x, 0)), x) / m.FEATURES, 0)
    touched = set((np.flatnonzero(expected.any(axis=1)) // m.BLOCK).tolist())
    assert set(got) == touched
    for block, rows in got.items():
        assert np.allclose(rows, want[block * m.BLOCK : (block + 1) * m.BLOCK], atol=0.02)


def update(spark, df, bias, w):
    m = language_model
    model = spark.sparkContext.broadcast((bias, w))
    sums = df.mapInArrow(m._sums(model), "block int, part int, seen binary, expected binary")
    return sums.repartition("block").sortWithinPartitions("block", "part").mapInArrow(m._update(model), "block int, w binary")


def test_factors_sum_to_one(small_model):
    """Over classes, groups and subgroups that some words reach, after any two words."""
    bias, w, _ = small_model
    m = language_model
    one, two = np.full(m.LEAVES, 77, dtype=np.uint64), np.full(m.LEAVES, m.START, dtype=np.uint64)
    leaves = np.arange(m.LEAVES)
    c, g, s = leaves // m.WIDTH**2, leaves // m.WIDTH % m.WIDTH, leaves % m.WIDTH
    words = (c + m.WIDTH * g + m.WIDTH**2 * s)[(c > m.END) | (g + s == 0)].astype(np.uint64)
    total = np.zeros(len(words))
    for part, softmax, outcome, place, rows in m._pieces(two[: len(words)], one[: len(words)], words):
        got = np.log(m._softmax(bias, w, softmax, rows)[np.arange(len(outcome)), outcome])
        total[part] += np.bincount(place, weights=got, minlength=len(total[part]))
    assert np.exp(total).sum() == pytest.approx(1, abs=1e-3)


def test_language_model_learns_the_order_of_words(spark):
    """Words of equal frequency in a fixed order: the same words shuffled score far lower; base scores can't tell them apart."""
    rng = np.random.default_rng(6)
    words = ["k%d" % i for i in range(50)]
    at = [int(x) for x in rng.integers(0, 50, 600)]
    rows = [(i, " ".join(words[(a + j) % 50] for j in range(40))) for i, a in enumerate(at)]
    rows += [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows if zlib.crc32(str(1000 + i).encode()) % 7 == 2]
    got = {r.doc_id: r for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = [r.score - r.base_score for i, r in got.items() if i < 1000 and r.held_out]
    wrong = [r.score - r.base_score for i, r in got.items() if i >= 1000]
    assert min(right) > max(wrong) and np.mean(right) > 0


def test_quality_sigmoid_sees_every_fold_at_any_size(monkeypatch):
    rng = np.random.default_rng(8)
    seen = []
    monkeypatch.setattr(quality, "platt", lambda margins, y: seen.append((len(y), int((margins != 0).sum()))) or (1.0, 0.0))
    for n in (100, 1600):
        y = rng.integers(0, 2, n)
        quality.fit([np.unique(rng.integers(0, 50, 6) + 30 * k) for k in y], y)
    assert seen == [(100, 100), (1600, 1600)]


def test_a_hot_word_is_one_row_a_chunk(spark, monkeypatch):
    """Counts over many chunks and buckets, a word that is a third of all tokens, and clashing columns."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["hot"] * 20 + ["w%d" % k for k in range(40)], 50))) for i in range(400)]
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 2_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS seq", "2 AS print", "3 AS chunk").repartition(7)
    got = language_model.score_texts(df).collect()
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.split(), None])
    n, v, text = sum(c.values()), len(c), dict(rows)
    assert len(got) == 400
    for r in got:
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*text[r.doc_id].split(), None])) and r.n_known == 51


def test_quality_fit_holds_few_copies():
    """Fitting runs on the driver; besides the rows it holds one value a feature."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(quality.DIMS) < 0.06).astype(np.int32) for _ in range(500)]
    y = np.arange(500) % 2
    tracemalloc.start()
    model = quality.fit(rows, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "wr" in model and peak < 2 * sum(x.nbytes for x in rows), peak / sum(x.nbytes for x in rows)
