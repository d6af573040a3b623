"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

A word's probability is P(class | context) times P(group | class, context) times P(subgroup | group, context) times the word's smoothed share of its subgroup.
Classes are the ``HEADS`` most frequent training words, one each, the end of a text, and ``TAILS`` classes by spelling for all other words; groups and subgroups
are digits of the word's hash. Each factor is a softmax over at most ``WIDTH`` outcomes with hashed features of the words themselves: the previous word, the word
skipped over, and both together. Without features the model is the unigram model, so a word never seen in training has a probability too.

1. Counting: each task cuts its texts into chunks and deals a chunk's distinct words out by a hash of the word, each once with its count. Where
   a word's rows meet, its exact training count is summed and goes back to every chunk that asked; the chunk, which kept which documents hold
   its words, makes their sums of log10(count + 1). So the commonest word is one row a chunk, and a task holds one bucket of words at a time.
2. Word hashes (four bytes a token) are written once, in ``UPDATES`` slices of documents by hash. Gradient updates are distributed: each takes the next slice with
   the weights broadcast; tasks sum observed and expected counts by weight row, blocks of rows meet in one task each, and the driver gathers the
   new weights. Every training token is used in exactly one update.
3. Scoring reads the hashes in sparse batches: a token looks up only the few weight rows that its features hash to.

The weight table has a fixed size (``ROWS`` by ``WIDTH``; features that hash to one row share it) and so have the subgroup totals. All else stays distributed, and counts cover all training texts.

Columns other than doc_id and text aren't read, whatever their names; an empty table gives an empty result; a text of any length is one row.
Defined results: null text counts as empty (its only token is the end); without training texts all base scores are 0;
rows with equal id and text share their scores and are all kept; null ids belong to the remainder of the empty text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import durable, id_remainder, lean_batches, null_safe, offsets, scratch_path
from weir.session import ship

BITS = 4
WIDTH = 1 << BITS  #: outcomes of a factor
HEADS, TAILS = 7, 8
END = HEADS  #: class of the end of a text
LEAVES = WIDTH**3  #: subgroups, counted by class, group and subgroup
START = 1 << 31  #: stands before a text, as context only
ROWS = 1 << 16  #: rows of the weight table that features hash to
BLOCK = 1 << 10  #: weight rows that travel together
FEATURES = 3
UPDATES = 8
RIDGE = 1.0
MOST = 8.0  #: largest size of a weight
PIECE = 16384  #: tokens scored at once
TASK_TOKENS = 4 << 20  #: tokens of a training task, which sends at most one table of sums
CHUNK_BYTES = 16 << 20
_COUNTED = "kind int, chunk long, key binary, a long, b long, blob binary, docs binary"
_NAMES = ["kind", "chunk", "key", "a", "b", "blob", "docs"]
_META, _COUNTS, _LEAF, _HEAD = range(4)  #: kinds of rows: a chunk's documents, its words' counts by bucket, totals of a subgroup, frequent words


def word_hash(word: bytes) -> int:
    """Hash of a word whose lowest ``BITS`` bits are its class by spelling: the last two bytes and whether the word is plain ASCII."""
    return zlib.crc32(word) & -WIDTH | HEADS + 1 + zlib.crc32(word[-2:] + (b"+" if word.isascii() else b"-")) % TAILS


@cache
def _spellings() -> np.ndarray:
    """Classes by spelling: of words that aren't plain ASCII and those that are, by their last two bytes, then words of one byte."""
    tails = [bytes((a, b)) for a in range(256) for b in range(256)] + [bytes((a,)) for a in range(256)]
    return np.array([[HEADS + 1 + zlib.crc32(t + mark) % TAILS for t in tails] for mark in (b"-", b"+")])


def word_hashes(words: pa.Array) -> np.ndarray:
    """``word_hash`` of a string or binary column of words, none of them empty."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    ends, raw = offsets(words).astype(np.int64), np.frombuffer(words.buffers()[2], dtype=np.uint8)
    whole = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(words))
    plain = np.maximum.reduceat(raw[: ends[-1]], ends[:-1]) < 0x80
    last, before = raw[ends[1:] - 1].astype(np.int64), raw[ends[1:] - 2].astype(np.int64)
    return whole & -WIDTH | _spellings()[plain.astype(np.int64), np.where(np.diff(ends) > 1, before * 256, 65_536) + last]


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of a column of texts, one after the other, and how many each text has; null has none."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    cut, flat = offsets(parts).astype(np.int64), parts.values
    full = np.diff(offsets(flat)) > 0  # white space around a text leaves empty ones
    return flat.filter(pa.array(full)), np.diff(np.r_[0, np.cumsum(full)][cut])


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 below 2 ** 32, in two rounds of 16 bits."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((x >> 16).astype(np.uint16)[low], kind="stable")]


def path(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, group and subgroup of hashed words; a class of one word has only the first of each."""
    words = words.astype(np.int64)
    low = WIDTH - 1
    tail = (words & low) > END
    return words & low, np.where(tail, words >> BITS & low, 0), np.where(tail, words >> 2 * BITS & low, 0)


def leaf(words: np.ndarray) -> np.ndarray:
    """Number of the subgroup of hashed words."""
    c, g, s = path(words)
    return (c * WIDTH + g) * WIDTH + s


def _deal(buckets: int):
    """Chunks of texts -> rows (bucket, chunk, words, train) and one meta row a chunk: its documents, their sizes, and how often (n) and where (docs) its words stand, in order of bucket and word."""
    names = ["bucket", "chunk", "words", "n", "train", "docs", "sizes", "ids", "prints", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for whole in lean_batches(batches, 1, CHUNK_BYTES):
            for at in range(0, whole.num_rows, 60_000):
                batch = whole.slice(at, 60_000)
                chunk += 1
                words, sizes = _words(batch.column(1))
                held = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
                rows = {k: [] for k in names}

                def add(bucket, words=b"", n=b"", train=b"", docs=b"", sizes=b"", ids=None, prints=None, held=None):
                    for k, v in zip(names, (bucket, chunk, words, n, train, docs, sizes, ids, prints, held)):
                        rows[k].append(v)

                every_n, every_doc = b"", b""
                if len(words):
                    coded = words.dictionary_encode()
                    unique, of = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
                    doc = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)
                    bucket = np.fromiter(map(zlib.crc32, unique), dtype=np.int64, count=len(unique)) % buckets
                    by = _order(bucket)
                    rank = np.empty(len(unique), dtype=np.int64)
                    rank[by] = np.arange(len(unique))
                    of = rank[of]
                    n = np.bincount(of, minlength=len(unique)).astype("<u4")
                    train = np.bincount(of[~held[doc]], minlength=len(unique)).astype("<u4")
                    doc = doc[_order(of)]
                    every_n, every_doc = n.tobytes(), doc.tobytes()
                    ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
                    ordered = [unique[i] for i in by]
                    for k in np.flatnonzero(np.diff(ends)):
                        s, e = ends[k], ends[k + 1]
                        add(int(k), b" ".join(ordered[s:e]), train=train[s:e].tobytes())
                add(chunk % buckets, n=every_n, docs=every_doc, sizes=sizes.astype("<i8").tobytes(), ids=batch.column(0), prints=batch.column(2), held=held)
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
                for part in range(0, len(rows["bucket"]), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([x if not isinstance(x, pa.Array) else x.to_pylist() for x in rows[k][part : part + 256]], t) for k, t in zip(names, kinds)], names=names)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each bucket's exact counts for every chunk that asked, totals by subgroup and its most frequent words; meta rows pass."""
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def out(rows):
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 256]), kinds)], names=_NAMES)

    def flush(bucket, rows):
        index: dict[bytes, int] = {}
        places = [np.array([index.setdefault(w, len(index)) for w in words.split(b" ")], dtype=np.int64) for _, words, _ in rows]
        counts = np.zeros(len(index), dtype=np.int64)
        for at, (_, _, train) in zip(places, rows):
            counts[at] += train  # a chunk names a word once
        yield from out([(_COUNTS, chunk, None, bucket, None, counts[at].astype("<i8").tobytes(), None) for at, (chunk, _, _) in zip(places, rows)])
        words = list(index)
        known = np.flatnonzero(counts)
        leaves = leaf(word_hashes(pa.array([words[i] for i in known.tolist()], pa.binary())))
        sums[0] += np.bincount(leaves, weights=counts[known], minlength=LEAVES).astype(np.int64)
        sums[1] += np.bincount(leaves, minlength=LEAVES)
        least = np.partition(counts, -HEADS)[-HEADS] if len(words) > HEADS else 0
        ties = sorted(np.flatnonzero(counts >= max(1, least)).tolist(), key=lambda i: (-counts[i], words[i]))[:HEADS]
        yield from out([(_HEAD, None, words[i], int(counts[i]), None, None, None) for i in ties])

    now, held, sums = None, [], np.zeros((2, LEAVES), dtype=np.int64)
    for batch in batches:
        for bucket, chunk, words, n, train, docs, sizes, ids, prints, outside in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if held:
                    yield from flush(now, held)
                now, held = bucket, []
            if ids is not None:
                meta = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(outside, pa.bool_()), pa.array(np.frombuffer(sizes, "<i8"))], names=["doc_id", "print", "held_out", "n"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, meta.schema) as w:
                    w.write_batch(meta)
                yield from out([(_META, chunk, n, None, None, sink.getvalue().to_pybytes(), docs)])
            else:
                held.append((chunk, words, np.frombuffer(train, "<u4")))
    if held:
        yield from flush(now, held)
    by_class = sums.reshape(2, WIDTH, -1)
    yield from out([(_LEAF, c, None, None, None, by_class[:, c].astype("<i8").tobytes(), None) for c in range(WIDTH) if by_class[1, c].any()])


def _leaf_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a class's counts over tasks; there are at most ``WIDTH`` classes."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(*(x.to_pylist() for x in batch.columns)):
            total[c] = total.get(c, 0) + np.frombuffer(raw, "<i8")
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "blob"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meta and counts of each chunk, sorted by chunk, kind and bucket -> one row a document."""

    def flush(meta, n, docs, counts):
        counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        n, docs, rows = np.frombuffer(n, "<u4"), np.frombuffer(docs, "<u2"), meta.num_rows
        logs, known = np.repeat(np.log10(counts + 1.0), n), np.repeat(counts > 0, n)
        sums = [np.bincount(docs, weights=v, minlength=rows)[:rows] for v in (known, logs)]
        return pa.RecordBatch.from_arrays([*meta.columns, pa.array(sums[0].astype(np.int64)), pa.array(sums[1])], names=["doc_id", "print", "held_out", "n_words", "n_known", "logs"])

    now, meta, n, docs, counts = None, None, b"", b"", []
    for b in batches:
        for kind, chunk, key, blob, where in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5, 6))):
            if chunk != now:
                if meta is not None:
                    yield flush(meta, n, docs, counts)
                now, meta, counts = chunk, None, []
            if kind == _META:
                meta, n, docs = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0], key, where
            else:
                counts.append(np.frombuffer(blob, "<i8"))
    if meta is not None:
        yield flush(meta, n, docs, counts)


def _sequences(heads: list[bytes]):
    """Texts -> their words as hashes of four bytes each, the end included; frequent words are numbers below ``HEADS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean_batches(batches):
            words, sizes = _words(batch.column(1))
            coded = words.dictionary_encode()
            number = word_hashes(coded.dictionary)
            frequent = pc.index_in(coded.dictionary.cast(pa.binary()), pa.array(heads, pa.binary())).fill_null(-1).to_numpy()
            number = np.where(frequent >= 0, frequent, number)
            ends = np.cumsum(sizes + 1)
            seq, word = np.full(ends[-1], END, dtype="<u4"), np.ones(ends[-1], dtype=bool)
            word[ends - 1] = False
            seq[word] = number[coded.indices.to_numpy()]
            out = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((4 * np.r_[0, ends]).astype(np.int32)), pa.py_buffer(seq)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), out], names=["doc_id", "print", "held_out", "slice", "seq"])

    return run


def _contexts(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word before last, last word, word) of every token of some texts, one after the other, and where each text starts."""
    words = np.frombuffer(b"".join(seqs), dtype="<u4").astype(np.uint64)
    starts = np.r_[0, np.cumsum([len(s) // 4 for s in seqs])[:-1]].astype(np.int64)
    one = np.r_[np.uint64(START), words[:-1]]
    one[starts] = START
    two = np.r_[np.uint64(START), one[:-1]]
    two[starts] = START
    return two, one, words, starts


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _choices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The factors of some words: number of the softmax, outcome, and place of the word. A class of one word has one factor, other words have three."""
    c, g, s = path(words)
    tail = np.flatnonzero(c > END)
    softmax = np.concatenate([np.zeros(len(c), dtype=np.int64), 1 + c[tail], 1 + WIDTH + c[tail] * WIDTH + g[tail]])
    return softmax, np.concatenate([c, g[tail], s[tail]]), np.concatenate([np.arange(len(c)), tail, tail])


def _hashed(two: np.ndarray, one: np.ndarray, softmax: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Weight rows of each factor's features: previous word, skipped word, both."""
    last, skipped = _scatter(one + np.uint64(1 << 33)), _scatter(two + np.uint64(2 << 33))
    which = _scatter(softmax.astype(np.uint64) + np.uint64(3 << 33))
    return [(_scatter(f[place] ^ which) % np.uint64(ROWS)).astype(np.int64) for f in (last, skipped, _scatter(last * np.uint64(3) + skipped))]


def _softmax(bias: np.ndarray, w: np.ndarray, softmax: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities of every outcome. Weights are at most ``MOST`` in size, so exponentials stay in single precision's range."""
    z = bias.take(softmax, axis=0, mode="clip")  # all are within; "clip" spares a copy
    each = np.empty_like(z)
    for r in rows:
        z += w.take(r, axis=0, out=each, mode="clip")
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


def _pieces(two: np.ndarray, one: np.ndarray, words: np.ndarray):
    """(slice of tokens, softmax, outcome, place, weight rows) of a bounded number of tokens at a time."""
    for at in range(0, len(words), PIECE):
        part = slice(at, at + PIECE)
        softmax, outcome, place = _choices(words[part])
        yield part, softmax, outcome, place, _hashed(two[part], one[part], softmax, place)


def _sums(model):
    """Tokens of a task -> observed and expected counts of the weight rows, a row for each block that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bias, w = model.value
        seen, expected = np.zeros(ROWS * WIDTH, dtype=np.float32), np.zeros((WIDTH, ROWS))
        for batch in lean_batches(batches, 0):
            two, one, words, _ = _contexts(batch.column(0).to_pylist())
            for _, softmax, outcome, _, rows in _pieces(two, one, words):
                p = _softmax(bias, w, softmax, rows)
                for r in rows:
                    np.add.at(seen, r * WIDTH + outcome, np.float32(1))
                for j, column in enumerate(np.ascontiguousarray(p.T)):
                    column = column.astype(np.float64)
                    for r in rows:
                        expected[j] += np.bincount(r, weights=column, minlength=ROWS)
        part, seen = TaskContext.get().partitionId(), seen.reshape(-1, BLOCK * WIDTH)
        for block, e in enumerate(expected.T.reshape(-1, BLOCK * WIDTH)):
            if e.any():
                packed = [pa.array([_pack(x)], pa.binary()) for x in (seen[block], e)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *packed], names=["block", "part", "seen", "expected"])

    return run


def _pack(x: np.ndarray) -> bytes:
    """Numbers as the rounded upper halves of their single-precision form."""
    return ((x.astype("<f4").view("<u4") + np.uint32(1 << 15)) >> np.uint32(16)).astype("<u2").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, "<u2").astype("<u4") << np.uint32(16)).view("<f4").astype(np.float64)


def _update(model):
    """Sums of a block's tasks, sorted by block and task -> the block's new weights."""

    def step(block, seen, expected):
        w = model.value[1].reshape(-1, BLOCK * WIDTH)[block].astype(np.float64)
        used = np.repeat(expected.reshape(BLOCK, WIDTH).any(axis=1), WIDTH)
        x = np.where(used, (seen - expected - RIDGE * w) / (expected + 2 * RIDGE), 0)
        w = np.clip(w + np.where(x > 0, np.log1p(np.maximum(x, 0)), x) / FEATURES, -MOST, MOST)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["block", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, expected = None, None, None
        for batch in batches:
            for block, _, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield step(now, seen, expected)
                    now, seen, expected = block, 0.0, 0.0
                seen, expected = seen + _unpack(s), expected + _unpack(e)
        if now is not None:
            yield step(now, seen, expected)

    return run


def unigram_bias(mass: np.ndarray) -> np.ndarray:
    """Log shares of classes, of groups in each class and of subgroups in each group, from the smoothed counts of subgroups."""
    levels = [mass.reshape(1, WIDTH, -1).sum(axis=2), mass.reshape(WIDTH, WIDTH, WIDTH).sum(axis=2), mass.reshape(-1, WIDTH)]
    x = np.concatenate(levels) + 0.25
    return np.log(x / x.sum(axis=1, keepdims=True)).astype(np.float32)


def fit(seqs: DataFrame, bias: np.ndarray, tokens: int) -> np.ndarray:
    """Weights by distributed updates, one a slice of the training texts: each adds the damped gradient over the curvature, shared among a context's features."""
    spark = seqs.sparkSession
    w = np.zeros((ROWS, WIDTH), dtype=np.float32)
    tasks = max(1, -(-tokens // (UPDATES * TASK_TOKENS)))
    for k in range(UPDATES):
        model = spark.sparkContext.broadcast((bias, w))
        part = seqs.where((F.col("slice") == k) & ~F.col("held_out")).select("seq").coalesce(tasks)
        sums = part.mapInArrow(_sums(model), "block int, part int, seen binary, expected binary")
        got = sums.repartition("block").sortWithinPartitions("block", "part").mapInArrow(_update(model), "block int, w binary").toArrow()
        w = w.copy()
        for block, raw in zip(got.column("block").to_pylist(), got.column("w").to_pylist()):
            w[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, "<f4").reshape(BLOCK, WIDTH)
        model.unpersist()
    return w


def log_probabilities(bias: np.ndarray, w: np.ndarray, extra: np.ndarray, seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability but for its log10(count + 1), and where each text starts."""
    two, one, words, starts = _contexts(seqs)
    each = extra[leaf(words)]
    for part, softmax, outcome, place, rows in _pieces(two, one, words):
        got = np.log10(_softmax(bias, w, softmax, rows)[np.arange(len(outcome)), outcome].astype(np.float64))
        each[part] += np.bincount(place, weights=got, minlength=len(each[part]))
    return each, starts


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w, extra = model.value
        for batch in lean_batches(batches, 2):
            each, starts = log_probabilities(bias, w, extra, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.add.reduceat(each, starts))], names=["of", "of_print", "modelled"])

    return run


def score_texts(docs: DataFrame, k: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"), (id_remainder("doc_id", k) == held).alias("held_out"))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_deal(buckets), "bucket int, chunk long, words binary, n binary, train binary, docs binary, sizes binary, ids array<long>, prints array<long>, held array<boolean>")
    met = durable(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _COUNTED))
    documents = met.where(F.col("kind").isin(_META, _COUNTS)).repartition("chunk").sortWithinPartitions("chunk", "kind", "a")
    documents = durable(documents.mapInArrow(_gather, "doc_id long, print long, held_out boolean, n_words long, n_known long, logs double"))

    top = met.where(F.col("kind") == _HEAD).select("key", "a").orderBy(F.col("a").desc(), "key").limit(HEADS).collect()
    heads = [(bytes(r["key"]), r["a"]) for r in top]
    by_class = np.zeros((2, WIDTH, LEAVES // WIDTH), dtype=np.int64)
    totals = met.where(F.col("kind") == _LEAF).select("chunk", "blob").repartition("chunk").mapInArrow(_leaf_totals, "chunk long, blob binary")
    for r in totals.collect():
        by_class[:, r["chunk"]] = np.frombuffer(bytes(r["blob"]), "<i8").reshape(2, -1)
    total, distinct = by_class.reshape(2, -1)
    texts_seen = documents.where(~F.col("held_out")).count()
    n = int(total.sum()) + texts_seen
    v = int(distinct.sum()) + (texts_seen > 0)

    counted = np.array([c for _, c in heads], dtype=np.int64)
    alone = leaf(np.arange(len(heads)))
    was = leaf(np.array([word_hash(w) for w, _ in heads], dtype=np.int64))
    np.subtract.at(total, was, counted)
    np.subtract.at(distinct, was, 1)
    extra = -np.log10(total + distinct + 1.0)
    mass = (total + distinct).astype(np.float64)
    mass[alone], extra[alone] = counted + 1, -np.log10(counted + 1.0)
    end = leaf(np.array([END]))
    mass[end], extra[end] = texts_seen + 1, 0
    bias = unigram_bias(mass)

    place = scratch_path(spark, "word-hashes")
    cut = F.pmod(F.xxhash64("doc_id", "print"), F.lit(UPDATES)).cast("int")
    seqs = rows.withColumn("slice", cut).mapInArrow(_sequences([w for w, _ in heads]), "doc_id long, print long, held_out boolean, slice int, seq binary")
    seqs.write.partitionBy("slice").option("compression", "zstd").parquet(place)
    seqs = spark.read.schema("doc_id long, print long, held_out boolean, seq binary, slice int").parquet(place)
    model = spark.sparkContext.broadcast((bias, fit(seqs, bias, n), extra))
    modelled = seqs.select("doc_id", "print", "seq").mapInArrow(_score(model), "of long, of_print long, modelled double")
    modelled = modelled.dropDuplicates(["of", "of_print"])
    both = documents.join(modelled, null_safe([(F.col("doc_id"), F.col("of")), (F.col("print"), F.col("of_print"))]))
    n_tokens = F.col("n_words") + 1
    return both.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.lit(int(texts_seen > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(float(np.log10(texts_seen + 1))) - n_tokens * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("logs") + F.col("modelled")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: base and model scores of every document."""
    from weir.session import table

    return score_texts(table(spark, sf_dir, "documents"))
