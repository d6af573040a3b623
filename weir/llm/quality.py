"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

A text's features are the byte 1- to 4-grams that occur in it (3- and 4-grams
hashed) and the word bigrams of one word twice, as indicators of how many there are. Indicators are scaled by the class log-count ratio, brought to unit length and given to a linear
hinge-loss model that dual coordinate descent fits on the driver. A sigmoid, fitted on margins of rows
that the margin model had not seen, turns margins into scores.

Fitting uses at most ``SAMPLE`` labelled rows, chosen by a hash of their id, one row an id and one of each group of near copies of a label; they reach the
driver as lists of feature numbers. All texts are scored whole. The sigmoid is fitted on margins of all ``FOLDS`` folds at every size.

Defined results: null text counts as empty; an empty text is scored from the bias; without labels of
both classes every score is the smoothed share of label 1 (0.5 without labels); repeated rows score alike; labels with
a null id or a value other than 0 and 1 are ignored, of an id's repeated labels the least counts, of a labelled id's repeated documents
the least text. An empty table gives an empty result. Other columns pass through, whatever their names: the score's own name must be free
(``score`` refuses a clash, ``keep_good`` picks a free name).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import add_text_columns, durable, first_of_copies, free_name, id_remainder, labelled_sample, lean_batches, sampled_texts, texts
from weir.session import ship

SAMPLE = 5_000  #: labelled rows that the model is fitted on, at most
FOLDS = 5
THRESHOLD = 0.3
_HASH = 1 << 17
_REPEATS = 256 + 65_536 + 2 * _HASH
REPEAT_COUNTS, REPEAT_SHARES = (1, 4, 16, 64), (0.05, 0.1, 0.25, 0.5)
DIMS = _REPEATS + len(REPEAT_COUNTS) + len(REPEAT_SHARES)


def marked(text: bytes, mark: np.ndarray) -> np.ndarray:
    """Sorted numbers of the n-grams in a text; ``mark`` is an all-false scratch array of DIMS and stays one."""
    for at in range(0, max(len(text), 1), 1 << 20):
        b = np.frombuffer(text[at : at + (1 << 20) + 3], dtype=np.uint8).astype(np.uint32)
        mark[b] = True
        if len(b) > 1:
            two = b[:-1] << 8 | b[1:]
            mark[256 + two] = True
        if len(b) > 2:
            three = two[:-1] << 8 | b[2:]
            mark[65_792 + (three * np.uint32(2_654_435_761) >> np.uint32(15))] = True
        if len(b) > 3:
            four = three[:-1] << 8 | b[3:]
            mark[65_792 + _HASH + (four * np.uint32(2_246_822_519) >> np.uint32(15))] = True
    words = text.split()
    twice = sum(map(eq, words, islice(words, 1, None)))
    if twice:
        mark[_REPEATS : _REPEATS + 4] = [twice >= n for n in REPEAT_COUNTS]
        mark[_REPEATS + 4 :] = [twice >= share * len(words) for share in REPEAT_SHARES]
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Per feature, the log of its share among the indicators of class 1 over that of class 0."""
    counts = []
    for c in (1, 0):
        own = [r for r, k in zip(rows, y) if k == c]
        n = np.zeros(DIMS, dtype=np.int64)
        for at in range(0, len(own), 256):  # numpy counts on a copy of twice the size
            n += np.bincount(np.concatenate(own[at : at + 256]), minlength=DIMS)
        counts.append(n + alpha)
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows, values, y, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine; classes weigh the same in sum."""
    rng, n = np.random.default_rng(seed), len(rows)
    s = np.where(y == 1, 1.0, -1.0)
    c = cost * np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum())))
    w, bias, a = np.zeros(DIMS), 0.0, np.zeros(n)
    q = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(n):
            g = s[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(a[i] - g / q[i], 0.0), c[i])
            if new != a[i]:
                step, a[i] = (new - a[i]) * s[i], new
                w[rows[i]] += step * values[i]
                bias += step
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid over margins, by Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (t - p) - 1e-3 * beta
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """The model as float32 weights, a bias and the sigmoid."""
    n1, n = int((y == 1).sum()), len(y)
    if n1 < 2 or n - n1 < 2:
        return {"share": (n1 + 1) / (n + 2)}

    def trained(part):
        some, ys = [rows[i] for i in part], y[part]
        r = log_count_ratio(some, ys)
        ends = np.cumsum([len(x) for x in some])
        flat = np.empty(ends[-1], dtype=np.float32)  # one block, which goes back to the system as a whole
        values = [flat[e - len(x) : e] for x, e in zip(some, ends)]
        for x, v in zip(some, values):
            v[:] = r[x]
            v /= np.linalg.norm(v) or 1.0
        w, bias = dual_coordinate_descent(some, values, ys)
        return r, w, bias

    def margin(x, r, w, bias):
        return float(w[x] @ r[x] / (np.linalg.norm(r[x]) or 1.0) + bias)

    fold = np.arange(n) % FOLDS
    margins = np.zeros(n)
    for k in range(FOLDS):
        part = np.flatnonzero(fold != k)
        if len(set(y[part])) == 2:
            model = trained(part)
            for i in np.flatnonzero(fold == k):
                margins[i] = margin(rows[i], *model)
    slope, offset = platt(margins, y)
    r, w, bias = trained(np.arange(n))
    return {"wr": (w * r).astype(np.float32), "rr": (r * r).astype(np.float32), "bias": bias, "slope": slope, "offset": offset}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = np.zeros(DIMS, dtype=bool)
    for batch in lean_batches(batches):
        got = [marked(t, mark).astype(np.int32) for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, type=pa.list_(pa.int32()))], names=["y", "found"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", k: int = 5, held: int = 0, most: int = SAMPLE) -> dict:
    """Fit on labelled rows whose crc32(id) modulo ``k`` isn't ``held``."""
    ship(docs.sparkSession)
    sample = labelled_sample(labels, label, k, held, most)
    rows = durable(sampled_texts(docs, sample))
    got = first_of_copies(rows).select("y", "text").mapInArrow(_features, "y int, found array<int>").toArrow()
    y = got.column("y").to_numpy()
    found = got.column("found").combine_chunks()
    del got  # the column is a copy
    flat, at = found.flatten().to_numpy(), found.offsets.to_numpy() - (found.offsets[0].as_py() if len(found) else 0)
    rows = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), int(rows[i].sum()), int(y[i])))  # not the order tasks ended in
    return fit([rows[i] for i in order], y[order])


def scorer(model: dict):
    """Function from whole texts to scores, for add_text_columns."""

    def run(batch: list[bytes]) -> dict:
        if "share" in model:
            return {"score": np.full(len(batch), model["share"])}
        mark, out = np.zeros(DIMS, dtype=bool), np.empty(len(batch))
        for i, t in enumerate(batch):
            x = marked(t, mark)
            m = float(model["wr"][x].sum(dtype=np.float64) / (np.sqrt(model["rr"][x].sum(dtype=np.float64)) or 1.0) + model["bias"])
            out[i] = 1 / (1 + np.exp(-np.clip(model["slope"] * m + model["offset"], -30, 30)))
        return {"score": out}

    return run


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; the model, of fixed size, is broadcast. ``name`` must not be a column of ``docs``."""
    if free_name(docs, name) != name:
        raise ValueError(f"column {name} is there already")
    held = docs.sparkSession.sparkContext.broadcast(model)
    return add_text_columns(docs, lambda batch: {name: scorer(held.value)(batch)["score"]}, f"{name} double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, columns unchanged."""
    name = free_name(docs, "quality_score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: quality score of every document."""
    from weir.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
