"""Toxicity: a weighted finite-state pattern grammar over clauses.

A lexical transducer reads a clause's tokens along paths of one or more words and writes insults, threats, targets, negations, reports and quotation
marks. Four transducers follow, each reading what the one before it wrote: targets (an insult becomes an aimed insult if its
target stands before or after it, a threat becomes a menace only with its target), negation, reported speech and quotation,
which weaken what they reach. Their composition is one machine over pairs of states, its arcs
built when first taken. Weights of arcs multiply along a path, matches of a clause add up; clause weights, not
single words, make up the features of a small logistic model.

Paths of the insult lexicon are fixed ones and, learned from labelled rows, words, pairs of words and word beginnings
that occur in far more toxic documents than chance allows; their weights are log odds. Learning
uses at most ``SAMPLE`` labelled rows, chosen by a hash of their id, one row an id and one of each group of near copies of a label; counting is distributed and
only what passes the test for chance reaches the driver. All texts are scored whole.

Defined results: null text counts as empty and scores the model's value for no match; without labels the
prior model is used; repeated rows score alike; labels with a null id or a value other than 0 and 1 are ignored, of an id's
repeated labels the least counts, of a labelled id's repeated documents the least text; an empty table gives an empty result. Other columns pass
through, whatever their names: the score's own name must be free (``score`` refuses a clash, ``keep_civil`` picks a free name).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import add_text_columns, durable, first_of_copies, free_name, id_remainder, labelled_sample, lean_batches, sampled_texts, texts
from weir.session import ship

SAMPLE = 20_000  #: labelled rows that arcs and model are learned from, at most
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)

INSULTS = frozenset(
    "idiot idiots moron morons stupid clown clowns loser losers scum trash worthless pathetic disgusting dumb fool fools imbecile "
    "cretin jerk garbage vermin filth scumbag degenerate subhuman parasite parasites bastard bitch asshole dipshit retard retarded "
    "idiota estúpido estúpida imbécil basura escoria payaso inútil patético asqueroso "
    "idiote imbécile stupide crétin ordure racaille minable pathétique abruti connard salaud "
    "dummkopf trottel abschaum versager widerlich erbärmlich wertlos schwachkopf arschloch".split()
)
THREATS = frozenset("kill hurt beat destroy shoot stab burn hang crush murder töten umbringen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours u he she him her they them his their this these those who everyone du dich ihr sie er tu toi vous il elle ils tú usted él ella ellos".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't weren't don't doesn't didn't won't can't nobody neither nicht kein keine nie pas jamais aucun nunca ningún".split())
REPORTS = frozenset("said says say told called calls claimed claims wrote reported reports quoted alleged allegedly accused sagte nannte disait appelé dijo llamó".split())

#: Paths of several words.
INSULT_PATHS = tuple(
    tuple(x.split())
    for x in (
        "piece of trash;piece of garbage;piece of shit;waste of space;waste of air;son of a bitch;good for nothing;shut up;"
        "fils de pute;tas de merde;hijo de puta;pedazo de basura;pedazo de mierda;stück dreck;halt die klappe"
    ).split(";")
)
THREAT_PATHS = tuple(tuple(x.split()) for x in "rip apart;tear apart;beat up;burn down;cut up;beat to death;put in the ground".split(";"))
#: Passive threats: an auxiliary, then a participle.
AUXILIARIES = frozenset("be been being get gets getting got is are was were werden wirst wird être sera seras ser serás será".split())
SUFFERED = frozenset("killed hurt beaten destroyed shot stabbed burned burnt hanged hung crushed murdered getötet umgebracht tué frappé asesinado golpeado".split())

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]+|[\"“”«»]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
INSULT, THREAT, SUFFER, TARGET, NEGATION, REPORT, QUOTE, OTHER, AIMED, MENACE = range(10)
MATCHES = (INSULT, AIMED, MENACE)


class Transducer:
    """A deterministic weighted transducer: step(state, symbol) -> (next state, written symbol, weight)."""

    start: tuple | int = 0
    keeps = False  #: whether the state lives on at a clause's end

    def step(self, state, symbol):
        raise NotImplementedError


class Aim(Transducer):
    """Writes AIMED for an insult with a target within ``reach`` tokens before it, and for a target that soon after an insult; MENACE for a threat and its
    target, in this order, or a target and what it is to suffer. State: tokens that a target, an insult and a threat still reach."""

    start = (0, 0, 0)

    def __init__(self, reach: int, factor: float):
        self.reach, self.factor = reach, factor

    def step(self, state, symbol):
        target, insult, threat = (max(0, x - 1) for x in state)
        near = [bool(x) for x in state]
        if symbol == INSULT:
            return ((0, 0, threat), AIMED, self.factor) if near[0] else ((target, self.reach, threat), INSULT, 1.0)
        if symbol == THREAT:
            return (target, insult, self.reach), OTHER, 1.0
        if symbol == SUFFER:
            return (0, insult, threat), (MENACE if near[0] else OTHER), 1.0
        if symbol == TARGET:
            written = MENACE if near[2] else AIMED if near[1] else TARGET
            return (self.reach, 0 if written == AIMED else insult, 0 if written == MENACE else threat), written, 1.0
        return (target, insult, threat), symbol, 1.0


class Scope(Transducer):
    """Matches within ``reach`` tokens after an opener weigh ``factor`` times as much."""

    def __init__(self, opener: int, reach: int, factor: float):
        self.opener, self.reach, self.factor = opener, reach, factor

    def step(self, state, symbol):
        weight = self.factor if state and symbol in MATCHES else 1.0
        return (self.reach if symbol == self.opener else max(0, state - 1)), symbol, weight


class Quoted(Transducer):
    """Quotation marks toggle a scope in which matches weigh less; it may span clauses."""

    keeps = True

    def __init__(self, factor: float):
        self.factor = factor

    def step(self, state, symbol):
        return (1 - state if symbol == QUOTE else state), symbol, (self.factor if state and symbol in MATCHES else 1.0)


class Composed(Transducer):
    """first ∘ second: what the first writes, the second reads. Arcs of the product are built when first taken."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.arcs = first, second, {}
        self.start = (first.start, second.start)

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        if arc is None:
            a, between, x = self.first.step(state[0], symbol)
            b, written, y = self.second.step(state[1], between)
            arc = self.arcs[state, symbol] = ((a, b), written, x * y)
        return arc

    def clause_end(self, state):
        """The state at the start of the next clause: only scopes that span clauses live on."""
        one, two = ((p.clause_end(s) if isinstance(p, Composed) else s if p.keeps else p.start) for p, s in zip((self.first, self.second), state))
        return one, two


def grammar() -> Composed:
    """target ∘ negation ∘ reported speech ∘ quotation; the lexical transducer is ``symbols``."""
    return Composed(Composed(Composed(Aim(4, 1.5), Scope(NEGATION, 4, 0.3)), Scope(REPORT, 12, 0.5)), Quoted(0.5))


THREAT_WEIGHT = 2.5
AIM_WEIGHT = 1.0  #: of a target after an insult that was weighed already
FEATURES = 5


def lexicon(pairs: dict[tuple[str, str], float]) -> dict[str, list[tuple[tuple[str, ...], int, float]]]:
    """Paths by their first word, longest first: (following words, symbol, weight)."""
    out: dict[str, list] = {}
    for path in INSULT_PATHS:
        out.setdefault(path[0], []).append((path[1:], INSULT, 3.0))
    for path in THREAT_PATHS:
        out.setdefault(path[0], []).append((path[1:], THREAT, 0.0))
    for (a, b), weight in pairs.items():
        out.setdefault(a, []).append(((b,), INSULT, weight))
    for a in AUXILIARIES:
        out.setdefault(a, []).extend(((b,), SUFFER, 0.0) for b in SUFFERED)
    for paths in out.values():
        paths.sort(key=lambda x: (-len(x[0]), x[0], x[1]))
    return out


def symbols(text: str, hot: dict[str, float], paths: dict[str, list]) -> Iterator[tuple[int | None, float]]:
    """The lexical transducer: (symbol, weight) of each token or path of tokens; None ends a clause."""
    tokens, at = _TOKEN.findall(text), 0
    while at < len(tokens):
        token = tokens[at]
        at += 1
        if token[0] in ".!?;:\n":
            yield None, 0.0
            continue
        for rest, symbol, weight in paths.get(token, ()):
            if tuple(tokens[at : at + len(rest)]) == rest:
                at += len(rest)
                yield symbol, weight
                break
        else:
            if token in hot:
                yield INSULT, hot[token]
            elif token in THREATS:
                yield THREAT, 0.0
            elif token in TARGETS:
                yield TARGET, 0.0
            elif token in NEGATIONS:
                yield NEGATION, 0.0
            elif token in REPORTS:
                yield REPORT, 0.0
            else:
                yield (QUOTE if token[0] in "\"“”«»" else OTHER), 0.0


def clause_features(text: str, arcs: dict[str, float], prefixes: dict[str, float], machine: Composed, paths: dict[str, list] | None = None) -> list[float]:
    """[log sum of clause weights, log matches, largest clause weight, matches in 100 words, log weakened matches]."""
    paths = _FIXED if paths is None else paths
    words = _WORD.findall(text)
    seen = set(words)
    hot = {}
    for w in seen:
        # the shortest learned beginning rests on the most documents; longer ones only overfit it
        weight = next((prefixes[w[:n]] for n in PREFIXES if len(w) >= n and w[:n] in prefixes), arcs.get(w))
        if w in INSULTS:
            weight = max(weight, arcs[w])
        if weight is not None and weight > 0:
            hot[w] = weight
    if not hot and not seen & THREATS and not any(paths[w][0][1] != SUFFER or seen & SUFFERED for w in seen & paths.keys()):
        return [0.0] * FEATURES
    clauses, matches, weak = [], 0, 0
    state, clause = machine.start, 0.0
    for symbol, weight in symbols(text, hot, paths):
        if symbol is None:
            if clause:
                clauses.append(clause)
            state, clause = machine.clause_end(state), 0.0
            continue
        state, written, factor = machine.step(state, symbol)
        if written in MATCHES:
            if written == MENACE:
                weight = THREAT_WEIGHT
            elif symbol == TARGET:
                weight = AIM_WEIGHT
            clause += weight * factor
            matches += symbol != TARGET or written == MENACE
            weak += factor < 1
    if clause:
        clauses.append(clause)
    return [math.log1p(sum(clauses)), math.log1p(matches), max(clauses, default=0.0), 100.0 * matches / max(1, len(words)), math.log1p(weak)]


_FIXED = lexicon({})


def _count_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each word, pair of words and word beginning, summed over the task."""
    pos, neg = Counter(), Counter()
    for batch in lean_batches(batches):
        for y, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            inorder = _WORD.findall(t.decode().lower())
            words = set(inorder)
            found = {"w" + w for w in words}
            found.update("b" + a + " " + b for a, b in zip(inorder, inorder[1:]))
            for n in PREFIXES:
                found.update("p" + w[:n] for w in words if len(w) > n)
            (pos if y else neg).update(found)
        if len(pos) + len(neg) > 1_000_000:
            yield _arc_rows(pos, neg)
            pos, neg = Counter(), Counter()
    yield _arc_rows(pos, neg)


def _arc_rows(pos: Counter, neg: Counter) -> pa.RecordBatch:
    arcs = list(dict.fromkeys([*pos, *neg]))
    return pa.RecordBatch.from_arrays([pa.array(arcs, pa.string()), pa.array([pos[a] for a in arcs], pa.int64()), pa.array([neg[a] for a in arcs], pa.int64())], names=["arc", "pos", "neg"])


def learn_arcs(rows: DataFrame, n1: int, n0: int) -> tuple[dict, dict, dict]:
    """(words, beginnings, pairs) with their weights, from (y, text) rows with n1 toxic and n0 other documents."""
    arcs = {w: 3.0 for w in INSULTS}
    if not n1 or not n0:
        return arcs, {}, {}
    counts = rows.mapInArrow(_count_arcs, "arc string, pos long, neg long").groupBy("arc").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    base = n1 / (n1 + n0)
    n = F.col("pos") + F.col("neg")
    g2 = 2 * (F.col("pos") * F.log(F.col("pos") / (n * base)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - base)))).otherwise(0.0))
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    candidates = n1 + n0  # documents bound the number of independent looks at this frequency well enough
    kept = counts.where("pos > 0").withColumn("g2", g2).withColumn("odds", odds)
    known = F.col("arc").isin(["w" + w for w in INSULTS]) & (n >= 20)
    kept = kept.where((F.col("odds") >= 1.5) & (F.col("g2") >= 2 * math.log(candidates * 100) + 2) | known)
    odds_of = {r["arc"]: r["odds"] for r in kept.select("arc", "odds").collect()}
    arcs |= {a[1:]: min(6.0, max(0.0, o)) for a, o in odds_of.items() if a[0] == "w"}
    prefixes = {a[1:]: min(6.0, o) for a, o in odds_of.items() if a[0] == "p"}
    # a pair says more than its words only if it tells more than either
    pairs = {}
    for a, o in odds_of.items():
        if a[0] == "b":
            one, two = a[1:].split(" ")
            if not any(w in arcs or any(w[:n] in prefixes for n in PREFIXES) for w in (one, two)):
                pairs[one, two] = min(6.0, o)
    return arcs, prefixes, pairs


#: Coefficients before any label is seen: offset, log sum, log matches, largest clause, density, weakened matches.
PRIOR = (-3.0, 1.5, 1.0, 0.3, 0.1, -0.5)


def logistic(x: np.ndarray, y: np.ndarray, prior=PRIOR, strength: float = 1.0) -> np.ndarray:
    """Logistic coefficients by Newton steps, drawn towards the prior."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta, mean = np.array(prior, dtype=float), np.array(prior, dtype=float)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (y - p) - strength * (beta - mean)
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + strength * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return beta


def features(model: dict):
    """Function from whole texts to clause features."""
    machine, paths = grammar(), lexicon(model["pairs"])

    def run(batch: list[bytes]) -> np.ndarray:
        got = [clause_features(t.decode().lower(), model["arcs"], model["prefixes"], machine, paths) for t in batch]
        return np.array(got, dtype=float).reshape(-1, FEATURES)

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", k: int = 3, held: int = 1, most: int = SAMPLE) -> dict:
    """Learn arcs and model from labelled rows whose crc32(id) modulo ``k`` isn't ``held``."""
    spark = ship(docs.sparkSession)
    rows = durable(first_of_copies(durable(sampled_texts(docs, labelled_sample(labels, label, k, held, most)))).select("y", "text", "label_id"))
    # arcs fit the rows they were found in too well, so the model over them is fitted on others
    apart = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(3)) == 0
    found_in = rows.where(~apart)
    n = {r["y"]: r["count"] for r in found_in.groupBy("y").count().collect()}
    arcs, prefixes, pairs = learn_arcs(found_in.select("y", "text"), n.get(1, 0), n.get(0, 0))
    model = {"arcs": arcs, "prefixes": prefixes, "pairs": pairs}
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        f = features(shared.value)
        for batch in lean_batches(batches):
            x = f(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i]) for i in range(FEATURES)]], names=["y", *"abcde"])

    got = rows.where(apart).select("y", "text").mapInArrow(run, "y int, a double, b double, c double, d double, e double").toArrow()
    x = np.stack([got.column(c).to_numpy() for c in "abcde"], axis=1) if got.num_rows else np.zeros((0, FEATURES))
    y = got.column("y").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, dtype=int)
    return model | {"beta": logistic(x[order], y[order])}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; the model, bounded by the sample, is broadcast. ``name`` must not be a column of ``docs``."""
    if free_name(docs, name) != name:
        raise ValueError(f"column {name} is there already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: list[bytes]) -> dict:
        m = shared.value
        x = features(m)(batch)
        return {name: 1 / (1 + np.exp(-np.clip(m["beta"][0] + x @ m["beta"][1:], -30, 30)))}

    return add_text_columns(docs, run, f"{name} double")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, columns unchanged."""
    name = free_name(docs, "toxicity_score")
    return score(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: toxicity score of every document."""
    from weir.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
