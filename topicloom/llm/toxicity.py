"""Toxicity by a weighted finite-state pattern grammar.

Words are read into symbols: insult, threat, target (whom it is said to), negation, saying, quotation mark, the end
of a clause, any other word. Four transducers over these symbols are composed into one machine. The first cuts
clauses: a full stop, semicolon, bar or line end closes one of two words or more, and is a mere pause after a single
word, so a list of words with marks between them is not taken for as many clauses. Negation discounts what stands
within its reach, reported speech what follows a verb of saying or an open quotation mark (both end with the
clause), and the target acceptor lets an insult count more if a target stands in the clause and a threat count only
then. The machine weighs the insults and threats on its arcs; a clause that it closes in an accepting state has a
score. A word alone has none; a document's features are its clauses'.

The insult lexicon (beyond a few seeds) and its weights are log odds over labelled rows outside the held-out
fold: whole words, and stems that nearly only insults begin with (written ``stem*``, the longest that fits a
word counts), so an inflection that the sample lacks is read too. A small logistic model maps clause features to a probability; both are fitted on a bounded
sample of labelled rows (``FIT_ROWS``). Every text is scored whole. Labels, lang, source and doc_id are no inputs.

Defined results: null and empty texts match nothing and score the model's base rate; equal texts get equal
scores; without labels the seeds alone decide; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bound_batches, fold

#: Labelled rows at most (in expectation) that lexicon and model are fitted on.
FIT_ROWS = 20_000
#: A learnt insult needs this likelihood ratio and this share of toxic rows among those that have it.
MIN_RATIO, MIN_SHARE = 20.0, 0.5
#: Lengths of stems, and the share of toxic rows among those that have a word with a learnt stem.
STEMS, STEM_SHARE = range(3, 9), 0.9
PREDICT = 0.3

SEEDS = dict.fromkeys("idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown imbecile dumb filth vermin bastard bitch asshole fuck fucking shit arschloch dummkopf abschaum schlampe connard salope ordure pendejo gilipollas escoria".split(), 4.0)
THREATS = dict.fromkeys("kill hurt destroy burn shoot stab beat hang töten umbringen verletzen tuer frapper matar golpear".split(), 3.0)
TARGETS = frozenset("you your you're youre u he she they them him her his their dich dir du ihr euch sie er toi tu vous te ton votre il elle ils tú usted ustedes vosotros él ella ellos".split())
NEGATION = frozenset("not no never isn't aren't don't doesn't didn't wasn't weren't nicht kein keine nie ne pas jamais ni nunca jamás".split())
REPORT = frozenset("said says say wrote claimed called quoted reported sagte sagt schrieb nannte dit disait écrit dijo dice escribió".split())

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;|\n\"“”«»]")
#: How far a negation reaches, in words.
REACH = 3
NEGATED, REPORTED, TARGETED = 0.25, 0.4, 1.5
N_FEATURES = 7


#: The symbols of the machine.
WORD, INSULT, THREAT, TARGET, NOT, SAYS, QUOTE, PAUSE, END = SYMBOLS = range(9)


@dataclass
class Transducer:
    """Deterministic and weighted: an arc from a state on a symbol gives the next state, a symbol and a factor.

    accept: of a final state the factors of insults and of threats; a state without an entry is not final.
    """

    start: object
    arcs: dict[tuple[object, int], tuple[object, int, float]]
    accept: dict[object, tuple[float, float]]

    @classmethod
    def make(cls, start: object, states: Iterable[object], step: Callable[[object, int], tuple[object, float]], accept: Callable[[object], tuple[float, float] | None], gives: Callable[[object, int], int] = lambda q, x: x) -> Transducer:
        """From a rule for each arc; the symbol passes through unless ``gives`` says another."""
        states = list(states)
        arcs = {(q, x): (n, gives(q, x), f) for q in states for x in SYMBOLS for n, f in [step(q, x)]}
        return cls(start, arcs, {q: a for q in states if (a := accept(q)) is not None})

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds what this one gives to the other; factors multiply."""
        start = (self.start, other.start)
        arcs, accept, todo = {}, {}, [start]
        seen = {start}
        while todo:
            q = todo.pop()
            p, r = q
            if p in self.accept and r in other.accept:
                accept[q] = tuple(a * b for a, b in zip(self.accept[p], other.accept[r], strict=True))
            for x in SYMBOLS:
                p2, y, f = self.arcs[p, x]
                r2, z, g = other.arcs[r, y]
                arcs[q, x] = ((p2, r2), z, f * g)
                if (p2, r2) not in seen:
                    seen.add((p2, r2))
                    todo.append((p2, r2))
        return Transducer(start, arcs, accept)


def negation() -> Transducer:
    """States: words since a negation, 0 for none within reach."""

    def step(q: int, x: int) -> tuple[int, float]:
        if x == NOT:
            return 1, 1.0
        if x in (QUOTE, PAUSE):
            return q, 1.0
        return (q + 1 if 0 < q < REACH and x != END else 0), NEGATED if q and x in (INSULT, THREAT) else 1.0

    return Transducer.make(0, range(REACH + 1), step, lambda q: (1.0, 1.0))


def reported_speech() -> Transducer:
    """States: whether a verb of saying came before, and whether a quotation is open."""

    def step(q: tuple[bool, bool], x: int) -> tuple[tuple[bool, bool], float]:
        said, quoted = q
        to = (False, False) if x == END else (True, quoted) if x == SAYS else (said, not quoted) if x == QUOTE else q
        return to, REPORTED if (said or quoted) and x in (INSULT, THREAT) else 1.0

    return Transducer.make((False, False), [(a, b) for a in (False, True) for b in (False, True)], step, lambda q: (1.0, 1.0))


def target() -> Transducer:
    """States: whether the clause has a target."""
    return Transducer.make(False, (False, True), lambda q, x: (x != END and (q or x == TARGET), 1.0), lambda q: (TARGETED, 1.0) if q else (1.0, 0.0))


def clauses() -> Transducer:
    """States: words of the clause, up to two; an end before the second word is given on as a pause."""
    step = lambda q, x: (q if x in (QUOTE, PAUSE) or x == END and q < 2 else 0 if x == END else min(2, q + 1), 1.0)
    return Transducer.make(0, range(3), step, lambda q: (1.0, 1.0) if q == 2 else None, lambda q, x: PAUSE if x == END and q < 2 else x)


class Machine:
    """The composed transducers as tables: states are numbered, the first is the start."""

    def __init__(self) -> None:
        t = clauses().compose(negation()).compose(reported_speech()).compose(target())
        number = {t.start: 0}
        for q, _ in t.arcs:
            number.setdefault(q, len(number))
        self.next = [[0] * len(SYMBOLS) for _ in number]
        self.gives = [list(SYMBOLS) for _ in number]
        self.factor = [[1.0] * len(SYMBOLS) for _ in number]
        self.accept: list[tuple[float, float]] = [(0.0, 0.0)] * len(number)
        self.targeted = [q[1] for q in number]
        for (q, x), (n, y, f) in t.arcs.items():
            self.next[number[q]][x], self.gives[number[q]][x], self.factor[number[q]][x] = number[n], y, f
        for q, a in t.accept.items():
            self.accept[number[q]] = a


MACHINE = Machine()
#: Symbols of fixed words and marks; insults and threats come from the lexicon.
FIXED = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(REPORT, SAYS) | dict.fromkeys(NEGATION, NOT) | dict.fromkeys("\"“”«»", QUOTE) | dict.fromkeys(".!?;|\n", END)


@dataclass
class Grammar:
    insults: dict[str, float] = field(default_factory=lambda: dict(SEEDS))
    threats: dict[str, float] = field(default_factory=lambda: dict(THREATS))

    def __post_init__(self) -> None:
        self.triggers = frozenset(w for w in self.insults if not w.endswith("*")) | frozenset(self.threats)
        self.stems = {w[:-1]: x for w, x in self.insults.items() if w.endswith("*")}
        self.heads = frozenset(w[: STEMS[0]] for w in self.stems)

    def stemmed(self, word: str) -> float | None:
        """Weight of the longest stem that the word goes on from."""
        for n in range(min(STEMS[-1], len(word) - 1), STEMS[0] - 1, -1):
            if (x := self.stems.get(word[:n])) is not None:
                return x
        return None

    def hits(self, words: set[str]) -> dict[str, tuple[str, float]]:
        """Kind and weight of the words that trigger a score; a threat is one even if it looks like an insult."""
        out = {w: ("insult", x) for w in words if w[: STEMS[0]] in self.heads and (x := self.stemmed(w)) is not None}
        for w in self.triggers & words:
            out[w] = ("insult", self.insults[w]) if w in self.insults else ("threat", self.threats[w])
        return out

    def clauses(self, text: str) -> tuple[list[tuple[float, bool]], int]:
        """Weight of each accepted clause and whether it has a target, and the number of words."""
        tokens = _TOKEN.findall(text.lower())
        known = self.hits(set(tokens))
        if not known:
            return [], len(tokens)
        out: list[tuple[float, bool]] = []
        m, q, insult, threat = MACHINE, 0, 0.0, 0.0
        for t in (*tokens, "."):
            hit = known.get(t)
            x = FIXED.get(t, WORD) if hit is None else INSULT if hit[0] == "insult" else THREAT
            if x == END and m.gives[q][x] == END:
                a, b = m.accept[q]
                if total := a * insult + b * threat:
                    out.append((total, m.targeted[q]))
                insult = threat = 0.0
            elif x == INSULT:
                insult += hit[1] * m.factor[q][x]
            elif x == THREAT:
                threat += hit[1] * m.factor[q][x]
            q = m.next[q][x]
        return out, len(tokens)

    def features(self, text: str | None) -> list[float]:
        found, n = self.clauses(text or "")
        if not found:
            return [0.0] * N_FEATURES
        w = [x for x, _ in found]
        return [1.0, max(w), math.log1p(sum(w)), math.log1p(len(w)), sum(w) / max(n, 1) * 10, float(any(t for _, t in found)), math.log1p(sum(w) / math.sqrt(n + 1))]


@dataclass
class Model:
    grammar: Grammar
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.ones((len(features), 1)), (features - self.mean) / self.scale], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the intercept and is not shrunk."""
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(r), x.T @ (y - p) - r * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _ratio(a: float, b: float, pos: float, neg: float) -> float:
    """Likelihood ratio (G) of a word in a of pos toxic and b of neg other rows."""
    n = pos + neg
    part = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
    return 2 * (part(a, (a + b) * pos / n) + part(b, (a + b) * neg / n) + part(pos - a, (n - a - b) * pos / n) + part(neg - b, (n - a - b) * neg / n))


def learn_lexicon(rows: DataFrame, pos: int, neg: int) -> dict[str, float]:
    """Insult words and stems (``stem*``) with their log odds, from rows text and toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in _TOKEN.findall((t or "").lower()) if len(w) > 1}
                seen[y].update(words)
                seen[y].update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield flush(seen)
                seen[0].clear(), seen[1].clear()
        yield flush(seen)

    def flush(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = sorted(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["w", "a", "b"])

    counts = rows.mapInArrow(count, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # nearly only toxic rows have it: what remains is bounded by the sample's toxic vocabulary
    share = F.when(F.col("w").endswith("*"), STEM_SHARE).otherwise(MIN_SHARE)
    found = counts.where((F.col("a") >= 3) & (F.col("a") >= share * (F.col("a") + F.col("b")))).collect()
    odds = lambda r: math.log((r.a + 0.5) / (pos + 1)) - math.log((r.b + 0.5) / (neg + 1))
    return {r.w: odds(r) for r in found if _ratio(r.a, r.b, pos, neg) >= MIN_RATIO}


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, rows / max(n, 1)))))
    few = known.count() <= 4 * rows
    sample = docs.join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    grammar = Grammar()
    if not pos or not neg:
        return Model(grammar, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([-3.0, 6.0, *[0.0] * (N_FEATURES - 1)]))
    grammar = Grammar(SEEDS | learn_lexicon(sample, pos, neg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = sample.mapInArrow(run, "x array<double>, y int").toArrow()
    x, y = np.array(got.column("x").to_pylist()), np.array(got.column("y").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order of rows
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(grammar, mean, scale, logistic(np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1), y))


def score(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([model.grammar.features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return apply(F.coalesce(F.col(text).cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score(fit(docs, labels, rows)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
