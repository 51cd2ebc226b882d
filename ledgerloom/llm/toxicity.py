"""Toxicity by a weighted finite-state grammar of clauses.

A lexical automaton turns words into symbols; transducers for insults, threats, negation, reported speech and
targets, composed into one machine, mark each insult, threat or word of violence of a clause as negated, reported or
aimed at a target. What counts is the matched clause with its marks, not the word. The lexicon of insults
(words, and stems of words) and the weights of the marks are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, raw_strings, stored, text_or_empty

SAMPLE = 20_000  # labelled documents that the grammar is fitted on, at most about so many
STEMS = (4, 5, 6, 7)  # letters of a stem
EVIDENCE = 12.0  # nats by which an entry must beat chance
RATIO = 20.0  # times that an entry must be likelier in toxic documents

# Closed classes of words (English, German, French, Spanish), and insults to start from.
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie ne jamais pas aucun nunca jamás tampoco".split()
REPORTING = "said says wrote writes called calls quoted claimed alleged reportedly sagte sagt schrieb behauptete disait écrit prétend dijo dice escribió afirmó".split()
TARGETS = "you your you're he she they him them du dich euch ihr ihn tu toi vous ils usted ustedes ellos".split()
INTENTS = "will shall gonna going must werde werden wirst wird soll vais va allons voy vas vamos".split()
VIOLENCE = "kill murder destroy hurt strangle shoot stab töten umbringen vernichten tuer assassiner matar asesinar destruir".split()
INSULTS = "idiot moron stupid".split()

#: Kinds of matched clauses and their weights before any label is seen; a fit moves them.
PRIOR = {
    "insult": 2.0, "insult+target": 3.0, "insult+negated": 0.2, "insult+reported": 0.5,
    "threat": 0.5, "threat+target": 3.0, "threat+negated": 0.0, "threat+reported": 0.3,
    "violence": 0.2, "violence+target": 2.5, "violence+negated": 0.0, "violence+reported": 0.2,
}
KINDS = list(PRIOR)
BIAS = -3.0
STIFF = 0.05  # how firmly the prior weights are held

_BREAKS = ".!?;:\n\r…"
_CLAUSE = re.compile(f"[{_BREAKS}]")
REACH = 4  # words that a negation or an intent reaches
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass(frozen=True)
class Transducer:
    """A deterministic finite-state transducer: (state, symbol) to (state, symbol); other symbols pass."""

    arcs: dict
    start: object = 0

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, alphabet: set[str]) -> Transducer:
    """The machine that feeds what ``first`` puts out to ``second``, over all states they reach together."""
    arcs, start = {}, (first.start, second.start)
    todo, seen = [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            a2, middle = first.step(a, symbol)
            b2, out = second.step(b, middle)
            arcs[state, symbol] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(arcs, start)


SYMBOLS = {"slur", "violence", "intent", "target", "negation", "report", "word"}
MARKABLE = ("insult", "threat", "violence")


def insults() -> Transducer:
    """A slur is an insult, wherever it stands."""
    return Transducer({(0, "slur"): (0, "insult")})


def threats(reach: int = REACH) -> Transducer:
    """Violence within ``reach`` words after an intent is a threat, which uses the intent up."""
    arcs = {(s, "intent"): (reach, "word") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x) for x in ("word", "target", "negation", "report", "insult")}
        arcs[s, "violence"] = (0, "threat")
    return Transducer(arcs)


def negations(reach: int = REACH) -> Transducer:
    """What follows a negation within ``reach`` words is negated."""
    arcs = {(s, "negation"): (reach, "word") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x) for x in ("word", "target", "report")}
        arcs |= {(s, x): (s - 1, f"{x}+negated") for x in MARKABLE}
    return Transducer(arcs)


def marks(symbol: str, mark: str) -> Transducer:
    """What follows ``symbol`` in the clause has the mark, if it has no other."""
    return Transducer({(s, symbol): (1, "word") for s in (0, 1)} | {(1, x): (1, f"{x}+{mark}") for x in MARKABLE})


def grammar() -> Transducer:
    """Insults, then threats, negation, reported speech and targets, each reading what the one before puts out."""
    machine = insults()
    for following in (threats(), negations(), marks("report", "reported"), marks("target", "target")):
        machine = compose(machine, following, SYMBOLS)
    return machine


class Scorer:
    """Applies a lexicon and the grammar to whole texts."""

    def __init__(self, lexicon: dict[str, float], weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.words = {w: v for w, v in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in lexicon.items() if w.endswith("*")}
        self.sizes = sorted({len(s) for s in self.stems})
        classes = {"negation": NEGATIONS, "report": REPORTING, "target": TARGETS, "intent": INTENTS, "violence": VIOLENCE}
        self.fixed = {w: symbol for symbol, words in classes.items() for w in words}
        self.machine = grammar()
        self.finder = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *VIOLENCE]:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def entry(self, word: str) -> float:
        """The weight of an insult, 0 for other words: a word of the lexicon, or one with a stem of it."""
        if value := self.words.get(word):
            return value
        for n in self.sizes:
            if len(word) >= n and (value := self.stems.get(word[:n])):
                return value
        return 0.0

    def events(self, text: str) -> dict[str, float]:
        """The sum of entry weights of each kind of matched clause."""
        low, found = text.lower(), dict.fromkeys(KINDS, 0.0)
        done = 0
        for last, size in self.finder.iter(low):
            at = last - size + 1
            if at < done or (at and (low[at - 1].isalpha())):
                continue
            # The clause around the match, and each insult or threat in it.
            start, stop = self._clause(low, at, done)
            done = stop
            state, pending, aimed = self.machine.start, [], False
            for m in _WORD.finditer(low, start, stop):
                word = m.group()
                value = self.entry(word)
                symbol = "slur" if value else self.fixed.get(word, "word")
                aimed |= symbol == "target"
                state, out = self.machine.step(state, symbol)
                if symbol in ("slur", "violence"):
                    pending.append((out, value or 1.0))
            for out, value in pending:  # a target may also follow
                found[f"{out}+target" if aimed and out in MARKABLE else out] += value
        return found

    @staticmethod
    def _clause(low: str, at: int, after: int) -> tuple[int, int]:
        """Where the whole clause around ``at`` begins (not before ``after``, the last one's end) and ends."""
        end = _CLAUSE.search(low, at)
        return max(after, *(low.rfind(c, after, at) + 1 for c in _BREAKS)), end.start() if end else len(low)

    def features(self, text: str) -> np.ndarray:
        found = self.events(text)
        return np.array([math.log1p(found[k]) for k in KINDS])

    def score(self, text: str) -> float:
        x = self.bias + float(self.features(text) @ np.array([self.weights[k] for k in KINDS]))
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the documents that may be learned from, sampled by a hash down to about ``SAMPLE``."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held).distinct()
    n = known.count()
    if n > SAMPLE:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(known, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words, and stems (with a trailing *), that beat chance in toxic documents, with their log odds.

    Document counts of every word and stem of the sample are added up on the executors; only entries that
    pass the test come to the driver, all of them: the sample bounds how many there can be.
    """
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    base = dict.fromkeys(INSULTS, 3.0)
    if not toxic or not clean:
        return base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen = set(_WORD.findall(text.lower()))
                for x in seen | {w[:n] + "*" for w in seen for n in STEMS if len(w) >= n}:
                    counts.setdefault(x, [0, 0])[label] += 1
            # An entry never seen in this batch's toxic documents still counts against itself.
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["entry", "k", "m"])

    chance = toxic / (toxic + clean)
    n, rate = F.col("k") + F.col("m"), F.col("k") / (F.col("k") + F.col("m"))
    other = F.when(F.col("m") > 0, F.col("m") * F.log((1 - rate) / (1 - chance))).otherwise(0.0)
    evidence = F.col("k") * F.log(rate / chance) + other
    odds = F.log(((F.col("k") + 0.5) / (toxic + 1)) / ((F.col("m") + 0.5) / (clean + 1)))
    summed = mapped(sample, run, "entry string, k long, m long").groupBy("entry").agg(F.sum("k").alias("k"), F.sum("m").alias("m"))
    found = summed.where((F.col("k") > 0) & (n >= 3) & (rate > chance)).select("entry", evidence.alias("evidence"), odds.alias("odds")).where((F.col("evidence") >= EVIDENCE) & (F.col("odds") >= math.log(RATIO)))
    rows = [(r[0], float(r[2])) for r in found.collect()]
    # A short stem stands for the longer stems and words that begin with it, unless they are clearer.
    lexicon: dict[str, float] = {}
    for entry, value in sorted(rows, key=lambda x: (len(x[0].rstrip("*")), x[0])):
        bare = entry.rstrip("*")
        if not any(bare.startswith(bare[:k]) and lexicon.get(bare[:k] + "*", -1.0) >= value - 0.7 for k in STEMS if k <= len(bare)):
            lexicon[entry] = value
    return base | lexicon


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], dict[str, float], float]:
    """The lexicon, the weights of clause kinds, and the bias.

    Learned from labelled rows whose crc32(doc_id) mod 5 is not 0, a sample of at most about ``SAMPLE``;
    without labels of both kinds the prior holds. Labels that are null or neither 0 nor 1 are left out; null texts are empty.
    """
    sample = stored(_labelled(docs, labels), "sample")
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, PRIOR, BIAS)
        for batch in batches:
            x = [scorer.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "y"])

    # Equal feature rows are counted before they come to the driver; most are all zero.
    grouped = mapped(sample, run, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if len({r["y"] for r in grouped}) < 2:
        return lexicon, PRIOR, BIAS
    x = np.array([[1.0, *r["x"]] for r in grouped])
    y, n = np.array([r["y"] for r in grouped], float), np.array([r["n"] for r in grouped], float)
    start = np.array([BIAS, *PRIOR.values()])
    w = start.copy()
    for _ in range(50):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + STIFF * (w - start)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + STIFF * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return lexicon, {k: float(v) for k, v in zip(KINDS, w[1:], strict=True)}, float(w[0])


def toxicity(docs: DataFrame, labels: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 from 0.5 on): whole texts, scored by nothing else.

    A null text is empty and scores the bias. All rows and columns of ``docs`` stay, repeated ones too; columns that
    have the names of the new ones give way to them.
    """
    lexicon, weights, bias = fit(docs, labels)
    docs = docs.drop(score, predicted)
    position = docs.columns.index("text")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, weights, bias)
        for batch in batches:
            at, data = raw_strings(batch.column(position))
            flat, ends = data.tobytes(), at.tolist()
            found = np.array([scorer.score(flat[a:b].decode()) for a, b in zip(ends[:-1], ends[1:], strict=True)])
            yield pa.record_batch([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*batch.schema.names, score, predicted])

    return mapped(docs, run, ", ".join([*types, f"`{score}` double", f"`{predicted}` int"]))
