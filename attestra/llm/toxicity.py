"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult (with a learned weight), threat, target, negation, reported speech, or other.
Three transducers read a clause and mark its insults and threats: as negated within three words of a negation,
as reported after a verb of speech, as aimed after a target. Their composition is made pair of states by pair
of states when first met. A clause's score is the weight of its best marks added up; a document's score is a
logistic function of its clause scores. Weights of insults, and the function, are learned from labelled rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Workspace, labelled_sample, slices

#: Fixed word lists: function words of the four languages of the corpus.
THREAT = frozenset("kill hurt destroy burn beat stab shoot töten schlagen verbrennen vernichten tuer frapper brûler détruire matar golpear quemar destruir".split())
TARGET = frozenset("you your you're they them their he she him her it those these du dich dir ihr euch sie er tu toi vous ils elles il elle tú vosotros usted ustedes ellos ellas él ella".split())
NEGATION = frozenset("not no never nor isn't aren't don't doesn't won't nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca ningún ninguna jamás tampoco".split())
REPORTED = frozenset("said says say told tells wrote writes quoted quotes claimed claims called reported sagte sagt schrieb zitierte behauptete dit écrit cité rapporte affirme dijo dice escribió citó afirma".split())

WORD = regex.compile(r"[\p{L}\p{M}]+(?:'[\p{L}]+)?")
CLAUSE = regex.compile(r"[.!?;:\n\r]+")
PREFIXES = range(3, 9)
OTHER = "o"


class Marker:
    """A deterministic transducer: symbol in, symbol with marks out. step(state, symbol) -> (state, marks)."""

    start = 0

    def step(self, state, symbol):
        raise NotImplementedError


class After(Marker):
    """Puts a mark on matches that follow a trigger by at most `reach` words (0: to the end of the clause)."""

    def __init__(self, trigger: str, mark: str, reach: int):
        self.trigger, self.mark, self.reach = trigger, mark, reach

    def step(self, state, symbol):
        marks = self.mark if state and symbol in "it" else ""
        if symbol == self.trigger:
            return (self.reach or 1), marks
        return (state if not self.reach else max(state - 1, 0)), marks


class Composed(Marker):
    """The composition of two transducers; its states and moves are made on demand and kept."""

    def __init__(self, first: Marker, second: Marker):
        self.first, self.second, self.start, self.known = first, second, (first.start, second.start), {}

    def step(self, state, symbol):
        move = self.known.get((state, symbol))
        if move is None:
            a, x = self.first.step(state[0], symbol)
            b, y = self.second.step(state[1], symbol)
            move = self.known[state, symbol] = ((a, b), x + y)
        return move


@dataclass
class Grammar:
    """insults: weights by word ("=word") and by prefix ("stem"). Factors multiply a match by its marks."""

    insults: dict[str, float] = field(default_factory=dict)
    threat_weight: float = 1.5
    negated: float = 0.2
    reported: float = 0.35
    aimed: float = 1.25
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self._machine = Composed(Composed(After("n", "-", 3), After("r", "r", 0)), After("y", "+", 5))
        self._symbols: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        known = self._symbols.get(word)
        if known is None:
            weight = max([self.insults.get("=" + word, 0.0), *(self.insults.get(word[:n], 0.0) for n in PREFIXES if len(word) > n)])
            if weight > 0:
                known = ("i", weight)
            else:
                known = next(((s, 1.0) for s, words in (("t", THREAT), ("n", NEGATION), ("r", REPORTED), ("y", TARGET)) if word in words), (OTHER, 0.0))
            if len(self._symbols) > 500_000:
                self._symbols.clear()
            self._symbols[word] = known
        return known

    def clause(self, words: list[tuple[str, float]]) -> float:
        state, total = self._machine.start, 0.0
        aimed = any(s == "y" for s, _ in words)
        for symbol, weight in words:
            state, marks = self._machine.step(state, symbol)
            if symbol == "i" or (symbol == "t" and aimed):
                w = weight if symbol == "i" else self.threat_weight
                w *= (self.negated if "-" in marks else 1.0) * (self.reported if "r" in marks else 1.0) * (self.aimed if "+" in marks else 1.0)
                total += w
        return total

    def measures(self, text: str) -> tuple[float, float, float, float]:
        """Of matched clauses: log of the summed score, the best score, log of their number, log of score a 100 words."""
        scores, n = [], 0
        for part in CLAUSE.split(text.lower()):
            words = [self.symbol(w) for w in WORD.findall(part)]
            n += len(words)
            if any(s in "it" for s, _ in words):
                scores.append(self.clause(words))
        total = sum(scores)
        return math.log1p(total), max(scores, default=0.0), math.log1p(len(scores)), math.log1p(100 * total / max(n, 1))

    def score(self, text: str) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.measures(text)))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(ws: Workspace, docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 12_000, lexicon: int = 4_000, min_docs: int = 5, min_z: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Learn a grammar from at most `sample` labelled documents; those with crc32(doc_id) mod 5 = 0 are held out.

    Insults are words and word beginnings found in more toxic documents than chance explains (z of the log odds
    at least min_z, at least min_docs documents); the `lexicon` best are collected. The logistic function is
    fitted on documents with remainder 4, from which no insult is learned. Without labels of both kinds the
    lexicon is empty and the score is the share of toxic labels.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = ws.save(labelled_sample(labels, docs, label, sample, id_col, text_col, rest != 0).withColumn("rest", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5), "sample")
    n = {r["label"]: r["n"] for r in rows.where("rest <> 4").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)

    def features(batches):
        for batch in batches:
            counts: list[Counter] = [Counter(), Counter()]
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(WORD.findall(text.as_py().lower()))
                counts[min(y, 1)].update({"=" + w for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) > k})
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["feature", "clean", "toxic"])

    grammar = Grammar()
    if n0 and n1:
        found = rows.where("rest <> 4").select("label", "text").mapInArrow(features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c0"), F.sum("toxic").alias("c1")).where(F.col("c1") >= min_docs)
        odds = F.log((F.col("c1") + 0.5) / (n1 + 1.0)) - F.log((F.col("c0") + 0.5) / (n0 + 1.0))
        found = found.withColumn("w", odds).withColumn("z", F.col("w") / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5)))
        best = found.where((F.col("z") >= min_z) & (F.col("w") >= 1.5)).orderBy(F.desc("z"), "feature").limit(lexicon).select("feature", "w").collect()
        grammar.insults = {r["feature"]: min(r["w"], 6.0) for r in best}
    insults = grammar.insults

    def measured(batches):
        g = Grammar(insults)
        for batch in slices(batches):
            rows_ = [g.measures(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows_], pa.float64()) for k in range(4))], ["label", "a", "b", "c", "d"])

    got = rows.where("rest = 4").select("label", "text").mapInArrow(measured, "label int, a double, b double, c double, d double").collect()
    y = np.array([min(r["label"], 1) for r in got], float)
    x = np.array([[1.0, r["a"], r["b"], r["c"], r["d"]] for r in got]).reshape(len(got), 5)
    w = np.zeros(5)
    share = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.0
    if n0 and n1 and 0 < y.sum() < len(y):
        ridge = np.diag([1e-6, 0.05, 0.05, 0.05, 0.05])
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(5), x.T @ (y - p) - ridge @ w)
            w += np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-8:
                break
    elif insults:
        w[:2] = math.log(share / (1 - share)), 1.0
    else:
        w[0] = math.log(share / (1 - share)) if 0 < share < 1 else -30.0
    grammar.coefficients = tuple(float(v) for v in w)
    return grammar


def toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    A null text counts as empty and gets the score of no match; a null id is written "null" for held_out.
    Repeated rows give repeated results; only id and text are read. One pass, no shuffle.
    """
    insults, coefficients = dict(grammar.insults), grammar.coefficients

    def work(batches):
        g = Grammar(insults, coefficients=coefficients)
        for batch in slices(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            scores = [g.score(t) for t in texts]
            kinds = [pa.bool_(), pa.float64(), pa.int32()]
            columns = [[held_out("null" if i is None else i) for i in batch.column(0).to_pylist()], scores, [int(s >= 0.5) for s in scores]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(work, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
