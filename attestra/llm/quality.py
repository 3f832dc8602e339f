"""Quality by ordinal cumulative-link regression over hashed text.

P(grade >= k) = sigmoid(w . x - t_k): one weight vector over hashed features is shared by all grades, and the
thresholds t_1 < t_2 < ... are kept in order by fitting their gaps as exponentials. The tail probability at a
grade selects documents; the expected grade ranks them.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Workspace, in_worker, labelled_sample, slices

DIMENSIONS = 1 << 16
TOKEN = re.compile(r"\S+")
#: Letters and digits by kind; marks that tables, code and shouting leave stay, other marks are one kind.
_SHAPES = ((regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{Ll}+"), "a"), (regex.compile(r"[\p{L}\p{M}--[Aa]]+", regex.V1), "l"), (regex.compile(r"\p{N}+"), "9"), (regex.compile(r"[^Aal9.,!?$%&*#|@=<>{}]"), "."))
MAX_TOKENS = 200_000


class Hasher:
    """Whole texts to sparse rows. Features: words, forms (case, digits, marks), pairs of forms, repeats.

    A token's places are worked out once and kept in arrays, so a text is numbers from its first look-up on.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self._restart()

    def _restart(self) -> None:
        self._number: dict[str, int] = {}
        self._words = np.zeros(1024, np.int64)
        self._forms = np.zeros(1024, np.int64)

    def place(self, feature: str) -> int:
        return zlib.crc32(feature.encode(errors="replace")) % self.dimensions

    def _learn(self, token: str) -> None:
        k = len(self._number)
        if k == len(self._words):
            self._words, self._forms = (np.concatenate([x, np.zeros_like(x)]) for x in (self._words, self._forms))
        form = token
        for pattern, name in _SHAPES:
            form = pattern.sub(name, form)
        self._words[k], self._forms[k] = self.place("w" + token.lower()), self.place("s" + form[:12])
        self._number[token] = k

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places and values: roots of shares, by group of features."""
        tokens = TOKEN.findall(text)
        if len(self._number) > MAX_TOKENS:
            self._restart()
        for token in set(tokens).difference(self._number):
            self._learn(token)
        n = len(tokens)
        at = [np.array([self.place("repeats"), self.place("distinct"), self.place("size")])]
        values = [np.array([0.0, 0.0, 0.3 * np.log1p(n)])]
        if n:
            found = np.fromiter(map(self._number.__getitem__, tokens), np.int64, n)
            words, times = np.unique(found, return_counts=True)
            values[0][:2] = 3.0 * np.count_nonzero(found[1:] == found[:-1]) / n, 3.0 * len(words) / n
            at.append(self._words[words])
            values.append(np.sqrt(times / n))
            forms = self._forms[found]
            pairs = (np.concatenate(([0], forms[:-1])) * 1_000_003 + forms * 8_191 + 12_345) % self.dimensions
            for group in (forms, pairs):
                place, times = np.unique(group, return_counts=True)
                at.append(place)
                values.append(2.0 * np.sqrt(times / n))
        places, inverse = np.unique(np.concatenate(at), return_inverse=True)
        return places, np.bincount(inverse, np.concatenate(values))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # one below each grade but the lowest
    grades: list[int]

    def tails(self, z: float) -> np.ndarray:
        """P(grade >= k) for every grade but the lowest."""
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -40, 40)))

    def expected(self, tails: np.ndarray) -> float:
        return float(self.grades[0] + (tails * np.diff(self.grades)).sum())


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], ratings: list[int], dimensions: int = DIMENSIONS, steps: int = 200, ridge: float = 2e-4, rate: float = 0.15) -> Ordinal:
    """Maximum likelihood by full-batch Adam. One grade only, or none: no thresholds, so that grade is certain."""
    grades = sorted(set(ratings)) or [0]
    if len(grades) < 2:
        return Ordinal(np.zeros(dimensions, np.float32), np.zeros(0), grades)
    y = np.searchsorted(grades, ratings)
    sizes = np.array([len(r[0]) for r in rows])
    owner, at, v = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    k = len(grades) - 1
    above = np.array([np.mean(y > j) for j in range(k)])
    t0 = -np.log(above / (1 - above))
    p = np.concatenate([np.zeros(dimensions), [t0[0]], np.log(np.maximum(np.diff(t0), 1e-3))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, head, gaps = p[:dimensions], p[dimensions], np.exp(p[dimensions + 1 :])
        t = head + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(owner, v * w[at], len(rows))
        edge = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -40, 40)))  # P(y > j)
        full = np.concatenate([np.ones((len(rows), 1)), edge, np.zeros((len(rows), 1))], axis=1)
        prob = np.maximum(full[np.arange(len(rows)), y] - full[np.arange(len(rows)), y + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), edge * (1 - edge), np.zeros((len(rows), 1))], axis=1)
        upper, lower = slope[np.arange(len(rows)), y] / prob, slope[np.arange(len(rows)), y + 1] / prob
        dz = (upper - lower) / len(rows)
        dt = np.zeros((len(rows), k + 2))
        dt[np.arange(len(rows)), y] -= upper
        dt[np.arange(len(rows)), y + 1] += lower
        dt = dt[:, 1 : k + 1].mean(0)
        g = np.concatenate([np.bincount(at, v * dz[owner], dimensions) - ridge * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        p += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
    t = p[dimensions] + np.concatenate([[0.0], np.cumsum(np.exp(p[dimensions + 1 :]))])
    return Ordinal(p[:dimensions].astype(np.float32), t, grades)


def fit(ws: Workspace, docs: DataFrame, labels: DataFrame, rating: str = "quality", sample: int = 6_000, id_col: str = "doc_id", text_col: str = "text", all_labels: bool = False) -> Ordinal:
    """Fit on at most `sample` rated documents, chosen by a hash of their ids; unless all_labels, those with
    crc32(doc_id) mod 5 = 0 are held out. Rows are hashed on the executors; the driver gets sparse rows only."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5

    def work(batches):
        h = in_worker(("hasher", DIMENSIONS), Hasher)
        for batch in slices(batches):
            rows = [h.row(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0].astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())], ["label", "doc_id", "at", "value"])

    chosen = labelled_sample(labels, docs, rating, sample, id_col, text_col, None if all_labels else rest != 0).select("label", "text", "doc_id")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    got = ws.save(chosen.mapInArrow(work, f"label int, doc_id {kind}, at binary, value binary"), "rated").orderBy("doc_id").collect()
    return fit_ordinal([(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["value"], "<f4")) for r in got], [r["label"] for r in got])


def quality(docs: DataFrame, model: Ordinal, grade: int | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, expected_grade, tail_probability of `grade` (default: the highest) or better, selected.

    A null text counts as empty; a null id stays null; repeated rows give repeated results; only id and text
    are read. With one grade known, every row gets it for certain. One pass, no shuffle.
    """
    weights, thresholds, grades = model.weights, model.thresholds, model.grades
    place = (grades.index(grade) if grade is not None else len(grades) - 1) - 1

    def work(batches):
        own, h = Ordinal(weights, thresholds, grades), in_worker(("hasher", len(weights)), lambda: Hasher(len(weights)))
        for batch in slices(batches):
            expected, tail = [], []
            for t in batch.column(1):
                at, v = h.row(t.as_py() or "")
                p = own.tails(float(weights[at] @ v))
                expected.append(own.expected(p))
                tail.append(float(p[place]) if place >= 0 and len(p) else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([x >= least for x in tail], pa.bool_())], ["doc_id", "expected_grade", "tail_probability", "selected"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(work, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double, selected boolean")


def selected_rows(docs: DataFrame, model: Ordinal, grade: int | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose tail probability is at least `least`, with all their columns, in one pass."""
    weights, thresholds, grades = model.weights, model.thresholds, model.grades
    place = (grades.index(grade) if grade is not None else len(grades) - 1) - 1
    if place < 0 or not len(thresholds):
        return docs

    @F.pandas_udf("double")
    def tail(texts: pd.Series) -> pd.Series:
        own, h = Ordinal(weights, thresholds, grades), in_worker(("hasher", len(weights)), lambda: Hasher(len(weights)))
        out = []
        for t in texts:
            at, v = h.row(t or "")
            out.append(float(own.tails(float(weights[at] @ v))[place]))
        return pd.Series(out, dtype=float)

    return docs.where(tail(F.col(text_col)) >= least)
