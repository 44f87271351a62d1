"""Quality by a factorisation machine over hashed words, structure and size.

Each text is a sparse vector: hashed words with damped frequencies, and one-of-n
bins of statistics of its structure and size. A score adds a linear part and the
interactions of all pairs of features, each pair weighted by the product of two
short factors. The sum over pairs is half the difference between the squared sum
and the sum of squares of the factors, so a score is linear in the text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import WORD
from glyphlake.llm.toxicity import id_fold, labelled_sample

#: Labelled rows that the model is fitted to at most, drawn by a hash of their id.
SAMPLE = 12_000
WORDS, BINS, FACTORS = 1 << 13, 16, 6
ROUNDS, BATCH, RATE, RIDGE = 12, 64, 0.08, 1e-4
CUT = 0.3

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(text: str, found: list[str]) -> list[float]:
    """Shares and means that describe the structure of a text; all 0 for an empty one."""
    if not text:
        return [0.0] * 15
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, n = raw.sum(), max(1, len(found))
    letters = max(1, raw[_LETTERS].sum())
    lines = text.split("\n")
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    return [
        raw[65:91].sum() / letters, raw[48:58].sum() / size, raw[124] / n, raw[33] / n, raw[[35, 36, 37, 38, 42]].sum() / n,
        raw[46] / n, raw[44] / n, raw[[60, 62, 123, 125]].sum() / n, marks / size, raw[32] / size,
        letters / n, len(set(found)) / n, len(set(lines)) / len(lines), n / len(lines), np.log1p(size)]


def features(text: str, edges: np.ndarray, find) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the sparse vector of a text."""
    found = find(text.lower())
    counts: dict[int, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    hashed = np.fromiter((zlib.crc32(w.encode()) for w in counts), np.int64, len(counts)) % WORDS
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(value):
        value /= np.sqrt((value * value).sum())
    s = np.array(statistics(text, found))
    bins = (s[:, None] > edges).sum(axis=1)
    return (np.concatenate([hashed, WORDS + np.arange(len(s)) * BINS + bins]),
            np.concatenate([value, np.full(len(s), 0.5)]))


@dataclass
class QualityModel:
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """Probability of label 1."""
        v = self.factors[index] * value[:, None]
        total = v.sum(axis=0)
        z = self.bias + self.linear[index] @ value + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_rows(texts: list[str], y: np.ndarray) -> QualityModel:
    """Adaptive gradient descent on the logistic loss, in a fixed order."""
    find = re.compile(WORD).findall
    stats = np.array([statistics(t, find(t.lower())) for t in texts]).reshape(len(texts), len(statistics("", [])))
    edges = (np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(texts)
             else np.zeros((len(statistics("", [])), BINS - 1)))
    # The outer bins are narrow, for rare kinds of text.
    if len(texts):
        edges[:, 0], edges[:, -1] = np.quantile(stats, [0.01, 0.99], axis=0)
    n = WORDS + edges.shape[0] * BINS
    rng = np.random.default_rng(3)
    model = QualityModel(edges, 0.0, np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)))
    if not len(texts) or len(set(y.tolist())) < 2:
        model.factors[:] = 0
        model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        return model
    rows = [features(t, edges, find) for t in texts]
    seen, seen_v, seen_b = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for _ in range(ROUNDS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            index, value = (np.concatenate([rows[i][k] for i in some]) for k in (0, 1))
            ends = np.cumsum([len(rows[i][0]) for i in some])
            starts, who = np.r_[0, ends[:-1]], np.repeat(np.arange(len(some)), np.diff(np.r_[0, ends]))
            v = model.factors[index] * value[:, None]
            total = np.add.reduceat(v, starts)
            z = (model.bias + np.add.reduceat(model.linear[index] * value, starts)
                 + 0.5 * (total ** 2 - np.add.reduceat(v * v, starts)).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            touched, where = np.unique(index, return_inverse=True)
            g = np.bincount(where, error[who] * value) + RIDGE * model.linear[touched]
            slope = (error[who] * value)[:, None] * (total[who] - v)
            gv = np.stack([np.bincount(where, slope[:, f]) for f in range(FACTORS)], axis=1) + RIDGE * model.factors[touched]
            seen[touched] += g * g
            seen_v[touched] += gv * gv
            seen_b += error.sum() ** 2
            model.linear[touched] -= RATE * g / np.sqrt(seen[touched])
            model.factors[touched] -= RATE * gv / np.sqrt(seen_v[touched])
            model.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return model


def fit(docs: DataFrame, labels: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text",
        bound: int = SAMPLE) -> QualityModel:
    """Learn from at most ``bound`` labelled rows that fulfil ``use``."""
    sample = labelled_sample(docs, labels, "quality", use, bound, doc_id, text).select("doc_id", "y", "text").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit_rows(sample.column("text").to_pylist(), sample.column("y").to_numpy().astype(float))


def _scorer(model: QualityModel):
    find = re.compile(WORD).findall

    def score(column) -> np.ndarray:
        return np.array([model.score(*features(t.as_py() or "", model.edges, find)) for t in column])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``.

    Labels are learned from rows outside of fold 0 of 5. Null and empty texts
    are scored by their structure alone. An id labelled twice has the higher
    label; null ids, null labels and labels without a document teach nothing;
    without labels every score is 0.5. Repeated rows are scored each; other
    columns are not carried.
    """
    model = fit(docs, labels, id_fold(F.col("doc_id"), 5) != 0, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        score = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")), pa.float64())],
                                             ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, cut: float = CUT, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, with all their columns.

    Null texts are scored as empty ones. Repeated rows and rows without an id are judged each by their own text; an
    empty table stays empty.
    """
    model = fit(docs, labels, id_fold(F.col("doc_id"), 5) != 0, doc_id, text)

    def run(batches):
        score = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(text)) >= cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
