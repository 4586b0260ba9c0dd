"""Toxicity scores by a character n-gram linear classifier on naive Bayes features.

A text's features are the presence of its hashed byte n-grams, lower-cased and with white space runs as one space. Each
is scaled by its naive Bayes log-count ratio, log((p + a)/|p + a|) - log((q + a)/|q + a|) for its counts p in toxic and
q in other labelled texts, and a logistic regression with an L2 penalty is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import doc_text, task

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Lengths of the n-grams in bytes, bits of a feature number.
ORDERS, BITS = (4, 5, 6, 7), 22
#: Labelled rows that a classifier is fitted on, at most; the choice follows a hash of doc_id.
SAMPLE_ROWS = 8_000
#: A feature is kept for the regression at this chi-square against the label, or as one of the first LEAST_FEATURES.
MIN_CHI2, LEAST_FEATURES, MOST_FEATURES = 40.0, 64, 1 << 16
#: POSITIVE_WEIGHT: what a row of label 1, the rarer, counts in the regression.
SMOOTHING, PENALTY, STEPS, POSITIVE_WEIGHT = 1.0, 1e-4, 800, 1.5
_SALT = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """The feature numbers of a text's n-grams, an array for each order, repeats included."""
    data = np.frombuffer(b" %b " % b" ".join(text.lower().encode().split()), np.uint8)
    salted = _SALT[data]
    rolling = salted
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        rolling = rolling[:-1] * np.uint32(0x9E3779B1) + salted[n - 1 :]
        if n in ORDERS:
            mixed = rolling ^ (rolling >> np.uint32(15))
            yield ((mixed * np.uint32(0x85EBCA6B)) ^ np.uint32(n << 27)) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class NaiveBayesLinear:
    """features: sorted feature numbers; weights: log-count ratio times coefficient of each; bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str, wanted: np.ndarray) -> float:
        """The probability of the label. wanted: self.mask(), made once."""
        found = [g[wanted[g]] for g in ngrams(text)]
        hits = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)
        z = self.bias + float(self.weights[np.searchsorted(self.features, hits)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def mask(self) -> np.ndarray:
        wanted = np.zeros(1 << BITS, bool)
        wanted[self.features] = True
        return wanted


def log_count_ratios(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The naive Bayes log-count ratio of each feature, of its counts in texts of label 1 and 0."""
    p, q = p + SMOOTHING, q + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def chi_squares(p: np.ndarray, q: np.ndarray, n_pos: float, n: float) -> np.ndarray:
    """The chi-square of each feature against the label, of its counts in texts of label 1 and 0; 0 for a feature of no or all texts."""
    both = p + q
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(n * (p * (n - n_pos - q) - q * (n_pos - p)) ** 2 / (n_pos * (n - n_pos) * both * (n - both)))


def fit(texts: list[str], labels: list[int]) -> NaiveBayesLinear:
    """Fit on labelled texts. Without rows of both labels the score is the share of label 1 (one half without rows)."""
    y = np.array(labels, float)
    n, n_pos = len(y), float(y.sum())
    if not 0 < n_pos < n:
        share = (n_pos + 0.5) / (n + 1)
        return NaiveBayesLinear(np.empty(0, np.uint32), np.empty(0), float(np.log(share / (1 - share))))
    present = lambda text: np.unique(np.concatenate([*ngrams(text), np.empty(0, np.uint32)]))
    size = 1 << BITS
    p, q = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for text, label in zip(texts, y, strict=True):
        (p if label else q)[present(text)] += 1
    chi2 = np.empty(size)
    for at in range(0, size, 1 << 16):  # a part at a time, for each makes several arrays
        part = slice(at, at + (1 << 16))
        chi2[part] = chi_squares(p[part].astype(float), q[part].astype(float), n_pos, n)
    found = np.flatnonzero(chi2 >= MIN_CHI2)
    if len(found) < LEAST_FEATURES:
        found = np.flatnonzero((p > 0) | (q > 0))
    strong = max(LEAST_FEATURES, int((chi2[found] >= MIN_CHI2).sum()))
    kept = np.sort(found[np.argsort(-chi2[found], kind="stable")][: min(strong, MOST_FEATURES)]).astype(np.uint32)
    p, q = p[kept].astype(float), q[kept].astype(float)
    del chi2, found
    ratio = log_count_ratios(p, q)

    wanted = np.zeros(size, bool)
    wanted[kept] = True
    # Features are hashed twice, so that those of all texts needn't be held at once.
    rows = [np.searchsorted(kept, row[wanted[row]]) for row in map(present, texts)]
    columns, of = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    del rows
    w, b = np.zeros(len(kept)), float(np.log(n_pos / (n - n_pos)))
    m1, m2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z = b + np.bincount(of, weights=(ratio * w)[columns], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * np.where(y > 0, POSITIVE_WEIGHT, 1)
        grad = np.append(ratio * np.bincount(columns, weights=error[of], minlength=len(kept)) / n + PENALTY * w, error.mean())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return NaiveBayesLinear(kept, ratio * w, b)


def held_out(doc_id):
    """Whether a row is kept from learning: crc32 of doc_id as text, mod 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> NaiveBayesLinear:
    """Fit on at most `sample_rows` labelled rows that aren't held out, in one task; only the model reaches the driver.

    Rows of `labels` with a null id or label don't count; an id with several labels counts with its largest.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = doc_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")

    @task("toxicity")
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted({(d, t, y) for b in batches for d, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True)})
        model = fit([t for _, t, _ in seen], [int(y > 0) for *_, y in seen])
        columns = [pa.array([model.features.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])]
        yield pa.RecordBatch.from_arrays(columns, ["features", "weights", "bias"])

    found = rows.repartition(1).mapInArrow(learn, "features binary, weights binary, bias double").collect()
    if not found:  # a table without rows has no task
        return fit([], [])
    row = found[0]
    return NaiveBayesLinear(np.frombuffer(row["features"], np.uint32), np.frombuffer(row["weights"]), row["bias"])


def toxicity_scores(docs: DataFrame, model: NaiveBayesLinear) -> DataFrame:
    """Score every whole text of `docs` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only the text is an input of a score. A null text counts as empty; an empty text has the score of no feature;
    repeated rows stay repeated; a null doc_id stays null and counts as held out; an empty table gives none; other
    columns don't matter. Memory: a batch of rows and the model.
    """

    @task("toxicity")
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = model.mask()
        for batch in batches:
            scores = [model.score(text, wanted) for text in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return doc_text(docs, held_out("doc_id").alias("held_out")).mapInArrow(score, SCHEMA)
