"""Quality selection by importance resampling of documents.

Hashed n-gram models of the target (texts labelled as good) and of the raw corpus give each document the log of its
importance weight, the sum over its n-grams of log p_target - log p_raw. Adding Gumbel noise to the logs and keeping the
k largest samples k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, doc_text, task
from specloom.llm.hashing import WORDS_AND_MARKS, mix, token_hashes

#: Buckets of the hashed n-grams; the last counts bigrams of a token with itself, whatever the token.
BUCKETS = 10_000
#: Labelled rows that the target model and the share of good rows are taken from, at most; the choice follows a hash of doc_id.
SAMPLE_ROWS = 20_000
SMOOTHING = 1.0
SHARE_ERRORS = 2.0
#: Bins of a histogram of the keys.
BINS = 4096


def buckets(text: str) -> np.ndarray:
    """The buckets of a text's tokens and of its pairs of neighbouring tokens; tokens are runs of word characters or of marks."""
    h, _, _ = token_hashes(text.encode(), WORDS_AND_MARKS)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) % np.uint64(BUCKETS - 1)
    pairs[h[:-1] == h[1:]] = BUCKETS - 1
    return np.concatenate([h % np.uint64(BUCKETS - 1), pairs]).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of each bucket over all of `docs` (text); they are added up in the tasks first, so the driver gets BUCKETS rows."""

    @task("quality")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount(buckets(text), minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def log_model(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))


def importance_logs(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, float]:
    """doc_id and log_weight for each row of `docs` (doc_id, text), and the share of good rows among the labelled ones, raised by
    SHARE_ERRORS standard errors so that the sample's error costs no good rows.

    The raw model counts all of `docs`; the target model the rows labelled 1, among at most `sample_rows` labelled ones.
    Labelled rows without a text count for neither. Without a good row all weights are equal and the share is 1.
    """
    texts = doc_text(docs)
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    good, n = known.agg(F.avg((F.col("label") > 0).cast("double")), F.count("*")).first()
    share = min(1.0, good + SHARE_ERRORS * (good * (1 - good) / n) ** 0.5) if n else 1.0
    target = bucket_counts(texts.join(F.broadcast(known.filter("label > 0")), "doc_id"))
    if not target.sum():
        ratio, share = np.zeros(BUCKETS), 1.0
    else:
        ratio = log_model(target) - log_model(bucket_counts(texts))

    @task("quality")
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [float(ratio[buckets(text)].sum()) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(logs, pa.float64())], ["doc_id", "log_weight"])

    return texts.mapInArrow(weigh, "doc_id long, log_weight double"), share


def gumbel(column: str, seed: int):
    """Gumbel noise that follows from a column's value, so a repeated task draws the same."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(seed)), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 53))))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, by histograms of the range that holds it; None for k < 1, the least for k
    over the count. Only BINS counts reach the driver in a round, so no task sees all values."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or not n:
        return None
    if k >= n:
        return low
    value = F.col(column)
    while low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        found = (
            rows.filter(value.between(low, high)).groupBy(bin_.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        )
        for row in sorted(found, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        if k == 1:
            return row["high"]
        if k == row["n"] or width == 0:
            return row["low"]
        low, high = row["low"], row["high"]
    return low


def importance_resampling(docs: DataFrame, labels: DataFrame, seed: int = 1, keep: float | None = None) -> DataFrame:
    """Sample the documents of `docs` (doc_id, text) that look like those labelled good in `labels` (doc_id, quality).

    Returns a row for each row: doc_id, log_weight (log p_target - log p_raw of the text), gumbel_key (with noise) and
    kept: whether the key is among the k largest, k being `keep` times the rows; by default the share of good rows as
    importance_logs() has it. Rows whose keys tie with the k-th are all kept, so repeated rows share a fate. A null text counts
    as empty and weighs 0; a null doc_id stays null and has the noise of null; an empty table gives none; without a
    labelled good row all are kept; other columns don't matter. Memory: a batch of rows and the models.
    """
    logs, share = importance_logs(docs, labels)
    keyed = cut(logs.withColumn("gumbel_key", F.col("log_weight") + gumbel("doc_id", seed)), "importance")
    n = keyed.count()
    threshold = kth_largest(keyed, "gumbel_key", int(np.ceil(n * (share if keep is None else keep))))
    return keyed.withColumn("kept", F.lit(False) if threshold is None else F.col("gumbel_key") >= F.lit(threshold))
