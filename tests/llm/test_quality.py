import math
import random

import numpy as np

from specloom.llm.quality import BUCKETS, buckets, importance_logs, importance_resampling, kth_largest, log_model


def test_keeps_the_good(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in importance_resampling(docs, labels).collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(kept) == docs.count()
    assert np.mean([kept[d] for d, q in quality.items() if q == 1]) > 0.97
    assert np.mean([kept[d] for d, q in quality.items() if q == 0]) < 0.3


def test_against_brute_force(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    logs, share = importance_logs(documents, labels)
    texts, quality = {r["doc_id"]: r["text"] for r in documents.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    count = lambda ids: sum((np.bincount(buckets(texts[d]), minlength=BUCKETS) for d in ids), np.zeros(BUCKETS, int))
    ratio = log_model(count([d for d, q in quality.items() if q == 1])) - log_model(count(texts))
    got = {r["doc_id"]: r["log_weight"] for r in logs.collect()}
    assert all(math.isclose(got[d], ratio[buckets(t)].sum(), rel_tol=1e-9, abs_tol=1e-9) for d, t in texts.items())
    good = np.mean([q == 1 for q in quality.values()])
    assert math.isclose(share, min(1, good + 2 * math.sqrt(good * (1 - good) / len(quality))))
    rows = importance_resampling(documents, labels, keep=0.4).collect()
    keys = sorted((r["gumbel_key"] for r in rows), reverse=True)
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in rows if r["gumbel_key"] >= keys[math.ceil(0.4 * len(rows)) - 1]}


def test_kth_largest(spark):
    r = random.Random(4)
    for values in ([r.gauss(0, 1) for _ in range(300)], [1.0] * 50 + [2.0] * 3, [-1e300, 1e300, 0.0], [5.0], [math.pi * 10**k for k in range(-8, 8)]):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        for k in {1, 2, len(values) // 2 + 1, len(values), len(values) + 5}:
            assert kth_largest(rows, "x", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
        assert kth_largest(rows, "x", 0) is None
    assert kth_largest(rows.limit(0), "x", 3) is None


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (7, None)], "doc_id long, quality int")
    rows = importance_resampling(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    assert len({(r["gumbel_key"], r["kept"]) for r in rows if r["doc_id"] == 2}) == 1
    assert all(r["kept"] for r in importance_resampling(odd_docs, labels.limit(0)).collect())
    assert importance_resampling(no_docs, labels).count() == 0


def test_draw_follows_the_weights(spark):
    """Over many rows of three weights the shares that the noise draws are those of a draw in proportion to them."""
    from pyspark.sql import functions as F

    from specloom.llm.quality import gumbel

    weights = [1.0, 2.0, 5.0]
    rows = spark.range(60_000).select("id", *(F.col("id").alias(f"i{k}") for k in range(3)))
    keys = rows.select(*((F.lit(math.log(w)) + gumbel(f"i{k}", 10 + k)).alias(f"k{k}") for k, w in enumerate(weights)))
    best = keys.select(*((F.col(f"k{k}") == F.greatest("k0", "k1", "k2")).cast("int").alias(f"b{k}") for k in range(3)))
    shares = best.agg(*(F.avg(f"b{k}") for k in range(3))).first()
    assert all(abs(s - w / 8) < 0.01 for s, w in zip(shares, weights))
