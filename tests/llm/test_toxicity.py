import zlib

import numpy as np

from specloom.llm.toxicity import fit, toxicity_scores, train


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity_scores(docs, train(docs, labels)).collect()
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    test = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    toxic, clean = ([s for s, y in test if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.8 and np.mean([s >= 0.5 for s in clean]) < 0.05


def test_single_words_tell():
    texts = [f"some {w} words about rivers" for w in ("quiet", "green", "paper", "glass") for _ in range(20)]
    bad = [f"some {w} idiot words about rivers" for w in ("quiet", "green", "paper", "glass") for _ in range(10)]
    model = fit(texts + bad, [0] * len(texts) + [1] * len(bad))
    wanted = model.mask()
    assert model.score("An IDIOT speaks", wanted) > 0.5 > model.score("some quiet words", wanted)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (13, 0), (14, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = train(odd_docs, labels)
    rows = toxicity_scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1
    assert toxicity_scores(no_docs, model).count() == 0
    for nothing in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r["predicted"] for r in toxicity_scores(odd_docs, train(odd_docs, nothing)).collect()} <= {0, 1}
    assert train(no_docs, labels).features.size == 0


def test_against_brute_force():
    """Ratios counted gram by gram, scores added up feature by feature, and a gradient that is 0 where the fit ends."""
    import math
    import random

    from specloom.llm import toxicity as T

    r, words = random.Random(2), [f"word{k}" for k in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(12)) + (" nasty fool" if k % 4 == 0 else " kind friend") for k in range(120)]
    labels = [int(k % 4 == 0) for k in range(120)]

    def grams(text):
        data = b" " + b" ".join(text.lower().encode().split()) + b" "
        return {data[i : i + n] for n in T.ORDERS for i in range(len(data) - n + 1)}

    def number(gram):  # of a gram alone, by 32-bit arithmetic
        x = 0
        for b in gram:
            x = (x * 0x9E3779B1 + int(T._SALT[b])) & 0xFFFFFFFF
        x ^= x >> 15
        return ((x * 0x85EBCA6B) & 0xFFFFFFFF ^ len(gram) << 27 & 0xFFFFFFFF) >> (32 - T.BITS)

    present = [{number(g) for g in grams(t)} for t in texts]
    for t, own in zip(texts, present):
        assert own == set(np.concatenate([*T.ngrams(t)]).tolist())
    model = fit(texts, labels)
    kept = model.features.tolist()
    p, q = ([sum(f in s for s, y in zip(present, labels) if y == k) for f in kept] for k in (1, 0))
    pa, qa = sum(p) + T.SMOOTHING * len(kept), sum(q) + T.SMOOTHING * len(kept)
    ratio = [math.log((a + T.SMOOTHING) / pa) - math.log((b + T.SMOOTHING) / qa) for a, b in zip(p, q)]
    assert np.allclose(ratio, T.log_count_ratios(np.array(p, float), np.array(q, float)))
    chi2 = {}
    for f in set().union(*present):
        a, b = (sum(f in s for s, y in zip(present, labels) if y == k) for k in (1, 0))
        n, pos = len(labels), sum(labels)
        chi2[f] = n * (a * (n - pos - b) - b * (pos - a)) ** 2 / (pos * (n - pos) * (a + b) * (n - a - b)) if a + b < n else 0
    assert {f for f, x in chi2.items() if x > T.MIN_CHI2 + 1e-9} <= set(kept)
    weight, wanted = dict(zip(kept, model.weights)), model.mask()
    scores = [1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0) for f in s)))) for s in present]
    assert np.allclose(scores, [model.score(t, wanted) for t in texts])
    w = np.array(model.weights) / ratio
    pull = [(s - y) * (T.POSITIVE_WEIGHT if y else 1) for s, y in zip(scores, labels)]
    gradient = [sum(g for g, s in zip(pull, present) if f in s) * x / len(labels) + T.PENALTY * c for f, x, c in zip(kept, ratio, w)]
    assert max(map(abs, gradient)) < 2e-3 and all((s > 0.5) == bool(y) for s, y in zip(scores, labels))
