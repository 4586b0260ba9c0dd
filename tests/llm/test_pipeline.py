import math
from collections import Counter

import numpy as np
import test_leaks
import test_near
import test_packing
from pyspark.sql import functions as F

import corpus_pipeline as P
from specloom.llm.quality import BUCKETS, SHARE_ERRORS, SMOOTHING, buckets
from specloom.llm.toxicity import fit


def test_stages_take_effect(spark):
    """Each stage keeps what its operator keeps of its own input, and the columns of documents."""
    folder = "/root/testdata/sf0.001"
    docs = P.table(spark, folder, "documents")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = {r["doc_id"] for r in docs.collect()}
        out = P.cut(stage(spark, docs, folder), "test")
        if name != "packing":
            after = {r["doc_id"] for r in out.collect()}
            assert out.columns == columns and after <= before
            if name == "quality classifier":
                gone = {r["doc_id"] for r in P.importance_resampling(docs, P.table(spark, folder, "labels")).filter("NOT kept").collect()}
            elif name == "toxicity":
                model = P.train(docs, P.table(spark, folder, "labels"))
                gone = {r["doc_id"] for r in P.toxicity_scores(docs, model).filter("predicted = 1").collect()}
            elif name == "n-gram Jaccard join":
                gone = {r["doc_id"] for r in P.jaccard_join(docs).filter("doc_id <> component_id").collect()}
            else:
                gone = {r["doc_id"] for r in P.benchmark_leaks(docs, P.table(spark, folder, "benchmark")).collect()}
            assert after == before - gone
            seen.append(len(before) - len(after))
        else:
            assert {r["doc_id"] for r in out.collect()} == before
        docs = out
    assert len(P.STAGES) == 5 and sum(seen) > 10


def test_odd_rows(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            docs = P.cut(stage(spark, docs, folder), "test")
            assert docs.columns == odd_docs.columns
        P.packing(spark, docs, folder).count()


def test_against_brute_force(spark):
    """Every stage by plain Python over the texts that the one before kept: models, noise and ranks, classifier, all pairs, all windows."""
    folder = "/root/testdata/sf0.001"
    source = P.table(spark, folder, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in source.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in P.table(spark, folder, "labels").collect()}
    items = [tuple(r) for r in P.table(spark, folder, "benchmark").select("item_id", "text").collect()]
    bits = {r[0]: r[1] for r in source.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 11)).collect()}

    known = {d: y for d, (y, _) in labels.items() if y is not None}
    counts = {kind: Counter() for kind in ("raw", "good")}
    for d, t in texts.items():
        counts["raw"].update(buckets(t).tolist())
        if known.get(d):
            counts["good"].update(buckets(t).tolist())
    log = lambda c, b: math.log((c[b] + SMOOTHING) / (sum(c.values()) + SMOOTHING * BUCKETS))
    ratio = {b: log(counts["good"], b) - log(counts["raw"], b) for b in counts["raw"]}
    keys = {d: sum(ratio[b] for b in buckets(t).tolist()) - math.log(-math.log((bits[d] + 0.5) / 2**53)) for d, t in texts.items()}
    share = sum(map(bool, known.values())) / len(known)
    share += SHARE_ERRORS * math.sqrt(share * (1 - share) / len(known))
    least = sorted(keys.values(), reverse=True)[min(len(keys), math.ceil(len(keys) * min(1, share))) - 1]
    texts = {d: t for d, t in texts.items() if keys[d] >= least - 1e-9}

    import zlib

    own = sorted((d, t, labels[d][1]) for d, t in texts.items() if labels.get(d, (0, None))[1] is not None and zlib.crc32(str(d).encode()) % 5)
    model = fit([t for _, t, _ in own], [int(y > 0) for *_, y in own])
    wanted = model.mask()
    texts = {d: t for d, t in texts.items() if model.score(t, wanted) < 0.5}

    kept = {d for d, n, c in test_near.brute(list(texts.items())) if not n or d == c}
    texts = {d: t for d, t in texts.items() if d in kept}
    leaks = {d for d, _ in test_leaks.brute([(d, t.lower().split()) for d, t in texts.items()], items)}
    texts = {d: t for d, t in texts.items() if d not in leaks}

    rows = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() and leaks
    used = test_packing.check(list(texts.items()), rows, 4096)
    assert np.sum(np.array(used) < 4096) <= source.rdd.getNumPartitions()


def test_rows_without_ids_of_their_own(spark):
    """Null and repeated ids: a row goes for its own text alone, and of a group of copies one row stays."""
    docs = P.table(spark, "/root/testdata/sf0.001", "documents")
    one, two = (r["text"] for r in docs.filter("length(text) BETWEEN 600 AND 1200").orderBy("doc_id").limit(2).collect())
    rows = [(None, one), (None, one), (5, one), (5, one), (5, two), (6, two), (None, None), (None, None), (7, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in P.near_duplicates(spark, table, "").collect()]
    assert sorted(t or "" for _, t in left) == sorted([one, two, "", "", ""])
    item = P.table(spark, "/root/testdata/sf0.001", "benchmark").filter("length(text) > 60").first()["text"]
    table = spark.createDataFrame([(1, one), (1, f"{two} {item} {two}"), (None, item), (None, two)], "doc_id long, text string")
    assert sorted((d, t) for d, t in map(tuple, P.decontamination(spark, table, "/root/testdata/sf0.001").collect()) if d) == [(1, one)]
    assert P.decontamination(spark, table, "/root/testdata/sf0.001").count() == 2
