from collections import defaultdict

import pytest
from conftest_words import mutate, prose
from pyspark.sql import functions as F

from specloom.llm import leaks
from specloom.llm.leaks import RADIUS, benchmark_leaks


def weighted(words):
    if 0 < len(words) < 5:
        return {tuple(words): sum(map(len, words))}
    return {tuple(words[i : i + 5]): sum(map(len, words[i : i + 5])) for i in range(len(words) - 4)}


def brute(docs, items):
    """The best similarity of any window of an item's size, for pairs that reach 0.75."""
    found = {}
    for item_id, text in items:
        item = (text or "").lower().split()
        own = weighted(item)
        if not own:
            continue
        for doc_id, words in docs:
            for start in range(max(1, len(words) - len(item) + 1)):
                window = weighted(words[start : start + len(item)])
                both = sum(n for s, n in window.items() if s in own)
                either = sum(window.values()) + sum(own.values()) - both
                if 4 * both >= 3 * either:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), both / either)
    return found


def test_against_all_windows(spark):
    items = [(k, prose(k, 20 + k)) for k in range(12)] + [(20, None), (21, ""), (22, "four words are few"), (23, "five words make one shingle")]
    docs = [(100 + k, f"{prose(300 + k, 40)} {prose(k, 20 + k)} {prose(400 + k, 30)}") for k in range(12)]
    docs += [(200 + k, f"{prose(500 + k, 10)} {mutate(prose(k, 20 + k), k, 0.03).upper()}") for k in range(12)]
    docs += [(300 + k, " ".join(prose(k, 20 + k).split()[:10])) for k in range(12)] + [(400, None), (401, ""), (402, "five words make one shingle"), (402, "five words make one shingle")]
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = brute([(d, (t or "").lower().split()) for d, t in docs], items)
    exact = {k for k, s in expected.items() if s > 0.999}
    assert got.keys() == expected.keys() and {(100 + k, k) for k in range(12)} <= exact
    for key, r in got.items():
        assert abs(r["similarity"] - expected[key]) < 1e-6 and r["hamming"] <= RADIUS
        words = next((t or "").lower().split() for d, t in docs if d == key[0])
        item = next(t.lower().split() for i, t in items if i == key[1])
        if key in exact:
            assert r["similarity"] == 1 and words[r["first_word"] : r["first_word"] + len(item)] == item


def test_edited_passages(spark):
    """All that brute force over all windows finds, with its similarity, when words are replaced, deleted or inserted."""
    import random

    items = [(k, prose(k, 15 + k)) for k in range(40)]
    docs = []
    for seed in range(6):
        r = random.Random(seed)
        for k, text in items:
            words = text.split()
            for _ in range(r.randint(1, 2)):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = [f"new{r.randrange(1000)}"] * r.randint(0, 1)
            docs.append((1000 * seed + k, f"{prose(5000 + 100 * seed + k, 20)} {' '.join(words)} {prose(9000 + 100 * seed + k, 20)}"))
    found = benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute([(d, t.split()) for d, t in docs], items)
    assert len(expected) > 100 and {(r["doc_id"], r["item_id"]) for r in found} == expected.keys()
    assert all(abs(r["similarity"] - expected[r["doc_id"], r["item_id"]]) < 1e-6 for r in found)


def test_short_items(spark):
    """Items of fewer than five words are one shingle; the plan for many items and anchors gives the same rows."""
    items = [(1, "four words are few"), (2, "One"), (3, "two words"), (4, prose(1, 30)), (5, "  ")]
    docs = [(k, f"{prose(50 + k, 12)} {t or ''} {prose(70 + k, k)}") for k, (_, t) in enumerate(items)] + [(10, "ONE"), (11, "two words two words"), (12, "four words are"), (13, prose(1, 30))]
    docs += [(20 + k, f"{prose(90 + k, 5)} {prose(1, 30)}") for k in range(30)]
    rows = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted(map(tuple, benchmark_leaks(*rows).collect()))
    expected = brute([(d, t.lower().split()) for d, t in docs], items)
    assert {r[:2] for r in found} == expected.keys() and {(0, 1), (10, 2), (11, 3), (13, 4), (29, 4)} <= expected.keys()
    assert next(r for r in found if r[:2] == (11, 3))[5] == 2
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(leaks, "BROADCAST_ANCHORS", 0)
        patch.setattr(leaks, "BROADCAST_ITEMS", 0)
        patch.setattr("specloom.llm.common.HOT_SHARES", 5)
        patch.setattr("specloom.llm.common.LEAST_HOT", 1)
        assert sorted(map(tuple, benchmark_leaks(*rows).collect())) == found


def test_recall_of_the_radius(spark):
    """Of windows that are barely similar, the share whose fingerprint is within the radius of the item's."""
    import random

    r, pairs = random.Random(3), []
    for k in range(600):
        words = prose(k, r.randint(36, 60)).split()
        other = list(words)
        other[r.randrange(len(other))] = f"new{r.randrange(10**6)}"
        a, b = weighted(words), weighted(other)
        both = sum(n for s, n in a.items() if s in b)
        similarity = both / (sum(a.values()) + sum(b.values()) - both)
        if 0.75 <= similarity < 0.85:
            pairs.append((words, other))
    table = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    prints = table.select(*(leaks.shingles_of(F.col(c)).alias(c) for c in "ab")).select(*(leaks.simhash(F.col(c)).alias(c) for c in "ab"))
    distances = [r[0] for r in prints.select(F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).collect()]
    assert len(distances) > 60 and sum(d <= RADIUS for d in distances) >= 0.99 * len(distances)


def test_documents(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items, shared = [tuple(r) for r in benchmark.select("item_id", "text").collect()], defaultdict(set)
    for i, t in items:
        for s in weighted(t.lower().split()):
            shared[s].add(i)
    docs = [(r["doc_id"], r["text"].lower().split()) for r in documents.collect()]
    near = [(d, w) for d, w in docs if any(s in shared for s in weighted(w))]
    assert {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(documents, benchmark).collect()} == brute(near, items).keys()


def test_odd_rows(spark, odd_docs, no_docs):
    odd = odd_docs.collect()
    items = spark.createDataFrame([(1, odd[0]["text"], 1), (None, odd[0]["text"], 2), (3, None, 3)], "item_id long, text string, words int")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(odd_docs, items).collect()}
    assert {(d, i) for d in (1, 2, 13, None) for i in (1, None)} <= got and all(i in (1, None) for _, i in got)
    assert benchmark_leaks(no_docs, items).count() == 0 and benchmark_leaks(odd_docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        benchmark_leaks(odd_docs, items, percent=50)


def test_simhash_by_definition(spark):
    """Both ways of adding weights give the bits of the definition, for signed hashes and for very long words."""
    texts = [prose(k, 5 + 3 * k) for k in range(20)] + ["one two", "", "x" * 9000 + " b c d e f " + "y" * 7000, "a b c d e f " * 3]
    rows = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>").select(leaks.shingles_of(F.col("w")).alias("s"))
    for r in rows.select("s", leaks.simhash(F.col("s")).alias("p")).collect():
        total = sum(x["weight"] for x in r["s"])
        bits = sum(1 << b for b in range(64) if 2 * sum(x["weight"] for x in r["s"] if x["hash"] >> b & 1) > total)
        assert r["p"] & (1 << 64) - 1 == bits
