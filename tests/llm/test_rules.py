import math
import re
from collections import Counter

from specloom.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, run in enumerate(zip(words, words[1:], words[2:])) if runs[run] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def histograms(text, lang):
    text = text or ""
    words = re.findall(r"[a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    chars = [len(re.findall(p, text)) for p in R.CLASSES.values()]
    common = [words.count(w) for w in R.COMMON_WORDS[lang]]
    return [*chars, len(text) - sum(chars)], [*common, len(words) - sum(common)]


def distance(p, q):
    n, m = sum(p), sum(q)
    if not n or not m:
        return None
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    p, q = [x / n for x in p], [x / m for x in q]
    middle = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, round((kl(p, middle) + kl(q, middle)) / 2, 12)))


def check(docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    sums = {}
    for _, text, lang in rows:
        if lang in R.COMMON_WORDS:
            own = histograms(text, lang)
            sums[lang] = [[a + b for a, b in zip(x, y)] for x, y in zip(own, sums[lang])] if lang in sums else own
    got = sorted(R.divergence_rules(docs).collect(), key=lambda r: (str(r["doc_id"]), r["word_chars"], str(r["char_distance"])))
    expected = []
    for d, text, lang in rows:
        counts, told = base(text), [None, None]
        if lang in R.COMMON_WORDS:
            told = [distance(a, b) for a, b in zip(histograms(text, lang), sums[lang])]
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        odd = told[0] is not None and len(text) >= R.LEAST_CHARS and told[0] > R.MAX_CHARS
        odd |= told[1] is not None and counts[0] >= R.LEAST_WORDS and told[1] ** 2 > R.MAX_WORDS**2 + R.WORDS_SLACK / counts[0]
        expected.append((d, *counts, failed, not failed and not odd, *told))
    assert len(got) == len(expected)
    for r, e in zip(got, sorted(expected, key=lambda e: (str(e[0]), e[2], str(None if e[8] is None else round(e[8], 6))))):
        assert tuple(r)[:8] == e[:8]
        for a, b in zip(tuple(r)[8:], e[8:]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 2e-6)


def test_rows(documents, odd_docs, no_docs):
    check(documents)
    check(odd_docs)
    assert R.divergence_rules(no_docs).count() == 0


def test_many_repeats(spark, monkeypatch):
    lines = [" ".join(f"w{k}" for k in range(n, n + 7)) for n in range(40)]
    texts = ["\n".join(lines + lines), "a b c d " * 30, "a a a a", "a a a", " ".join(lines[0].split() * 2), "x y z x y z q x y z"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    check(docs)
    monkeypatch.setattr(R, "FEW", 0)  # all by sorting
    check(docs)


def test_case_and_marks_dont_count(spark):
    """Of two texts that differ in case and marks, the distances of words are one."""
    plain = " ".join("the river of stone and cloud is in the glass".split() * 8)
    docs = spark.createDataFrame([(1, plain, "en"), (2, plain.title().replace(" ", ", "), "en"), (3, "zq " * 80, "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in R.divergence_rules(docs).collect()}
    assert found[1]["word_distance"] == found[2]["word_distance"] < found[3]["word_distance"] <= 1
