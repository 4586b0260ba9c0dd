"""Quality rules by distribution divergence, in DataFrame expressions alone.

A document's histograms of character classes and of its language's commonest words are compared with those of its language
over the whole corpus by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). Texts too short for a histogram to mean anything,
and languages without a word list, aren't judged by it.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut

# Very common words of each language.
COMMON_WORDS = {
    "de": "der die und das in zu den mit von ist des sich auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin".split(),
    "fr": "de la le et les des en un une que est pour qui dans a par plus pas au sur ne se ce il sont avec son du ou mais".split(),
}
# The character classes that are counted; all other characters are one class more.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "mark": "[!-\"'-),-/:;=?@\\[-`{}~]", "space": "[ \t-\r]", "wide": "[^\\x00-\\x7f]"}
MIN_WORDS, MAX_REPEAT = 50, 50
#: The distance of characters above which a text is rejected, and the least characters that it is told from.
MAX_CHARS, LEAST_CHARS = 0.28, 200
#: The same of words; a few words differ by chance, so the square of the distance may be WORDS_SLACK / words more.
MAX_WORDS, WORDS_SLACK, LEAST_WORDS = 0.2, 8.0, 50
#: Distinct repeated windows of a text up to which their places are looked up one by one.
FEW = 32


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once: a lambda's variable is the one binding that expressions have."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a run of three found twice or more.

    Windows are compared by hash. Those found again are told by sorting; their places by a look-up if they are few, else by
    sorting hashes with places. Every place covers three words, less what the place before covers too.
    """
    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    covered = lambda at: F.aggregate(F.filter(at, lambda p: p.isNotNull()), begin, add)["n"]
    again = lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1)))
    looked_up = lambda t, found: covered(F.transform(t, lambda x, i: F.when(F.array_contains(found, x), i)))
    sorted_ = lambda t: let(
        F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        lambda d: covered(
            F.sort_array(F.transform(d, lambda x, k: F.when((x["h"] == F.get(d, k - 1)["h"]) | (x["h"] == F.get(d, k + 1)["h"]), x["i"])))
        ),
    )
    places = lambda t: let(let(F.sort_array(t), again), lambda found: F.when(F.size(found) <= FEW, looked_up(t, found)).otherwise(sorted_(t)))
    any_ = lambda w: let(hashes(w), lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), places(t)).otherwise(0))
    return F.when(F.size(words) > 3, any_(words)).otherwise(0).cast("long")


def common_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the language occurs; null for a language without a list."""
    lists = None
    for name, found in COMMON_WORDS.items():
        array = F.array(*map(F.lit, found))
        lists = F.when(lang == name, array) if lists is None else lists.when(lang == name, array)
    counted = lambda c, of: F.transform(of, lambda y: F.size(F.filter(c, lambda x: x == y)).cast("long"))
    return let(lists, lambda of: F.when(of.isNotNull(), let(F.filter(words, lambda x: F.array_contains(of, x)), lambda c: counted(c, of))))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, a count for each class of characters, n_runs: the runs of letters (a-z once A-Z are lower-cased, and
    all beyond ASCII), and common: how many of these are each common word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words")
    )
    letters = F.array_remove(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), "[\\x00-\\x60\\x7b-\\x7f]+"), "")
    of_letters = lambda w: F.struct(F.size(w).cast("long").alias("n"), common_counts(w, F.col("lang")).alias("common"))
    counts = docs.select(
        "doc_id",
        "lang",
        let(F.array_remove(F.split(text, "[ \t-\r]+"), ""), of_words).alias("words"),
        let(letters, of_letters).alias("letters"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.length(text).cast("long").alias("n_chars"),
        *(count_matches(text, pattern).alias(name) for name, pattern in CLASSES.items()),
    )
    return counts.select(
        "doc_id", "lang", F.col("words.n_words"), (F.col("n_chars") - F.col("space")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"), "n_dup_lines", F.col("words.n_repeat_words"), "n_chars", *CLASSES, F.col("letters.n").alias("n_runs"), F.col("letters.common"),
    )


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, to six places, of two arrays of counts; null if one is null or has none."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    share = lambda a, n: F.transform(a, lambda x: x / n)
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0) + F.when(y > 0, y * F.log2(2 * y / (x + y))).otherwise(0.0)
    added = lambda n, m: F.aggregate(F.zip_with(share(p, n), share(q, m), part), F.lit(0.0), lambda x, y: x + y)
    of = lambda n, m: F.when((n > 0) & (m > 0), F.round(F.sqrt(F.round(F.greatest(F.lit(0.0), added(n, m) / 2), 12)), 6))
    return let(total(p), lambda n: let(total(q), lambda m: of(n, m)))


def divergence_rules(docs: DataFrame) -> DataFrame:
    """Judge every whole text of `docs` (doc_id, text, lang) by the base rules and its divergence from its language.

    Words are runs of anything but ASCII white space. Returns a row for each row: doc_id, n_words, word_chars (code points
    in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line), n_repeat_words, base_failed (under
    MIN_WORDS words, or more than MAX_REPEAT percent of them repeated), kept, char_distance and word_distance. A text is
    kept unless base_failed or, where it is long enough, a distance is above its limit. The words of the histogram are runs
    of letters, so case and marks don't count. The references are sums over
    all rows of a language, so they are as many as the word lists. A null text has no words; texts of a null or unlisted
    language have null distances and aren't rejected by them; repeated rows stay repeated and count each; a null doc_id
    stays null; an empty table gives none; other columns don't matter.
    """
    rows = cut(measures(docs), "measures")
    plain = F.col("n_chars") - sum((F.col(c) for c in list(CLASSES)[1:]), F.col(next(iter(CLASSES))))
    others = F.col("n_runs") - F.aggregate("common", F.lit(0).cast("long"), lambda x, y: x + y)
    rows = rows.withColumns({"chars": F.array(*CLASSES, plain), "common": F.concat("common", F.array(others))})
    lengths = {"chars": len(CLASSES) + 1, "common": len(COMMON_WORDS["en"]) + 1}
    sums = {name: F.array(*(F.sum(F.get(name, F.lit(k))) for k in range(n))) for name, n in lengths.items()}
    known = rows.filter(F.col("lang").isin(list(COMMON_WORDS)))
    references = known.groupBy("lang").agg(*(x.alias(f"all_{name}") for name, x in sums.items()))
    judged = rows.join(F.broadcast(references), "lang", "left").withColumns(
        {"char_distance": distance(F.col("chars"), F.col("all_chars")), "word_distance": distance(F.col("common"), F.col("all_common"))}
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    chars, words = F.col("char_distance"), F.col("word_distance")
    odd = ((F.col("n_chars") >= LEAST_CHARS) & (chars > MAX_CHARS)) | ((F.col("n_words") >= LEAST_WORDS) & (words * words > MAX_WORDS**2 + WORDS_SLACK / F.greatest("n_words", F.lit(1))))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & ~F.coalesce(odd, F.lit(False))).alias("kept"), "char_distance", "word_distance",
    )
