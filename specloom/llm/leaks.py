"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame expressions alone.

Windows and items have a weighted 64-bit SimHash of their shingles. Each fingerprint is cut into BLOCKS blocks; the items of a
size are indexed under all values of a block within RADIUS // BLOCKS bits, so every fingerprint within RADIUS of a window's
meets it in one block at least, and which items a window is compared with follows from the blocks alone. What meets is
compared by the exact weighted similarity of the shingle sets, and that decides.

Windows that can't be similar to any item aren't hashed: an item's anchors are its rarest shingles, of more than a quarter of
its weight, and a window that is similar enough shares one of them, or the common weight would stay below three quarters of
the item's. So the windows of the size of an item are those that hold one of the anchors of the items of that size.
Equal windows, as copies and popular passages have them, are one window until the end.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, split_hot

WIDTH = 5
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Anchors, or found windows, up to which they are broadcast, about 20 MB; more are joined by a shuffle.
BROADCAST_ANCHORS = 200_000
#: Items up to which their index, 296 rows each, and their shingles are broadcast, about 30 MB together.
BROADCAST_ITEMS = 2_000


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, parted by ASCII white space; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), "")


def run_hash(words: Column, at: Column | int, width: int) -> Column:
    return F.xxhash64(*(F.get(words, at + k if isinstance(at, Column) else F.lit(at + k)) for k in range(width)))


def shingles_of(words: Column) -> Column:
    """The distinct shingles of an array of words: their hash and their weight, the characters of their words. Fewer than
    WIDTH words are one shingle."""
    empty = F.array().cast("array<struct<hash:bigint,weight:int>>")

    def one(at: Column | int, width: int) -> Column:
        lengths = [F.length(F.get(words, at + k if isinstance(at, Column) else F.lit(at + k))) for k in range(width)]
        return F.struct(run_hash(words, at, width).alias("hash"), sum(lengths[1:], lengths[0]).alias("weight"))

    places = F.sequence(F.lit(0), F.size(words) - WIDTH)
    found = F.when(F.size(words) >= WIDTH, F.array_distinct(F.transform(places, lambda i: one(i, WIDTH))))
    for width in range(1, WIDTH):
        found = found.when(F.size(words) == width, F.array(one(0, width)))
    return found.otherwise(empty)


def weight_of(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + x["weight"])


def simhash(shingles: Column) -> Column:
    """Bit b is set where the shingles with that bit have more than half of all weight.

    The weights of four bits are added up at once, in the four lanes of a 64-bit number; sets whose weight doesn't fit into a
    lane have a sum for each bit.
    """
    zero, total = F.lit(0).cast("long"), weight_of(shingles)
    spread = F.array(*(F.lit(sum(1 << 16 * j for j in range(4) if k >> j & 1)).cast("long") for k in range(16)))
    nibble = lambda x, n: F.call_function("shiftright", x["hash"], (4 * n).cast("int")).bitwiseAND(15).cast("int")
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda n: F.aggregate(shingles, zero, lambda acc, x: acc + F.get(spread, nibble(x, n)) * x["weight"]),
    )
    in_lanes = lambda of, b: F.call_function("shiftright", F.get(of, F.floor(b / 4).cast("int")), (b % 4 * 16).cast("int")).bitwiseAND(0xFFFF)
    one_by_one = lambda b: F.aggregate(shingles, zero, lambda acc, x: acc + F.call_function("getbit", x["hash"], b) * x["weight"])

    def print_of(votes) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: 2 * votes(b) > total)
        return F.aggregate(bits, zero, lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))

    few = F.get(F.transform(F.array(lanes), lambda of: print_of(lambda b: in_lanes(of, b))), F.lit(0))
    return F.when(total < 1 << 15, few).otherwise(print_of(one_by_one))


def block_of(fingerprint: Column, block: Column) -> Column:
    return F.call_function("shiftright", fingerprint, block * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)


def flips() -> list[int]:
    """The masks that change at most RADIUS // BLOCKS bits of a block."""
    return [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def first_meeting(distance: Column) -> Column:
    """The first block in which two fingerprints meet, by the bits in which they differ: a pair is taken there alone."""
    found = None
    for block in range(BLOCKS):
        meets = F.bit_count(block_of(distance, F.lit(block))) <= RADIUS // BLOCKS
        found = F.when(meets, block) if found is None else found.when(meets, block)
    return found


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a name for id and words), item_id, size (in words), shingles, weight and fingerprint of the items with words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    items = cut(items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("size"), shingles_of(F.col("words")).alias("shingles")), "items")
    return items.select("*", weight_of(F.col("shingles")).alias("weight"), simhash(F.col("shingles")).alias("fingerprint"))


def anchors_of(items: DataFrame) -> DataFrame:
    """(size, hash): the anchors of the items of a size. The rarest come first, by the items that have them."""
    spread = items.select("item", F.explode("shingles").alias("s")).select("item", "s.hash", F.col("s.weight").alias("own"))
    rarity = spread.groupBy("hash").agg(F.count("*").alias("items"))
    rarest = spread.join(rarity, "hash").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("items", "hash", "own"))).alias("rarest"))
    begin = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("kept"))
    chosen = lambda acc, x: F.when(4 * acc["sum"] > F.col("weight"), acc).otherwise(
        F.struct((acc["sum"] + x["own"]).alias("sum"), F.concat(acc["kept"], F.array(x["hash"])).alias("kept"))
    )
    kept = items.join(rarest, "item").select("item", "size", F.aggregate("rarest", begin, chosen)["kept"].alias("kept"))
    return kept.select("size", F.explode("kept").alias("hash")).distinct()


def candidate_windows(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, doc, size, start, name, window): each window of an item's size that holds an anchor of such an item, once.

    doc names a row by its id and text; name is that of the window's words. Where the anchors are too many to broadcast, only
    hashes and places are shuffled, hot ones dealt to several tasks, and the texts are joined to what was found.
    """
    few = anchors.count() <= BROADCAST_ANCHORS
    texts = docs.select("doc_id", F.struct(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")).alias("doc"), words_of(F.col("text")).alias("words"))
    widths = [r[0] for r in anchors.select(F.least(F.col("size"), F.lit(WIDTH))).distinct().collect()]  # five at most
    hits = None
    for width in widths:
        own = anchors.filter(F.least(F.col("size"), F.lit(WIDTH)) == width)
        range_ = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width))
        places = texts.select("doc_id", "doc", "words", F.explode(range_).alias("place")).withColumn("hash", run_hash(F.col("words"), F.col("place"), width))
        if few:
            met = places.join(F.broadcast(own), "hash")
        else:
            bare = places.select("doc", "place", "hash")
            one, other = split_hot(bare, own, ["hash"], F.xxhash64("doc", "place"))
            met = one.join(other, ["hash", "salt"]).select("doc", "place", "size").join(texts.dropDuplicates(["doc"]), "doc")
        first = F.greatest(F.lit(0), F.col("place") + width - F.col("size"))
        last = F.least(F.col("place"), F.greatest(F.lit(0), F.size("words") - F.col("size")))
        starts = met.select("doc_id", "doc", "words", "size", F.explode(F.sequence(first, last)).alias("start"))
        hits = starts if hits is None else hits.union(starts)
    if hits is None:  # no items
        hits = texts.limit(0).select("doc_id", "doc", "words", F.lit(0).alias("size"), F.lit(0).alias("start"))
    window = F.slice("words", F.col("start") + 1, F.col("size"))
    hits = hits.select("doc_id", "doc", "size", "start", window.alias("window")).dropDuplicates(["doc", "size", "start"])
    return hits.select("*", F.struct(F.xxhash64("window"), F.xxhash64(F.lit(1), "window")).alias("name"))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The benchmark items (item_id, text) that texts of `docs` (doc_id, text) contain, at a similarity of `percent` / 100.

    Words are lower-cased runs of anything but ASCII white space. The similarity of a window and an item is the weight of
    the distinct five-word shingles in both over that of those in either, a shingle's weight being its characters; an item
    of fewer words is one shingle, so a window is equal to it or isn't similar. Returns a row for each doc_id and item_id
    with such a window: similarity (the largest, to six places), first_word (the smallest start of a window that has it,
    words from 0), hamming (of its fingerprint) and n_windows. Null texts and texts without words, in either table, match
    nothing; rows of one doc_id count as one document; a null doc_id or item_id stays null; empty tables give none; other
    columns don't matter. A pair is lost only if the fingerprints of all its windows differ in more than RADIUS bits: at the
    least similarity 11 are to be expected, with a standard deviation of 3.
    """
    if not 75 <= percent <= 100:
        raise ValueError("the anchors hold for a similarity of 0.75 or more")
    items = cut(items_of(benchmark), "items")
    few = items.count() <= BROADCAST_ITEMS
    hits = cut(candidate_windows(docs, cut(anchors_of(items), "anchors")), "hits")
    # Both are written, or the optimizer would compute fingerprints anew to test that they aren't null.
    windows = hits.groupBy("size", "name").agg(F.first("window").alias("window")).select("size", "name", shingles_of(F.col("window")).alias("own"))
    windows = cut(cut(windows, "windows").select("*", simhash(F.col("own")).alias("print")), "windows")

    numbers = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    masks = F.array(*map(F.lit, flips()))
    index = items.select("item", "size", "fingerprint", numbers).withColumn("value", block_of(F.col("fingerprint"), F.col("block")))
    index = index.select("item", "size", "fingerprint", "block", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    carried = ["own"] if few else []  # through a shuffle the sets would go once a block
    met = (
        windows.select("size", "name", "print", *carried, numbers).withColumn("value", block_of(F.col("print"), F.col("block")))
        .join(F.broadcast(index) if few else index, ["size", "block", "value"])
        .withColumn("distance", F.col("print").bitwiseXOR(F.col("fingerprint"))).withColumn("hamming", F.bit_count("distance"))
        .filter((F.col("hamming") <= RADIUS) & (F.col("block") == first_meeting(F.col("distance"))))
        .select("size", "name", "item", "hamming", *carried)
    )
    met = met if few else met.join(windows.select("size", "name", "own"), ["size", "name"])
    whole = items.select("item", "item_id", "shingles", "weight")
    both = weight_of(F.array_intersect("own", "shingles"))
    either = weight_of(F.col("own")) + F.col("weight") - both
    found = (
        met.join(F.broadcast(whole) if few else whole, "item")
        .select("size", "name", "item_id", "hamming", both.alias("both"), either.alias("either"))
        .filter(F.lit(100) * F.col("both") >= F.lit(percent) * F.col("either"))
        .select("size", "name", "item_id", "hamming", F.round(F.col("both") / F.col("either"), 6).alias("similarity"))
    )
    found, places = cut(found, "found"), hits.select("doc_id", "size", "name", "start")
    if found.count() <= BROADCAST_ANCHORS:
        placed = places.join(F.broadcast(found), ["size", "name"])
    else:
        places, found = split_hot(places, found, ["size", "name"], F.xxhash64("doc_id", "start"))
        placed = places.join(found, ["size", "name", "salt"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("hamming")).alias("near")))
    return placed.groupBy("doc_id", "item_id").agg(best.alias("best"), F.countDistinct("start").alias("n_windows")).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("first_word"),
        (-F.col("best.near")).cast("int").alias("hamming"), "n_windows",
    )
