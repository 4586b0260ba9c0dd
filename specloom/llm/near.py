"""N-gram Jaccard join by parity sketches.

A text's set is its distinct shingles. Sets of a size band share the layout of one bit sketch: every shingle flips one bit
of it, so the Hamming distance of two sketches is at most the size of the sets' symmetric difference, which for a linked
pair of n and p shingles is at most d = (n + p) / 7 (similarity 0.75). The sketch is parted into blocks, and a block is
named by the XOR of its shingles' hashes. At most d blocks of a linked pair differ. Blocks are ordered by how common their
rarest shingle is; of a linked pair, the first d + 1 blocks of either that aren't empty have one in common, by the pigeonhole
principle. Only those are joined, so a passage that many texts share is looked at only in texts that are little else.

Blocks that several sets share make a group. Its members are compared with the group's leader first, the member with the
least of its own, and the verified links give components; within a group only pairs of different components are still
open. Those are compared by their sketches, part by part of a group, and verified where the bound allows a link. So no group
of copies is ever expanded into rows of pairs, and no link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import cut, doc_text, split_hot, task
from specloom.llm.components import connected_components
from specloom.llm.hashing import SPACES, mix, shingle_hashes, token_hashes

WIDTH = 5
#: Shingles of a task's sets that are packed at once; bits of a hash that are counted, enough to tell common from rare.
COUNTED, RESOLUTION = 1 << 20, 40
#: The largest sum by which leaders are ordered, so that it and a count fit into 64 bits; larger ones are equal.
MOST_OWN = (1 << 31) - 1
#: Values that a task gathers before it hands them on.
HANDED = 1 << 18
#: Hashes that a task counts at once, and rows of blocks that one sorts, about.
RANGE, SORTED = 1 << 21, 1 << 20
#: A shingle found in so many sets is common; the most common ones, about 8 MB, are told to all tasks.
COMMON, MOST_COMMON = 6, 1 << 19
#: Members of a common block that a task gets, about; what lies above it is dealt to several tasks.
SALTED = 2048
#: Members of a group that a task compares with as many others.
PART = 512
#: Sets of so many texts are picked by a broadcast; more by a shuffled join.
BROADCAST_NODES = 1_000_000
_BLOCK = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z lower-cased. Two different shingles of a pair of texts have one
    64-bit hash with odds below 1e-10 even for texts of 20,000 words."""
    return np.unique(shingle_hashes(token_hashes(text.encode().lower(), SPACES)[0], WIDTH))


def node_of(shingles: np.ndarray) -> int:
    """The 64-bit name of a set, as a signed number."""
    parts = [np.bitwise_xor.reduce(mix(shingles ^ _BLOCK)), np.sum(mix(shingles + _BLOCK)), len(shingles)]
    return int(mix(np.cumsum(np.array(parts, np.uint64)))[-1:].view(np.int64)[0])


def layouts(n: int) -> list[tuple[int, int, int]]:
    """The sketches that a set of n shingles takes part in: band, bits of the block number, first blocks that are joined.

    Bands hold the sizes [4^k, 4^(k+1)); a set also takes part in the next band if it can link with a set there.
    """
    band = (n.bit_length() - 1) // 2
    end, largest = 4 ** (band + 1), 4 * n // 3
    found = [(band, (n + min(largest, end - 1)) // 7 + 1)]
    if largest >= end:
        found.append((band + 1, (n + largest) // 7 + 1))
    return [(k, max(12, 2 * k + 3), first) for k, first in found]


def block_keys(shingles: np.ndarray, often: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each sketch of a set, the names of the blocks that are joined and how common each is. often: how common the shingles are."""
    spread = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    for band, bits, first in layouts(len(shingles)):
        number = shingles >> np.uint64(64 - bits)
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        keys = mix(np.bitwise_xor.reduceat(spread, starts) ^ (number[starts] * _BLOCK + np.uint64(band)))
        rarest = np.minimum.reduceat(often, starts)
        if len(keys) > first:
            order = (np.minimum(rarest, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20))
            chosen = order <= np.partition(order, first - 1)[first - 1]
            keys, rarest = keys[chosen], rarest[chosen]
        yield keys, rarest


def pack_hashes(parts: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """The first RESOLUTION bits of hashes, repeats included, as compressed differences: a range, of 2^bits, and its blob."""
    import zstandard

    values = np.sort(np.concatenate([*parts, np.empty(0, np.uint64)]) >> np.uint64(64 - RESOLUTION))
    edges = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(RESOLUTION - bits))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for r in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(r), squeeze(np.diff(values[edges[r] : edges[r + 1]], prepend=np.uint64(0)).astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_hashes(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def _measured(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (0, doc_id, shingles, node, sketch) of all texts and (1, null, range, null, blob) of the hashes of a task's sets."""
    names = ["kind", "doc_id", "n", "node", "sketch"]

    @task("near")
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []
        pooled, known = 0, set()

        def packed() -> pa.RecordBatch:
            found = list(pack_hashes(pool, bits))
            size = len(found)
            columns = [pa.array(np.ones(size, np.int32)), pa.nulls(size, pa.int64()), pa.array([r for r, _ in found], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(size, pa.int64()), pa.array([b for _, b in found], pa.binary())], names)

        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                node = node_of(s)
                sizes.append(len(s))
                nodes.append(node)
                sketches.append(parity_sketch(s))
                if node not in known:
                    known.add(node)
                    pool.append(s)
                    pooled += len(s)
                if pooled > COUNTED:
                    yield packed()
                    pool.clear()
                    pooled = 0
            columns = [pa.array(np.zeros(len(nodes), np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        yield packed()

    return cut(doc_text(docs).mapInArrow(measure, "kind int, doc_id long, n long, node long, sketch binary"), "measured")


def _common(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The MOST_COMMON hashes (their first bits) that COMMON sets or more have, sorted, and in how many sets they are."""

    def count(group: pa.Table) -> pa.Table:
        values, n = np.unique(np.concatenate([unpack_hashes(b) for b in group.column("sketch").to_pylist()]), return_counts=True)
        often = n >= COMMON
        return pa.table({"hash": pa.array(values[often].astype(np.int64)), "n": pa.array(n[often].astype(np.int64))})

    blobs = measured.filter("kind = 1").select("n", "sketch")
    counts = blobs.groupBy("n").applyInArrow(count, "hash long, n long")
    found = counts.orderBy(F.desc("n"), "hash").limit(MOST_COMMON).toArrow()
    hashes, n = found.column("hash").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _blocks(docs: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(key, salt, order, node): the joined blocks of each set, once a task. order: own << 32 | shingles, own being the sum of
    1000 / sets over the shingles, so that the text that others are copies of comes before them; salt: -1, or of a block with many members the part of them that the set is in."""

    @task("near")
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        low = np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[common & low] = True
        keys, salts, orders, nodes = [], [], [], []

        def handed() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in (keys, salts, orders, nodes)]
            for x in (keys, salts, orders, nodes):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "salt", "order", "node"])

        for batch in batches:
            gathered = 0
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                if not len(s) or (node := node_of(s)) in known:
                    continue
                known.add(node)
                often = np.zeros(len(s), np.int64)
                if len(common):
                    brief = s >> np.uint64(64 - RESOLUTION)
                    at = np.flatnonzero(maybe[brief & low])
                    place = np.minimum(np.searchsorted(common, brief[at]), len(common) - 1)
                    often[at] = np.where(common[place] == brief[at], counts[place], 0)
                own = min(int(1000 * (1 / np.maximum(often, 1)).sum()), MOST_OWN)
                for k, found in block_keys(s, often):
                    parts = found // SALTED
                    keys.append(k.view(np.int64))
                    salts.append(np.where(parts > 0, node % (1 + parts), -1).astype(np.int32))
                    orders.append(np.full(len(k), own << 32 | len(s), np.int64))
                    nodes.append(np.full(len(k), node, np.int64))
                    gathered += len(k)
                if gathered > HANDED:
                    yield handed()
                    gathered = 0
            if keys:
                yield handed()

    return docs.mapInArrow(sketch, "key long, salt int, order long, node long")


def _lead(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` with the leader of each group, its first by order and node; head: whether it is the first row; pair: whether it
    is the last of two."""
    group = Window.partitionBy(*by).orderBy("order", "node")
    return rows.withColumns(
        {
            "leader": F.first("node").over(group),
            "leader_order": F.first("order").over(group),
            "head": F.lag("node").over(group).isNull(),
            "pair": F.lag("node", 2).over(group).isNull() & F.lead("node").over(group).isNull(),
        }
    )


def _groups(blocks: DataFrame, parts: int) -> DataFrame:
    """(node, order, leader, leader_order, pair, group): the members, but for the leader, of each block that several sets share.

    The rows are sorted in `parts` partitions. The parts of a block with many members have a leader each, and those are the members of one more group. group: the
    leader of the whole block, so that all pairs of a block are pairs of a group.
    """
    led = cut(_lead(blocks.repartition(parts, "key", "salt"), "key", "salt").filter("leader <> node OR (head AND salt >= 0)"), "led")
    heads = cut(_lead(led.filter("head AND salt >= 0").select("key", "order", "node"), "key"), "heads")
    tops = heads.select("key", F.col("leader").alias("top")).distinct()
    members = led.filter("leader <> node")
    plain = members.filter("salt < 0").withColumn("group", F.col("leader"))
    one, other = split_hot(members.filter("salt >= 0").withColumnRenamed("salt", "part"), tops, ["key"], F.xxhash64("node"))
    dealt = one.join(other, ["key", "salt"]).withColumn("pair", F.lit(False)).withColumn("group", F.col("top"))
    more = heads.filter("leader <> node").withColumn("pair", F.lit(False)).withColumn("group", F.col("leader"))
    columns = ["node", "order", "leader", "leader_order", "pair", "group"]
    return plain.select(columns).union(dealt.select(columns)).union(more.select(columns))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the sets named in `wanted` (node, rep), rep being the id of a row that has the set."""

    @task("near")
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = [shingle_set(text.as_py()) for text in batch.column("text").slice(at, 256)]
                columns = [pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    few = wanted.count() <= BROADCAST_NODES
    small = F.broadcast if few else lambda x: x
    ids = wanted.select("rep").distinct()
    texts = doc_text(docs).join(small(ids), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    rows = texts.mapInArrow(features, "node long, shingles array<long>")
    return cut(rows.join(small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")


def parity_sketch(shingles: np.ndarray) -> bytes:
    """A bit for each value of the hashes' low bits: the parity of the shingles that have it."""
    size = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches; the longer is folded onto the shorter's bits, by which parities add up."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _close(pairs: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that the sketches in `brief` (node, n, sketch) don't rule out, with the sketches' distance."""

    @task("near")
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            sa, sb = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            distance = np.array([sketch_distance(x, y) for x, y in zip(sa, sb, strict=True)], np.int64)
            kept = pa.array((100 + percent) * distance <= (100 - percent) * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(distance)], ["a", "b", "distance"]).filter(kept)

    a, b = (brief.toDF(x, f"n{x}", f"s{x}") for x in "ab")
    one, other = split_hot(pairs, b, ["b"], F.xxhash64("a"))  # one leader may have most members
    sized = one.join(a, "a").join(other, ["b", "salt"]).select("a", "b", "na", "nb", "sa", "sb")
    return sized.mapInArrow(near, "a long, b long, distance long")


def _within(members: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (group, node, component) of one group but of different components that the sketches don't rule out.

    A group is dealt into parts of about PART members, and a task compares two parts by their sketches alone, as matrices: no
    row is made for a pair that is ruled out, and a large group is work for many tasks.
    """
    names = ["node", "component", "part", "n", "sketch"]

    def compare(unit: pa.Table) -> pa.Table:
        one, two = unit.column("one")[0].as_py(), unit.column("two")[0].as_py()
        node, component, part, n = (unit.column(c).to_numpy() for c in names[:4])
        length = np.array([len(x) for x in unit.column("sketch").to_pylist()])
        rows = {int(k): np.flatnonzero(length == k) for k in np.unique(length)}
        bits = {k: np.array([np.frombuffer(unit.column("sketch")[int(i)].as_py(), np.uint64) for i in at]) for k, at in rows.items()}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k, at in rows.items():
            for other in (k, 2 * k):  # sets of linked sizes have sketches of one length, or one of twice the other's
                if other not in rows:
                    continue
                to, y = rows[other], bits[other]
                if other != k:
                    y = y.reshape(len(y), 2, -1)
                    y = y[:, 0] ^ y[:, 1]
                for i, x in zip(at, bits[k], strict=True):
                    if one == two:
                        pick = to > i if other == k else np.ones(len(to), bool)
                    else:
                        pick = (part[to] != part[i]) & ((to > i) | (other != k))
                    pick &= (component[to] != component[i]) & (4 * n[to] >= 3 * n[i]) & (3 * n[to] <= 4 * n[i])
                    if pick.any():
                        v = to[pick]
                        distance = np.bitwise_count(y[pick] ^ x).sum(1, dtype=np.int64)
                        v = v[(100 + percent) * distance <= (100 - percent) * (n[v] + n[i])]
                        found.append((np.full(len(v), node[i]), node[v]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    parts = members.groupBy("group").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"))
    parts = parts.filter("x < y").select("group", F.ceil(F.col("members") / PART).cast("int").alias("parts"))
    one, other = split_hot(members, parts, ["group"], F.xxhash64("node"))
    rows = one.join(other, ["group", "salt"]).drop("salt").join(brief, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    units = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("group", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), *names)
    return units.groupBy("group", "one", "two").applyInArrow(compare, "a long, b long").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the close `pairs` (a, b) whose sets have the similarity."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, cut(named.join(reps, "node"), "wanted"))
    a, b = (sets.toDF(x, f"w{x}") for x in "ab")
    common = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - common
    one, other = split_hot(pairs, b, ["b"], F.xxhash64("a"))
    return cut(one.join(a, "a").join(other, ["b", "salt"]).filter(100 * common >= percent * either).select("a", "b"), "links")


def jaccard_join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Link the texts of `docs` (doc_id, text) whose shingle sets have a Jaccard similarity of `percent` / 100 or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set is a text's distinct runs of five words, of
    a shorter text the one run of all. Returns a row for each row: doc_id, n_shingles and component_id, the smallest doc_id
    that links reach. Texts without words, and null texts, have no shingles and link with nothing. Equal sets link, so
    repeated rows share a component; rows with a null doc_id take part, have the component of their set, and a null
    one if nothing else is in it; an empty table gives none; other columns don't matter. Memory: a batch of rows, a text's
    hashes, and the names of a task's texts.
    """
    if percent != 75:
        raise ValueError("the size bands and prefixes are those of a similarity of 0.75")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = _measured(docs, (chars // 6 // RANGE).bit_length())  # a word has about six
    common, counts = _common(rows)
    shingles = rows.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    groups = _groups(_blocks(doc_text(docs).select("text"), common, counts), 8 + shingles // SORTED)
    texts = rows.filter("kind = 0 AND n > 0")
    brief = texts.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = texts.groupBy("node").agg(F.min("doc_id").alias("rep"))

    # Members against leaders: each member's closest leader first, which leaves most others in one component.
    size, leader_size = (F.col(c).bitwiseAND(0xFFFFFFFF) for c in ("order", "leader_order"))
    edges = groups.filter((4 * size >= 3 * leader_size) & (4 * leader_size >= 3 * size)).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    close = cut(_close(edges.distinct(), brief, percent), "close")
    first = cut(close.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b")), "first")
    links = _linked(first, docs, reps, percent)
    labels = connected_components(links)

    # Pairs that are left in different components: other leaders, and members of one block with each other.
    few = labels.count() <= BROADCAST_NODES

    def placed(frame: DataFrame, node: str) -> DataFrame:
        of = labels.toDF(node, f"{node}_component")
        frame = frame.join(F.broadcast(of) if few else of, node, "left")
        return frame.withColumn(f"{node}_component", F.coalesce(f"{node}_component", node))

    others = placed(placed(close.join(first, ["a", "b"], "left_anti"), "a"), "b").filter("a_component <> b_component").select("a", "b")
    many = groups.filter("NOT pair")
    members = many.select("group", "node").union(many.select("group", "leader")).distinct()
    members = placed(members, "node").withColumnRenamed("node_component", "component")
    more = cut(_within(members, brief, percent).union(others).distinct(), "close")
    if not more.isEmpty():
        extra = _linked(more, docs, reps, percent)
        if not extra.isEmpty():
            labels = connected_components(links.union(extra))

    # The least id of a set, then of a component: copies are added up before anything is dealt by component.
    sets = texts.groupBy("node").agg(F.min("doc_id").alias("own")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sets = cut(sets, "components")
    least = sets.groupBy("component").agg(F.min("own").alias("least"))
    one, other = split_hot(sets, least, ["component"], F.xxhash64("node"))
    found = cut(one.join(other, ["component", "salt"]).select("node", "least"), "found")
    one, other = split_hot(rows.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node"), found, ["node"], F.xxhash64("doc_id"))
    of = one.join(other, ["node", "salt"], "left")
    return of.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
