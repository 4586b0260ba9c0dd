"""Harmonic packing of token sequences.

Lengths are partitioned into reciprocal-capacity classes: class k holds the documents of more than C/(k+1) and at most C/k
tokens, and a bin of class k is filled with exactly k of them, whole. Lengths of at most C/CLASSES tokens share the last
class, whose bins take what fits. Each worker fills its own bins, one open bin a class, without hearing of the others.

What k documents leave of a bin is filled as well, so that sequences aren't padded: by the next document that fits into it
whole, the tightest such rest first, and once PENDING bins wait, by the beginning of a document that fits into none. So
documents are cut only where they exceed C or fill a rest. When a worker's rows end, what is open goes into as few bins as
hold it, and one sequence of the worker is padded at most.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from specloom.llm.common import cache, doc_text, task

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "harmonic_class int"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Classes of lengths, and bins that wait for their rest to be filled.
CLASSES, PENDING = 64, 64
#: Words that a worker keeps the ids of; beyond it the memory is emptied.
MEMO_WORDS = 700_000
#: Words that are one piece of Latin letters, alone or before one piece of marks, for a tokenizer that parts letters and marks.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]{1,8})?").fullmatch

_encoders: dict[str, "WordEncoder"] = cache()


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizer that never joins across ASCII space and, if it
    marks the ends of pieces, lower-cases and parts letters from marks.

    A tokenizer that drops white space gives a text the ids of its words one after the other, so a word is encoded
    once and remembered. Texts that spell a special token are encoded whole, as the tokenizer sees them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        model = json.loads(self.tokenizer.to_str())["model"]
        #: By id, whether a token ends a piece; None if the vocabulary doesn't mark it.
        self.ends = None
        if suffix := model.get("end_of_word_suffix"):
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str], pieces: list[int]) -> list[bytes]:
        """The ids of words with a known number of pieces each: encoded as one text, and parted after so many ends of pieces."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        cuts = [0, *(4 * ends[np.cumsum(pieces) - 1]).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _marks(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self.marks[marks] = self._raw([marks])[0]
        return found

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            plain, pieces, rest = [], [], []
            for w in part:
                m = PLAIN(text := w.decode()) if self.ends is not None else None
                if m:
                    marks = m.group(2)
                    known = self.memo.get(m.group(1).lower().encode())  # letters have the ids of lower case
                    if known is not None:
                        self.memo[w] = known + self._marks(marks) if marks else known
                    else:
                        plain.append((w, text))
                        pieces.append(1 + bool(marks))
                else:
                    rest.append((w, text))
            if plain:
                self.memo.update(zip((w for w, _ in plain), self._plain([t for _, t in plain], pieces), strict=True))
            if rest:
                self.memo.update(zip((w for w, _ in rest), self._raw([t for _, t in rest]), strict=True))

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._raw([text])[0]
        words = text.encode().split()
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            new = [w for w in set(words) if w not in memo]
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                self.marks.clear()
                new = list(set(words))
            self._learn(new)
            return b"".join(map(memo.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


Piece = tuple[int, int, memoryview, int]  # doc_id, start, ids, doc_tokens


class HarmonicBins:
    """The bins of one worker. `add` takes a document and gives back the rows of the sequences that it completes; `close` gives
    those of the rest. Memory: the ids of an open bin for each class, and of the bins that wait."""

    def __init__(self, capacity: int, worker: int, classes: int = CLASSES, pending: int = PENDING):
        self.capacity, self.next_id, self.classes, self.most = capacity, worker << 36, classes, pending
        self.open: dict[int, list[Piece]] = {}
        self.used: dict[int, int] = {}
        self.waiting: list[tuple[int, int]] = []  # (rest, bin), by rest
        self.bins: dict[int, tuple[int, list[Piece]]] = {}
        self.n_bins = 0

    def class_of(self, length: int) -> int:
        return min(self.capacity // length, self.classes)

    def _placed(self, k: int, pieces: list[Piece]) -> list[tuple]:
        rows, at = [], 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // 4
            rows.append((doc_id, start, length, zlib.crc32(ids), doc_tokens, self.next_id, at, k))
            at += length
        self.next_id += 1
        return rows

    def _filled(self, k: int, pieces: list[Piece], rest: int) -> list[tuple]:
        """A bin's rows if it is full; else it waits."""
        if not rest:
            return self._placed(k, pieces)
        self.bins[self.n_bins] = (k, pieces)
        insort(self.waiting, (rest, self.n_bins))
        self.n_bins += 1
        return []

    def _fill(self, place: int, piece: Piece) -> list[tuple]:
        """Put a piece into the rest of a waiting bin that holds it."""
        rest, number = self.waiting.pop(place)
        k, pieces = self.bins.pop(number)
        return self._filled(k, [*pieces, piece], rest - len(piece[2]) // 4)

    def add(self, doc_id: int, ids: bytes) -> list[tuple]:
        n, at, rows, view = len(ids) // 4, 0, [], memoryview(ids)
        while n - at >= self.capacity:
            rows += self._placed(1, [(doc_id, at, view[4 * at : 4 * (at + self.capacity)], n)])
            at += self.capacity
        while at < n:
            place = bisect_left(self.waiting, (n - at, -1))
            if place < len(self.waiting):
                return rows + self._fill(place, (doc_id, at, view[4 * at :], n))
            if len(self.waiting) < self.most:
                return rows + self._join((doc_id, at, view[4 * at :], n))
            cut = at + self.waiting[0][0]  # the least rest is the hardest to fill
            rows += self._fill(0, (doc_id, at, view[4 * at : 4 * cut], n))
            at = cut
        return rows

    def _join(self, piece: Piece) -> list[tuple]:
        """Put a piece into the open bin of its class."""
        length, rows = len(piece[2]) // 4, []
        k = self.class_of(length)
        pieces, used = self.open.setdefault(k, []), self.used.get(k, 0)
        if used + length > self.capacity:  # in the last class alone
            rows, pieces, used = self._filled(k, pieces, self.capacity - used), [], 0
        pieces.append(piece)
        self.open[k], self.used[k] = pieces, used + length
        if len(pieces) == k < self.classes or self.used[k] == self.capacity:
            rows += self._filled(k, pieces, self.capacity - self.used[k])
            self.open[k], self.used[k] = [], 0
        return rows

    def close(self) -> list[tuple]:
        """The rows of all that is open: rests of waiting bins are filled by what is in open ones, the fullest first; where
        that isn't enough, bins with large rests are taken apart."""
        size = lambda piece: len(piece[2]) // 4
        loose = [p for pieces in self.open.values() for p in pieces]
        self.open, self.used = {}, {}
        while sum(rest for rest, _ in self.waiting) > sum(map(size, loose)):
            _, number = self.waiting.pop()
            loose += self.bins.pop(number)[1]
        rows, kept = [], []
        for piece in sorted(loose, key=size, reverse=True):
            place = bisect_left(self.waiting, (size(piece), -1))
            if place < len(self.waiting):
                rows += self._fill(place, piece)
            else:
                kept.append(piece)
        k, pieces, rest = self.classes, [], self.capacity
        if self.waiting:
            rest, number = self.waiting.pop()
            k, pieces = self.bins.pop(number)
        while kept:
            doc_id, start, ids, n = kept.pop()
            fits = min(rest, len(ids) // 4)
            pieces = [*pieces, (doc_id, start, ids[: 4 * fits], n)]
            rest -= fits
            if 4 * fits < len(ids):
                kept.append((doc_id, start + fits, ids[4 * fits :], n))
            if not rest:
                rows += self._placed(k, pieces)
                k, pieces, rest = self.classes, [], self.capacity
                if self.waiting:
                    rest, number = self.waiting.pop()
                    k, pieces = self.bins.pop(number)
        return rows + (self._placed(k, pieces) if pieces else [])


def harmonic_pack(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, make_encoder: Callable[[str], Callable[[str], bytes]] = encoder
) -> DataFrame:
    """Pack the token sequences of `docs` (doc_id, text) into sequences of at most `capacity` tokens, a power of two.

    A document's tokens are its ids by the vocabulary file, then `end_id`; a null or empty text is the one token
    `end_id`. Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    harmonic_class, the count of documents that its bin was filled with before its rest was (CLASSES or more in the last class). Repeated rows are packed as often as they occur;
    a null doc_id stays null; an empty table gives none; columns besides doc_id and text don't matter. The ids of a
    sequence follow from the input's partitions alone, so a repeated task gives the same rows. Memory: the open bins
    of the classes and the waiting ones, a batch of rows and MEMO_WORDS words.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    @task("packing")
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(vocabulary)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId())
        end = end_id.to_bytes(4, "little")

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += bins.add(doc_id, encode(text) + end)
            if rows:
                yield frame(rows)
        if rows := bins.close():
            yield frame(rows)

    return doc_text(docs).mapInArrow(pack, SCHEMA)
