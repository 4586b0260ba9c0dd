import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from specloom.llm.packing import HarmonicBins, encoder, harmonic_pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, pieces, capacity):
    """Every id of every row in exactly one piece, sequences without gaps, padding only in a worker's last sequence."""
    tokenizer = Tokenizer.from_file(PATH)
    wanted = defaultdict(int)
    for doc_id, text in docs:
        wanted[doc_id, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for (doc_id, ids), times in wanted.items():
        own = [p for p in got[doc_id] if p["doc_tokens"] == len(ids) // 4]
        at = 0
        while at < len(ids) // 4:
            here = [p for p in own if p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])]
            assert len(here) >= times
            at += here[0]["length"]
    assert sum(p["length"] for p in pieces) == sum(len(ids) // 4 * n for (_, ids), n in wanted.items())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in places) for places in sequences.values()]


def test_documents(documents):
    pieces = harmonic_pack(documents, PATH).collect()
    used = check([(r["doc_id"], r["text"]) for r in documents.collect()], pieces, 4096)
    assert sum(n < 4096 for n in used) <= documents.rdd.getNumPartitions()
    assert len(pieces) < 1.5 * documents.count()


def test_odd_rows(odd_docs, no_docs):
    check([(r["doc_id"], r["text"]) for r in odd_docs.collect()], harmonic_pack(odd_docs, PATH, capacity=64).collect(), 64)
    assert harmonic_pack(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        harmonic_pack(odd_docs, PATH, capacity=100)


@settings(deadline=None)
@given(st.lists(st.integers(1, 300), max_size=200), st.integers(1, 12), st.integers(1, 8))
def test_bins(lengths, classes, pending):
    """Each id once, in order of its document; no sequence but one has a gap; documents of a class are whole, and as many as it says."""
    bins, placed, docs = HarmonicBins(64, 3, classes, pending), [], {}
    for d, n in enumerate(lengths):
        docs[d] = np.arange(n, dtype="<u4").tobytes()
        placed += bins.add(d, docs[d])
    placed += bins.close()
    full, covered = defaultdict(list), defaultdict(list)
    for d, start, length, crc, n, sequence, offset, k in placed:
        assert length > 0 and n == lengths[d] and crc == zlib.crc32(docs[d][4 * start : 4 * (start + length)])
        full[sequence].append((offset, length))
        covered[d].append((start, length))
    for runs, whole in ((full, None), (covered, lengths)):
        for key, parts in runs.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at <= 64 if whole is None else at == whole[key]
    assert sum(sum(n for _, n in v) < 64 for v in full.values()) <= 1 and covered.keys() == docs.keys()


def test_a_bin_holds_the_count_of_its_class():
    """Documents of a third to a quarter of the capacity go three to a bin, whole, and what is left is filled by the next that fits."""
    bins, rows = HarmonicBins(64, 0), []
    for d, n in enumerate([18, 20, 21, 17, 19, 21, 5, 7]):
        rows += bins.add(d, bytes(4 * n))
    assert [(r[0], r[7]) for r in rows] == [(0, 3), (1, 3), (2, 3), (6, 3), (3, 3), (4, 3), (5, 3), (7, 3)] and not bins.close()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abC dé\n\t'st \x1cİΣ3<|>", max_size=40))
def test_words_encode_as_texts(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert encoder(PATH)(text) == np.array(ids, "<u4").tobytes()
