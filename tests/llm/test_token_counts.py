import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from specloom.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_rows(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        got = sorted(map(repr, T.token_counts(docs, PATH).collect()))
        rows = [(r["doc_id"], len((r["text"] or "").encode()), library(r["text"])) for r in docs.collect()]
        assert got == sorted(f"Row(doc_id={d}, n_bytes={b}, n_tokens={n}, over_limit={n > 1024})" for d, b, n in rows)
    assert T.token_counts(no_docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdest'rl  \n\t.!?09é²½ 　\u0085中文", max_size=60), st.integers(1, 9))
def test_chunks_compose(text, size):
    counter, kept = T.counter(PATH), T.CHUNK
    T.CHUNK = size
    try:
        assert counter(text) == library(text)
    finally:
        T.CHUNK = kept
    assert counter(text + "<|endoftext|>" + text) == library(text + "<|endoftext|>" + text)


def test_transitions_add_up():
    machine = T.counter(PATH).machine.words
    for word in ("unbelievable", " the", "zzzzzzzz", "naïveté", bytes(range(1, 60)).decode()):
        assert machine.read(machine.START, word)[1] == len(machine.merged(word.encode()))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40), st.text(alphabet="'rvelstmd ' aB1\x1c\x1f\x85\u180e\u200b\n", max_size=40))
def test_any_text(one, other):
    for text in (one, other, one + other):
        assert T.counter(PATH)(text) == library(text)


def test_memory_is_emptied(monkeypatch):
    counter = T.TokenCounter(PATH)
    monkeypatch.setattr(T, "MEMO_TRANSITIONS", 50)
    monkeypatch.setattr(T, "MEMO_PAIRS", 20)
    monkeypatch.setattr(T, "CHUNK", 64)
    text = "The quick brown fox's  jumps\n\n over 12345 lazy dogs, isn't it? " * 40
    assert counter(text) == library(text) and counter.machine.n_cells <= 50 and len(counter.machine.words.follows) <= 20


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import pytest

    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in (dict(pre_tokenizer={"type": "Whitespace"}), dict(normalizer={"type": "Lowercase"}), dict(model=spec["model"] | {"dropout": 0.1})):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            T.TokenCounter(str(tmp_path / "v.json"))
