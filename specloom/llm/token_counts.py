"""Exact token counts by compiled finite-state transducers.

A byte-level BPE vocabulary and the pattern that cuts texts into words before it are compiled, state by state as texts need
them, into one deterministic transducer over characters. A transition is annotated with the tokens that it adds to the
count (less than one where tokens merge), and so is the end of a text in each state.

Within a word its states follow from one fact: every prefix of a word has one encoding, and the encoding of a longer prefix
ends in a token whose start is the end of an encoded shorter prefix. So a state is the set of places from which a token may
still reach further, each with its place in the vocabulary's trie, the last token of the encoding up to it, and its count
relative to the present one. Between words it is what the pattern still has open: white space whose last character may
belong to the next word, or an apostrophe that may begin a contraction.

White space after other text leads to one state, whatever the state before. A chunk of a text therefore maps any state
before it to a count and a state after it by two parts: the text up to its first such place, which is run from the state
that it is given, and the count and the state from there on. These maps compose associatively, and long texts are counted
by the up-sweep of a prefix scan over their chunks' maps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame

from specloom.llm.common import cache, doc_text, task

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Transitions that a worker keeps, and pairs of tokens that it knows to follow each other; beyond them the memory is emptied.
MEMO_TRANSITIONS, MEMO_PAIRS = 600_000, 500_000
#: Characters of a chunk.
CHUNK = 1 << 16
# Unicode's White_Space; the pattern by which the public byte-level vocabularies cut words, and its contractions.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = frozenset("'s 't 're 've 'm 'll 'd".split())

FIXED = re.compile(f"[^{WHITE}][{WHITE}]")
_counters: dict[str, "TokenCounter"] = cache()
Places = tuple[tuple[int, int, int], ...]
State = tuple[str, Places, str]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeTransducer:
    """The transducer of a merge list over the bytes of a word. A state is the places from which a token may reach further."""

    START: Places = ((0, -1, 0),)

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.tokens, self.merges = tokens, merges
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.children: dict[int, int] = {}  # node << 8 | byte: node
        self.inner = {0}  # nodes that some longer token passes
        self.token_at: dict[int, int] = {}
        n = 0
        for token, i in tokens.items():
            node = 0
            for b in token:
                self.inner.add(node)
                child = self.children.get(node << 8 | b)
                if child is None:
                    n += 1
                    child = self.children[node << 8 | b] = n
                node = child
            self.token_at[node] = i
        self.follows: dict[int, bool] = {}  # last token + 1 << 32 | token: may it follow

    def merged(self, word: bytes) -> list[bytes]:
        """The encoding by its definition: merge the pair of lowest rank, the first of equals, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the encoding of both texts joined is these two tokens; last -1: of the one, that token."""
        key = last + 1 << 32 | token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= MEMO_PAIRS:
                self.follows.clear()
            b = self.bytes_of[token]
            a = [self.bytes_of[last]] if last >= 0 else []
            known = self.follows[key] = self.merged(b"".join([*a, b])) == [*a, b]
        return known

    def move(self, state: Places, byte: int) -> tuple[Places, int]:
        """The state after a byte, and the tokens that it adds."""
        further, found = [], None
        for node, last, less in state:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token_at.get(child)
            if found is None and token is not None and self.may_follow(last, token):
                found = (token, less + 1)
            if child in self.inner:
                further.append((child, last, less))
        token, added = found
        return (*((node, last, less - added) for node, last, less in further), (0, token, 0)), added

    def read(self, state: Places, text: str) -> tuple[Places, int]:
        total = 0
        for b in text.encode():
            state, added = self.move(state, b)
            total += added
        return state, total


class Table(dict):
    """The transitions of a state: character to (tokens added, table of the next state), compiled when first asked for."""

    __slots__ = ("state", "machine")

    def __missing__(self, c: str) -> tuple[int, Table]:
        cell = self[c] = self.machine.compile(self.state, c)
        return cell


class TextTransducer:
    """The transducer of whole texts. A state is (kind, places, held): kind is the class of the open word (L letters, N numbers, O
    other), W in white space, A after an apostrophe, or S where nothing is open; places are the word's, or those of the white
    space but its last character; held is that character, or the begun contraction."""

    def __init__(self, words: BpeTransducer):
        import regex

        self.words, self.classes = words, {}
        self.letter, self.digit, self.space = (regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self.reset()

    def reset(self) -> None:
        self.tables: dict[State, Table] = {}
        self.n_cells = 0

    def table(self, state: State) -> Table:
        found = self.tables.get(state)
        if found is None:
            found = self.tables[state] = Table()
            found.state, found.machine = state, self
        return found

    def class_of(self, c: str) -> str:
        found = self.classes.get(c)
        if found is None:
            found = self.classes[c] = "L" if self.letter(c) else "N" if self.digit(c) else "W" if self.space(c) else "O"
        return found

    def compile(self, state: State, c: str) -> tuple[int, Table]:
        if self.n_cells >= MEMO_TRANSITIONS:
            self.reset()  # tables in use go on by themselves
        self.n_cells += 1
        after, added = self.step(state, c)
        return added, self.table(after)

    def begin(self, c: str) -> tuple[State, int]:
        """The state after a character that begins a token."""
        kind = self.class_of(c)
        if kind == "W":
            return ("W", self.words.START, c), 0
        if c == "'":
            return ("A", (), c), 0
        places, added = self.words.read(self.words.START, c)
        return (kind, places, ""), added

    def step(self, state: State, c: str) -> tuple[State, int]:
        (kind, places, held), new, words = state, self.class_of(c), self.words
        if kind == "S":
            return self.begin(c)
        if kind == "W":
            if new == "W":
                places, added = words.read(places, held)
                return ("W", places, c), added
            if held == " ":  # the last space belongs to the word
                places, added = words.read(words.START, " " + c)
                return (new, places, ""), added
            after, added = self.begin(c)
            return after, added + self.ends(("W", words.START, held))
        if kind == "A":
            if held + c in CONTRACTIONS:
                return ("S", (), ""), words.read(words.START, held + c)[1]
            if any(x.startswith(held + c) for x in CONTRACTIONS):
                return ("A", (), held + c), 0
            places, added = words.read(words.START, "'")
            after: State = ("O", places, "")
            for x in held[1:] + c:
                after, more = self.step(after, x)
                added += more
            return after, added
        if new == kind:
            places, added = words.read(places, c)
            return (kind, places, ""), added
        return self.begin(c)

    def ends(self, state: State) -> int:
        """The tokens that the end of a text adds."""
        kind, places, held = state
        if kind == "W":
            return self.words.read(places, held)[1]
        if kind == "A":
            return self.words.read(self.words.START, "'")[1] + (self.words.read(self.words.START, held[1:])[1] if held[1:] else 0)
        return 0

    def run(self, table: Table, text: str) -> tuple[int, Table]:
        total = 0
        for c in text:
            added, table = table[c]
            total += added
        return total, table


class TokenCounter:
    """Counts the tokens of texts as the tokenizers library does for a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        check_pipeline(spec)
        letters = byte_letters()
        as_bytes = lambda s: bytes(map(letters.__getitem__, s))
        self.special = [x["content"] for x in spec["added_tokens"]]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        merges = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        tokens = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.machine = TextTransducer(BpeTransducer(tokens, merges))
        self.cut_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def fixed(self, white: str) -> Table:
        """The table of the one state after white space that follows other text."""
        return self.machine.table(("W", BpeTransducer.START, white))

    def chunk_map(self, chunk: str) -> tuple[str, int, Table | None]:
        """A chunk's state map: the text that is run from the state before it; with a fixed state inside, the count from there
        on and the table of the state after the chunk, else 0 and None."""
        m = FIXED.search(chunk)
        if m is None:
            return chunk, 0, None
        n, table = self.machine.run(self.fixed(chunk[m.end() - 1]), chunk[m.end() :])
        return chunk[: m.end()], n, table

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a's chunk followed by b's: what b's takes from before is run from the state that a's leaves."""
        if a[2] is None:
            head = a[0] + b[0]
            m = FIXED.search(head)  # the chunks may meet at a fixed state
            if m is None or m.end() == len(head) and b[2] is not None:
                return head, b[1], b[2]
            n, table = self.machine.run(self.fixed(head[m.end() - 1]), head[m.end() :])
            return head[: m.end()], n + b[1], table if b[2] is None else b[2]
        n, table = self.machine.run(a[2], b[0])
        return a[0], a[1] + n + b[1], table if b[2] is None else b[2]

    def plain(self, text: str) -> int:
        """The count of a text that spells no special token."""
        machine = self.machine
        start = machine.table(("S", (), ""))
        if len(text) <= CHUNK:
            n, table = machine.run(start, text)
            return n + machine.ends(table.state)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # neighbours compose, and the number of maps halves
            maps = [reduce(self.compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
        head, count, table = maps[0]
        n, last = machine.run(start, head)
        return n + count + machine.ends((last if table is None else table).state)

    def __call__(self, text: str) -> int:
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut_special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def check_pipeline(spec: dict) -> None:
    """Raise unless a vocabulary file asks for what is compiled here: byte-level BPE on words cut by PATTERN."""
    model, cutting = spec["model"], spec.get("pre_tokenizer") or {}
    steps = cutting.get("pretokenizers", [cutting])
    plain = [s for s in steps if s.get("type") == "ByteLevel"]
    others = [s for s in steps if s.get("type") != "ByteLevel"]
    by_pattern = [s for s in others if s.get("type") == "Split" and s.get("pattern", {}).get("Regex") == PATTERN]
    cut = len(plain) == 1 and (plain[0].get("use_regex", True) if not others else len(others) == len(by_pattern) == 1 and not plain[0].get("use_regex", True))
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or not cut or (plain and plain[0].get("add_prefix_space")) or spec.get("normalizer") or odd or model.get("ignore_merges") or model.get("byte_fallback"):
        raise ValueError("the vocabulary file isn't plain byte-level BPE with the words of PATTERN")


def counter(path: str) -> TokenCounter:
    """The worker's counter for a vocabulary file, compiled once."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text of `docs` (doc_id, text) under a byte-level BPE vocabulary file.

    Returns doc_id, n_bytes (UTF-8), n_tokens (no begin, end or added tokens; a special token's string counts as that
    token) and over_limit (n_tokens > limit), a row for each row. Null and empty texts count 0; repeated rows stay
    repeated; a null doc_id stays null; an empty table gives none; other columns don't matter. Memory: a batch of rows,
    MEMO_TRANSITIONS transitions and MEMO_PAIRS pairs.
    """

    @task("token counts")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [tokens(text) for text in texts]
            columns = [pa.array([len(text.encode()) for text in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_text(docs).mapInArrow(count, SCHEMA)
