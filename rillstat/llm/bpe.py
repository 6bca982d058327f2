"""Byte-pair encoding of whole texts by a tokenization automaton.

Published method: M. Berglund, W. Martens, B. van der Merwe, "Constructing a BPE
Tokenization DFA" (2024). The automaton reads tokens, and its paths are exactly
the token sequences that the merges produce.

It starts with one state that has an arc for every byte. Each merge (u, v) -> w,
in order, puts in its gadget: the state that u leads to is replaced by a copy
without the arc v (so u can no longer be followed by v), and wherever u and then
v could be read, the arc w leads to where v led. A state is thus a chain of
(removed arc, merge number) links; a token's state is fixed by the token alone.
The compiled transition table is the complement: all removed arcs of all states,
(state, token) -> merge number, in one hash table. A token's arc is in a state
unless it, or the arc of a left part from which it came, was removed before the
merge that needed it; so a transition takes one look-up for each left part.

A pre-split word is encoded in one pass over its bytes, without backtracking: as
every prefix of a word has exactly one path, the last token of a prefix is the
one token ending there whose start has a path with an arc for it. The paths of
words met lately are kept (a bounded number). Decoding emits the labels of the
arcs.

The tokenizer is a public vocabulary file in the format of the `tokenizers`
library (byte-level BPE); the file's content goes to the workers by broadcast,
its size is checked, and the file need only be on the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MAX_FILE_BYTES = 32 * 2**20
_KEPT_WORDS = 400_000
_KEPT_WORD_CHARS = 64
_START = -1


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a vocabulary file of the installed public tokenizers, where no path is given."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_of_char() -> dict[str, int]:
    """The printable characters by which vocabulary files write bytes: printable Latin-1 as is, the rest from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of one vocabulary file's merges, with encoding and decoding of words."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        byte = _byte_of_char()
        vocab: dict[str, int] = model["vocab"]
        self.token = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
        self.label: dict[int, bytes] = {i: b for b, i in self.token.items()}
        self.left: dict[int, int] = {}  # of a merged token, its left part
        self.born: dict[int, int] = {}  # and the number of its merge
        #: links of the states' chains: (next link, removed arc, merge number)
        self.links: list[tuple[int, int, int]] = []
        #: the state after each token: a link number, _START for the state with all arcs
        self.state: dict[int, int] = {}
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self._gadget(n, vocab[a], vocab[b], vocab[a + b])
        #: the tokens that end with a byte string, by a trie of reversed tokens: node << 8 | byte -> node
        self.trie: dict[int, int] = {}
        self.node_token: list[int] = [-1]
        for b, t in self.token.items():
            at = 0
            for x in reversed(b):
                step = at << 8 | x
                at = self.trie.get(step, 0)
                if not at:
                    at = self.trie[step] = len(self.node_token)
                    self.node_token.append(-1)
            self.node_token[at] = t
        self._compile()
        self.words = _Words(self)
        self.lengths = _Lengths(self.words)
        self.split = regex.compile(PATTERN).findall

    def _gadget(self, n: int, u: int, v: int, w: int) -> None:
        if w in self.born:
            return
        self.state[w] = self.state.get(v, _START)
        self.left[w], self.born[w] = u, n
        self.links.append((self.state.get(u, _START), v, n))
        self.state[u] = len(self.links) - 1

    def _compile(self) -> None:
        """The table of removed arcs, and for each token the steps of its history: (token << 20, last merge that counts)."""
        self.gone: dict[int, int] = {}
        for t, at in self.state.items():
            while at != _START:
                at, arc, n = self.links[at]
                self.gone[t << 20 | arc] = n  # the chain goes back in time: the first removal stays
        last = len(self.links) + 1
        self.history: dict[int, tuple[tuple[int, int], ...]] = {}
        for t in self.label:
            steps, x, until = [], t, last
            while True:
                steps.append((x, until))
                if x not in self.left:
                    break
                until, x = self.born[x], self.left[x]
            self.history[t] = tuple(steps)
        self.links = []

    def has_arc(self, before: int, t: int) -> bool:
        """Whether the state after token ``before`` reads token ``t``; the start (-1) reads every token."""
        if before < 0:
            return True
        row, gone = before << 20, self.gone
        for x, until in self.history[t]:
            n = gone.get(row | x)
            if n is not None and n <= until:
                return False
        return True

    def path(self, word: bytes) -> tuple[int, ...]:
        """The one token path of a pre-split word."""
        trie, tokens, last = self.trie, self.node_token, [-1] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            node, start = 0, end
            while start:
                start -= 1
                node = trie.get(node << 8 | word[start], 0)
                if not node:
                    break
                t = tokens[node]
                if t >= 0 and (not start or last[start] >= 0) and self.has_arc(last[start], t):
                    last[end] = t
                    break
        out, at = [], len(word)
        while at:
            t = last[at]
            if t < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(t)
            at -= len(self.label[t])
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else []

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids. Ids of a whole text give it back exactly; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace") if ids is not None and len(ids) else ""


class _Words(dict):
    """Paths of the words met lately. Long or many words are looked up again instead of kept."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        path = self.automaton.path(word.encode("utf-8"))
        if len(word) <= _KEPT_WORD_CHARS:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            self[word] = path
        return path


class _Lengths(dict):
    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, word: str) -> int:
        n = len(self.words[word])
        if len(word) <= _KEPT_WORD_CHARS:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


_BUILT: dict[str, TokenAutomaton] = {}


def automaton(content: bytes) -> TokenAutomaton:
    """The automaton of a vocabulary file's content, built once per process."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = TokenAutomaton(content)
    return _BUILT[key]


def _shipped(spark: SparkSession, path: str | None):
    path = path or tokenizer_path()
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str | Column = "text", path: str | None = None) -> Column:
    """ARRAY<INT> column: the ids of each text of ``df`` as it stands, without special tokens.

    Null and empty texts both give an empty list. Whole texts are encoded, of
    any length; strings that look like special tokens are ordinary text.
    """
    content = _shipped(df.sparkSession, path)

    @F.arrow_udf("array<int>")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(content.value)
        for part in parts:
            ends, flat, n = [0], [], 0
            for t in part.to_pylist():
                if t:
                    got = np.fromiter(chain.from_iterable(map(a.words.__getitem__, a.split(t))), dtype=np.int32)
                    flat.append(got)
                    n += len(got)
                ends.append(n)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))

    return ids(F.col(text) if isinstance(text, str) else text)


def count_tokens(df: DataFrame, text: str | Column = "text", path: str | None = None) -> Column:
    """INT column: the number of ids that ``encode`` gives, without making the lists."""
    content = _shipped(df.sparkSession, path)

    @F.arrow_udf("int")
    def n(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(content.value)
        for part in parts:
            yield pa.array([sum(map(a.lengths.__getitem__, a.split(t))) if t else 0 for t in part.to_pylist()], pa.int32())

    return n(F.col(text) if isinstance(text, str) else text)


def decode(df: DataFrame, ids: str | Column = "ids", path: str | None = None) -> Column:
    """STRING column: the text of each list of ids; a null list gives an empty text."""
    content = _shipped(df.sparkSession, path)

    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(content.value)
        for part in parts:
            yield pa.array([a.decode(x) for x in part.to_pylist()], pa.string())

    return text(F.col(ids) if isinstance(ids, str) else ids)
