"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes if and only if each token encodes itself and each neighbouring pair
(a, b) encodes as [a, b]. So after reading a prefix of a word, every position has exactly one last token, and what is
undecided is a short tree of such tokens: those that end where a longer token may still begin. The transducer's state is
that tree and the unread suffix's place in the vocabulary's trie. States and transitions are made when first met, and a
transition emits the tokens on which all branches agree, so the lookahead is bounded by the longest token. Tokens of words
met before come from a table; both tables are dropped when they reach a fixed size, which changes no result.
Decoding joins the tokens' bytes and reads them with an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every entry point.
TOKENIZERS = "/opt/tokenizers"
#: How text is cut into words before byte pairs are merged (fixed value of the vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which the word table, and states after which the transducer, start anew.
MOST_WORDS, MOST_STATES = 200_000, 200_000
#: Bytes of a word between two looks at the number of states.
STRETCH = 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain byte-pair merging, lowest rank first and leftmost among equals; used on short words only."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes words; deterministic, with states made on demand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.texts = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        own = {t: i for t, i in ranks.items() if merge(t, ranks) == [i]}
        # trie of the tokens that encode themselves: children and the token that ends at a node
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, i in own.items():
            node = 0
            for b in text:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self.reset()

    def reset(self) -> None:
        # a state: its open positions as (trie node of what was read since, undecided tokens up to it), latest first
        self.states: list[tuple[tuple[int, tuple[int, ...]], ...]] = [((0, ()),)]
        self.last: list[int] = [-1]
        self.number = {(self.states[0], -1): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = merge(self.texts[a] + self.texts[b], self.ranks) == [a, b]
            if len(self.pairs) > 4 * MOST_STATES:
                self.pairs.clear()
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that are decided; ``last`` of a state is the token before its undecided ones."""
        before = self.last[state]
        live, path = [], None
        for node, tokens in self.states[state]:
            node = self.child[node].get(byte, -1)
            if node < 0:
                continue
            live.append((node, tokens))
        # the one token that ends here and fits the tokens before its own beginning; longest first
        for node, tokens in reversed(live):
            t = self.token[node]
            if t >= 0:
                a = tokens[-1] if tokens else before
                if a < 0 or self.fits(a, t):
                    path = (*tokens, t)
                    break
        if path is None:
            raise ValueError("the vocabulary has no token for a byte")
        grow = [(node, tokens) for node, tokens in live if self.child[node]]
        branches = [(0, path), *grow]
        agreed = 0
        shortest = min(len(p) for _, p in branches)
        while agreed < shortest and all(p[agreed] == path[agreed] for _, p in branches):
            agreed += 1
        out = path[:agreed]
        key = tuple((node, p[agreed:]) for node, p in branches), (out[-1] if out else before)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key[0])
            self.last.append(key[1])
        move = self.moves[state << 8 | byte] = (number, out)
        return move

    def encode(self, word: bytes) -> list[int]:
        state, ids = 0, []
        for at in range(0, len(word), STRETCH):
            moves = self.moves
            for byte in word[at : at + STRETCH]:
                move = moves.get(state << 8 | byte) or self.step(state, byte)
                state = move[0]
                if move[1]:
                    ids.extend(move[1])
            if len(self.states) > MOST_STATES:
                key = self.states[state], self.last[state]
                self.reset()
                if key not in self.number:
                    self.number[key] = len(self.states)
                    self.states.append(key[0])
                    self.last.append(key[1])
                state = self.number[key]
        ids.extend(self.states[state][0][1])
        return ids


class ByteBpe:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORDS) -> None:
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        words = self.words
        for w in self.split(text or ""):
            own = words.get(w)
            if own is None:
                own = self.transducer.encode(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    if len(words) >= MOST_WORDS:
                        words.clear()
                    words[w] = own
            ids.extend(own)
        return ids

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as it becomes known, token by token; bytes that aren't UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.transducer.texts[i]):
                yield part
        if part := machine.decode(b"", True):
            yield part


_HELD: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _HELD:
        _HELD[path] = ByteBpe(read_ranks(path))
    return _HELD[path]


def byte_bpe_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ids: str = "ids", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id`` and ``ids`` (array of integers) of each row by a byte-level BPE vocabulary, without special tokens.

    An empty list for an empty and for a null text; blank texts are encoded as they are, and special tokens written out in
    a text are ordinary text. Whole texts are encoded, however long; repeated rows come out as often; an empty table gives
    an empty one; other columns aren't read. No exchange. The vocabulary file must be readable on every executor.
    """
    kind = dict(documents.select(F.col(doc_id).alias("d")).dtypes)["d"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            raw = batch.column(1)
            at = 0
            while at < batch.num_rows:
                lists, held, first = [], 0, at
                while at < batch.num_rows and held < 1 << 20:
                    own = bpe.encode(raw[at].as_py())
                    lists.append(np.array(own, np.int32))
                    held += len(own)
                    at += 1
                offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), values], names=[doc_id, ids])

    return documents.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(encode, f"`{doc_id}` {kind}, `{ids}` array<int>")


def byte_bpe_text(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The texts of lists of ids; null for null, an empty text for an empty list."""
    kind = dict(encoded.select(F.col(doc_id).alias("d")).dtypes)["d"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            texts = ["".join(bpe.decode(x)) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, text])

    return encoded.select(F.col(doc_id).alias("d"), F.col(ids).alias("i")).mapInArrow(decode, f"`{doc_id}` {kind}, `{text}` string")
