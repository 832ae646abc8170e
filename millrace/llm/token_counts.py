"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary becomes a trie. Every node gets a failure link, the node at which matching goes on when no child fits, and
the number of pieces that are popped on the way; so each byte of a word is read once and no piece is ever built.
Words are run through the automaton in batches, a byte position of all words at a time, and only those that a
worker has not met lately (a cache, without influence on results).

A text is cut into words: a run of non-blank bytes with the one blank (0x20) before it if there is one; what
white space is left forms words of its own. Each word is matched greedily from its start, longest piece first. All 256 single
bytes are pieces, so every text has a length.

Cases: a null text has a null length, an empty one 0. Texts of any length are read whole. Repeated rows are counted each. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, lean, table
from .vectext import prefix_hash, slices, span_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of lines with a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass(frozen=True)
class Automaton:
    """The trie as a double array: the child of node u by byte c is at base[u] + c if owner[there] is u.

    pops[u]: pieces popped when u is left by its failure link `fail[u]`; rest[u]: pieces popped when a word ends in u."""

    base: np.ndarray
    owner: np.ndarray
    node: np.ndarray
    fail: np.ndarray
    pops: np.ndarray
    rest: np.ndarray

    @cached_property
    def plain(self) -> tuple[list, ...]:
        return tuple(x.tolist() for x in (self.base, self.owner, self.node, self.fail, self.pops))

    def walk(self, u: int, word: bytes) -> tuple[int, int]:
        """The node after these bytes, and the pieces popped on the way."""
        base, owner, node, fail, pops = self.plain
        popped = 0
        for c in word:
            while owner[base[u] + c] != u:
                popped += pops[u]
                u = fail[u]
            u = node[base[u] + c]
        return u, popped

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each span of bytes."""
        order = np.argsort(starts - ends, kind="stable")  # long words first: the living ones are a head of the arrays
        at, length = starts[order], (ends - starts)[order]
        state, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length, -k, "left"))
            if alive <= 4 and length[0] - k > 256:  # a few very long words are walked one after another
                for i in range(alive):
                    state[i], more = self.walk(int(state[i]), data[at[i] + k : at[i] + length[i]].tobytes())
                    count[i] += more
                break
            byte = data[at[:alive] + k].astype(np.int64)
            todo = np.arange(alive)
            while len(todo):
                u = state[todo]
                slot = self.base[u] + byte[todo]
                fits = self.owner[slot] == u
                state[todo[fits]] = self.node[slot[fits]]
                todo, u = todo[~fits], u[~fits]
                count[todo] += self.pops[u]
                state[todo] = self.fail[u]
        count += self.rest[state]
        out = np.empty(len(at), np.int64)
        out[order] = count
        return out


def build_automaton(pieces: Iterable[bytes]) -> Automaton:
    """The automaton of these pieces and all single bytes."""
    vocabulary = {bytes([c]) for c in range(256)} | {p for p in pieces if p}
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in sorted(vocabulary):
        u = 0
        for c in piece:
            v = children[u].get(c)
            if v is None:
                v = children[u][c] = len(children)
                children.append({})
                whole.append(False)
            u = v
        whole[u] = True
    n = len(children)
    fail, pops = [0] * n, [0] * n
    level = [0]
    while level:
        below = []
        for u in level:
            for c, v in children[u].items():
                if whole[v]:
                    pops[v] = 1
                else:
                    z, popped = fail[u], pops[u]
                    while c not in children[z]:
                        popped += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = children[z][c], popped
                below.append(v)
        level = below
    rest = [-1] * n
    rest[0] = 0
    for v in range(n):
        path = []
        while rest[v] < 0:
            path.append(v)
            v = fail[v]
        for u in reversed(path):
            rest[u] = rest[fail[u]] + pops[u]
    # next fit into the double array for nodes with several children, then single children fill the gaps
    size = 4 * n + 1024
    owner, node, base = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(n, np.int32)
    taken = bytearray(size)
    free = cursor = 0
    for u in sorted(range(n), key=lambda u: -len(children[u])):
        own = children[u]
        if not own:
            base[u] = size - 512  # never owned
            continue
        keys = list(own)
        if len(keys) > 1:
            while any(taken[cursor + c] for c in keys):
                cursor += 1
            at = cursor
        else:
            while taken[free] or free < keys[0]:
                free += 1
            at = free - keys[0]
        base[u] = at
        for c in keys:
            taken[at + c] = 1
            owner[at + c], node[at + c] = u, own[c]
    return Automaton(base, owner, node, np.array(fail, np.int32), np.array(pops, np.int32), np.array(rest, np.int32))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte."""
    blank = _BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    before_blank = np.concatenate(([True], blank[:-1]))
    after_blank = np.concatenate((blank[1:], [True]))
    next_first = np.concatenate((first[1:], [True]))
    single = (data == 32) & ~after_blank & ~next_first  # the blank that belongs to the word after it
    joined = np.concatenate(([False], single[:-1]))
    return first | single | (~blank & before_blank & ~joined) | (blank & ~before_blank)


class Counter:
    """Counts texts with an automaton; keeps the lengths of words met lately."""

    def __init__(self, automaton: Automaton, cache_bits: int = 20):
        self.automaton, self.mask = automaton, np.uint64((1 << cache_bits) - 1)
        self.known, self.length = np.zeros(1 << cache_bits, np.uint64), np.zeros(1 << cache_bits, np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces and the words of each text."""
        pieces, words = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for at, rows, data, offsets in slices(column):
            if not len(data):
                continue
            s = np.flatnonzero(word_starts(data, offsets))
            e = np.append(s[1:], len(data))
            h = span_hash(prefix_hash(data), s, e)
            slot = (h & self.mask).astype(np.int64)
            count = self.length[slot]
            new = np.flatnonzero(self.known[slot] != h)
            if len(new):
                _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
                own = new[one]
                found = self.automaton.lengths(data, s[own], e[own])
                count[new] = found[back]
                # of several words for one slot the last is remembered, under its own hash
                self.known[slot[own]] = h[own]
                self.length[slot[own]] = found
            sums = np.concatenate(([0], np.cumsum(count)))
            bounds = np.searchsorted(s, offsets)
            pieces[at : at + rows] = sums[bounds[1:]] - sums[bounds[:-1]]
            words[at : at + rows] = np.diff(bounds)
        return pieces, words


def token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, tokens: str = "n_tokens", words: str | None = None) -> DataFrame:
    """df with the number of pieces of `text` (and of words, if a name is given for it), renamed with leading underscores if there are such columns. The vocabulary is read by the driver."""
    automaton, at = build_automaton(read_vocabulary(vocabulary)), df.columns.index(text)
    tokens = fresh(df.columns, tokens)
    words = words and fresh([*df.columns, tokens], words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(automaton)
        for batch in batches:
            got = count(batch.column(at))
            null = np.asarray(batch.column(at).is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, mask=null) for x in got[: 1 + bool(words)]]], names=[*batch.schema.names, *[tokens, words][: 1 + bool(words)]])

    more = [T.StructField(name, T.LongType(), True) for name in (tokens, words) if name]
    return df.mapInArrow(lean(counted), T.StructType([*df.schema.fields, *more]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its length in pieces and in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, words="n_words").drop("text")
