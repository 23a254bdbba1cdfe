"""Language-model scores by a weighted backoff automaton.

N-grams up to ``order`` are counted over all training texts. States are the contexts seen in training; a state's arcs are its
seen continuations, with their smoothed log-probabilities, and lead to the longest state that is a suffix of what was read.
A failure arc leads from a context to its next shorter one, with the backoff weight. Smoothing is a hierarchy of Dirichlet
priors, P(w|h) = (c(hw) + s P(w|h')) / (c(h) + s), so an unseen word's probability is the failure arc's weight
s / (c(h) + s) times what the shorter context gives it, down to (c + 0.5) / (N + 0.5 (V + 1)).

The model grows with the corpus, so it is never in one place: blocks of documents ask for the counts of their own n-grams
(see ``blocks``), from which each builds the part of the automaton that its texts can reach. One traversal from left to right reads the
block's tokens: it carries a state, takes the token's arc or else failure arcs until there is one, and adds up the weights. The block is
read in lanes side by side; a lane that begins within a text first reads the ``order`` - 1 tokens before it, which give its state.

Defined results: null and empty texts hold the end only; rows of a null key are scored but never learned; repeated rows
count each time; without training texts the model is the uniform base of V = N = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks
from .common import mix64, text_chunks, widened, word_hashes

ORDER = 3
#: Tokens that a lane reads.
_LANE = 512
STRENGTH = 4.0
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_TRAIN = "_train"
COLUMNS = (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))


def chain(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of an n-gram from its context's key and its last token."""
    with np.errstate(over="ignore"):
        return mix64(context * np.uint64(0x9E3779B97F4A7C15) + token)


@F.pandas_udf(T.BinaryType())
def squeezed(texts: pd.Series) -> pd.Series:
    """Each text's bytes, compressed, so that the documents' exchange takes less disk."""
    press = zstandard.ZstdCompressor(level=7)
    return texts.map(lambda b: None if b is None else press.compress(b))


def unsqueezed(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """The texts again; null as empty."""
    press = zstandard.ZstdDecompressor()
    texts = [press.decompress(b) if b else b"" for b in column.to_pylist()]
    offsets = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    return pa.chunked_array([pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(b"".join(texts)))])


class Tokens:
    """Token hashes of a block's texts, each text with its end; ``first`` has each text's first token."""

    def __init__(self, column: pa.ChunkedArray):
        hashes, counts = [], []
        for a, b, data, offsets in text_chunks(column):
            h, first = word_hashes(data, offsets)
            hashes.append(h)
            counts.append(np.diff(first))
        words = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        n = np.concatenate([np.zeros(0, dtype=np.int64), *counts])
        self.first = np.r_[0, np.cumsum(n + 1)]
        self.token = np.full(self.first[-1], _END, dtype=np.uint64)
        keep = np.ones(len(self.token), dtype=bool)
        keep[self.first[1:] - 1] = False
        self.token[keep] = words

    def grams(self, order: int) -> Iterator[np.ndarray]:
        """Keys of the n-grams that end at each token, by order; where the text has begun later, 0."""
        key = mix64(self.token)
        yield key
        at = self.first[:-1]
        for n in range(2, order + 1):
            before = np.zeros(len(self.token), dtype=np.uint64)
            before[1:] = key[:-1]
            before[at] = mix64(np.array([_START]))[0] if n == 2 else 0
            key = chain(before, self.token)
            key[before == 0] = 0
            yield key


class Grams:
    """The distinct n-grams of one order in a block: sorted keys, how often each is learned here (if that is asked for), each token's
    n-gram (-1: none), and of each n-gram a place where it ends."""

    def __init__(self, keys: np.ndarray, learned: np.ndarray | None):
        order = np.argsort(keys)
        order = order[np.count_nonzero(keys == 0) :].astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        ordered = keys[order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        self.keys = ordered[starts]
        if learned is not None:
            self.learned = np.add.reduceat(learned[order].astype(np.int64), starts) if len(starts) else np.zeros(0, dtype=np.int64)
        self.of = np.full(len(keys), -1, dtype=np.int32)
        self.of[order] = np.cumsum(new, dtype=np.int32) - 1
        self.place = order[starts]


class Automaton:
    """The part of the automaton that a block's texts can reach.

    Nodes are the root (0), the start of a text (1) and the block's n-grams by order. A node that was learned is an arc, from the node of its
    context, by its last token; below the highest order it is a state as well. ``to`` is where an arc leads, ``fail`` the state
    of the next shorter context.
    """

    ROOT, START = 0, 1

    def __init__(self, tokens: Tokens, grams: list[Grams], counts: list[np.ndarray], begun: int, distinct: int, total: int, strength: float):
        self.floor = total + 0.5 * (distinct + 1)
        sizes = [len(c) for c in counts]
        base = np.r_[2, 2 + np.cumsum(sizes)].astype(np.int64)
        self.words, self.base, self.states = sizes[0], int(base[0]), int(base[max(len(grams) - 1, 1)])
        self.known = counts[0] > 0
        state_counts = np.concatenate([np.array([0, begun], dtype=np.int64), *counts[: max(len(grams) - 1, 1)]])
        p = np.zeros(base[-1])
        self.to, self.fail = np.zeros(base[-1], dtype=np.int32), np.zeros(self.states, dtype=np.int32)
        own = slice(base[0], base[1])
        p[own] = (counts[0] + 0.5) / self.floor
        if len(grams) > 1:
            self.to[own] = np.where(self.known, np.arange(base[0], base[1]), self.ROOT)
        many = sum(int(np.count_nonzero(c)) for c in counts[1:])
        arc, node, done = np.empty(many, dtype=np.int64), np.empty(many, dtype=np.int32), 0
        is_first = np.zeros(len(tokens.token), dtype=bool)
        is_first[tokens.first[:-1]] = True
        for n in range(2, len(grams) + 1):
            g, count, span = grams[n - 1], counts[n - 1], slice(base[n - 1], base[n])
            suffix = (base[n - 2] + grams[n - 2].of[g.place]).astype(np.int32)
            context = np.where(is_first[g.place], self.START, base[n - 2] + grams[n - 2].of[np.maximum(g.place - 1, 0)]).astype(np.int32)
            p[span] = (count + strength * p[suffix]) / (state_counts[context] + strength)
            if n < len(grams):
                self.fail[span], self.to[span] = suffix, np.arange(base[n - 1], base[n])
            else:
                self.to[span] = suffix
            del suffix
            seen = np.flatnonzero(count)
            into = slice(done, done + len(seen))
            arc[into], node[into] = context[seen].astype(np.int64) * self.words + grams[0].of[g.place[seen]], base[n - 1] + seen
            done += len(seen)
        order = np.argsort(arc)
        self.arcs, self.nodes = np.r_[arc[order], np.iinfo(np.int64).max], np.r_[node[order], 0].astype(np.int32)
        with np.errstate(divide="ignore"):
            self.weight = np.log10(p, out=p)  # of unlearned n-grams, unused
        self.back = np.log10(strength / (state_counts + strength))
        self.begin = self.START if begun and len(grams) > 1 else self.ROOT
        self.order = len(grams)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a token each, and the weights on the way."""
        cost = np.zeros(len(state))
        node = self.base + word  # the root has an arc for every token
        left = np.flatnonzero(state != self.ROOT)
        while len(left):
            at = state[left]
            key = at.astype(np.int64) * self.words + word[left]
            found = np.searchsorted(self.arcs, key)
            hit = self.arcs[found] == key
            node[left[hit]] = self.nodes[found[hit]]
            left, at = left[~hit], at[~hit]
            cost[left] += self.back[at]
            state[left] = self.fail[at]
            left = left[state[left] != self.ROOT]
        return self.to[node], cost + self.weight[node]

    def traverse(self, tokens: Tokens, words: np.ndarray) -> np.ndarray:
        """Each token's log10 probability; ``words``: the tokens' numbers."""
        size, warm = len(words), self.order - 1
        out = np.zeros(size)
        is_first = np.zeros(size, dtype=bool)
        is_first[tokens.first[:-1]] = True
        starts = np.arange(0, size, _LANE)
        state = np.full(len(starts), self.ROOT, dtype=np.int32)
        for t in range(-warm, _LANE):
            at = starts + t
            a, b = np.searchsorted(at, [0, size])  # lanes that have a token here
            at = at[a:b]
            now = np.where(is_first[at], self.begin, state[a:b]).astype(np.int32)
            state[a:b], logp = self.step(now, words[at])
            if t >= 0:
                out[at] = logp
        return out


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, strength: float = STRENGTH, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``docs`` without the text, with COLUMNS; texts of rows for which ``learn`` is true are the training texts.

    ``docs`` must have no column named as one of COLUMNS, ``_train`` or ``_block``.
    """
    rest = [c for c in docs.columns if c != text]
    if clash := ({n for n, _ in COLUMNS} | {_TRAIN, blocks.BLOCK}) & set(rest):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    marked = docs.withColumn(_TRAIN, F.coalesce(learn, F.lit(False)))
    dealt, buckets = blocks.spread(marked, key, text, block_bytes)
    dealt = dealt.withColumn(text, squeezed(F.col(text).cast("binary")))

    def send(block: int, table: pa.Table) -> list[tuple]:
        tokens = Tokens(unsqueezed(table.column(text)))
        learned = table.column(_TRAIN).to_numpy(zero_copy_only=False).astype(bool)
        each = np.repeat(learned, np.diff(tokens.first))
        parts = []
        for kind, keys in enumerate(tokens.grams(order)):
            g = Grams(keys, each)
            parts.append(blocks.messages(kind, g.keys, g.learned, buckets))
        return blocks.posted(block, *parts, blocks.messages(order, mix64(np.array([_START])), np.array([learned.sum()]), buckets))

    def finish(block: int, table: pa.Table, answers: blocks.Answers) -> pa.Table:
        if not table.num_rows:
            return to_arrow_schema(schema).empty_table()
        tokens = Tokens(unsqueezed(table.column(text)))
        grams = [Grams(keys, None) for keys in tokens.grams(order)]
        for g in grams:
            del g.keys
        distinct, total = answers.sums(0)
        model = Automaton(tokens, grams, [answers.totals(k) for k in range(order)], int(answers.totals(order)[0]), distinct, total, strength)
        words = grams[0].of
        del grams
        add = lambda x: np.add.reduceat(x, tokens.first[:-1])
        n = np.diff(tokens.first)
        base = model.weight[model.base : model.base + model.words][words]
        values = (n, add(model.known[words].astype(np.int64)), np.full(len(n), total), add(base), add(model.traverse(tokens, words)))
        out = table.select(rest)
        for (name, _), v in zip(COLUMNS, values, strict=True):
            out = out.append_column(name, pa.array(v))
        return out

    schema = widened(docs.select(*rest).schema, *COLUMNS)
    return blocks.conclude(dealt, blocks.ask(dealt, send, firsts=False), finish, schema)

