"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Texts become words that start at their blank marks. The distinct words of a batch are sorted, so that walking through them
is a depth-first traversal of their trie; the forward table of the path is a stack, and words with a common prefix share
its entries. For unigram models an entry holds the best score of a prefix and its last piece. For merge (BPE) models, whose
scores are merge ranks and whose segmentation isn't the one of largest sum, an entry holds the last piece of the prefix's
segmentation: the only piece ending there that may follow the segmentation of what stands before it, as two neighbours
are compatible exactly if merging both texts gives the two. Ranks must differ for that, so runs of several blanks, whose
pieces share one rank, are merged directly.

Defined results: null gives null; an empty text gives no ids; characters outside the vocabulary become byte pieces where
the model has them, else the unknown id. Decoding inverts encoding but for the mark U+2581 in a text, which reads as a blank.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, forget_powers, small_batches, text_slices, tidied, widened

MARK = "▁"
#: Words and pairs kept between a task's batches; beyond that a table starts anew.
KEEP_WORDS = 300_000
_KEEP_PAIRS = 1_000_000
#: Bytes of texts, and ids, that are worked on at once.
_CHUNK = 3 << 20
_loaded: dict[bytes, PieceModel] = {}


class PieceModel:
    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normalizer and marks before words are supported")
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.merges = m.trainer_spec.model_type == 2
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        self.kind = [p.type for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.scores = {p.piece: p.score for p in m.pieces if p.type in (1, 4)}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == 2), 0)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.low = min(self.scores.values(), default=0.0) - 10.0
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.split = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+|[{apart}]" if apart else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.automaton = ahocorasick.Automaton()  # finds the pieces that end at each place
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    # merging, as training defined it

    def merge(self, word: str) -> list[str]:
        """Pieces of a word by merging neighbours, best score first, leftmost among equals."""
        pieces, n = list(word), len(word)
        if n < 2:
            return pieces
        before, after, scores = list(range(-1, n - 1)), [*range(1, n), -1], self.scores
        heap = [(-scores[x], i, x) for i in range(n - 1) if (x := pieces[i] + pieces[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, x = heapq.heappop(heap)
            j = after[i] if pieces[i] else -1
            if j < 0 or pieces[i] + pieces[j] != x:
                continue
            pieces[i], pieces[j] = x, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (y := x + pieces[k]) in scores:
                    heapq.heappush(heap, (-scores[y], i, y))
            if (h := before[i]) >= 0 and (y := pieces[h] + x) in scores:
                heapq.heappush(heap, (-scores[y], h, y))
        return [p for p in pieces if p]

    def _fits(self, pair: int) -> bool:
        """Whether two pieces stay apart when their joined text is merged. A negative number is a character without a piece."""
        if len(self._pairs) > _KEEP_PAIRS:
            self._pairs.clear()
        left, right = (self.text[i] if i >= 0 else chr(~i) for i in ((pair >> 32) - (1 << 22), (pair & 0xFFFFFFFF) - (1 << 22)))
        found = self._pairs[pair] = self.merge(left + right) == [left, right]
        return found

    def _is_whole(self, number: int) -> bool:
        found = self._whole[number] = self.merge(self.text[number]) == [self.text[number]]
        return found

    # the forward tables

    def _walk_merges(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Words and their pieces. The stacks hold, for each prefix, the number and the start of the last piece."""
        pairs, whole, matches, shift = self._pairs, self._whole, self.automaton.iter, 1 << 22
        last, begin = [0], [0]
        old = ""
        for word in words:
            done = 0
            for x, y in zip(word, old):  # noqa: B905
                if x != y:
                    break
                done += 1
            del last[done + 1 :], begin[done + 1 :]
            for end, (number, size) in matches(word):
                if end < done:
                    continue  # shared with the word before, or settled
                while end > done:  # characters that end no piece
                    last.append(~ord(word[done]))
                    begin.append(done)
                    done += 1
                start = end + 1 - size
                if start:
                    pair = (last[start] + shift) << 32 | number + shift
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = self._fits(pair)
                else:
                    ok = whole.get(number)
                    if ok is None:
                        ok = self._is_whole(number)
                if ok:
                    last.append(number)
                    begin.append(start)
                    done = end + 1
            at = len(word)
            while done < at:
                last.append(~ord(word[done]))
                begin.append(done)
                done += 1
            old, out = word, []
            while at:
                out.append(last[at])
                at = begin[at]
            out.reverse()
            yield word, tuple(out) if min(out) >= 0 else self._numbers([self.text[i] if i >= 0 else chr(~i) for i in out])

    def _walk_scores(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        scores, longest = self.scores, self.longest
        best: list[float] = [0.0]
        last: list[int] = [0]  # length of each prefix's last piece
        old = ""
        for word in words:
            n, k = len(word), 0
            for k in range(min(n, len(old)) + 1):
                if k == n or k == len(old) or word[k] != old[k]:
                    break
            del best[k + 1 :], last[k + 1 :]
            for end in range(k + 1, n + 1):
                top, size = best[end - 1] + scores.get(word[end - 1 : end], self.low), 1
                for start in range(max(0, end - longest), end - 1):
                    s = scores.get(word[start:end])
                    if s is not None and best[start] + s > top:
                        top, size = best[start] + s, end - start
                best.append(top)
                last.append(size)
            old, at, out = word, n, []
            while at:
                out.append(word[at - last[at] : at])
                at -= last[at]
            yield word, self._numbers(out[::-1])

    def _numbers(self, pieces: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            elif self.merges or not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def learn(self, words: set[str]) -> None:
        """Fill the table of words."""
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        new = words.difference(self.words)
        if self.merges:
            for w in [w for w in new if MARK * 2 in w]:
                self.words[w] = self._numbers(self.merge(w))
                new.discard(w)
        self.words.update((self._walk_merges if self.merges else self._walk_scores)(sorted(new)))

    def forget(self) -> None:
        """Empties the tables of words and pairs."""
        self.words.clear()
        self._pairs.clear()

    def marked(self, text: str) -> list[str]:
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return [text] if self.crossing or not self.merges and len(text) < 2 else self.split(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.marked(t) for t in texts]
        self.learn(set().union(*split))
        of = self.words.__getitem__
        split.reverse()
        out = []
        while split:  # a text's words go when its ids are there
            out.append(list(chain.from_iterable(map(of, split.pop()))))
        return out

    def decode(self, ids: list[int]) -> str:
        text, of_byte, kind, parts = self.text, self.byte_of, self.kind, []
        run = bytearray()
        for i in ids:
            if (b := of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            if kind[i] != 3:
                parts.append(text[i] if kind[i] != 2 else " ⁇ ")
        if run:
            parts.append(run.decode("utf-8", "replace"))
        out = "".join(parts).replace(MARK, " ")
        return out[1:] if self.prefix and out[:1] == " " else out


def model(proto: bytes) -> PieceModel:
    """The model of a process, loaded once."""
    if proto not in _loaded:
        _loaded.clear()
        _loaded[proto] = PieceModel(proto)
    return _loaded[proto]


def read_model(path: str) -> bytes:
    """A model file's bytes, read on the driver; the vocabulary's size bounds them."""
    with open(path, "rb") as f:
        return f.read()


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    if not pa.types.is_list(column.type):
        return text_slices(column, _CHUNK)
    return chunks(np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)], _CHUNK)


def _run(df: DataFrame, proto: bytes, source: str, added: list[tuple[str, T.DataType]], work: Callable[[PieceModel, list], list[list]]) -> DataFrame:
    """``df`` with columns made from one of its columns, some megabytes at a time; nulls give nulls."""
    small_batches(df.sparkSession)
    names = df.columns
    if clash := {n for n, _ in added} & set(names):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shared = df.sparkSession.sparkContext.broadcast(proto)
    kinds = [pa.list_(pa.int32()) if isinstance(t, T.ArrayType) else pa.string() for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_powers()  # of a stage before
        m = model(shared.value)
        gc.disable()  # millions of lists and tuples come and go here, none in cycles
        for batch in batches:
            for a, b in _parts(batch.column(names.index(source))):
                values = batch.column(names.index(source)).slice(a, b - a).to_pylist()
                columns = [iter(c) for c in work(m, [v for v in values if v is not None])]
                made = [pa.array([None if v is None else next(c) for v in values], k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *made], [*names, *(n for n, _ in added)])
                del values, columns, made
                pa.default_memory_pool().release_unused()
        m.forget()
        gc.enable()

    return df.mapInArrow(tidied(run), widened(df.schema, *added))


def encode(df: DataFrame, proto: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of its texts; the new name must be free."""
    return _run(df, proto, text, [(ids, T.ArrayType(T.IntegerType()))], lambda m, texts: [m.encode(texts)])


def decode(df: DataFrame, proto: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts of its piece ids; the new name must be free."""
    return _run(df, proto, ids, [(text, T.StringType())], lambda m, rows: [[m.decode(r) for r in rows]])


def encode_and_decode(df: DataFrame, proto: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass, so that a task needs one worker only."""

    def both(m: PieceModel, texts: list[str]) -> list[list]:
        found = m.encode(texts)
        return [found, [m.decode(i) for i in found]]

    return _run(df, proto, text, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], both)
