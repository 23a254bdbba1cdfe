"""Exact removal of repeated passages by longest-previous-factor arrays.

The longest previous factor of a place is the longest string that starts there and also starts earlier. It follows from the
suffix array: among the places that sort before a suffix, the nearest one with a smaller position, and likewise among those
that sort behind it, are the best earlier matches (previous and next smaller positions). ``previous_factors`` computes it.

One array can't hold a corpus, so texts are dealt to blocks by ranges of their key (see ``blocks``). Strings of ``length``
bytes that are equal have the same minimiser, the place of the smallest hash among the short grams in them. Blocks first
exchange hashes of their minimisers and of the text around each (96 bits, by two independent hashes, as of all strings compared). A minimiser that occurs once has no repeats near it. If its
surroundings occurred before, all strings within are later copies. What remains, the edges of copies and edited copies, gets
factor arrays in its block, and strings that are new to their block are exchanged by 96 bits of hash: of each, the first block keeps the first one.

Defined results: a null text is empty; of repeated rows (same key and text) the first is kept and later ones are removed; null keys come
first; rows of one key stand in the order of a hash of their texts, then of the texts. Strings are judged on the input. Matches don't cross texts. Texts shorter than ``length`` bytes keep everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks
from .common import ByteHash, chunks, mix64, utf8, widened

LENGTH = 100
GRAM = 32
#: Minimisers and factor arrays are worked out for about so many bytes at a time, to bound a task's memory. Strings that stand in several parts
#: of a block count as one all the same, by their hashes.
_CHUNK = 1 << 19
COLUMNS = (("n_bytes", "long"), ("n_removed", "long"), ("removed", "array<struct<start:bigint,end:bigint>>"), ("kept", "binary"))


def ranks(symbols: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of each place by its first so many symbols), for growing lengths up to ``depth``; symbols from 1 to 500."""
    n = len(symbols)
    per = 7
    padded = np.zeros(n + per, dtype=np.int64)
    padded[:n] = symbols
    key = np.zeros(n, dtype=np.int64)
    for k in range(min(per, depth)):
        key = key * 512 + padded[k : k + n]
    out, length = [], min(per, depth)
    while True:
        _, rank = np.unique(key, return_inverse=True)
        rank = (rank + 1).astype(np.int32)
        out.append((length, rank))
        if length >= depth:
            return out
        step = min(length, depth - length)
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(n - step, 0)] = rank[step:]
        key, length = rank.astype(np.int64) * (n + 2) + behind, length + step


def previous_factors(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length, up to ``depth``, of the longest string there that also starts earlier, and where (-1: nowhere)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    levels = ranks(symbols, depth)
    order = np.argsort(levels[-1][1], kind="stable")  # the suffix array, as far as depth
    # common prefixes of neighbours, by the ranks of ever shorter lengths
    left, right = order[:-1], order[1:]
    same = levels[-1][1][left] == levels[-1][1][right]
    common = np.where(same, depth, 0)
    off = np.zeros(n - 1, dtype=np.int64)
    for length, rank in reversed(levels[:-1]):
        padded = np.r_[rank, np.zeros(depth + 1, dtype=np.int32)]
        a, b = padded[left + off], padded[right + off]
        off += np.where((a == b) & (a > 0) & ~same, length, 0)
    padded = np.r_[symbols, np.zeros(depth + 8, dtype=np.int64)]
    going = ~same
    for _ in range(7):
        going &= (padded[left + off] == padded[right + off]) & (padded[left + off] > 0) & (off < depth)
        off += going
    common = np.where(same, depth, np.minimum(off, depth))

    def smaller(position: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest earlier entry with a smaller position (-1: none), and the least of ``link`` on the way, by pointer jumping."""
        to = np.arange(n) - 1
        least = np.r_[0, link]
        active = np.flatnonzero(to >= 0)
        while len(active := active[(to[active] >= 0)]) and len(active := active[position[to[active]] > position[active]]):
            at = to[active]
            new_to, new_least = to[at], np.minimum(least[active], least[at])
            to[active], least[active] = new_to, new_least
        least[to < 0] = 0
        return to, least

    to, before = smaller(order, common)
    back, behind = smaller(order[::-1], common[::-1])
    back, behind = n - 1 - back[::-1], behind[::-1]  # mirrored; n stands for none
    best = np.where(before >= behind, before, behind)
    source = np.where(before >= behind, order[np.maximum(to, 0)], order[np.minimum(back, n - 1)])
    factor, where = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    factor[order], where[order] = best, np.where(best > 0, source, -1)
    return factor, where


def minimisers(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest value in each run of ``width``; values count by their first 40 bits."""
    out, low = np.empty(max(len(h) - width + 1, 0), dtype=np.int64), np.uint64((1 << 24) - 1)
    for a in range(0, len(out), 1 << 22):
        part = h[a : a + (1 << 22) + width - 1]
        least, size = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1  # value and place in one number
        while size < width:
            step = min(size, width - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        out[a : a + len(least)] = (least & low).astype(np.int64) + a
    return out


class Scan:
    """Minimisers of a block's texts: hashes, two hashes of their surroundings, and the strings of each, which follow each other in one
    text: where the first one starts (``start``), and how many there are (``times``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        gram = min(GRAM, length)
        none = np.zeros(0, dtype=np.uint64)
        hashes, around, check, start, times = [none], [none], [none.astype(np.uint32)], [none.astype(np.int64)], [none.astype(np.int64)]
        for a, b in chunks(offsets, _CHUNK):
            lo, hi = offsets[a], offsets[b]
            part, off = data[lo:hi], offsets[a : b + 1] - lo
            if len(part) < length:
                continue
            of = ByteHash(part)
            h = of.runs(gram)
            first = minimisers(h, length - gram + 1)
            end = np.repeat(off[1:], np.diff(off))[: len(first)]
            string = np.flatnonzero(np.arange(len(first)) + length <= end)
            if not len(string):
                continue
            mine = first[string]  # never falls, so equal ones stand together
            new = np.ones(len(mine), dtype=bool)
            new[1:] = mine[1:] != mine[:-1]
            place = mine[new]
            text = np.searchsorted(off, place, side="right") - 1
            x, y = np.maximum(place - (length - gram), off[text]), np.minimum(place + length, off[text + 1])
            hashes.append(h[place])
            around.append(mix64(of(x, y) + (place - x).astype(np.uint64)))
            del of, h
            check.append((mix64(ByteHash(part, 1)(x, y) + (place - x).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))
            start.append(string[new] + lo)
            times.append(np.diff(np.r_[np.flatnonzero(new), len(mine)]))
        self.hash, self.around, self.check, self.start, self.times = map(np.concatenate, (hashes, around, check, start, times))

    def strings(self, of: np.ndarray) -> np.ndarray:
        """The places of the strings of some minimisers."""
        start, times = self.start[of], self.times[of]
        return np.repeat(start - (np.cumsum(times) - times), times) + np.arange(times.sum())


class _Facts:
    """The distinct keys of a block in order, with their checks, first places and counts; ``of``: which of them each place has."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray | None = None):
        order, new = blocks.distinct(keys, checks)
        starts = np.flatnonzero(new)
        self.first = order[starts]
        self.keys, self.checks = keys[self.first], None if checks is None else checks[self.first]
        self.counts = np.diff(np.r_[starts, len(order)])
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1


def _arranged(table: pa.Table, key: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's rows, and the bytes and offsets of their texts in it."""
    # repeated keys: by tie-breaker and text, so that the order is the same whenever the block is read
    order = pc.sort_indices(table.select([key, blocks.TIE, text]), sort_keys=[(key, "ascending"), (blocks.TIE, "ascending"), (text, "ascending")], null_placement="at_start").to_numpy()
    data, offsets = utf8(table.column(text).take(pa.array(order)))
    return order, data, offsets


def _string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings at ascending places, of 64 and 32 bits."""
    out, check = np.empty(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.uint32)
    start = 0
    while start < len(at):
        end = int(np.searchsorted(at, at[start] + _CHUNK))
        lo = at[start]
        for which in (0, 1):
            h = ByteHash(data[lo : at[end - 1] + length], which)(at[start:end] - lo, at[start:end] - lo + length)
            if which:
                check[start:end] = h >> np.uint64(32)
            else:
                out[start:end] = h
        start = end
    return out, check


def _new_in_block(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at ascending places don't start earlier, as far as factor arrays over parts of the block tell."""
    # fragments: runs of places whose strings overlap (so within a text), each followed by a separator
    cut = np.flatnonzero(np.diff(at) >= length) + 1
    starts, stops = np.r_[0, cut], np.r_[cut, len(at)]
    room = np.cumsum(at[stops - 1] - at[starts] + length + 1) if len(at) else np.zeros(0, dtype=np.int64)
    out, done = np.ones(len(at), dtype=bool), 0
    while len(at) and done < len(starts):
        base = room[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(room, base + _CHUNK, side="right")))
        a, b = starts[done], stops[end - 1]
        out[a:b] = _new_in_part(data, at[a:b], length)
        done = end
    return out


def _new_in_part(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    cut = np.flatnonzero(np.diff(at) >= length) + 1
    heads, tails = at[np.r_[0, cut]].astype(np.int64), at[np.r_[cut - 1, len(at) - 1]].astype(np.int64) + length
    sizes = tails - heads + 1
    begin = np.cumsum(sizes) - sizes
    symbols = np.full(sizes.sum(), 257, dtype=np.int64)
    real = np.ones(len(symbols), dtype=bool)
    real[begin + sizes - 1] = False
    inside = np.repeat(heads - begin, sizes) + np.arange(len(symbols))
    symbols[real] = data[inside[real]].astype(np.int64) + 1
    factor, _ = previous_factors(symbols, length)
    run = np.searchsorted(heads, at, side="right") - 1
    return factor[at - heads[run] + begin[run]] < length


def _cover(delta: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> None:
    """Notes strings, or runs of them, as covered; their starts are distinct, and so are their ends. So a call changes a note by 1 at most."""
    delta[at] += 1
    delta[at + length] -= 1


def _covered(delta: np.ndarray) -> np.ndarray:
    """Which bytes are covered, by the sums of the notes up to them; some at a time."""
    out, before = np.empty(len(delta) - 1, dtype=bool), np.int32(0)
    for a in range(0, len(out), _CHUNK):
        sums = np.cumsum(delta[a : min(a + _CHUNK, len(out))], dtype=np.int32) + before
        out[a : a + len(sums)] = sums > 0
        before = sums[-1]
    return out


def _bits(flags: np.ndarray) -> bytes:
    packed = np.packbits(flags)
    return blocks.pack(packed)


def _unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(blocks.unpack(b, -(-n // 8), np.uint8), count=n).astype(bool)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, block_bytes: int = blocks.BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """``docs`` without the text, with COLUMNS: removed byte ranges, and the bytes that stay.

    ``as_text``: what stays is a string, without what a cut has left of a character.

    The key must be an integer. ``docs`` must have no column named as one of COLUMNS, ``_block`` or ``_tie``.
    """
    rest = [c for c in docs.columns if c != text]
    if clash := ({n for n, _ in COLUMNS} | {blocks.BLOCK, blocks.TIE}) & set(rest):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    dealt, buckets = blocks.deal(docs, key, text, block_bytes)

    def send(block: int, table: pa.Table) -> list[tuple]:
        _, data, offsets = _arranged(table, key, text)
        scan = Scan(data, offsets, length)
        hash_, around = _Facts(scan.hash), _Facts(scan.around, scan.check)
        return blocks.posted(block, blocks.messages(0, hash_.keys, hash_.counts, buckets), blocks.messages(1, around.keys, around.counts, buckets, around.checks))

    def heard(block: int, table: pa.Table, answers: blocks.Answers) -> list[tuple]:
        _, data, offsets = _arranged(table, key, text)
        scan = Scan(data, offsets, length)
        around = _Facts(scan.around, scan.check)
        total, alike, new = answers.totals(0)[_Facts(scan.hash).of], answers.totals(1)[around.of], answers.first(1)[around.of]
        new &= around.first[around.of] == np.arange(len(around.of))
        open_ = new & (alike < total)  # first of its surroundings, but the minimiser occurs in others
        covered = np.zeros(len(data) + 1, dtype=np.int8)
        _cover(covered, scan.start[~new], scan.times[~new] - 1 + length)
        left = scan.strings(open_)
        del scan
        fresh = _new_in_block(data, left, length)
        strings = _Facts(*_string_hashes(data, left[fresh], length))
        asked = np.zeros(len(left), dtype=bool)
        asked[np.flatnonzero(fresh)[strings.first]] = True
        _cover(covered, left[~asked], length)
        asks = np.zeros(len(data), dtype=bool)
        asks[left[asked]] = True
        rows = blocks.posted(block, blocks.messages(2, strings.keys, None, buckets, strings.checks))
        for kind, flags in ((-1, _covered(covered)), (-2, asks)):  # what the block has found so far goes with one of the messages
            for column, value in zip(rows[block % buckets][2:], (kind, len(data), b"", b"", _bits(flags)), strict=True):
                column.append(value)
        return rows

    def finish(block: int, table: pa.Table, answers: blocks.Answers) -> pa.Table:
        if not table.num_rows:
            return to_arrow_schema(schema).empty_table()
        order, data, offsets = _arranged(table, key, text)
        covered, asks = _unbits(answers.passed(-1), len(data)), np.flatnonzero(_unbits(answers.passed(-2), len(data)))
        which = _Facts(*_string_hashes(data, asks, length)).of
        gone = asks[~answers.first(2)[which]] if len(asks) else asks
        delta = np.zeros(len(data) + 1, dtype=np.int8)
        _cover(delta, gone, length)
        covered |= _covered(delta)
        n, size = len(offsets) - 1, np.diff(offsets)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins, ends = covered.copy(), covered.copy()
        begins[1:] &= ~covered[:-1] | edge[1:-1]
        ends[:-1] &= ~covered[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        owner = np.searchsorted(offsets, start, side="right") - 1
        removed = np.bincount(owner, end - start, n).astype(np.int64)
        spans = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(end - offsets[owner])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), spans)
        kept = data[~covered].tobytes()
        cuts = np.r_[0, np.cumsum(size - removed)]
        parts = [kept[a:b].decode("utf-8", "ignore") if as_text else kept[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = table.select(rest).take(pa.array(order))
        for name, column in zip(("n_bytes", "n_removed", "removed", "kept"), (pa.array(size), pa.array(removed), lists, pa.array(parts, pa.string() if as_text else pa.binary())), strict=True):
            out = out.append_column(name, column)
        return out



    kinds = dict(COLUMNS) | {"removed": T.ArrayType(T.StructType().add("start", "long").add("end", "long")), "kept": "string" if as_text else "binary"}
    schema = widened(docs.select(*rest).schema, *kinds.items())
    asked = blocks.ask(dealt, send)
    return blocks.conclude(dealt, blocks.ask(dealt, send, asked, heard), finish, schema)
