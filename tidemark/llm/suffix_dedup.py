"""Suffix-array dedup: a logarithmic index family over sampled suffixes (operator 7).

Every byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another, is
removed; matches never cross texts and are judged on the input.

1. Sampling. In each window of `length` bytes the 32-gram of least hash is the window's anchor. Equal windows
   have equal anchors at equal offsets, so the suffixes at anchors, about one in 185 bytes, are enough.
   Anchors whose 32-gram occurs once are left out by a count over all texts.
2. Index. Each remaining anchor sends its segment (the bytes of its windows) to the task of its 32-gram. There every new
   batch gets two suffix arrays, of the bytes from the anchors on and of those before them read backwards, with the
   common prefixes of neighbours. It is merge-scanned against the existing levels; levels of equal size merge geometrically.
   Two windows that begin s bytes before their anchors are equal if and only if the anchors stand in one interval of
   common prefixes of at least `length` - s in the first array and in one of at least s in the second. So bytes
   decide, and an anchor whose neighbours share too little with it is out before any window is looked at.
3. 32-grams with over `crowd` anchors are salted over several tasks by text and place; those tasks also send 128-bit
   fingerprints of their distinct windows, packed, to tasks by fingerprint, which find what is shared between salts.
4. Marked windows are joined to their texts, and texts that occur twice or more are removed whole (from `length` bytes on).

Long texts are read in parts that overlap by `length` - 1 bytes, so memory is bounded however long a text is. In a part
that has far more anchors than a text should (one byte or a short period repeated: all its 32-grams tie) windows that
equal an earlier one of the part are marked at once, by comparing bytes, and only the first of each is sent: such a part
sends no more than a few segments, not one for every byte.

What is broadcast is bounded: a bit field of at most 2**27 bits, and at most 10**6 salted 32-grams. Texts are told apart by
64-bit fingerprints over all their bytes and their length.

Defined cases: null counts as empty; texts under `length` bytes stay as they are; repeated rows are copies of one
another; a text of any length is treated whole; all columns pass through, results replace columns of the same name in any case
(without_repeats() returns the columns of docs, also those that are named as results).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import tokens
from tidemark.llm.frames import arrow_map, map_texts, pieces, without, written

LENGTH, GRAM = 400, 32
#: Anchors of one 32-gram in one task, and most 32-grams that are salted (crowd grows where they were more).
CROWD, MOST_SALTED = 1024, 1_000_000
MOST_FILTER_BITS = 1 << 27
#: Bytes of text that a task works on at once; longer texts come in parts of that size.
PIECE = 1 << 18
#: A part with this many times the anchors that random bytes have is thinned.
DENSE = 3
_U = np.uint64
_POSITION = 28  # bits of a position in a part; more in a longer one


def text_ids(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts, summed over parts so that a long text needs no arrays of its length."""
    if len(data) <= 2 * PIECE:
        return tokens.span_hashes(tokens.prefix(data), bounds[:-1], bounds[1:]).view(np.int64)
    out = np.zeros(len(bounds) - 1, _U)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        total = 0
        for at in range(a, b, PIECE):
            total += int(tokens.prefix(data[at : min(b, at + PIECE)])[-1]) * tokens.power(at - a)
        out[i] = (total + b - a) % 2**64
    return tokens.mix(out).view(np.int64)


def parts_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, data, bounds, shift) of runs of texts; a longer text comes in several parts that overlap by length - 1 bytes, of which shift is the first byte."""
    for _, texts in pieces(batch, 0, PIECE):
        data, bounds = tokens.raw(texts)
        ids = text_ids(data, bounds)
        if len(texts) > 1 or len(data) <= 2 * PIECE:
            yield ids, data, bounds, 0
            continue
        for at in range(0, max(1, len(data) - length + 1), PIECE):
            part = data[at : at + PIECE + length - 1]
            yield ids, part, np.array([0, len(part)]), at


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, first window, last window, anchor and 32-gram hash of each anchor, and begin and end of what repeats inside a dense part; positions in data."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none, none.view(_U), none, none)
    n = len(data)
    if n < length:
        return nothing
    sums = tokens.prefix(data)
    grams = tokens.span_hashes(sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    low = max(_POSITION, n.bit_length())
    key = (grams >> _U(low) << _U(low)) | np.arange(len(grams), dtype=_U)
    w = length - GRAM + 1
    rows = -(-len(key) // w)
    full = np.full(rows * w, ~_U(0), _U)
    full[: len(key)] = key
    grid = full.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    at = (np.minimum(right[:count], left[w - 1 : w - 1 + count]) & _U((1 << low) - 1)).astype(np.int64)
    steps = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(bounds) >= length)
    steps[bounds[long]] += 1
    steps[bounds[long + 1] - length + 1] -= 1
    inside = np.cumsum(steps[:count], dtype=np.int8) > 0

    def grouped(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = at[windows]
        begins = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        return windows[begins], windows[np.concatenate([begins[1:], [len(windows)]]) - 1]

    windows = np.flatnonzero(inside)
    if not len(windows):
        return nothing
    first, last = grouped(windows)
    text = np.searchsorted(bounds, first, "right") - 1
    runs = [(none, none)]
    many = np.bincount(text, minlength=len(bounds) - 1)
    for i in np.flatnonzero(many > 16 + DENSE * 2 * (np.diff(bounds) // w)).tolist():
        again, repeated = repeats_inside(data[bounds[i] : bounds[i + 1]], length)
        inside[bounds[i] : bounds[i] + len(again)] &= ~again
        if len(found := np.flatnonzero(repeated)):
            cut = np.flatnonzero(found[1:] != found[:-1] + 1) + 1
            runs.append((bounds[i] + found[np.concatenate([[0], cut])], bounds[i] + found[np.concatenate([cut, [len(found)]]) - 1] + length))
    if len(runs) > 1:
        first, last = grouped(np.flatnonzero(inside))
        text = np.searchsorted(bounds, first, "right") - 1
    anchor = at[first]
    return text, first, last, anchor, grams[anchor], *(np.concatenate(x) for x in zip(*runs, strict=True))


def repeats_inside(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of one text: those that equal an earlier one, and those that equal any other. Candidates by fingerprint, then bytes."""
    n = len(data) - length + 1
    starts = np.arange(n)
    prints = tokens.span_hashes(tokens.prefix(data), starts, starts + length)
    order = np.argsort(prints, kind="stable")
    same = prints[order[1:]] == prints[order[:-1]]
    back = np.full(n, -1, np.int64)
    back[order[1:][same]] = order[:-1][same]
    again, repeated = np.zeros(n, bool), np.zeros(n, bool)
    at = np.flatnonzero(back >= 0)
    if not len(at):
        return again, repeated
    # Windows next to each other whose likes are too are compared as one stretch of bytes.
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (back[at[1:]] != back[at[:-1]] + 1)]))
    for a, b in zip(at[cut].tolist(), at[np.concatenate([cut[1:], [len(at)]]) - 1].tolist(), strict=True):
        x, m = int(back[a]), b - a + length
        unlike = np.flatnonzero(data[a : a + m] != data[x : x + m])
        good = np.ones(b - a + 1, bool)
        for u in unlike.tolist():
            good[max(0, u - length + 1) : u + 1] = False
        again[a : b + 1] |= good
        repeated[a : b + 1] |= good
        repeated[x : x + b - a + 1] |= good
    return again, repeated


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def table_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row for each byte string, read forwards (step 1) or backwards (-1): its bytes, zeros up to width, and its size, so that rows sort as the strings do."""
    out = np.zeros((len(starts), width + 2), np.uint8)
    nth = ranges(np.zeros(len(sizes), np.int64), sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, nth] = data[np.repeat(starts, sizes) + step * nth]
    out[:, width], out[:, width + 1] = sizes >> 8, sizes & 255
    return out


class Array:
    """A suffix array: rows of table_of(), their order, and how many bytes neighbours in it have in common."""

    def __init__(self, rows: np.ndarray):
        self.rows, width = rows, rows.shape[1] - 2
        self.sizes = rows[:, width].astype(np.int64) << 8 | rows[:, width + 1]
        keys = np.ascontiguousarray(rows).view(f"S{width + 2}").ravel()
        self.order = np.argsort(keys, kind="stable")  # merges the runs that are sorted already
        common = np.zeros(max(0, len(rows) - 1), np.int64)
        for a in range(0, len(common), 2048):
            x, y = self.order[a : a + 2048][: len(common) - a], self.order[a + 1 : a + 2049]
            apart = rows[x, :width] != rows[y, :width]
            shared = np.where(apart.any(1), apart.argmax(1), width)
            common[a : a + len(x)] = np.minimum(shared, np.minimum(self.sizes[x], self.sizes[y]))
        self.common = common

    def nearest(self) -> np.ndarray:
        """The most bytes that each row has in common with any other."""
        best = np.zeros(len(self.order), np.int64)
        best[self.order[1:]] = self.common
        best[self.order[:-1]] = np.maximum(best[self.order[:-1]], self.common)
        return best

    def among(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, among the chosen rows, in this order, and what neighbours then have in common."""
        at = np.flatnonzero(chosen[self.order])
        number = np.cumsum(chosen) - 1
        common = np.minimum.reduceat(self.common[: at[-1]], at[:-1]) if len(at) > 1 else self.common[:0]
        return number[self.order[at]], common


class Level:
    """Anchors with the suffix arrays of the bytes from them on and before them, and marks of their windows."""

    def __init__(self, gram: np.ndarray, about: np.ndarray, counts: np.ndarray, marked: np.ndarray, onward: np.ndarray, before: np.ndarray):
        self.gram, self.about, self.counts, self.marked = gram, about, counts, marked
        self.onward, self.before = Array(onward), Array(before)
        self.first = np.cumsum(counts) - counts

    def __len__(self) -> int:
        return len(self.gram)

    def fields(self, chosen: np.ndarray) -> list[np.ndarray]:
        """What makes a level of the chosen anchors, these in suffix order."""
        at = self.onward.order[chosen[self.onward.order]]
        return [self.gram[at], self.about[at], self.counts[at], self.marked[self.windows(at)], self.onward.rows[at], self.before.rows[at]]

    def windows(self, at: np.ndarray) -> np.ndarray:
        return ranges(self.first[at], self.counts[at])

    def joined(self, other: Level, only_met: bool = False) -> tuple[Level, np.ndarray]:
        """Both as one level, and which anchors of other are in it: all, or those whose 32-gram this one has."""
        chosen = np.isin(other.gram, self.gram) if only_met else np.ones(len(other), bool)
        mine = self.fields(np.ones(len(self), bool))
        return Level(*(np.concatenate(x) for x in zip(mine, other.fields(chosen), strict=True))), chosen

    def mark(self, length: int) -> None:
        """Mark the windows that two anchors of the level have."""
        least, most = length - self.onward.nearest(), self.before.nearest()
        chosen = least <= most
        m = int(chosen.sum())
        if m < 2:
            return
        least, most = least[chosen], most[chosen]
        (onward, common), (before, common_before) = self.onward.among(chosen), self.before.among(chosen)
        at = self.first[chosen] + self.before.sizes[chosen]
        place, place_before = np.empty(m, np.int64), np.empty(m, np.int64)
        for s in range(int(least.min()), int(most.max()) + 1):
            active = np.flatnonzero((least <= s) & (s <= most))
            if len(active) < 2:
                continue
            place[onward] = np.concatenate([[0], np.cumsum(common < length - s)])
            place_before[before] = np.concatenate([[0], np.cumsum(common_before < s)])
            key = place_before[active] * m + place[active]
            order = np.argsort(key)
            same = np.concatenate([[False], key[order[1:]] == key[order[:-1]], [False]])
            self.marked[at[active[order[same[1:] | same[:-1]]]] - s] = True


class Family:
    """Levels of geometrically growing size."""

    def __init__(self, length: int) -> None:
        self.levels: list[Level] = []
        self.length = length

    def add(self, new: Level) -> None:
        new.mark(self.length)
        while self.levels and len(self.levels[-1]) <= len(new):
            new = new.joined(self.levels.pop())[0]
            new.mark(self.length)
        for old in self.levels:
            self.scan(new, old)
        self.levels.append(new)

    def scan(self, new: Level, old: Level) -> None:
        """Mark what a new level and an older, larger one have in common, in both."""
        both, met = new.joined(old, only_met=True)
        if not met.any():
            return
        both.mark(self.length)
        n = len(new.marked)
        new.marked[new.windows(new.onward.order)] = both.marked[:n]
        old.marked[old.windows(old.onward.order[met[old.onward.order]])] = both.marked[n:]


SEGMENTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("gram", "salt", "id", "begin", "end")] + [T.StructField("anchor", T.IntegerType()), T.StructField("segment", T.BinaryType()), T.StructField("salted", T.BooleanType())]
)
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "begin", "end")] + [T.StructField("part", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in ("prints", "ids", "begins")])


def counted(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """kind, key, n: texts (kind 0) and anchors' 32-grams (kind 1) that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, bounds, shift in parts_of(batch, length):
                grams = anchors(data, bounds, length)[4].view(np.int64)
                ids = ids[:0] if shift else ids
                kinds = np.repeat(np.array([0, 1], np.int8), [len(ids), len(grams)])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([ids, grams]))], names=["kind", "key"])

    keys = arrow_map(docs.select(F.col(f"`{text_col}`").alias("text")), run, "kind byte, key long")
    return keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def segments(docs: DataFrame, text_col: str, length: int, grams: DataFrame, crowd: int) -> DataFrame:
    """The segments of all anchors whose 32-gram is in grams (gram, n), salted where n is over crowd; and, without one, what is known to repeat inside a text."""
    spark = docs.sparkSession
    n, total = grams.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    crowd = max(crowd, total // MOST_SALTED)
    salted = grams.where(F.col("n") > crowd).toPandas()  # at most MOST_SALTED
    order = np.argsort(salted["gram"].to_numpy(np.int64))
    hot, salts = salted["gram"].to_numpy(np.int64)[order], -(-salted["n"].to_numpy(np.int64)[order] // crowd)
    bits = 1 << min(MOST_FILTER_BITS.bit_length() - 1, max(16, math.ceil(math.log2(max(n, 1) * 16))))
    words = grams.select(F.shiftrightunsigned("gram", 64 - (bits.bit_length() - 1)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toPandas()
    field = np.zeros(bits // 64, np.int64)
    field[words["w"]] = words["b"]
    shared = spark.sparkContext.broadcast((field.view(_U), hot, salts))
    shift_by = _U(64 - (bits.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, hot, salts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for ids, data, bounds, shift in parts_of(batch, length):
                if not shift:  # further parts are of the same text
                    fresh = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()], bool)
                text, first, last, anchor, gram, begin, end = anchors(data, bounds, length)
                place = gram >> shift_by
                keep = (field[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)
                at = np.flatnonzero(keep & fresh[text]) if len(text) else text
                gram, mine, start = gram[at].view(np.int64), ids[text[at]], shift + first[at] - bounds[text[at]]
                near = np.minimum(np.searchsorted(hot, gram), max(0, len(hot) - 1))
                is_hot = hot[near] == gram if len(hot) else np.zeros(len(at), bool)
                spread = (tokens.mix(mine.view(_U) ^ tokens.mix(start.astype(_U))) >> _U(1)).astype(np.int64)
                salt = np.where(is_hot, spread % salts[near], 0) if len(hot) else np.zeros(len(at), np.int64)
                sizes = last[at] - first[at] + length
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[ranges(first[at], sizes)])]).cast(pa.binary())
                columns = [gram, salt, mine, start, start + sizes, (anchor[at] - first[at]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), parts, pa.array(is_hot)], names=SEGMENTS.names)
                owner = np.searchsorted(bounds, begin, "right") - 1
                begin, end, owner = begin[fresh[owner]], end[fresh[owner]], owner[fresh[owner]]
                if len(begin):
                    columns = [ids[owner], begin, ids[owner], shift + begin - bounds[owner], shift + end - bounds[owner]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(owner), pa.int32()), pa.nulls(len(owner), pa.binary()), pa.array(np.zeros(len(owner), bool))], names=SEGMENTS.names)

    return arrow_map(docs.select(F.col(f"`{text_col}`").alias("text")), run, SEGMENTS)


def indexed(found: DataFrame, length: int, parts: int) -> DataFrame:
    """Rows of FOUND: runs of marked windows by text, and the packed windows of salted 32-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, seen = Family(length), set()
        for batch in batches:
            known = pc.is_null(batch.column(6))
            if pc.any(known).as_py():
                own = batch.filter(known)
                yield rows(id=own.column(2), begin=own.column(3), end=own.column(4))
            names = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), known.to_pylist(), strict=True))
            fresh = [i for i, x in enumerate(names) if not (x[2] or x in seen or seen.add(x))]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            data, bounds = tokens.raw(batch.column(6).cast(pa.large_binary()))
            anchor = np.asarray(batch.column(5)).astype(np.int64)
            at = bounds[:-1] + anchor
            about = np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(3)), np.asarray(batch.column(7)).astype(np.int64)], axis=1)
            counts = np.diff(bounds) - length + 1
            onward, before = table_of(data, at, bounds[1:] - at, length, 1), table_of(data, at - 1, anchor, length - GRAM, -1)
            family.add(Level(np.asarray(batch.column(0)), about, counts, np.zeros(int(counts.sum()), bool), onward, before))
        for level in family.levels:
            at = np.flatnonzero(level.marked)
            if len(at):
                owner = np.searchsorted(level.first, at, "right") - 1
                cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
                begins, ends = np.flatnonzero(cut), np.concatenate([np.flatnonzero(cut)[1:], [len(at)]]) - 1
                who = owner[begins]
                base = level.about[who, 1] - level.first[who]
                yield rows(id=level.about[who, 0], begin=at[begins] + base, end=at[ends] + base + length)
            hot = np.flatnonzero(level.about[:, 2])
            if len(hot):
                yield from packed_windows(level, hot, length, parts)

    return arrow_map(found.repartition(parts, "gram", "salt"), run, FOUND)


def packed_windows(level: Level, hot: np.ndarray, length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """One of each of the distinct windows of these anchors, packed by fingerprint; the others are marked."""
    before, onward = level.before, level.onward
    sizes = before.sizes[hot] + onward.sizes[hot]
    starts = np.cumsum(sizes) - sizes
    data = np.empty(int(sizes.sum()), np.uint8)
    nth = ranges(np.zeros(len(hot), np.int64), before.sizes[hot])
    data[np.repeat(starts + before.sizes[hot] - 1, before.sizes[hot]) - nth] = before.rows[np.repeat(hot, before.sizes[hot]), nth]
    nth = ranges(np.zeros(len(hot), np.int64), onward.sizes[hot])
    data[np.repeat(starts + before.sizes[hot], onward.sizes[hot]) + nth] = onward.rows[np.repeat(hot, onward.sizes[hot]), nth]
    begin = ranges(starts, level.counts[hot])
    one = tokens.span_hashes(tokens.prefix(data), begin, begin + length)
    two = tokens.span_hashes(tokens.prefix(data[::-1]), len(data) - begin - length, len(data) - begin)
    who, at = np.repeat(hot, level.counts[hot]), level.windows(hot)
    order = np.lexsort((two, one))
    order = order[np.concatenate([[True], (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])])]
    one, two, who, at = one[order], two[order], who[order], at[order]
    part = ((one >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)  # grows with the print
    limits = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
    yield rows(part=part[limits[:-1]], prints=cut(np.stack([one, two], axis=1)), ids=cut(level.about[who, 0]), begins=cut(level.about[who, 1] + at - level.first[who]))


def rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(FOUND.names, kinds, strict=True)], names=FOUND.names)


def between_salts(packed: DataFrame, length: int) -> DataFrame:
    """id, begin, end of windows of salted 32-grams that occur in several salts."""

    def meet(table: pa.Table) -> pa.Table:
        prints, ids, begins = (np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]) for c, k in (("prints", _U), ("ids", np.int64), ("begins", np.int64)))
        one, two = prints[::2], prints[1::2]
        order = np.lexsort((two, one))
        same = np.concatenate([[False], (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]), [False]])
        at = order[same[1:] | same[:-1]]
        return pa.table({"id": ids[at], "begin": begins[at], "end": begins[at] + length})

    return packed.groupBy("part").applyInArrow(meet, "id long, begin long, end long")


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """text_id, whole, spans: texts with repeated strings; spans are the sorted marked runs (begin, end) in bytes, whole: the text occurs again.

    A text that occurs again has no spans: they would go to each of its copies, which are removed whole (a text with a span has `length` bytes at least).
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = written(counted(docs, text_col, length), "dedup-keys")
    grams = keys.where("kind = 1").select(F.col("key").alias("gram"), "n")
    found = written(indexed(segments(docs, text_col, length, grams, crowd), length, parts), "dedup-found")
    marks = found.where("id is not null").select("id", "begin", "end")
    packed = found.where("part is not null").select("part", "prints", "ids", "begins")
    if packed.limit(1).count():
        marks = marks.union(written(between_salts(packed, length), "dedup-salts"))
    copies = keys.where("kind = 0").select(F.col("key").alias("id"), F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"))
    span = F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))
    return marks.union(copies).groupBy(F.col("id").alias("text_id")).agg(F.count_if(F.col("begin").isNull()).alias("n_whole"), F.sort_array(F.collect_list(span)).alias("spans")).select("text_id", (F.col("n_whole") > 0).alias("whole"), F.when(F.col("n_whole") == 0, F.col("spans")).alias("spans"))


def merged_runs(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in the order of their begins as maximal runs."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


SPACED_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_text", T.BinaryType())])


def cut_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, crowd: int = CROWD, least_words: int = 0, as_text: bool = False, left_text: bool = False) -> DataFrame:
    """Every row of docs with n_bytes, n_removed, n_spans (removed runs) and kept_text (the bytes that stay; as_text: without characters of which a part was removed).

    left_text adds a column of that name with the same as a string, always without such characters. Runs with fewer than least_words words stay.
    """
    found = written(repeats(docs, text_col, length, crowd), "dedup-spans")
    added = [*ADDED.fields, *([T.StructField("left_text", T.StringType())] if left_text else [])]
    base = without(docs, *(f.name for f in added), "_text_id", "_whole", "_spans")

    def make_ids():
        return lambda texts: [pa.array(text_ids(*tokens.raw(texts)))]

    named = map_texts(base, text_col, T.StructType([T.StructField("_text_id", T.LongType())]), make_ids)
    joined = named.join(found.select(F.col("text_id").alias("_text_id"), F.col("whole").alias("_whole"), F.col("spans").alias("_spans")), "_text_id", "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in base.columns), "_whole", "_spans")
    schema = T.StructType([*base.schema.fields, *added])
    text_at, n = base.columns.index(text_col), len(base.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch, text_at):
                out = []
                for text, whole, spans in zip(texts.cast(pa.large_binary()).to_pylist(), piece.column(n).to_pylist(), piece.column(n + 1).to_pylist(), strict=True):
                    if whole and len(text) >= length:
                        gone = [(0, len(text))]
                    else:
                        gone = merged_runs((s["begin"], s["end"]) for s in spans or ())
                    if least_words:
                        gone = [(a, b) for a, b in gone if len(SPACED_WORD.findall(text, a, b)) >= least_words]
                    stays = zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True)
                    out.append((len(text), sum(b - a for a, b in gone), len(gone), b"".join(text[a:b] for a, b in stays)))
                made = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                whole = [r[3].decode(errors="ignore") for r in out] if as_text or left_text else []
                if as_text:
                    made[-1] = pa.array([x.encode() for x in whole], pa.binary())
                if left_text:
                    made.append(pa.array(whole, pa.string()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *made], names=schema.names)

    return arrow_map(joined, cut, schema)


def without_repeats(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """The rows of docs without their repeated strings, with the columns of docs.

    Removed are runs of strings of `length` bytes that occur elsewhere, from least_words words on. A character of which a part of the bytes was removed goes whole. Rows of whose text nothing is left are left out. chars_col, where
    docs have it, becomes the new text's length. Columns that are named as this operator's results keep their values.
    """
    names = [*ADDED.names, "_text_id", "_whole", "_spans"]
    away = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    out = cut_repeats(docs.withColumnsRenamed(away), text_col, length, least_words=least_words, as_text=True).where("n_bytes = 0 or octet_length(kept_text) > 0")
    text = F.when(F.col("n_removed") == 0, F.col(f"`{text_col}`")).otherwise(F.col("kept_text").cast("string"))
    if chars_col in docs.columns:
        n = F.char_length(text).cast(dict(docs.dtypes)[chars_col])
        out = out.withColumn(chars_col, F.when(F.col("n_removed") > 0, n).otherwise(F.col(f"`{chars_col}`")))
    out = out.withColumn(text_col, text)
    return without(out, *ADDED.names).withColumnsRenamed({v: k for k, v in away.items()}).select([F.col(f"`{c}`") for c in docs.columns])
