"""Benchmark decontamination: Wu-Manber multi-pattern search over words (operator 10).

Patterns are the windows of 10 consecutive words of every benchmark item, or the whole item where it
has fewer. Patterns of one length form one searcher: a shift table over blocks of two words tells how
far a cursor may jump, the hash of the pattern's last words selects a bucket of patterns, and a direct
comparison of the words' bytes confirms. Many cursors, one for every stretch of a text, move at once in
numpy; each stretch overlaps the next by a pattern, so whole texts are searched.

Documents stay where they are: one narrow stage, no shuffle. The benchmark is the only broadcast; it goes
out in blocks of at most `block_bytes` of text, one narrow stage after the other with a written table between
them, so its size is bounded whatever the table holds.

Defined cases: a text of any length is searched whole. Empty and null texts have no words: nothing is hit. Items without words are ignored. Items that repeat
count once by item_id; a null item_id counts under the empty string. Rows of documents that repeat are
each reported. find_benchmark() replaces columns that are named as its results in any case, decontaminate() returns those of docs.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import tokens
from tidemark.llm.frames import map_texts, without, written

WINDOW_WORDS = 10
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 8 << 20
#: Words of a text that one cursor walks over.
STRETCH = 512
_U = np.uint64

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text as the search sees them."""
    data = tokens.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = tokens.words(data, np.array([0, len(data)]), tokens.ALNUM)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Searcher:
    """Wu-Manber tables for patterns of one length, in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.items = length, list(patterns.values())
        self.block = min(2, length)
        words = [w for p in patterns for w in p]
        data = np.frombuffer(b"\n".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - [len(w) for w in words]
        self.texts = [b" ".join(p) for p in patterns]
        hashes = tokens.word_hashes(data, starts, ends).reshape(len(patterns), length)
        # The least jump of each block: how far its last place in any pattern is from the pattern's end.
        shift: dict[int, int] = {}
        for end in range(self.block, length + 1):
            for h in self.blocks(hashes[:, end - self.block : end].ravel(), self.block)[:: self.block].tolist():
                shift[h] = length - end
        keys = np.array(sorted(shift), _U)
        self.keys, self.jumps = keys, np.array([shift[k] for k in keys.tolist()], np.int64)
        # Most blocks of a text are in no pattern; a table over their low bits says so in one step.
        self.mask = _U((1 << max(10, int(4 * len(keys)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(keys & self.mask).astype(np.int64)] = True
        self.far = length - self.block + 1
        # Buckets by the hash of a pattern's last words, here all of them.
        full = tokens.window_hashes(hashes.ravel(), length)[::length]
        self.order = np.argsort(full, kind="stable")
        self.bucket = full[self.order]

    @staticmethod
    def blocks(hashes: np.ndarray, size: int) -> np.ndarray:
        return tokens.window_hashes(hashes, size)

    def jump(self, blocks: np.ndarray) -> np.ndarray:
        out = np.full(len(blocks), self.far, np.int64)
        some = np.flatnonzero(self.maybe[(blocks & self.mask).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, blocks[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == blocks[some], self.jumps[at], self.far)
        return out

    def find(self, data, starts, ends, hashes, blocks, firsts) -> list[tuple[int, list[str]]]:
        """(first word, items) of every occurrence in the texts."""
        n = self.length
        long = np.flatnonzero(np.diff(firsts) >= n)
        if not len(long):
            return []
        # One cursor for each stretch of places at which a pattern may begin.
        places = firsts[long + 1] - firsts[long] - n + 1
        count = -(-places // STRETCH)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(firsts[long], count) + nth * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(firsts[long] + places, count))
        found = []
        while len(at):
            jump = self.jump(blocks[at + n - self.block])
            zero = at[jump == 0]
            if len(zero):
                full = np.zeros(len(zero), _U)
                for j in range(n):
                    full += hashes[zero + j] * tokens._Q[j]
                full = tokens.mix(full + _U(n))
                low = np.searchsorted(self.bucket, full)
                for k in np.flatnonzero((low < len(self.bucket)) & (self.bucket[np.minimum(low, len(self.bucket) - 1)] == full)).tolist():
                    place, j = int(zero[k]), int(low[k])
                    here = b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(place, place + n))
                    while j < len(self.bucket) and self.bucket[j] == full[k]:
                        if self.texts[self.order[j]] == here:
                            found.append((place, self.items[self.order[j]]))
                        j += 1
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return found


def compiled(items: list[tuple[str, str]]) -> list[Searcher]:
    """Searchers for (item id, text) pairs, one for each length of pattern."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = normal_words(text)
        n = min(WINDOW_WORDS, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            by_length[n][tuple(w[i : i + n])].add(item)
    return [Searcher(n, {p: sorted(ids) for p, ids in found.items()}) for n, found in sorted(by_length.items())]


#: The searchers that this worker has compiled last, by the name of their block.
_last: dict[str, list[Searcher]] = {}


def compiled_once(name: str, shared: Broadcast) -> list[Searcher]:
    """compiled() of a block, once a worker and not once a task."""
    if name not in _last:
        _last.clear()
        _last[name] = compiled(shared.value)
    return _last[name]


def search(texts: pa.Array, searchers: list[Searcher]) -> list[pa.Array]:
    """The columns of ADDED for a batch of texts."""
    data, bounds = tokens.raw(texts)
    data = tokens.LOWER[data]
    starts, ends, firsts = tokens.words(data, bounds, tokens.ALNUM)
    hashes = tokens.word_hashes(data, starts, ends)
    blocks = {size: tokens.window_hashes(hashes, size) for size in {s.block for s in searchers}}
    hit = np.zeros(len(starts), bool)
    items: dict[int, set[str]] = defaultdict(set)
    for s in searchers:
        for place, ids in s.find(data, starts, ends, hashes, blocks[s.block], firsts):
            hit[place : place + s.length] = True
            items[int(np.searchsorted(firsts, place, "right") - 1)].update(ids)
    at = np.flatnonzero(hit)
    owner = np.searchsorted(firsts, at, "right") - 1
    sizes = np.bincount(owner, minlength=len(texts))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array((at - firsts[owner]).astype(np.int32)))
    return [pa.array(np.diff(firsts)), lists, pa.array([sorted(items.get(i, ())) for i in range(len(texts))], pa.list_(pa.string()))]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items with words in blocks of at most about block_bytes of text, dealt by the hash of their text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0))).first()[0]
    n = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs with n_words, the positions of its hit words and the ids of the items found in it."""
    out, blocks = docs, item_blocks(benchmark, block_bytes)
    for k, block in enumerate(blocks):
        # At most block_bytes of text, see item_blocks().
        pairs = [(r["item"], r["text"]) for r in block.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(pairs)

        def make(shared=shared, name=uuid.uuid4().hex):
            searchers = compiled_once(name, shared)
            return lambda texts: search(texts, searchers)

        if k:  # one block at a time: each block's tables are in the memory of one stage
            out = written(out, "benchmark-block").withColumnsRenamed({"hit_words": "_hit_words", "hit_items": "_hit_items"})
        out = map_texts(out, text_col, ADDED, make)
        if k:
            out = out.withColumns({c: F.array_sort(F.array_union(f"_{c}", c)) for c in ("hit_words", "hit_items")}).drop("_hit_words", "_hit_items")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no pattern of the benchmark occurs, with the columns of docs."""
    plain = without(docs, *ADDED.names, "_hit_words", "_hit_items")
    if set(plain.columns) == set(docs.columns):
        return find_benchmark(docs, benchmark, text_col).where(F.size("hit_items") == 0).select([F.col(f"`{c}`") for c in docs.columns])
    # A column of docs has the name of a result: it travels under another name.
    away = {c: f"_doc_{i}_{c}" for i, c in enumerate(docs.columns) if c != text_col}
    back = {v: k for k, v in away.items()}
    found = find_benchmark(docs.withColumnsRenamed(away), benchmark, text_col).where(F.size("hit_items") == 0)
    return found.drop(*ADDED.names).withColumnsRenamed(back).select([F.col(f"`{c}`") for c in docs.columns])
