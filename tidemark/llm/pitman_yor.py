"""LM scoring: a hierarchical Pitman-Yor model, seated by Gibbs sampling (operator 9).

The model has three kinds of restaurants:
- Context restaurants. The context of a token is the word before it, whatever word that is; its dishes are words. The end of a text is
  the empty word, as is the context of a text's first token. Contexts share one parent, the restaurant of words.
- The restaurant of words. Its customers are the contexts' tables, its parent spells words.
- Spelling restaurants. The context of a byte is the two bytes before it, its parent the context of one byte,
  then of none, then the uniform distribution. The customers are the spellings of the tables above.

Seating is sampled by Gibbs sweeps: all customers of a dish are seated anew by the Chinese restaurant process,
given the other restaurants as they were (large dishes in blocks of customers). After `burn_in` sweeps the predictive probabilities of
the states are averaged; the text's score is the sum of the log10 of these averages. Discounts are estimated from the numbers of
dishes with one and two customers. The draws of a dish depend on the seed, its context and its word, not on how rows are dealt to batches.

Words that no training text has are one type, as for the base score: its probability is that of all spellings
that no known word has, what the known words leave of the whole.

What is counted is counted over all training texts: words, and pairs of a context and a word. Both stay tables, which grow with the corpus.
Pairs that occur once have one table in every state, as have words with one customer of such a pair, so sweeps go over the others. The commonest
`known_words` are listed: their values are broadcast, so pairs of two listed words are swept without a shuffle and those of one meet
the other word in its bucket. Both stay packed, some rows for each bucket; pairs of two words that aren't listed are rows and meet them by
joins. To be counted, and to be scored, words and pairs go packed to buckets, too: those of listed words, which may be hot, by the
pair, others by the word that isn't listed. In its bucket a token finds its pair and that word; sums by text come back, packed too. Of a
token with two words that aren't listed each side is found in the bucket of its word. On the driver are at most 258 ** 3 spelling cells, the
listed words and the `head` commonest pairs, of which tokens are scored without a message.

Defined cases: null counts as the empty text, which has one token, the end. A null id trains (its crc32 is that of the empty
string). Repeated rows are scored, and train, as often as they occur. Without training texts every score is that of an empty
model (uniform over bytes). Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import tokens
from tidemark.llm.frames import arrow_map, forget, pieces, written

#: Commonest pairs, and words, that are broadcast as lookups; the model has all of them.
HEAD, KNOWN_WORDS = 400_000, 100_000
SWEEPS, BURN_IN = 4, 2
STRENGTH = 1.0
#: Symbols of spellings: start, end, then the bytes.
SYMBOLS = 258
_U = np.uint64
#: Distinct words, or pairs, that a task holds before it merges, and sends, its counts.
HELD, HELD_PAIRS = 150_000, 1_000_000
#: Buckets of words, of which a task counts one at a time; more where there are over 256 shuffle partitions.
WORD_BUCKETS = 1024
#: The hash of the empty word: the end of a text, and what its first token follows.
END = int(tokens.word_hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)).view(np.int64)[0])


def in_fold(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    """Whether a document is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == held


def seat(customers: np.ndarray, new_table: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers are seated one after another.

    new_table: the weight of a new table, (strength + discount * tables of the restaurant) * parent's probability. From 64
    customers on, blocks of a tenth of those seated are seated at once.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    seated = tables.copy()
    at = np.flatnonzero(seated < customers)
    while len(at):
        n = seated[at]
        block = np.minimum(np.where(n < 64, 1, n // 10), customers[at] - n)
        p = new_table[at] / (new_table[at] + n - discount * tables[at])
        tables[at] += rng.binomial(block, np.clip(p, 0, 1))
        seated[at] = n + block
        at = at[seated[at] < customers[at]]
    return tables


def binomial(uniform: np.ndarray, other: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Binomial numbers from two uniform ones each: by the inverse distribution function, for a mean over 30 by a rounded normal variable."""
    p = np.clip(p, 0.0, 1.0)
    mean = n * p
    z = np.sqrt(-2 * np.log(np.maximum(uniform, 1e-300))) * np.cos(2 * np.pi * other)
    out = np.clip(np.rint(mean + np.sqrt(mean * (1 - p)) * z), 0, n).astype(np.int64)
    at = np.flatnonzero((mean <= 30) & (p < 0.5) & (n > 0))
    out[at] = 0
    odds, chance = p[at] / (1 - p[at]), np.power(1 - p[at], n[at])
    reached, k = chance.copy(), 0
    while len(at):
        on = (uniform[at] >= reached) & (k < n[at]) & (chance > 0)
        at, odds, chance, reached = at[on], odds[on], chance[on], reached[on]
        chance = chance * odds * (n[at] - k) / (k + 1)
        reached, k = reached + chance, k + 1
        out[at] = k
    return out


def seat_by_hash(customers: np.ndarray, new_table: np.ndarray, discount: float, names: np.ndarray, seed: int) -> np.ndarray:
    """seat(), with the draws of each dish from its name and seed alone. From 64 customers on, blocks of half of those seated, at the chance in their middle."""
    tables = np.minimum(customers, 1).astype(np.int64)
    state = tokens.mix(names ^ tokens.mix(np.full(len(names), seed + 1, np.int64).view(_U)))
    uniform = lambda at, k: ((tokens.mix(state[at] + _U(k)) >> _U(11)).astype(float) + 0.5) / 2.0**53
    at, n = np.flatnonzero(customers > 1), 1
    while len(at) and n < 64:
        tables[at] += uniform(at, n) < new_table[at] / (new_table[at] + n - discount * tables[at])
        n += 1
        at = at[customers[at] > n]
    k = 1000
    while len(at):
        block = np.minimum(n // 2, customers[at] - n)
        p = new_table[at] / (new_table[at] + n + block / 2 - discount * tables[at])
        tables[at] += binomial(uniform(at, k), uniform(at, k + 1), block, p)
        n, k = n + n // 2, k + 2
        at = at[customers[at] > n]
    return tables


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones + twos > 0 else 0.5


class Contexts:
    """Context restaurants over few dishes with a parent of their own, as arrays: the small form of the tables of pairs."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.tables = np.minimum(counts, 1)
        self.discount = discount_of((counts == 1).sum(), (counts == 2).sum())

    def parent(self) -> np.ndarray:
        """Probabilities of the classes in the parent, whose customers are the contexts' tables."""
        c = self.tables.sum(0).astype(float)
        return (c + STRENGTH / len(c)) / (c.sum() + STRENGTH)

    def predictive(self) -> np.ndarray:
        """Probability of each class (column) after each context (row)."""
        c, t = self.counts.sum(1, keepdims=True), self.tables.sum(1, keepdims=True)
        own = np.maximum(self.counts - self.discount * self.tables, 0)
        return (own + (STRENGTH + self.discount * t) * self.parent()) / (c + STRENGTH)

    def sweep(self, rng: np.random.Generator) -> None:
        weight = (STRENGTH + self.discount * self.tables.sum(1, keepdims=True)) * self.parent()
        self.tables = seat(self.counts.ravel(), weight.ravel(), self.discount, rng).reshape(self.counts.shape)


class Spelling:
    """Byte restaurants: two bytes of context, one, none, uniform; as sorted cells of the first and arrays of the others."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, rng: np.random.Generator, before: Spelling | None = None):
        self.cells, x = cells, cells % SYMBOLS
        context, short = cells // SYMBOLS, cells // SYMBOLS % SYMBOLS
        self.discount = discount_of((counts == 1).sum(), (counts == 2).sum())
        d = self.discount
        # Seated given the probabilities of the last state (at first, the uniform ones).
        parent = before.one[short, x] if before else np.full(len(cells), 1 / SYMBOLS)
        held = np.bincount(context, np.minimum(counts, 1), SYMBOLS**2)
        tables = seat(counts, (STRENGTH + d * held[context]) * parent, d, rng)
        one_counts = np.bincount(short * SYMBOLS + x, tables, SYMBOLS**2).astype(np.int64)
        root = before.none if before else np.full(SYMBOLS, 1 / SYMBOLS)
        one_held = np.minimum(one_counts, 1).reshape(SYMBOLS, SYMBOLS).sum(1)
        weight = (STRENGTH + d * one_held)[:, None] * root
        one_tables = seat(one_counts, weight.ravel(), d, rng).reshape(SYMBOLS, SYMBOLS)
        none_counts = one_tables.sum(0).astype(float)
        self.none = (none_counts + STRENGTH / SYMBOLS) / (none_counts.sum() + STRENGTH)
        one_counts = one_counts.reshape(SYMBOLS, SYMBOLS)
        self.one = (np.maximum(one_counts - d * one_tables, 0) + (STRENGTH + d * one_tables.sum(1))[:, None] * self.none) / (one_counts.sum(1) + STRENGTH)[:, None]
        total, held = np.bincount(context, counts, SYMBOLS**2), np.bincount(context, tables, SYMBOLS**2)
        self.back = (STRENGTH + d * held) / (total + STRENGTH)
        self.two = np.maximum(counts - d * tables, 0) / (total[context] + STRENGTH) + self.back[context] * self.one[short, x]

    def probability(self, cells: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Probabilities of spellings, given as cells of which firsts tells the first of each word."""
        if not len(cells):
            return np.zeros(len(firsts) - 1)
        p = self.back[cells // SYMBOLS] * self.one[cells // SYMBOLS % SYMBOLS, cells % SYMBOLS]
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            p = np.where(self.cells[at] == cells, self.two[at], p)
        return np.exp(np.maximum(np.add.reduceat(np.log(p), firsts[:-1]), -700))


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells (two symbols before, symbol) of words and their end, and the firsts of the words."""
    sizes = ends - starts
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
    padded = np.zeros(int(firsts[-1]) + 2 * len(sizes), np.int64)
    to = firsts[:-1] + 2 * np.arange(len(sizes)) + 2
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(to, sizes) + at] = data[np.repeat(starts, sizes) + at].astype(np.int64) + 2
    padded[to + sizes] = 1
    here = np.ones(len(padded), bool)
    here[to - 1] = here[to - 2] = False
    here = np.flatnonzero(here)
    return (padded[here - 2] * SYMBOLS + padded[here - 1]) * SYMBOLS + padded[here], firsts


def binary_parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, bounds = tokens.raw(words.cast(pa.large_binary()))
    return data, bounds[:-1], bounds[1:]


def read(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """data, starts, ends, firsts and hashes of the words of lower-cased texts."""
    data, bounds = tokens.raw(texts)
    data = tokens.lower(data)
    starts, ends, firsts = tokens.words(data, bounds, tokens.SPACED)
    return data, starts, ends, firsts, tokens.word_hashes(data, starts, ends)


def order_of(keys: np.ndarray) -> np.ndarray:
    """argsort() of hashes, or of smaller numbers, by a sort of values that hold their places in the last bits, which is faster."""
    keys, bits = keys.astype(_U, copy=False), len(keys).bit_length()
    low, place = _U((1 << bits) - 1), np.arange(len(keys), dtype=_U)
    if not len(keys) or int(keys.max()).bit_length() + bits <= 64:
        return (np.sort((keys << _U(bits)) | place) & low).astype(np.int64)
    at = (np.sort((keys & ~low) | place) & low).astype(np.int64)
    found = keys[at]
    wrong = np.flatnonzero(found[1:] < found[:-1])  # keys that differ in those bits alone
    if len(wrong) > 1000:
        return np.argsort(keys)
    top = found & ~low
    for x in top[wrong]:
        here = slice(np.searchsorted(top, x), np.searchsorted(top, x, "right"))
        at[here] = at[here][np.argsort(keys[at[here]])]
    return at


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys in their order, and where in it the distinct ones begin."""
    order = order_of(keys)
    found = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), found[1:] != found[:-1]]))


def sums_of(values: np.ndarray, order: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values by the groups of groups()."""
    return np.add.reduceat(values[order], cuts) if len(cuts) else values[:0]


def common(words: DataFrame, n: int) -> Column:
    """Whether a word (c) is one of the commonest: whole bins of like counts, at most n of them.

    A sort with a limit would send n rows of every task to the driver; here the driver gets some hundred bins.
    """
    bin_of = F.floor(F.log2(F.greatest("c", F.lit(1)).cast("double")) * 8).cast("int")
    return bin_of >= last_bin(words.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")), n)


def last_bin(bins: DataFrame, most: int) -> int:
    """The least of the highest bins (bin, n) that have at most so many rows in all."""
    bins = sorted(((r["bin"], r["n"]) for r in bins.collect()), reverse=True)
    taken, last = 0, bins[0][0] + 1 if bins else 0
    for number, count in bins:
        if taken + count > most:
            break
        taken, last = taken + count, number
    return last


def transitions(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of all tokens: the words of each text and its end."""
    n = len(firsts) - 1
    end = np.array([END]).view(_U)[0]
    end_at = firsts[1:] + np.arange(n)
    now = np.full(len(hashes) + n, end, _U)
    inside = np.ones(len(now), bool)
    inside[end_at] = False
    now[inside] = hashes
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[firsts[:-1] + np.arange(n)] = end
    return before, now


def pair_names(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return tokens.mix(before + tokens.mix(now ^ _U(0x9E3779B97F4A7C15)))


#: Kinds of pairs, by whether the context and the word are listed, that is, among the commonest words, whose values are broadcast.
BOTH, WORD, CONTEXT, NEITHER = range(4)
#: Further kinds of messages: what asks for the word of a pair of kind NEITHER, texts, sums of tokens, words, pairs of kind BOTH, other pairs.
ASKED, TEXT, SUMS, WORDS_OF, NEAR, FAR = range(4, 10)


def pack(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, which a shuffle compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(found: list[bytes], kind: type) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() for x in found]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def rising(x: np.ndarray) -> bytes:
    """pack() of sorted numbers: the steps between them."""
    return pack(np.concatenate([x[:1], np.diff(x)]).astype(x.dtype))


def unpack_rising(found: list[bytes], kind: type) -> np.ndarray:
    parts = [np.cumsum(unpack([x], kind), dtype=kind) for x in found]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted among the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Places:
    """find() in sorted hashes, of all or of a range of them, by a table over their first bits in that range, faster for many that are wanted."""

    def __init__(self, keys: np.ndarray):
        bits = min(22, max(8, int(len(keys)).bit_length() + 2))
        self.keys, self.low, self.high = keys, *((keys[0], keys[-1]) if len(keys) else (_U(0), _U(0)))
        self.shift = _U(max(0, int(self.high - self.low).bit_length() - bits))
        starts = np.searchsorted((keys - self.low) >> self.shift, np.arange(2**bits + 1, dtype=_U))
        self.starts, self.longest = np.minimum(starts[:-1], max(len(keys) - 1, 0)).astype(np.int32), int(np.diff(starts).max())

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return find(self.keys, wanted)
        at = self.starts[(np.clip(wanted, self.low, self.high) - self.low) >> self.shift]
        found = self.keys[at]
        ok = found == wanted
        open_ = np.flatnonzero(found < wanted)
        for _ in range(self.longest - 1):
            at[open_] = np.minimum(at[open_] + 1, len(self.keys) - 1)
            found = self.keys[at[open_]]
            ok[open_] = found == wanted[open_]
            open_ = open_[found < wanted[open_]]
        return at, ok


def near_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of pairs of listed words, given by their numbers."""
    return (u.astype(_U) << _U(32)) | w.astype(_U)


def kinds_of(u_listed: np.ndarray, w_listed: np.ndarray) -> np.ndarray:
    """The kind of each pair, by whether its context and its word are listed."""
    return np.where(u_listed, np.where(w_listed, BOTH, CONTEXT), np.where(w_listed, WORD, NEITHER))


def dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets by ranges of hashes: what is sorted by hash is sorted by bucket."""
    return (((hashes >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def parts_of(bucket: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with its places, sorted by the key: numbers of listed words, or hashes by which buckets are dealt."""
    order = order_of((bucket.astype(_U) << _U(int(key.max(initial=0)).bit_length())) | key if key.itemsize == 4 else key)
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def home(kind: int, names: np.ndarray, u: np.ndarray, w: np.ndarray, at_u: np.ndarray, at_w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of pairs of one kind with the two columns that name them. A pair goes to the bucket of its word that isn't listed, of two
    to that of the context; pairs of listed words, which may be hot, go by the pair."""
    if kind == BOTH:
        return dealt(tokens.mix(near_keys(at_u, at_w)), n), at_u, at_w
    if kind == CONTEXT:
        return dealt(w, n), w, at_u
    return dealt(u, n), u, at_w if kind == WORD else w


def away(kind: int, names: np.ndarray, a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of home(), read back."""
    return unpack_rising(a, np.uint32 if kind == BOTH else _U), unpack(b, _U if kind == NEITHER else np.uint32)


def pair_hashes(kind: int, names: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts and the words of pairs, given the columns of home()."""
    return (names[a], names[b]) if kind == BOTH else (names[b], a) if kind == CONTEXT else (a, names[b] if kind == WORD else b)


def grouped(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Each key of rows sorted by it with its rows, the columns `names`, by their kind."""
    last, rows = None, {}
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (key, "kind", *names)]
        for k, kind, *row in zip(*columns, strict=True):
            if k != last and rows:
                yield last, rows
                rows = {}
            last = k
            rows.setdefault(kind, []).append(row)
    if rows:
        yield last, rows


def gathered(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.repartition(n, key).sortWithinPartitions(key)


PARTS = "bucket int, kind int, a binary, b binary, n binary"
WORD_PARTS = "bucket int, kind int, a binary, b binary, c binary, n binary"
#: Pairs of a bucket and a kind that occur more than once, packed: how many, how many of them occur twice, the columns of home(), counts,
#: tables and own weights. Of kind WORDS_OF: words with held and now.
MANY = "bucket int, kind int, pairs int, twos int, a binary, b binary, c binary, t binary, own binary"
#: The same and, of kind ASKED, words with the number of pairs that occur once by word (x0) and by context (y0).
PAIRS = MANY + ", hash long, x0 long, y0 long"
PACKED_PAIRS = 1 << 17


def shrunk(x: np.ndarray) -> bytes:
    return pa.compress(pack(x), codec="zstd", asbytes=True)


def grown(found: bytes, kind: type, n: int) -> np.ndarray:
    return unpack([pa.decompress(found, n * np.dtype(kind).itemsize, codec="zstd")], kind)


def many_rows(bucket: int, kind: int, a: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
    """Rows of MANY. a: sorted. rest: further columns."""
    steps = lambda x: np.concatenate([x[:1], np.diff(x)]).astype(x.dtype)
    found = []
    for i in range(0, len(a), PACKED_PAIRS):
        part = [x[i : i + PACKED_PAIRS] for x in rest]
        twos = int((part[1] == 2).sum()) if kind <= NEITHER else 0
        found.append((bucket, kind, len(part[0]), twos, shrunk(steps(a[i : i + PACKED_PAIRS])), *(shrunk(x) for x in part), *[None] * (4 - len(part))))
    return rows_of(found, MANY)


def pairs_in(kind: int, n: int, a: bytes, b: bytes, c: bytes, t: bytes, own: bytes) -> tuple[np.ndarray, ...]:
    """The columns of a row of pairs: those of home(), counts, tables, own weights."""
    kinds = (np.uint32 if kind == BOTH else _U, _U if kind == NEITHER else np.uint32, np.int64, np.int64, float)
    a, *rest = (grown(x, k, n) for x, k in zip((a, b, c, t, own), kinds, strict=True))
    return np.cumsum(a, dtype=a.dtype), *rest


def each_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """The bucket, the kind and pairs_in() of each row of MANY."""
    for batch in batches:
        for bucket, kind, n, *columns in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "pairs", "a", "b", "c", "t", "own")), strict=True):
            yield bucket, kind, pairs_in(kind, n, *columns)


def word_counts(texts: DataFrame, n: int) -> DataFrame:
    """hash, word, c: how often each word occurs in the one text column of texts. The words of many texts go packed to n buckets, which count them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            hashes, counts = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            words = pa.concat_arrays([h[2] for h in held])
            order, cuts = groups(hashes)
            first = order[cuts]
            return hashes[first], sums_of(counts, order, cuts), words.take(pa.array(first))

        def out(x: tuple) -> pa.RecordBatch:
            hashes, counts, words = x
            data, bounds = tokens.raw(words.cast(pa.large_binary()))
            sizes = np.diff(bounds).astype(np.uint32)
            found = []
            for k, p in parts_of(dealt(hashes, n), hashes):  # merged() sorts by hash, so that p are neighbours
                found.append((k, 0, rising(hashes[p]), data[bounds[p[0]] : bounds[p[-1] + 1]].tobytes(), pack(sizes[p]), pack(counts[p])))
            return rows_of(found, WORD_PARTS)

        for batch in batches:
            for _, piece in pieces(batch, 0):
                data, starts, ends, _, hashes = read(piece)
                order, cuts = groups(hashes)
                first, counts = order[cuts], np.diff(np.append(cuts, len(order)))
                found, sizes = hashes[first], (ends - starts)[first]
                at = np.repeat(starts[first] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                words = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
                held.append((found, counts, words))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield out(held[0])
                        held = []
        if held:
            yield out(merged())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "bucket", ["a", "b", "c", "n"]):
            a, b, c, counts = zip(*rows[0], strict=True)
            hashes, data, sizes = unpack_rising(a, _U), b"".join(b), unpack(c, np.uint32)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(hashes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            order, cuts = groups(hashes)
            first = order[cuts]
            c = sums_of(unpack(counts, np.int64), order, cuts)
            for i in range(0, len(first), PACKED_PAIRS):
                at = first[i : i + PACKED_PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), words.take(pa.array(at)).cast(pa.binary()), pa.array(c[i : i + PACKED_PAIRS])], names=["hash", "word", "c"])

    return arrow_map(gathered(arrow_map(texts, run, WORD_PARTS), "bucket", int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), count, "hash long, word binary, c long")


def pair_counts(texts: DataFrame, listed: Broadcast, n: int) -> DataFrame:
    """PAIRS of the one text column of texts. The pairs of many texts go packed to n buckets, which count them. listed: sorted hashes of listed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed_names, places = listed.value, Places(listed.value)
        held: list[tuple] = []

        def merged() -> tuple:
            keys, u, w, n = (np.concatenate([h[i] for h in held]) for i in range(4))
            order, cuts = groups(keys)
            first = order[cuts]
            return keys[first], u[first], w[first], sums_of(n, order, cuts)

        def out(x: tuple) -> Iterator[pa.RecordBatch]:
            _, u, w, count = x
            (at_u, u_listed), (at_w, w_listed) = places.find(u), places.find(w)
            kinds, at_u, at_w = kinds_of(u_listed, w_listed), at_u.astype(np.uint32), at_w.astype(np.uint32)
            for kind in range(4):
                at = np.flatnonzero(kinds == kind)
                bucket, a, b = home(kind, listed_names, u[at], w[at], at_u[at], at_w[at], n)
                found = [(k, kind, rising(a[p]), pack(b[p]), pack(count[at[p]].astype(np.uint32))) for k, p in parts_of(bucket, a)]
                if found:
                    yield rows_of(found, PARTS)

        for batch in batches:
            for _, piece in pieces(batch, 0):
                *_, firsts, hashes = read(piece)
                before, now = transitions(hashes, firsts)
                names = pair_names(before, now)
                order, cuts = groups(names)
                first = order[cuts]
                held.append((names[first], before[first], now[first], np.diff(np.append(cuts, len(order)))))
                if sum(len(h[0]) for h in held) > HELD_PAIRS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield from out(held[0])
                        held = []
        if held:
            yield from out(merged())

    def asked(hashes: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), ASKED, np.int32)), *(pa.array(x) for x in (hashes.view(np.int64), x0, y0))], names=["kind", "hash", "x0", "y0"])
        return with_all(found, PAIRS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = listed.value
        as_word, as_context = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for bucket, rows in grouped(batches, "bucket", ["a", "b", "n"]):
            once: list[tuple] = [(np.zeros(0, _U), False)]
            for kind, found in rows.items():
                a, b = away(kind, names, [r[0] for r in found], [r[1] for r in found])
                order, cuts = groups(tokens.mix(near_keys(a, b)) if kind == BOTH else pair_names(*pair_hashes(kind, names, a, b)))
                c, first = sums_of(unpack([r[2] for r in found], np.uint32).astype(np.int64), order, cuts), order[cuts]
                many, lone = first[c > 1], first[c == 1]
                by_a = order_of(a[many])
                if len(many):
                    yield with_all(many_rows(bucket, kind, a[many][by_a], b[many][by_a], c[c > 1][by_a], np.ones(len(many), np.int64), np.zeros(len(many))), PAIRS)
                if kind in (BOTH, WORD):
                    as_word += np.bincount(b[lone], minlength=len(names))
                if kind in (BOTH, CONTEXT):
                    as_context += np.bincount(a[lone] if kind == BOTH else b[lone], minlength=len(names))
                if kind != BOTH:
                    once.append((a[lone], kind == CONTEXT))
                if kind == NEITHER:
                    once.append((b[lone], True))
            hashes = np.concatenate([x for x, _ in once])
            is_word = np.repeat([y for _, y in once], [len(x) for x, _ in once]).astype(np.int64)
            order, cuts = groups(hashes)
            yield asked(hashes[order[cuts]], sums_of(is_word, order, cuts), sums_of(1 - is_word, order, cuts))
        at = np.flatnonzero(as_word + as_context)
        yield asked(names[at], as_word[at], as_context[at])

    return arrow_map(gathered(arrow_map(texts, run, PARTS), "bucket", n), count, PAIRS)


ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def with_all(batch: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    """A batch with all columns of a schema; those it hasn't are null."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column(n) if n in batch.schema.names else pa.nulls(len(batch), ARROW[k]) for n, k in fields], names=[n for n, _ in fields])


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Tuples as a batch of a schema of int, long and binary columns."""
    kinds = ARROW
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def sweep_words(words: DataFrame, shared: Broadcast, tables: int, total: int, discount: float, context_discount: float, keep: bool, seed: int) -> DataFrame:
    """The restaurant of words after a sweep, with the probability `now` of each in the state before it; if keep, p and b grow by that state's
    probability of the word, and its weight of the parent after the word as a context. shared: the spelling."""
    names = [f.name for f in WORDS.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = shared.value.probability(*spell(*binary_parts(batch.column("word"))))
            c, customers, t, held = (np.asarray(batch.column(n)) for n in ("c", "customers", "t", "held"))
            fresh = (STRENGTH + discount * tables) * spelled
            p = (np.maximum(customers - discount * t, 0) + fresh) / (total + STRENGTH)
            b = (STRENGTH + context_discount * held) / (c + STRENGTH)
            kept = [states_in(batch.column(n)) for n in ("p", "b")]
            if keep:
                kept = [np.column_stack([old, new]) for old, new in zip(kept, (p, b), strict=True)]
            seated = seat_by_hash(customers, fresh, discount, np.asarray(batch.column("hash")).view(_U), seed)
            new = {"t": pa.array(seated), "now": pa.array(p)} | {n: pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel())) for n, k in zip(("p", "b"), kept, strict=True)}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)

    return arrow_map(words.select(names), run, WORDS)


def kept_words(words: DataFrame, kept: list[tuple[Broadcast, int, int]], discount: float, context_discount: float) -> DataFrame:
    """hash, c, p, b of words with one customer, and one table, in every kept state. kept: the spelling, tables and customers of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, firsts = spell(*binary_parts(batch.column(1)))
            c, held = (np.asarray(batch.column(i)) for i in (2, 3))
            p = np.column_stack([(1 - discount + (STRENGTH + discount * tables) * model.value.probability(cells, firsts)) / (total + STRENGTH) for model, tables, total in kept])
            b = np.repeat((STRENGTH + context_discount * held) / (c + STRENGTH), len(kept))
            ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (p.ravel(), b))], names=["hash", "c", "p", "b"])

    return arrow_map(words.select("hash", "word", "c", "held"), run, "hash long, c long, p array<double>, b array<double>")


def added_cells(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cells, back = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    return cells, np.bincount(back, np.concatenate([x[1], y[1]]), len(cells)).astype(np.int64)


def states_in(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = np.asarray(lists.flatten())
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def packed_words(words: DataFrame, n: int) -> DataFrame:
    """Rows of MANY with the words (hash, held, now), in their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []

        def out() -> Iterator[pa.RecordBatch]:
            hashes, held, now = (np.concatenate([x[i] for x in found]) for i in range(3))
            hashes = hashes.view(_U)
            for k, p in parts_of(dealt(hashes, n), hashes):
                yield many_rows(k, WORDS_OF, hashes[p], held[p], now[p])

        for batch in batches:
            found.append([np.asarray(x) for x in batch.columns])
            if sum(len(x[0]) for x in found) > HELD_PAIRS:
                yield from out()
                found.clear()
        if found:
            yield from out()

    return arrow_map(words.select("hash", "held", "now"), run, MANY)


def sweep_pairs(many: DataFrame, words: DataFrame, shared: Broadcast, n: int, discount: float, keep: bool, seed: int) -> DataFrame:
    """The context restaurants (MANY) after a sweep; if keep, own grows by what the customers of the state before it weigh. shared: hashes of listed words,
    their held and now. Pairs of listed words stay where they are, others meet the words that aren't listed in their buckets."""

    def seated(kind: int, bucket: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, t: np.ndarray, own: np.ndarray, held: np.ndarray, now: np.ndarray) -> pa.RecordBatch:
        if keep:
            own = own + np.maximum(c - discount * t, 0)
        t = seat_by_hash(c, (STRENGTH + discount * held) * now, discount, pair_names(*pair_hashes(kind, shared.value[0], a, b)), seed)
        return many_rows(bucket, kind, a, b, c, t, own)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, held, now = shared.value
        for bucket, kind, (a, b, *rest) in each_of(batches):
            yield seated(kind, bucket, a, b, *rest, held[a], now[b])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, held, now = shared.value
        for bucket, rows in grouped(batches, "bucket", ["pairs", "a", "b", "c", "t", "own"]):
            own_words = [(np.cumsum(grown(a, _U, m), dtype=_U), grown(b, np.int64, m), grown(c, float, m)) for m, a, b, c, *_ in rows.pop(WORDS_OF, [])]
            if not rows:
                continue
            hashes, own_held, own_now = (np.concatenate([x[i] for x in own_words]) for i in range(3))
            order = order_of(hashes)
            places, own_held, own_now = Places(hashes[order]), own_held[order], own_now[order]
            for kind, found in rows.items():
                for row in found:
                    a, b, *rest = pairs_in(kind, *row)
                    at, _ = places.find(a)
                    yield seated(kind, bucket, a, b, *rest, *((own_held[at], now[b]) if kind == WORD else (held[b], own_now[at])))

    far = many.where(F.col("kind").isin(WORD, CONTEXT)).unionByName(packed_words(words.where("moving and not listed"), n))
    return arrow_map(many.where(F.col("kind") == BOTH), listed, MANY).unionByName(arrow_map(gathered(far, "bucket", n), others, MANY))


NEITHER_PAIRS = "u long, w long, c long, t long, own double"


def pairs_of_neither(many: DataFrame) -> DataFrame:
    """The pairs of two words that aren't listed as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (a, b, *rest) in each_of(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (a, b)), *map(pa.array, rest)], names=[x.split()[0] for x in NEITHER_PAIRS.split(", ")])

    return arrow_map(many.where(F.col("kind") == NEITHER), run, NEITHER_PAIRS)


def sweep_neither(pairs: DataFrame, words: DataFrame, discount: float, keep: bool, seed: int) -> DataFrame:
    """sweep_pairs() for pairs of two words that aren't listed, which meet both by joins."""
    side = lambda key, name: words.where("moving and not listed").select(F.col("hash").alias(key), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, c, t, own, held, now = (np.asarray(x) for x in batch.columns)
            if keep:
                own = own + np.maximum(c - discount * t, 0)
            t = seat_by_hash(c, (STRENGTH + discount * held) * now, discount, pair_names(u.view(_U), w.view(_U)), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(t), pa.array(own)], names=batch.schema.names[:5])

    about = pairs.join(side("u", "held"), "u").join(side("w", "now"), "w")
    return arrow_map(about.select(*pairs.columns, "held", "now"), run, NEITHER_PAIRS)


def tables_by_word(many: DataFrame, neither: DataFrame | None, listed: Broadcast) -> DataFrame:
    """hash, x, y: the tables of each word in all contexts, and of each context, of pairs that occur more than once."""

    def rows(hashes: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)) for z in (hashes, x, y)], names=["hash", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = listed.value
        x, y = np.zeros(len(names)), np.zeros(len(names))
        for _, kind, (a, b, _, t, _) in each_of(batches):
            if kind in (BOTH, WORD):
                x += np.bincount(b, t, len(names))
            if kind in (BOTH, CONTEXT):
                y += np.bincount(a if kind == BOTH else b, t, len(names))
            if kind != BOTH:
                cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                found = np.add.reduceat(t, cuts)
                none = np.zeros(len(cuts), np.int64)
                yield rows(a[cuts], *((none, found) if kind == WORD else (found, none)))
        at = np.flatnonzero(x + y)
        yield rows(names[at], x[at].astype(np.int64), y[at].astype(np.int64))

    zero = F.lit(0).cast("long")
    found = arrow_map(many.where(F.col("kind") != NEITHER), run, "hash long, x long, y long")
    if neither is not None:
        found = found.unionByName(neither.select(F.explode(F.array(F.struct(F.col("w").alias("hash"), F.col("t").alias("x"), zero.alias("y")), F.struct(F.col("u").alias("hash"), zero.alias("x"), F.col("t").alias("y")))).alias("s")).select("s.*"))
    return found.groupBy("hash").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def bins_of(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(c, 1)) * 8).astype(np.int32)


def head_pairs(near: DataFrame, most: int) -> tuple[pa.Table, int]:
    """u, w, own of the commonest pairs of listed words, whole bins of like counts and at most so many, and the least of the bins."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, (_, _, c, _, _) in each_of(batches):
            found, n = np.unique(bins_of(c), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["bin", "n"])

    last = last_bin(arrow_map(near, binned, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")), most)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, (a, b, c, _, own) in each_of(batches):
            at = np.flatnonzero(bins_of(c) >= last)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at].astype(np.int64)) for x in (a, b)), pa.array(own[at])], names=["u", "w", "own"])

    return arrow_map(near, chosen, "u long, w long, own double").toArrow(), last


def spelling_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the spellings of all tables of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            found, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return found, np.bincount(back, np.concatenate([h[1] for h in held])).astype(np.int64)

        for batch in batches:
            cells, firsts = spell(*binary_parts(batch.column(0)))
            found, back = np.unique(cells, return_inverse=True)
            held.append((found, np.bincount(back, np.repeat(np.asarray(batch.column(1)), np.diff(firsts))).astype(np.int64)))
            if sum(len(h[0]) for h in held) > 4 * HELD_PAIRS:
                held = [merged()]
        if held:
            found, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["cell", "n"])

    found = arrow_map(words.select("word", "t"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS ** 3 rows
    cells, n = (found[name].to_numpy() for name in ("cell", "n"))
    order = np.argsort(cells)
    return cells[order], n[order]


#: Words: their tokens in training texts (c; as a context it has as many customers), pairs that occur once by word and by context (x0, y0), whether
#: other pairs have it and whether it is listed, customers and tables in the restaurant of words, tables as a context, probability in the last
#: state, and by kept state probability as a word and weight of the parent as a context.
WORDS = T.StructType(
    [T.StructField("hash", T.LongType()), T.StructField("word", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in ("c", "x0", "y0")]
    + [T.StructField(n, T.BooleanType()) for n in ("moving", "listed")] + [T.StructField(n, T.LongType()) for n in ("customers", "t", "held")]
    + [T.StructField("now", T.DoubleType())] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("p", "b")]
)
#: Messages: packed tokens, words, pairs and sums to a bucket or about a chunk (the row of its first text), and texts.
MESSAGE = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary"
TEXTS = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("base", "score")]
)
#: Tokens, and entries of sums, that a task holds before it sends them.
HELD_TOKENS = 2_000_000


def own_of(keys: np.ndarray, train: np.ndarray, known: Places, weights: np.ndarray, lone: float) -> np.ndarray:
    """Own weights of the pairs of tokens. known, weights: the keys of pairs that occur more than once. Any other pair of a training text occurs
    once, and one of a held-out text does if a training text of the same bucket, which has all its tokens, has it."""
    at, found = known.find(keys)
    own = np.where(found, weights[at] if len(weights) else 0.0, 0.0)
    own[~found & train] = lone
    open_ = np.flatnonzero(~found & ~train)
    own[open_] = np.where(find(np.unique(keys[~found & train]), keys[open_])[1], lone, 0.0)
    return own


def side_parts(words: DataFrame, many: DataFrame, neither: DataFrame | None, listed: Broadcast, n: int, states: int, head: int) -> DataFrame:
    """Messages with the words that aren't listed (c, p, b) and with pairs and their own weights, to their buckets. head: the least bin of pairs that are broadcast."""

    def packed(columns: Callable[[pa.RecordBatch], tuple]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def out() -> Iterator[pa.RecordBatch]:
                kind, bucket, key, *rest = held[0][0], *(np.concatenate([h[i] for h in held]) for i in range(1, len(held[0])))
                found = [(k, None, kind, rising(key[p]), *(pack(x[p].ravel()) for x in rest), *[None] * (3 - len(rest))) for k, p in parts_of(bucket, key)]
                if found:
                    yield rows_of(found, MESSAGE)

            for batch in batches:
                held.append(columns(batch))
                if sum(len(h[1]) for h in held) > HELD_TOKENS // 4:
                    yield from out()
                    held = []
            if held:
                yield from out()

        return run

    def of_words(batch: pa.RecordBatch) -> tuple:
        hashes = np.asarray(batch.column(0)).view(_U)
        return WORDS_OF, dealt(hashes, n), hashes, np.asarray(batch.column(1)), states_in(batch.column(2)), states_in(batch.column(3))

    def of_neither(batch: pa.RecordBatch) -> tuple:
        u, w = (np.asarray(batch.column(i)).view(_U) for i in (0, 1))
        return FAR, dealt(u, n), u, pair_names(u, w), np.asarray(batch.column(2)) / states

    def of_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = listed.value
        for bucket, kind, (a, b, c, _, own) in each_of(batches):
            if kind == BOTH:
                at = bins_of(c) < head
                keys, own = tokens.mix(near_keys(a[at], b[at])), own[at]
            else:
                keys = pair_names(*pair_hashes(kind, names, a, b))
            order = order_of(keys)
            if len(keys):
                yield rows_of([(bucket, None, NEAR if kind == BOTH else FAR, None, pack(keys[order]), pack(own[order] / states), None)], MESSAGE)

    found = arrow_map(words.select("hash", "c", "p", "b"), packed(of_words), MESSAGE).unionByName(arrow_map(many.where(F.col("kind") != NEITHER), of_many, MESSAGE))
    return found if neither is None else found.unionByName(arrow_map(neither.select("u", "w", "own"), packed(of_neither), MESSAGE))


def score_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", held_out: Column | None = None, head: int = HEAD, known_words: int = KNOWN_WORDS, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity of every row of docs.

    The model learns from the rows that are not held out. base_score: add-one unigram probabilities.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    held_out = in_fold(F.col(f"`{id_col}`")) if held_out is None else held_out
    train = docs.where(~held_out).select(F.col(f"`{text_col}`").alias("text"))
    known = written(word_counts(train, max(WORD_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "lm-words")
    n_texts = train.count()
    n_words, n_types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    train_tokens, types = n_words + n_texts, n_types + (n_texts > 0)
    unit = train_tokens + types + 1
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), train_tokens >> 21)  # buckets

    # The listed words: the commonest, and the end.
    end = spark.range(1).select(F.lit(END).cast("long").alias("hash"), F.lit(b"").alias("word"), F.lit(n_texts).cast("long").alias("c"))
    known = known.unionByName(end)
    is_listed = common(known, known_words) | (F.col("hash") == END)
    few = known.where(is_listed).select("hash", "c").toArrow()
    names = few["hash"].to_numpy().view(_U)
    by_name = np.argsort(names)
    names, counts = names[by_name], few["c"].to_numpy()[by_name]
    listed = send(names)

    # Pairs. One that occurs once has one table whatever the state, so sweeps leave it out.
    pairs = written(pair_counts(train, listed, n), "lm-pairs")
    ones, twos, n_neither = (x or 0 for x in pairs.agg(F.sum("x0"), F.sum("twos"), F.count_if(F.col("kind") == NEITHER)).first())
    context_discount = discount_of(ones, twos)
    many = pairs.where(F.col("kind") <= NEITHER).select([x.split()[0] for x in MANY.split(", ")])
    neither = pairs_of_neither(many) if n_neither else None

    zero = F.lit(0).cast("long")
    none = F.array().cast("array<double>")
    lone = pairs.where(F.col("kind") == ASKED).select("hash", "x0", "y0", zero.alias("x"), zero.alias("y"))
    more = tables_by_word(many, neither, listed).select("hash", zero.alias("x0"), zero.alias("y0"), "x", "y")
    both = lone.unionByName(more).groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("x0", "y0", "x", "y")))
    words = known.withColumn("listed", is_listed).join(both, "hash", "left").na.fill(0, ["x0", "y0", "x", "y"])
    words = words.withColumns({"moving": F.col("x") + F.col("y") > 0, "customers": F.col("x0") + F.col("x"), "held": F.col("y0") + F.col("y"), "now": F.lit(0.0), "p": none, "b": none})
    all_words = written(words.withColumn("t", F.least("customers", F.lit(1)).cast("long")).select(WORDS.names), "lm-all")
    # Words with one customer, of a pair that occurs once, have one table in every state: sweeps leave them out.
    is_still = (F.col("customers") == 1) & ~F.col("moving") & ~F.col("listed")
    still, words = all_words.where(is_still), all_words.where(~is_still)
    still_cells, n_still = spelling_counts(still), still.count()

    def seated(words: DataFrame, tables: DataFrame) -> DataFrame:
        """words with their customers and tables by the seating of pairs; those of pairs that occur once stay as they are."""
        moved = words.where("moving").join(tables, "hash", "left")
        moved = moved.withColumns({"customers": F.col("x0") + F.coalesce("x", zero), "held": F.col("y0") + F.coalesce("y", zero)})
        return words.where("not moving").unionByName(moved.select(WORDS.names))

    def by_listed(columns: list[str]) -> list[np.ndarray]:
        """Columns of the listed words, in the order of names."""
        found = words.where("listed").select("hash", *columns).toArrow().combine_chunks()
        order = np.argsort(found["hash"].to_numpy().view(_U))
        return [(states_in(pa.concat_arrays(found[c].chunks)) if pa.types.is_list(found[c].type) else found[c].to_numpy())[order] for c in columns]

    # Gibbs sweeps over all restaurants.
    rng = np.random.default_rng(seed)
    ones, twos, total, lone_total = words.agg(F.count_if(F.col("customers") == 1), F.count_if(F.col("customers") == 2), F.sum("customers"), F.sum("x0")).first()
    ones, total, lone_total, kept = ones + n_still, total + n_still, lone_total + n_still, []
    discount, states, model, sums = discount_of(ones, twos), 0, None, None
    for s in range(sweeps):
        tables = words.agg(F.sum("t")).first()[0] + n_still
        model = Spelling(*added_cells(still_cells, spelling_counts(words)), rng, model)
        keep = s >= burn_in
        states += keep
        spelling = send(model)
        last, words = words, written(sweep_words(words if sums is None else seated(words, sums), spelling, tables, total, discount, context_discount, keep, 2 * s + seed * 1000), "lm-rest")
        if keep:
            kept.append((spelling, tables, total))
        else:
            spelling.destroy()
        for table in (*([last] if s else []), *([sums] if sums is not None else [])):
            forget(table)
        values = send((names, *by_listed(["held", "now"])))
        last = [x for x in (many, neither) if x is not None]
        many = written(sweep_pairs(many, words, values, n, context_discount, keep, 2 * s + 1 + seed * 1000), "lm-many")
        neither = neither if neither is None else written(sweep_neither(neither, words, context_discount, keep, 2 * s + 1 + seed * 1000), "lm-neither")
        values.destroy()
        for table in last if s else [pairs]:
            forget(table)
        if s < sweeps - 1:
            sums = written(tables_by_word(many, neither, listed), "lm-sums")
            total = lone_total + (sums.agg(F.sum("x")).first()[0] or 0)

    # What no known word has of the states, and the commonest words and pairs for broadcasts of bounded length.
    still = written(kept_words(still, kept, discount, context_discount), "lm-still")
    forget(all_words)
    rest = words.where("not listed").select("hash", "c", "p", "b").unionByName(still)
    left = words.select("p").unionByName(still.select("p")).agg(*(F.sum(F.col("p")[i]) for i in range(states))).first()
    unknown = np.array([max(1 - x, 1e-12) for x in left])
    p, b = by_listed(["p", "b"])
    frequent, least = head_pairs(many.where(F.col("kind") == BOTH), head)
    keys = tokens.mix(near_keys(frequent["u"].to_numpy(), frequent["w"].to_numpy()))
    by_key = np.argsort(keys)
    shared = send((names, counts, p, b, keys[by_key], frequent["own"].to_numpy()[by_key] / states))

    id_type = docs.schema[id_col].dataType
    text_fields = T.StructType([T.StructField(f.name, id_type if f.name == "doc_id" else f.dataType) for f in TEXTS.fields])
    schema = T.StructType([*T.StructType.fromDDL(MESSAGE).fields, *text_fields.fields])
    text_names, parts = TEXTS.names, [x.split()[0] for x in MESSAGE.split(", ")]

    def tokens_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with the sums of the tokens whose words and pair are broadcast, and packed messages with all other tokens."""
        names, counts, p, b, keys, own = shared.value
        places, pair_places = Places(names), Places(keys)
        held: list[tuple] = []
        chunk, types = None, None

        def out() -> Iterator[pa.RecordBatch]:
            u, w, kinds, at_u, at_w, text = (np.concatenate([h[i] for h in held]) for i in range(6))
            number = np.arange(len(u), dtype=np.uint32)
            for kind in range(4):
                at = np.flatnonzero(kinds == kind)
                bucket, x, y = home(kind, names, u[at], w[at], at_u[at], at_w[at], n)
                found = [(k, chunk, kind, rising(x[q]), pack(y[q]), pack(text[at[q]]), pack(number[at[q]]) if kind == NEITHER else None) for k, q in parts_of(bucket, x)]
                if kind == NEITHER:
                    found += [(k, chunk, ASKED, rising(w[at[q]]), None, pack(text[at[q]]), pack(number[at[q]])) for k, q in parts_of(dealt(w[at], n), w[at])]
                if found:
                    rows = rows_of(found, MESSAGE)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(len(found), k) for k in types)], names=[*parts, *text_names])

        for batch in batches:
            for piece, texts in pieces(batch, 3):
                rows = np.asarray(piece.column(0))
                chunk = int(rows[0]) if chunk is None else chunk
                *_, firsts, hashes = read(texts)
                ends = firsts + np.arange(len(firsts))
                before, now = transitions(hashes, firsts)
                at_w, w_listed = places.find(now)
                at_u, u_listed = np.empty_like(at_w), np.empty_like(w_listed)
                for x, of in ((at_u, at_w), (u_listed, w_listed)):
                    x[1:], x[ends[:-1]] = of[:-1], of[ends[1:] - 1]  # a text's first token follows the end
                kinds, at_u, at_w = kinds_of(u_listed, w_listed), at_u.astype(np.uint32), at_w.astype(np.uint32)
                is_listed = (kinds == BOTH) | (kinds == WORD)
                base = np.where(is_listed, np.log10((counts[at_w] + 1) / unit), 0.0)
                end = np.zeros(len(now), bool)
                end[ends[1:] - 1] = True
                is_known = is_listed & (~end | (n_texts > 0))
                at, paired = pair_places.find(tokens.mix(near_keys(at_u, at_w)))
                done = np.flatnonzero((kinds == BOTH) & paired)
                score = np.zeros(len(now))
                score[done] = np.log10(own[at[done]] / (counts[at_u[done]] + STRENGTH) + (p[at_w[done]] * b[at_u[done]]).mean(1))
                m = len(ends) - 1
                sums = [pa.array(np.diff(ends)), *(pa.array(tokens.per_text(x, ends)) for x in (is_known.astype(np.int64), base, score))]
                types = [piece.column(0).type, piece.column(1).type, pa.bool_(), *(x.type for x in sums)]
                packed = [pa.array(rows % n, pa.int32()), pa.array(np.full(m, chunk)), pa.array(np.full(m, TEXT, np.int32)), *(pa.nulls(m, pa.binary()) for _ in range(4))]
                yield pa.RecordBatch.from_arrays([*packed, *piece.columns[:3], *sums], names=[*parts, *text_names])
                open_ = np.ones(len(now), bool)
                open_[done] = False
                # Twice the text's number in its chunk, and one if it is held out.
                text = np.repeat((2 * (rows - chunk) + np.asarray(piece.column(2).cast(pa.int8()))).astype(np.uint32), np.diff(ends))
                held.append(tuple(x[open_] for x in (before, now, kinds, at_u, at_w, text)))
                if sum(len(h[0]) for h in held) > HELD_TOKENS:
                    yield from out()
                    held, chunk = [], None
        if held:
            yield from out()

    lone_own = 1 - context_discount

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of each bucket with the words and pairs of it: sums by text; of pairs of kind NEITHER each side of the token."""
        names, counts, p, b, *_ = shared.value
        types: list = []

        def messages(found: list[tuple]) -> pa.RecordBatch:
            rows = rows_of(found, MESSAGE)
            return pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(len(found), k) for k in types)], names=[*parts, *text_names])

        def packed_only(batches: Iterator[pa.RecordBatch], texts: list) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.column(k).type for k in text_names]
                is_text = np.asarray(batch.column("kind")) == TEXT
                if is_text.any():
                    texts.append(batch.filter(pa.array(is_text)))
                yield batch.filter(pa.array(~is_text))

        texts: list[pa.RecordBatch] = []
        for bucket, rows in grouped(packed_only(batches, texts), "bucket", ["chunk", "a", "b", "c", "d"]):
            yield from texts
            texts.clear()
            column = lambda kind, i: [r[i] for r in rows.get(kind, [])]
            words = unpack_rising(column(WORDS_OF, 1), _U)
            order = order_of(words)
            words, places, c_of = words[order], Places(words[order]), unpack(column(WORDS_OF, 2), np.int64)[order]
            p_of, b_of = (unpack(column(WORDS_OF, i), float).reshape(-1, states)[order] for i in (3, 4))
            pairs_of = {}
            for kind in (NEAR, FAR):
                found, own = unpack(column(kind, 2), _U), unpack(column(kind, 3), float)
                order = order_of(found)
                pairs_of[kind] = Places(found[order]), own[order]

            def as_context(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at, ok = places.find(u)
                if not len(words):
                    return np.ones(len(u)), np.ones((len(u), states))
                return 1 / (np.where(ok, c_of[at], 0) + STRENGTH), np.where(ok[:, None], b_of[at], 1.0)

            def as_word(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at, ok = places.find(w)
                if not len(words):
                    return np.zeros(len(w), np.int64), np.tile(unknown, (len(w), 1))
                return np.where(ok, c_of[at], 0), np.where(ok[:, None], p_of[at], unknown)

            sums: list[tuple] = []
            for kind in range(ASKED + 1):
                if kind not in rows:
                    continue
                sizes = [len(x) // 4 for x in column(kind, 3)]
                chunks = np.repeat(np.array(column(kind, 0), np.int64), sizes)
                text = unpack(column(kind, 3), np.uint32).astype(np.int64)
                row, is_train = chunks + text // 2, text % 2 == 0
                if kind == ASKED:
                    c_w, shares = as_word(unpack_rising(column(kind, 1), _U))
                    more = np.zeros(len(row))
                else:
                    x, y = away(kind, names, column(kind, 1), column(kind, 2))
                    u, w = pair_hashes(kind, names, x, y)
                    own = own_of(tokens.mix(near_keys(x, y)), is_train, *pairs_of[NEAR], lone_own) if kind == BOTH else own_of(pair_names(u, w), is_train, *pairs_of[FAR], lone_own)
                    scale, weights = (1 / (counts[x] + STRENGTH), b[x]) if kind == BOTH else (1 / (counts[y] + STRENGTH), b[y]) if kind == CONTEXT else as_context(u)
                    c_w, shares = (None, p[y]) if kind in (BOTH, WORD) else as_word(w) if kind == CONTEXT else (None, None)
                if kind in (NEITHER, ASKED):
                    number, cut = unpack(column(kind, 4), np.uint32), np.concatenate([[0], np.cumsum(sizes)])
                    value = [number, own * scale, weights] if kind == NEITHER else [number, shares, text.astype(np.uint32)]
                    if kind == NEITHER:
                        value = [*value, text.astype(np.uint32)]
                        yield messages([(bucket, k, kind, pack(number[i:j]), pack(value[1][i:j]), pack(weights[i:j].ravel()), pack(value[3][i:j])) for k, i, j in zip(column(kind, 0), cut, cut[1:], strict=False)])
                    else:
                        yield messages([(bucket, k, kind, pack(number[i:j]), pack(shares[i:j].ravel()), None, None) for k, i, j in zip(column(kind, 0), cut, cut[1:], strict=False)])
                else:
                    more = np.log10(own * scale + (weights * shares).mean(1))
                if kind != NEITHER:
                    some = c_w is not None
                    sums.append((chunks, row, more, np.log10((c_w + 1) / unit) if some else np.zeros(len(row)), (c_w > 0).astype(float) if some else np.zeros(len(row))))
            if sums:
                chunks, row, *values = (np.concatenate([x[i] for x in sums]) for i in range(5))
                order, cuts = groups(row)
                values = [sums_of(v, order, cuts) for v in values]
                row, chunks = row[order[cuts]], chunks[order[cuts]]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]])
                yield messages([(bucket, int(chunks[i]), SUMS, rising((row[i:j] - chunks[i]).astype(np.uint32)), *(pack(v[i:j]) for v in values)) for i, j in zip(cut, cut[1:], strict=False)])
        yield from texts

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of each chunk with all sums of their tokens."""
        texts: dict[int, list] = {}

        def packed_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_text = np.asarray(batch.column("kind")) == TEXT
                found = batch.filter(pa.array(is_text))
                if len(found):
                    chunks = np.asarray(found.column("chunk"))
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]])
                    for i, j in zip(cut, cut[1:], strict=False):
                        texts.setdefault(int(chunks[i]), []).append(found.slice(i, j - i).select(text_names))
                # One row of each chunk stays, so that a chunk of texts alone is seen.
                keep = ~is_text
                keep[np.unique(np.asarray(batch.column("chunk")), return_index=True)[1]] = True
                yield batch.filter(pa.array(keep))

        for chunk, rows in grouped(packed_only(batches), "chunk", ["a", "b", "c", "d"]):
            found = pa.Table.from_batches(texts.pop(chunk)).sort_by("row")
            at = found["row"].to_numpy() - chunk
            more, base, known = np.zeros((3, int(at.max()) + 1))
            for a, *values in rows.get(SUMS, []):
                i = unpack_rising([a], np.uint32)
                for total, v in zip((more, base, known), values, strict=True):
                    total[i] += unpack([v], float)
            if NEITHER in rows:
                column = lambda kind, i: [r[i] for r in rows[kind]]
                order, asked = (order_of(unpack(column(k, 0), np.uint32)) for k in (NEITHER, ASKED))
                weights, shares = unpack(column(NEITHER, 2), float).reshape(-1, states)[order], unpack(column(ASKED, 1), float).reshape(-1, states)[asked]
                value = np.log10(unpack(column(NEITHER, 1), float)[order] + (weights * shares).mean(1))
                more += np.bincount(unpack(column(NEITHER, 3), np.uint32)[order] // 2, value, len(more))
            added = {"n_known": known.astype(np.int64), "base": base, "score": more}
            columns = [pa.array(found[k].to_numpy() + added[k][at]) if k in added else found[k].combine_chunks() for k in text_names]
            yield from pa.Table.from_arrays(columns, names=text_names).to_batches()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    sides = side_parts(rest, many, neither, listed, n, states, least)
    sent = arrow_map(numbered, tokens_out, schema).unionByName(sides, allowMissingColumns=True)
    replies = arrow_map(gathered(sent, "bucket", n), in_buckets, schema)
    out = arrow_map(gathered(replies, "chunk", n), by_text, text_fields)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
