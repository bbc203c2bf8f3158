"""N-gram Jaccard join: parity sketches, pigeonhole join by size band, verification (operator 2).

A document is its set of distinct 5-word shingles, as 64-bit hashes. Sizes fall into bands of a factor of two; a
set takes part in the join of its own band, and of the next one if a linked set can be there. A band has as many
cells as its least size: each shingle is XORed into the cell its hash names, so an even number of equal entries vanishes and
a cell is the parity (as a 64-bit scramble) of the shingles in it. The number of cells in which two
sketches differ - their Hamming distance - is at most the size of the symmetric difference. Sets of sizes a and b with
100 * intersection >= 80 * union differ in at most (a + b) / 9 shingles, a quarter of either. A set with c cells that are
not empty shares at least c less that many with every set that it is linked with, so a join on (band, cell number, cell) finds every link
of a set for which that is 1 or more. Of other sets, whose few shingles fall into few cells, all shingles are keys too: linked sets have one in common.

How the work is kept whole and bounded:
- Documents with the same set are one class and are never paired.
- Cells are dealt to tasks packed, and only cells that two classes share leave the tasks. A class that shares
  fewer cells than any link of it must share is out.
- Star round: each class is verified against one class of those that its cells propose, the one with which it shares most cells,
  if those are enough. Then, in further rounds, against some of other components that its rare cells propose. The links'
  components settle the cells whose classes are all in one component, so groups of near copies shrink in every round, at a few
  pairs a copy. The number of rounds doesn't change the result: one that links nothing is the last, and without open cells there is no rest.
- Rest: of two linked classes the one with fewer shingles has 8/9 of them in the other, the larger one 4/5. Classes that have less in common with
  all classes of other components together take neither part, so texts with up to 8/9 of one boilerplate are not compared with each other. A smaller one that
  reaches 8/9 only with shingles that few classes have (up to FEW) meets others in these, in as many of its rarest as a link can't do without:
  at most FEW classes a shingle. One that reaches 8/9 by frequent shingles alone meets others in cells: a class that shares s cells, of which a link
  needs r, in its s - r + 1 rarest. Two classes with r common cells have one of these in common, whatever the rest, so cells of passages that many
  documents quote are left out without losing a link. Pairs meet only if bit sketches of a fixed length, in which every shingle flips one bit, differ in
  no more bits than linked sets in shingles; those of cells must share enough of all their cells before their sets are compared.

Defined cases: a text of any length is read whole. Null and empty texts, and texts without words, have an empty set, link with nothing and are
their own component. jaccard_components() has no other columns of docs, one_of_each() those of docs, whatever their names. Fewer than 5 words: the whole sequence is the one shingle. Repeated rows are in one class. A null
doc_id takes part; the component is the least non-null doc_id in it, or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import tokens
from tidemark.llm.frames import arrow_map, map_texts, pieces, written
from tidemark.llm.graphs import joined

SHINGLE = 5
#: Least similarity, as numerator and denominator.
SIMILAR = (80, 100)
#: Bits of a cell's key that hold the band; bytes of it that travel, beside the part that its leading bits choose.
BAND_BITS, KEY_BYTES = 6, 6
#: 64-bit words of a bit sketch.
SKETCH_WORDS = 8
#: Rounds in which classes try some of another component, and how many each cell proposes; what they leave open is compared in pairs.
STARS, PROPOSED = 2, 6
#: Classes up to which a shingle is one of few.
FEW = 64
#: Packed cells that a task holds before it sends them on, and that a task brings together.
FLUSH, PART_CELLS = 500_000, 1 << 21
#: Bits of the filter that tells which sets a verification needs; beyond its capacity it only lets more pass.
MOST_FILTER_BITS = 1 << 27
_U = np.uint64


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, bounds = tokens.raw(texts)
    data = tokens.LOWER[data]
    starts, ends, firsts = tokens.words(data, bounds, tokens.SPACED)
    words = tokens.word_hashes(data, starts, ends)
    windows = tokens.window_hashes(words, SHINGLE)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        else:
            out.append(tokens.window_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of the set."""
    if not len(hashes):
        return 0
    pair = np.array([np.bitwise_xor.reduce(tokens.mix(hashes)), hashes.sum(dtype=_U)], _U)
    return int(tokens.mix(tokens.mix(pair[:1]) ^ pair[1:] + _U(len(hashes))).view(np.int64)[0])


def most_apart(n: int) -> int:
    """The most shingles in which a set linked with one of n differs from it: the linked set has at most n * 100 / 80."""
    low, high = SIMILAR
    return n * (high - low) // low


def bands_of(n: int) -> list[int]:
    """The bands in whose join a set of n shingles takes part: its own, from 2**band on, and the next one if a set in it can be near enough."""
    own = n.bit_length() - 1
    low, high = SIMILAR
    return [own, own + 1] if n * high >= (2 << own) * low else [own]


def sketch(hashes: np.ndarray, band: int) -> np.ndarray:
    """Keys of the cells that are not empty, of 2**band cells; the band stands in their lowest bits."""
    cell = hashes >> _U(64 - band) if band else hashes & _U(0)  # grows with the hash: each cell is a run of the sorted set
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    parity = np.bitwise_xor.reduceat(tokens.mix(hashes), first)
    keys = tokens.mix(parity ^ tokens.mix(cell[first] + (_U(band + 1) << _U(40))))
    return keys >> _U(BAND_BITS) << _U(BAND_BITS) | _U(band)


def join_keys(hashes: np.ndarray, band: int) -> np.ndarray:
    """The sketch; with so few cells that a linked set may have none of them, the keys of all shingles too."""
    cells = sketch(hashes, band)
    if len(cells) > most_apart(len(hashes)):
        return cells
    single = tokens.mix(tokens.mix(hashes + _U(5)) + (_U(band + 1) << _U(40)))
    return np.concatenate([cells, single >> _U(BAND_BITS) << _U(BAND_BITS) | _U(band)])


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS * 64 bits, of which every shingle flips one."""
    place = (tokens.mix(hashes + _U(3)) % _U(SKETCH_WORDS * 64)).astype(np.int64)
    bits = (np.bincount(place, minlength=SKETCH_WORDS * 64) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def named_sets(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, n_shingles, set_id, own_band, own_cells, next_cells: the cells that aren't empty in the set's bands."""
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = ["doc_id", "n_shingles", "set_id", "own_band", "own_cells", "next_cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch, 1):
                made = []
                for s in shingle_sets(texts):
                    n = len(s)
                    own, *more = bands_of(n) if n else [0]
                    made.append((n, set_id(s), own, len(sketch(s, own)) if n else 0, len(sketch(s, more[0])) if more else None))
                columns = [pa.array([m[i] for m in made], pa.int64() if i < 2 else pa.int32()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns], names=names)

    return arrow_map(kept, run, f"doc_id {dict(kept.dtypes)['doc_id']}, n_shingles long, set_id long, own_band int, own_cells int, next_cells int")


def shared_cells(docs: DataFrame, text_col: str, parts: int) -> DataFrame:
    """cell, band, id, size: the classes in every cell that two classes or more share, and how many they are.

    Cells travel packed: one row holds the cells of many classes for one of `parts` ranges of keys. Keys that meet by chance
    only add candidates.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, records, held = [], [], 0

        def flush():
            nonlocal keys, records, held
            all_keys = np.concatenate(keys)
            owner = np.repeat(np.arange(len(records), dtype=np.int32), [len(k) for k in keys])
            part = ((all_keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            owner, part = owner[order], part[order]
            low = all_keys[order].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            limits = [*first.tolist(), len(part)]
            about = np.array(records, np.int64)
            cells, owners, counts = [], [], []
            for a, b in zip(limits[:-1], limits[1:], strict=True):
                mine, n = np.unique(owner[a:b], return_counts=True)
                cells.append(low[a:b].tobytes())
                owners.append(about[mine].tobytes())
                counts.append(n.astype(np.int32).tobytes())
            keys, records, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(cells, pa.binary()), pa.array(owners, pa.binary()), pa.array(counts, pa.binary())], names=["part", "cells", "owners", "counts"])

        for batch in batches:
            for _, texts in pieces(batch, 0):
                for s in shingle_sets(texts):
                    name = set_id(s)
                    if not len(s) or name in seen:
                        continue
                    seen.add(name)
                    for band in bands_of(len(s)):
                        found = join_keys(s, band)
                        keys.append(found)
                        records.append(name)
                        held += len(found)
                if held >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, KEY_BYTES) for x in table.column("cells").to_pylist()])
        cells = np.zeros((len(low), 8), np.uint8)
        cells[:, :KEY_BYTES] = low
        cells = cells.view(_U).ravel()
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
        about = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("owners").to_pylist()])
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.argsort(cells)
        s = cells[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        order = order[same[1:] | same[:-1]]
        key, rec = cells[order].view(np.int64), about[owner[order]]
        # Copies from other tasks: one entry for each class of a cell.
        order = np.lexsort((rec, key))
        key, rec = key[order], rec[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (rec[1:] != rec[:-1])]) if len(key) else np.zeros(0, bool)
        key, rec = key[new], rec[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(key)]]))
        keep = np.repeat(size, size) > 1
        part = table.column("part")[0].as_py() if len(table) else 0
        band = (key & np.int64((1 << BAND_BITS) - 1)).astype(np.int32)
        columns = [key + (np.int64(part) << np.int64(8 * KEY_BYTES)), band, rec, np.repeat(size, size).astype(np.int32)]
        return pa.table([pa.array(np.ascontiguousarray(c[keep])) for c in columns], names=["cell", "band", "id", "size"])

    packed = arrow_map(docs.select(F.col(f"`{text_col}`").alias("text")), pack, "part int, cells binary, owners binary, counts binary")
    return packed.groupBy("part").applyInArrow(meet, "cell long, band int, id long, size int")


def filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit field in which the (mixed) id of every row of ids has its bit set; of bounded size."""
    n = ids.count()
    bits = 1 << min(MOST_FILTER_BITS.bit_length() - 1, max(16, math.ceil(math.log2(max(n, 1) * 16))))
    place = F.shiftrightunsigned(F.col("id"), 64 - (bits.bit_length() - 1))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[words["w"]] = words["b"]
    return out


def sets_of(docs: DataFrame, text_col: str, ids: DataFrame) -> DataFrame:
    """id, n, hashes, sketch: the sets of the named ids, packed, and their bit sketches; one row an id."""
    field = docs.sparkSession.sparkContext.broadcast(filter_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = field.value
        shift = 64 - (len(bits) * 64).bit_length() + 1
        seen: set[int] = set()
        for batch in batches:
            for _, texts in pieces(batch, 0):
                made = []
                for s in shingle_sets(texts):
                    if not len(s):
                        continue
                    name = set_id(s)
                    place = (name & (2**64 - 1)) >> shift
                    if int(bits[place >> 6]) >> (place & 63) & 1 and name not in seen:
                        seen.add(name)
                        made.append((name, len(s), s.tobytes(), bit_sketch(s).tolist()))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["id", "n", "hashes", "sketch"])

    found = arrow_map(docs.select(F.col(f"`{text_col}`").alias("text")), run, "id long, n long, hashes binary, sketch array<long>")
    return found.join(ids, "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by their whole sets."""
    low, high = SIMILAR

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                shorter, longer = (x, y) if len(x) <= len(y) else (y, x)
                if high * len(shorter) < low * len(longer):
                    good.append(False)
                    continue
                at = np.searchsorted(longer, shorter)
                both = int((longer[np.minimum(at, len(longer) - 1)] == shorter).sum())
                good.append(high * both >= low * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
    return arrow_map(with_b.select("a", "b", "set_a", "set_b"), check, "a long, b long")


def strong_cells(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of shared whose class shares enough cells, with cells (its cells that aren't empty), need (how many of them a linked class shares),
    left (how many of the shared ones are no rarer than this one) and `rare`: whether the class meets others in the cell.

    A window holds one class's keys of one band, at most twice as many as its shingles.
    """
    own = Window.partitionBy("id", "band")
    low, high = SIMILAR
    about = classes.select(F.col("set_id").alias("id"), F.col("n_shingles").alias("n"), "own_band", "own_cells", "next_cells")
    rows = shared.join(about, "id").withColumn("cells", F.when(F.col("band") == F.col("own_band"), F.col("own_cells")).otherwise(F.col("next_cells")))
    need = (F.col("cells") - F.floor(F.col("n") * F.lit(high - low) / F.lit(low))).cast("int")
    ranked = rows.withColumns({"need": F.greatest(need, F.lit(1)), "all": F.count(F.lit(1)).over(own), "r": F.row_number().over(own.orderBy("size", "cell"))})
    ranked = ranked.where(F.col("all") >= F.col("need")).withColumn("left", F.col("all") - F.col("r") + 1)
    return ranked.select("cell", "band", "id", "cells", "need", (F.col("left") >= F.col("need")).alias("rare"), F.col("left").cast("int").alias("left"))


def apart(n_a: Column, n_b: Column) -> Column:
    """The most shingles in which linked sets of these sizes differ."""
    low, high = SIMILAR
    return F.floor((n_a + n_b) * F.lit(high - low) / F.lit(high + low))


def near_sketches(a: Column, b: Column) -> Column:
    """Whether two sets, given as structs with n and sketch, may be similar enough: sketches differ in no more bits than the sets in shingles."""
    low, high = SIMILAR
    bits = [F.bit_count(F.get(a["sketch"], i).bitwiseXOR(F.get(b["sketch"], i))) for i in range(SKETCH_WORDS)]
    differ = bits[0]
    for x in bits[1:]:
        differ = differ + x
    return (F.least(a["n"], b["n"]) * high >= F.greatest(a["n"], b["n"]) * low) & (differ <= apart(a["n"], b["n"]))


def open_cells(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with component, of the cells in which two components or more are left."""
    own = rows.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = own.groupBy("cell").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("cell")
    return own.join(mixed, "cell")


def star_pairs(strong: DataFrame) -> DataFrame:
    """Each class with the class with which it shares most cells, of two that every cell proposes: the least and the greatest by hash."""
    name = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    ends = strong.groupBy("cell").agg(F.min(name).alias("low"), F.max(name).alias("high"))
    x = strong.join(ends, "cell").withColumn("other", F.when(F.col("low.id") != F.col("id"), F.col("low.id")).otherwise(F.col("high.id")))
    shared = x.groupBy("id", "band", "other").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need")
    best = shared.groupBy("id").agg(F.max_by("other", F.struct("n", "other")).alias("b"))
    return best.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def proposed_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each class with those of PROPOSED classes that its cells propose by hash which are in another component and near by their bit sketches."""
    who = F.struct("id", "component", "n", "sketch")
    chosen = rows.groupBy("cell").agg(*(F.min_by(who, F.xxhash64("id", F.lit(turn * PROPOSED + j))).alias(f"p{j}") for j in range(PROPOSED)))
    x = rows.join(chosen, "cell")
    own = F.struct("n", "sketch")
    near = F.filter(F.array(*(F.col(f"p{j}") for j in range(PROPOSED))), lambda p: (p["component"] != F.col("component")) & near_sketches(own, p))
    pairs = x.select("id", F.explode(F.array_distinct(F.transform(near, lambda p: p["id"]))).alias("other"))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def open_rows(strong: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """The rare cells that are open, with what is known of each class."""
    rows = open_cells(strong.where("rare"), comps).join(sets.select("id", "n", "sketch"), "id")
    return written(rows.select("cell", "band", "id", "component", "cells", "left", "n", "sketch"), "join-open")


def met_shingles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """id, component, n, hash, holders: the shingles of the classes in rows (id, component) that classes of two components have, with how many have them."""
    named = rows.select("id", "component").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                hashes = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(3)]
                sizes = [len(h) for h in hashes]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                columns = [pa.array(np.asarray(part.column(k))[owner]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(hashes))], names=["id", "component", "n", "hash"])

    each = arrow_map(named.join(sets.select("id", "n", "hashes"), "id").select("id", "component", "n", "hashes"), spread, "id long, component long, n long, hash long")
    each = written(each, "join-shingles")
    met = each.groupBy("hash").agg(F.min("component").alias("one"), F.max("component").alias("other"), F.count(F.lit(1)).alias("holders")).where("one <> other")
    return written(each.join(met.select("hash", "holders"), "hash"), "join-met-shingles")


def parts_taken(met: DataFrame) -> DataFrame:
    """id, and what the class can be in a link: `smaller` ("few", "many" or null) of two, and how many of its shingles of few classes a link needs (`least`).

    Sets of sizes a <= b have at least (a + b) * 80 / 180 shingles in common, so at least 8/9 of a and 4/5 of b. Classes that can be neither are left out.
    """
    low, high = SIMILAR
    many = F.count_if(F.col("holders") > FEW)
    least = F.ceil(F.col("n") * F.lit(2 * low) / F.lit(low + high))
    shared = met.groupBy("id", "n").agg(F.count(F.lit(1)).alias("shared"), many.alias("many")).where(F.col("shared") * high >= F.col("n") * low)
    smaller = F.when(F.col("many") >= least, "many").when(F.col("shared") >= least, "few")
    return shared.select("id", smaller.alias("smaller"), (least - F.col("many")).alias("least"))


def few_pairs(met: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a class that is the smaller one by shingles of few classes with others that are as large or larger, met in its rarest ones."""
    few = met.where(F.col("holders") <= FEW).join(parts, "id").select("id", "component", "n", "hash", "holders", "smaller", "least")
    own = Window.partitionBy("id")
    ranked = few.where("smaller = 'few'").withColumns({"r": F.row_number().over(own.orderBy("holders", "hash")), "all": F.count(F.lit(1)).over(own)})
    sketches = sets.select("id", "sketch")
    x = ranked.where("r <= all - least + 1").select("id", "component", "n", "hash").join(sketches, "id").alias("x")
    y = few.select("id", "component", "n", "hash").join(sketches, "id").alias("y")
    c = F.col
    near = near_sketches(F.struct("x.n", "x.sketch"), F.struct("y.n", "y.sketch"))
    met_pairs = x.join(y, (c("x.hash") == c("y.hash")) & (c("x.component") != c("y.component")) & (c("x.n") <= c("y.n")) & near)
    return met_pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def cell_pairs(strong: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes in rows of which the smaller one is so by frequent shingles, that share as many cells as a link needs.

    The first cell that a pair has in common, in the order from rare to frequent, has all others after it for both: pairs meet
    only in cells after which enough are left for both.
    """
    x, y = rows.where("smaller = 'many'").alias("x"), rows.alias("y")
    c = F.col
    others = (c("x.component") != c("y.component")) & (c("x.n") <= c("y.n"))
    enough = F.least("x.left", "y.left") >= F.greatest("x.cells", "y.cells") - apart(c("x.n"), c("y.n"))
    near = near_sketches(F.struct("x.n", "x.sketch"), F.struct("y.n", "y.sketch"))
    met = x.join(y, (c("x.cell") == c("y.cell")) & others & enough & near)
    met = written(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), c("x.band").alias("band")).distinct(), "join-met")
    ids = met.select(c("a").alias("id"), "band").union(met.select(c("b").alias("id"), "band")).distinct()
    cells = strong.join(ids, ["id", "band"], "left_semi").groupBy("id", "band").agg(F.first("cells").alias("all"), F.collect_list("cell").alias("cells"))
    cells = written(cells.join(sets.select("id", "n"), "id"), "join-cells")
    of = lambda side: cells.select(c("id").alias(side), "band", *(c(x).alias(f"{x}_{side}") for x in ("n", "all", "cells")))
    both = met.join(of("a"), ["a", "band"]).join(of("b"), ["b", "band"])
    share = F.size(F.array_intersect("cells_a", "cells_b")) >= F.greatest("all_a", "all_b") - apart(c("n_a"), c("n_b"))
    return both.where(share).select("a", "b").distinct()


def rest_pairs(strong: DataFrame, comps: DataFrame, sets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Pairs of classes in different components that may be similar enough, all linked ones among them. rows: open_rows() of these, where they are known."""
    rows = open_rows(strong, comps, sets) if rows is None else rows
    met = met_shingles(rows, sets)
    parts = written(parts_taken(met), "join-roles")
    kinds = {r["smaller"] for r in parts.select("smaller").distinct().collect()}  # "few", "many" or null
    pairs = parts.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))
    if "few" in kinds:
        pairs = pairs.union(few_pairs(met, parts, sets))
    if "many" in kinds:
        pairs = pairs.union(cell_pairs(strong, written(rows.join(parts.select("id", "smaller"), "id"), "join-open"), sets))
    return pairs.distinct()


def part_count(members: DataFrame) -> int:
    """Tasks that bring cells together, so that none holds many more than PART_CELLS."""
    n, own = F.col("n_shingles"), F.col("own_cells")
    keys = own + F.coalesce("next_cells", F.lit(0)) + F.when(own * 4 <= n, 2 * n).otherwise(0)
    total = members.agg(F.sum(keys).alias("k")).first()["k"] or 0
    return max(4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_CELLS))


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id: one row for each row of docs."""
    members = written(named_sets(docs, text_col, id_col), "join-members")
    cells = ["n_shingles", "own_band", "own_cells", "next_cells"]
    classes = members.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least_doc"), *(F.first(c).alias(c) for c in cells))
    strong = written(strong_cells(shared_cells(docs, text_col, part_count(members)), classes), "join-strong")
    sets = written(sets_of(docs, text_col, written(strong.select("id").distinct(), "join-ids")), "join-sets")
    comps = joined(None, written(linked(star_pairs(strong), sets), "join-links"))
    rows = open_rows(strong, comps, sets)
    for turn in range(stars):
        if not rows.limit(1).count():
            break
        further = joined(comps, written(linked(proposed_pairs(rows, turn), sets), "join-links"))
        if further is comps:  # the same cells are open, and what a round didn't find is left to the rest
            break
        comps, rows = further, open_rows(strong, further, sets)
    if rows.limit(1).count():
        rest = written(rest_pairs(strong, comps, sets, rows), "join-pairs")
        if rest.limit(1).count():
            comps = joined(comps, written(linked(rest, sets), "join-links"))
    classes = classes.join(comps.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = classes.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    named = classes.join(least, "component").select(F.col("set_id").alias("s"), "component_id")
    out = members.join(named, (F.col("set_id") == F.col("s")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", "set_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, that of its least doc_id (a null id only if there is no other), with the columns of docs.

    Rows without words are components of their own: all stay.
    """
    away = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("_row", "_set", "_n")}
    plain = docs.withColumnsRenamed(away)
    found = jaccard_components(docs, text_col, id_col)
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("set_id"))
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("set_id")).alias("lone")]  # without any id each set stays
    best = found.where("n_shingles > 0").groupBy(*group).agg(F.min(name).alias("x"))
    kept = best.select(F.coalesce(F.col("x.doc_id").cast("string"), F.lit("null")).alias("_row"), F.col("x.set_id").alias("_set"))
    kept = kept.union(found.where("n_shingles = 0").select(row, "set_id").distinct())
    sets = T.StructType([T.StructField("_set", T.LongType())])
    named = map_texts(plain, text_col, sets, lambda: lambda texts: [pa.array([set_id(s) for s in shingle_sets(texts)], pa.int64())])
    named = named.withColumn("_row", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    rows = named.join(kept, ["_row", "_set"])
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_row", "_set").orderBy("_row"))).where("_n = 1 or _set = 0")
    return rows.select([F.col(f"`{c}`") for c in plain.columns]).withColumnsRenamed({v: k for k, v in away.items()})
