"""Quality classifier: importance resampling with hashed n-gram models (operator 6).

Two generative models of hashed words and word pairs are counted: one of the target texts (labelled good
and not toxic), one of the raw text (all documents). A document's log weight is the sum, over its distinct n-grams, of
the log of target over raw probability, of either sign. Two things keep it from measuring length and noise: ratios are relative to the bulk
of the raw text (weighted median), so an n-gram of everyday text says nothing and a long text is worth no more than a
short one; and each is multiplied by the posterior probability that target and raw differ in it at all (a Poisson likelihood ratio
against prior odds), so that chance differences of rare n-grams fade while those with much evidence count in full.

Gumbel noise, drawn from a hash of the row, is added to log weight over temperature (1: as the weights say) and the k
largest keys are kept: a sample without replacement in proportion to the weights. k is `share` of all documents; by default the number that
rejection sampling would accept, with an envelope a little under the weight of everyday text.

The copies of a text count as one document together, else what thousands of copies say would pass for the use of its words.

The labels used are those of at most `max_labelled` documents (whole bins of a hash of doc_id); the raw model counts all
documents, and the copies of all texts are known: those of the MOST_COPIED texts with most copies by a broadcast, those of the others by a join, for which
the texts of these alone are shuffled. Four passes over the texts, all narrow but for that (copies, counts, keys,
results); else what is shuffled are hashes of texts and counts of at most BUCKETS buckets a task.
A text is read whole whatever its length.

Defined cases: empty and null texts have no n-grams: log weight 0, as everyday text. Documents with equal keys at rank k are all
kept. Repeated rows have the same key: all kept or none. Without any target label, or with target labels alone for all documents, all
weights are 0 and nothing is rejected. Labels that repeat count by their worst quality and toxicity; null labels count as
unlabelled. resample() replaces columns that are named as its results in any case, keep_quality() returns the columns of docs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import tokens
from tidemark.llm.frames import arrow_map, map_texts, pieces, without, written

#: Words and pairs are hashed into so many tables of SIZE buckets each; one counts with the log ratio nearest to 0 of its buckets, so that sharing a
#: bucket with a bad word doesn't harm it.
SIZE, WORD_TABLES, PAIR_TABLES = 1 << 18, 3, 2
BUCKETS = SIZE * (WORD_TABLES + PAIR_TABLES)
#: Repeated texts whose copies are told by a broadcast, longs of the bit field that finds the others, and the unit of counts.
MOST_COPIED, MOST_WORDS, UNIT = 500_000, 1 << 20, 1 << 20
#: Labelled documents that are used.
MAX_LABELLED = 200_000
#: Pseudo-count of the models, log odds against an n-gram being used differently in target and raw text, and the least log weight that counts in
#: full towards the size of the sample.
KAPPA, AGAINST, ENVELOPE = 0.5, 7.0, -2.0
TEMPERATURE = 1.0
ADDED = T.StructType([T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType()), T.StructField("text_hash", T.LongType())])
_U = np.uint64


def once(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers without repetitions inside a text: a text that repeats a word doesn't count it again."""
    keys = tokens.mix(hashes ^ tokens.mix(owner.astype(np.uint64)))
    first = np.unique(keys, return_index=True)[1]
    return hashes[first], owner[first]


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """By table, the buckets of the distinct words, then of the distinct pairs, of the texts of a batch; the words' and pairs' text numbers, and a hash of each text."""
    data, bounds = tokens.raw(texts)
    data = tokens.LOWER[data]
    starts, ends, firsts = tokens.words(data, bounds, tokens.SPACED)
    sums = tokens.prefix(data)
    words = tokens.span_hashes(sums, starts, ends)
    owner = tokens.owners(firsts)
    pairs = tokens.window_hashes(words, 2)
    whole = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    pairs, pair_owner = once(pairs[whole], owner[:-1][whole]) if len(pairs) else (pairs, owner[:0])
    words, owner = once(words, owner)
    tables = [(tokens.mix((words if k < WORD_TABLES else pairs) + _U(k)) % _U(SIZE)).astype(np.int64) for k in range(WORD_TABLES + PAIR_TABLES)]
    return tables, owner, pair_owner, tokens.span_hashes(sums, bounds[:-1], bounds[1:]).view(np.int64)


def copied(texts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """h, copies of the texts (h) that occur twice or more: of those that occur most often (whole bins of like counts, `most` texts at most), and of all others (None where there are none)."""
    many = written(texts.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "quality-copies")
    bin_of = F.floor(F.log2("copies") * 8).cast("int")
    taken, last, whole = 0, None, True
    for b, n in sorted(((r["bin"], r["n"]) for r in many.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):  # some hundred bins
        if taken + n > most:
            whole = False
            break
        taken, last = taken + n, b
    if whole:
        return many, None
    often = bin_of >= last if last is not None else F.lit(False)
    return many.where(often), many.where(~often)


def with_others(texts: DataFrame, others: DataFrame) -> DataFrame:
    """texts (h, copies, and more) with the copies of `others` (h, copies) too.

    Only texts whose hash may be among the others are shuffled: a bit field over their hashes, of at most MOST_WORDS longs, is broadcast.
    """
    shift = 64 - min(MOST_WORDS.bit_length() - 1, max(10, others.count().bit_length()))
    word, bit = F.shiftrightunsigned("h", shift), F.expr("shiftleft(1L, cast(h & 63 as int))")
    field = others.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("field"))
    marked = texts.withColumn("word", word).join(F.broadcast(field), "word", "left")
    maybe = F.col("copies").isNull() & (F.coalesce("field", F.lit(0)).bitwiseAND(bit) != 0)
    found = marked.where(maybe).select([c for c in texts.columns if c != "copies"]).join(others, "h", "left")
    return marked.where(~maybe).select(texts.columns).unionByName(found.select(texts.columns))


def counts(docs: DataFrame, text_col: str, target: DataFrame, id_col: str) -> DataFrame:
    """bucket, raw, good: n-grams of all documents and of the target's, in UNITs. The copies of one text count as one document together."""
    hashed = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("h"))
    often, others = copied(hashed.select("h"), MOST_COPIED)
    counted = hashed.join(F.broadcast(often), "h", "left")  # at most MOST_COPIED hashes
    if others is not None:
        counted = with_others(counted, others)
    flagged = counted.join(F.broadcast(target), F.col("doc") == F.col("target_id"), "left")  # at most max_labelled ids
    weight = F.round(F.lit(float(UNIT)) / F.coalesce("copies", F.lit(1))).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece, texts in pieces(batch, 0):
                tables, owner, pair_owner, _ = features(texts)
                weights = np.asarray(piece.column(1)).astype(float)
                of_target = weights * np.asarray(piece.column(2).is_valid())
                for k, buckets in enumerate(tables):
                    of, mine = pair_owner if k >= WORD_TABLES else owner, slice(k * SIZE, (k + 1) * SIZE)
                    raw[mine] += np.bincount(buckets, weights[of], SIZE).astype(np.int64)
                    good[mine] += np.bincount(buckets, of_target[of], SIZE).astype(np.int64)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(good[part])], names=["bucket", "raw", "good"])

    each = arrow_map(flagged.select("text", weight.alias("weight"), "target_id"), run, "bucket long, raw long, good long")
    return each.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "good")))


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of counts by bucket the log of target over raw probability, relative to the bulk, times the probability that they differ.

    The bulk's ratio in each table is the median over its raw n-grams; where most have none in the target, the mean.
    """
    out = np.zeros(BUCKETS)
    for table in range(WORD_TABLES + PAIR_TABLES):
        mine = slice(table * SIZE, (table + 1) * SIZE)
        n, g = raw[mine] / UNIT, good[mine] / UNIT
        if not g.sum():
            continue
        order = np.argsort(ratio := np.divide(g, n, out=np.zeros(len(n)), where=n > 0))
        middle = ratio[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
        expected = n * (middle or g.sum() / n.sum())
        evidence = expected - g + np.where(g > 0, g * np.log(np.where(g > 0, g, 1) / np.where(n > 0, expected, 1)), 0.0)
        out[mine] = np.log((g + KAPPA) / (expected + KAPPA)) / (1 + np.exp(np.minimum(AGAINST - evidence, 700)))
    return out


def target_ids(labels: DataFrame, max_labelled: int, bins: int = 1 << 12) -> DataFrame:
    """target_id: documents labelled good and not toxic, among at most max_labelled labelled ones, taken in whole bins by hash."""
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    judged = judged.withColumn("bin", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - (bins.bit_length() - 1)))
    taken, last = 0, -1
    for b, n in sorted((r["bin"], r["n"]) for r in judged.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()):  # at most `bins` rows
        if taken + n > max_labelled:
            break
        taken, last = taken + n, b
    return judged.where((F.col("bin") <= last) & (F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").alias("target_id"))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """The log ratio of every bucket. The driver gets the packed counts of BUCKETS buckets at most, whatever the table holds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([np.asarray(c) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], names=["counts"])

    found = counts(docs, text_col, target_ids(labels, max_labelled), id_col)
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row in arrow_map(found, pack, "counts binary").collect():
        bucket, n, g = np.frombuffer(zlib.decompress(row["counts"]), np.int64).reshape(3, -1)
        raw[bucket], good[bucket] = n, g
    return log_ratios(raw, good)


def weigh(docs: DataFrame, shared: Broadcast, text_col: str = "text") -> DataFrame:
    """Every row of docs with log_weight, n_grams, and the hash that its Gumbel noise is drawn from. shared: what fit() found."""

    def make():
        value = shared.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            tables, owner, pair_owner, own = features(texts)
            n = len(texts)
            weight = np.zeros(n)
            for of, first, last in ((owner, 0, WORD_TABLES), (pair_owner, WORD_TABLES, WORD_TABLES + PAIR_TABLES)):
                each = np.stack([value[k * SIZE + tables[k]] for k in range(first, last)])
                weight += np.bincount(of, each[np.abs(each).argmin(0), np.arange(len(of))], n)
            grams = np.bincount(owner, minlength=n) + np.bincount(pair_owner, minlength=n)
            return [pa.array(weight), pa.array(grams.astype(np.int64)), pa.array(own)]

        return compute

    return map_texts(docs, text_col, ADDED, make)


def gumbel_key(id_col: str, temperature: float, seed: int):
    """log_weight / temperature plus Gumbel noise from a hash of id, text and seed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col("text_hash"), F.lit(seed)), 12)
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.col("log_weight") / F.lit(temperature) - F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 20_000) -> float:
    """The k-th largest value of the column key, found by counting in ever finer bins."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    inside, above = keys, 0
    while True:
        if n <= few or high <= low:
            return inside.orderBy(F.desc("key")).select("key").offset(k - above - 1).limit(1).first()[0]
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        bin_of = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        found = sorted(((r[0], r[1], r[2], r[3]) for r in inside.groupBy(bin_of.alias("bin")).agg(F.count("key"), F.min("key"), F.max("key")).collect()), reverse=True)
        for _, n, least, most in found:  # noqa: B007
            if above + n >= k:
                break
            above += n
        low, high = least, most
        inside = keys.where(F.col("key").between(low, high))


def sample_size(weights: DataFrame, share: float | None) -> int:
    """share of the rows; by default what rejection sampling with the envelope exp(ENVELOPE) would accept, the sum of min(1, weight / envelope)."""
    n, whole = weights.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.exp(F.least(F.col("log_weight") - ENVELOPE, F.lit(0.0)))), F.lit(0.0))).first()
    return round(whole if share is None else n * share)


def resample(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", temperature: float = TEMPERATURE, share: float | None = None, seed: int = 7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Every row of docs with log_weight, n_grams, gumbel_key and kept."""
    ratios = fit(docs, labels, text_col, id_col, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    plain = without(docs, "gumbel_key", "kept")
    scored = weigh(plain, shared, text_col).withColumn("gumbel_key", gumbel_key(id_col, temperature, seed))
    slim = weigh(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), shared, text_col)
    keys = written(slim.select("log_weight", gumbel_key(id_col, temperature, seed).alias("key")), "quality-keys")
    least = kth_largest(keys, sample_size(keys, share))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(least)).drop("text_hash")


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the sample takes, with the columns of docs."""
    names = ["log_weight", "n_grams", "text_hash", "gumbel_key", "kept"]
    away = {c: f"_doc_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in names}
    back = {v: k for k, v in away.items()}
    found = resample(docs.withColumnsRenamed(away), labels).where("kept")
    return without(found, *names).withColumnsRenamed(back).select([F.col(f"`{c}`") for c in docs.columns])
