"""Source divergence audit: how far each source's terms are from its language and from its other sources (operator 12).

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. A language keeps the terms that stand in at least
`least_docs` of its documents. A group (language and source, or the language as a whole) with N occurrences of the V kept
terms gives a term that occurs count times p = 1 + floor(1e9 * (count + 1) / (N + V)); f(p, q) = floor((p - q)**2 / q) is
how far p is from q. All of it is integers, so results don't depend on order or layout.

1. Counting. Each task counts the terms of its documents by group in Arrow and numpy and hands on one row a group and term, so a
   common term is no hot group; one shuffle by language and term then gives counts, document frequencies and what is kept.
2. Pairs. The sum of f over all kept terms of two sources would ask for V terms each. Instead every pair begins at the baseline,
   V times f of the two p of an absent term. Terms in one of both correct it by their p alone, so these come from the histogram of p in a
   group. Only terms that both have are joined, once for both directions, and correct what the two histograms said of them.
3. Ranking. Of a group's terms the `most` with the largest f are selected by radix: histograms over value bits, from the highest, give the
   digit in which the group's last wanted value lies, and only rows in that digit are looked at again, until at most
   `settle` rows of the group are there. Where more have the very same value, histograms over the bytes of the terms go on. What
   is left, under most + settle rows a group, is ranked by a window.

Memory: a task holds PARTIAL rows of counts and a piece of text; a longer text is counted in parts. Histograms have at most 2**15 digits (2**16 by
bytes) a group. Nothing reaches the driver but whether a refinement is over.

Defined cases: null text, language and source are ''; repeated rows are documents of their own; a source without kept terms has
the p of absent terms for all; a language without kept terms has pairs of value 0 and no terms; ties are ordered by the UTF-8 bytes of
the item; texts of any length count whole; other columns aren't used. An empty table has an empty result. A count beyond a
decimal of 20 digits and sums beyond a long are errors (ANSI mode), not wrong numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.frames import arrow_map, pieces, written

LEAST_DOCS, MOST, UNIT = 3, 200, 1_000_000_000
#: Bytes that terms consist of, after A-Z are in lower case.
TERM = np.zeros(256, bool)
TERM[0x61:0x7B] = TERM[0x80:] = True
#: Bytes of text that are counted at once, and rows of counts that a task holds.
PIECE, PARTIAL = 2 << 20, 400_000
#: Value bits of a digit and of a value, bytes of a digit of a term, and rows of a group that need no further histogram.
DIGIT, VALUE, DIGIT_BYTES, SETTLE = 15, 60, 2, 4096


def _codes(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts, each occurrence's number among these, and the texts' first occurrences."""
    data = tokens.LOWER[data]
    starts, ends, firsts = tokens.words(data, bounds, TERM)
    held = np.ascontiguousarray(data[TERM[data]])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(held)).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), firsts


def _parts(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """One text in parts of about `most` bytes that begin at no byte of a term."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and TERM[tokens.LOWER[data[end]]]:
            end += 1
        yield data[at:end]
        at = end


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["g", "term", "n", "docs"])


def _table(groups: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    return pa.table([pa.array(groups), terms, pa.array(n), pa.array(docs)], names=["g", "term", "n", "docs"])


def _counted(texts: pa.Array, groups: np.ndarray) -> pa.Table:
    """g, term, n, docs of the texts, whose groups are numbers."""
    data, bounds = tokens.raw(texts)
    if len(texts) == 1 and len(data) > 2 * PIECE:
        held: list[pa.Table] = []
        for part in _parts(data, PIECE):
            terms, codes, _ = _codes(part, np.array([0, len(part)]))
            held.append(_table(np.zeros(len(terms), np.int64), terms, np.bincount(codes, minlength=len(terms)), np.zeros(len(terms), np.int64)))
            if sum(t.num_rows for t in held) > PARTIAL:
                held = [_summed(held)]
        one = _summed(held)
        ones = np.ones(one.num_rows, np.int64)
        return _table(ones * groups[0], one.column("term").combine_chunks(), one.column("n").to_numpy(), ones)
    terms, codes, firsts = _codes(data, bounds)
    by_text, counts = np.unique(tokens.owners(firsts) * max(1, len(terms)) + codes, return_counts=True)
    text, code = np.divmod(by_text, max(1, len(terms)))
    by_group, at = np.unique(groups[text] * max(1, len(terms)) + code, return_inverse=True)
    g, code = np.divmod(by_group, max(1, len(terms)))
    return _table(g, terms.take(pa.array(code)), np.bincount(at, counts, len(g)).astype(np.int64), np.bincount(at, minlength=len(g)))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): partial counts of a narrow stage, to be summed."""
    blank = F.lit("")
    rows = docs.select(F.coalesce(lang_col, blank).alias("lang"), F.coalesce(source_col, blank).alias("source"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(known)
            lang, source = (pa.array([g[i] for g in names], pa.string()).take(table.column("g").combine_chunks()) for i in (0, 1))
            yield from pa.table([lang, source, table.column("term").cast(pa.string()), table.column("n"), table.column("docs")], names=["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=50_000)

        for batch in batches:
            for piece, texts in pieces(batch, 2, PIECE):
                groups = np.array([known.setdefault(g, len(known)) for g in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)], np.int64)
                held.append(_counted(texts, groups))
                if sum(t.num_rows for t in held) > PARTIAL:
                    held = [_summed(held)]
                    if held[0].num_rows > PARTIAL // 2:
                        yield from out(held[0])
                        held = []
        if held:
            yield from out(_summed(held))

    return arrow_map(rows, count, "lang string, source string, term string, n long, docs long")


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term that occurs count times in a group of n occurrences of v terms; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(v > 0, 1 + F.call_function("div", wide(F.lit(UNIT)) * wide(count + 1), wide(n + v)))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit_tables(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(terms, groups), written.

    terms: lang, source, term, p, absent (the group's p of a term that it lacks), q (the language's p), for the kept terms that occur in the group.
    groups: lang, source, v (kept terms of the language), absent, for every group that occurs.
    """
    counts = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("in_docs"), (F.min("source").over(term) == F.col("source")).cast("long").alias("first"))
    kept = written(kept.where(F.col("in_docs") >= least_docs).drop("in_docs"), "terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first").alias("v"))
    langs = sizes.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("v").alias("v"))
    blank, none = F.lit(""), F.lit(0).cast("long")
    all_groups = docs.select(F.coalesce(lang_col, blank).alias("lang"), F.coalesce(source_col, blank).alias("source")).distinct()
    groups = all_groups.join(sizes.drop("v"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("size", none).alias("size"), F.coalesce("lang_size", none).alias("lang_size"), F.coalesce("v", none).alias("v"))
    groups = written(groups.withColumn("absent", share(none, F.col("size"), F.col("v"))), "groups")
    p, q = share(F.col("n"), F.col("size"), F.col("v")), share(F.col("lang_n"), F.col("lang_size"), F.col("v"))
    terms = written(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), "absent", q.alias("q")), "shares")
    return terms, groups.select("lang", "source", "v", "absent")


def pair_divergence(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for any two sources of a language, the distance of `source` from `item` over all kept terms."""
    c = F.col
    a, b = groups.toDF("lang", "source", "v", "a0"), groups.select("lang", c("source").alias("item"), c("absent").alias("b0"))
    base = a.join(b, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(c("v") * distance(c("a0"), c("b0")), F.lit(0)).alias("there"), F.lit(0).cast("long").alias("back"))
    shares = terms.groupBy("lang", "source", "p", c("absent").alias("a0")).agg(F.count("*").alias("n"))
    alone = shares.join(b, "lang").where("source <> item").select(
        "lang", "source", "item", (c("n") * (distance(c("p"), c("b0")) - distance(c("a0"), c("b0")))).alias("there"), (c("n") * (distance(c("b0"), c("p")) - distance(c("b0"), c("a0")))).alias("back"),
    )
    one = terms.select("lang", "term", "source", c("p"), c("absent").alias("a0"))
    other = terms.select("lang", "term", c("source").alias("item"), c("p").alias("r"), c("absent").alias("b0"))
    both = lambda p, p0, r, r0: distance(p, r) - distance(p, r0) - distance(p0, r) + distance(p0, r0)
    shared = one.join(other, ["lang", "term"]).where("source < item").select("lang", "source", "item", both(c("p"), c("a0"), c("r"), c("b0")).alias("there"), both(c("r"), c("b0"), c("p"), c("a0")).alias("back"))
    sums = lambda df: df.groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    parts = base.unionByName(sums(alone)).unionByName(sums(shared))
    ways = F.array(F.struct("source", "item", c("there").alias("value")), F.struct(c("item").alias("source"), c("source").alias("item"), c("back").alias("value")))
    return parts.select("lang", F.inline(ways)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _chosen(counted: DataFrame, keys: list[str], falling: bool) -> DataFrame:
    """Of a histogram (keys, digit, n, need): the digit of each group in which its need-th row lies, and what is needed of that digit."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("digit") if falling else F.asc("digit")).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).withColumn("need", F.col("need") - F.col("upto") + F.col("n")).drop("upto")


def select_top(rows: DataFrame, keys: list[str], value: str, item: str, most: int = MOST, settle: int = SETTLE) -> DataFrame:
    """The rows with their rank (int, from 1) by falling value (0 to 2**60 - 1) and rising bytes of item, for ranks up to `most` of every group of `keys`.

    Keys must not be null. Rows that are equal in all of these are ranked in any order.
    """
    v, shift = F.col(value), VALUE - DIGIT
    first = rows.groupBy(*keys, F.shiftright(v, shift).alias("digit")).agg(F.count("*").alias("n"))
    first = first.withColumn("need", F.least(F.lit(most), F.sum("n").over(Window.partitionBy(*keys))))
    state = written(_chosen(first, keys, True).withColumnRenamed("digit", "prefix"), "radix")
    while shift and state.where(F.col("n") > settle).limit(1).count():
        shift -= DIGIT
        within = rows.join(state.drop("n"), keys).where(F.shiftright(v, shift + DIGIT) == F.col("prefix"))
        counted = within.groupBy(*keys, "prefix", "need", F.shiftright(v, shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.count("*").alias("n"))
        state = written(_chosen(counted, keys, True).withColumn("prefix", F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit"))).drop("digit"), "radix")
    state, at = state.withColumn("start", F.lit(b"")).withColumn("open", F.col("n") > settle), F.length("start")
    text = F.col(item).cast("binary")
    while state.where("open").limit(1).count():
        tied = rows.join(state.where("open").drop("n", "open"), keys).where((v == F.col("prefix")) & (F.substring(text, F.lit(1), at) == F.col("start")))
        counted = tied.groupBy(*keys, "prefix", "need", "start", F.substring(text, at + 1, F.lit(DIGIT_BYTES)).alias("digit")).agg(F.count("*").alias("n"))
        further = _chosen(counted, keys, False).withColumn("start", F.concat("start", "digit"))
        further = further.withColumn("open", (F.col("n") > settle) & (F.length("digit") == DIGIT_BYTES)).drop("digit")
        state = written(state.where("not open").unionByName(further), "radix")
    digit, before = F.shiftright(v, shift), F.substring(text, F.lit(1), at)
    candidates = rows.join(state.select(*keys, "prefix", "start"), keys).where((digit > F.col("prefix")) | (digit == F.col("prefix")) & (before <= F.col("start")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(text)))
    return candidates.drop("prefix", "start").withColumn("rank", rank).where(F.col("rank") <= most)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, most: int = MOST, settle: int = SETTLE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all other sources, and the `most` terms that a source has more of than its language."""
    terms, groups = audit_tables(docs, text_col, lang_col, source_col, least_docs)
    pairs = pair_divergence(terms, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    above = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    top = select_top(above, ["lang", "source"], "value", "item", most, settle)
    return pairs.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
