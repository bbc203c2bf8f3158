"""Quality rules: repetition coverage (operator 8).

Rolling hashes of several n-gram lengths measure the characters inside word n-grams and lines that
occur more than once in a text. One narrow stage over Arrow batches; nothing is shuffled.

The limits fall with the length: chance and phrases repeat short n-grams, so more of these are borne, while a long n-gram
that stands twice is copied text. As words in duplicated 10-grams are in duplicated 5-grams too, only limits that
fall let every length decide: a text with 25 % of its characters in copied passages of 10 words fails, one with as much in
scattered phrases of 5 doesn't.

Defined cases: empty and null texts have no words: all counts 0, all shares 0, base_failed and not kept. A text of any
length is measured whole. Rows that repeat and null ids pass through, each with its result; other columns pass unchanged, those
that are named as a result in any case are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import tokens
from tidemark.llm.frames import map_texts

#: Largest shares of a text's word characters inside duplicated n-grams, by n; the shortest as wide as the base rule.
DUPLICATE_NGRAMS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest share of word characters inside duplicated lines.
DUPLICATE_LINES = 0.3
#: Symbols a word above which a text is rejected; see n_symbols.
SYMBOLS_PER_WORD = 0.1
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8

ADDED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("dup_line_share", T.DoubleType())]
    + [T.StructField(f"dup_{n}gram_share", T.DoubleType()) for n in DUPLICATE_NGRAMS]
    + [T.StructField("failed_rules", T.StringType())]
)


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Whether each hash occurs at another place too."""
    order = np.argsort(hashes)
    s = hashes[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def later(hashes: np.ndarray) -> np.ndarray:
    """Whether each hash occurs at an earlier place too."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    out = np.zeros(len(s), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def covered(hashes: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """Words that stand in an n-word window occurring twice or more in their text, the first occurrence included."""
    out = np.zeros(len(hashes), bool)
    windows = tokens.window_hashes(hashes, n)
    if not len(windows):
        return out
    owner = tokens.owners(firsts)
    whole = owner[: len(windows)] == owner[n - 1 :]
    at = np.flatnonzero(whole)
    # The text's number goes into the hash, so one sort serves the whole batch.
    keys = tokens.mix(windows[at] ^ tokens.mix(owner[at].astype(np.uint64) + np.uint64(n)))
    hit = at[repeated(keys)]
    for j in range(n):
        out[hit + j] = True
    return out


def measure(texts: pa.Array) -> list[pa.Array]:
    """The columns of ADDED for a batch of texts."""
    data, bounds = tokens.raw(texts)
    starts, ends, firsts = tokens.words(data, bounds, tokens.SPACED)
    n_docs = len(texts)
    sums = tokens.prefix(data)
    hashes = tokens.span_hashes(sums, starts, ends)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    n_words = np.diff(firsts)
    word_chars = tokens.per_text(chars, firsts)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[data], out=marks[1:])
    n_symbols = marks[bounds[1:]] - marks[bounds[:-1]]

    # Lines: one more than the line feeds of each text.
    feeds = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable")
    line_end = np.sort(np.concatenate([feeds, bounds[1:]]), kind="stable")
    line_text = np.sort(np.concatenate([np.arange(n_docs), np.searchsorted(bounds, feeds, "right") - 1]), kind="stable")
    first_word, end_word = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = np.flatnonzero(end_word > first_word)
    keys = tokens.mix(tokens.span_hashes(sums, line_start[full], line_end[full]) ^ tokens.mix(line_text[full].astype(np.uint64)))
    dup = later(keys) if len(keys) else np.zeros(0, bool)
    n_dup_lines = np.bincount(line_text[full], dup, n_docs).astype(np.int64)
    running = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=running[1:])
    line_chars = (running[end_word] - running[first_word])[full]
    dup_line_chars = np.bincount(line_text[full], dup * line_chars, n_docs)

    n_repeat_words = tokens.per_text(covered(hashes, firsts, WINDOW), firsts)
    whole = np.maximum(word_chars, 1)
    shares = {n: tokens.per_text(covered(hashes, firsts, n) * chars, firsts) / whole for n in DUPLICATE_NGRAMS}
    line_share = dup_line_chars / whole
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > 30 * n_words)
    rules = [("base", base_failed), ("lines", line_share > DUPLICATE_LINES), ("symbols", n_symbols > SYMBOLS_PER_WORD * n_words)]
    rules += [(f"{n}grams", shares[n] > most) for n, most in DUPLICATE_NGRAMS.items()]
    failed = np.array([""] * n_docs, object)
    for name, bad in rules:
        for i in np.flatnonzero(bad):
            failed[i] += f",{name}" if failed[i] else name
    kept = np.array([not x for x in failed], bool)
    counts = [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words]
    return [*(pa.array(x.astype(np.int64)) for x in counts), pa.array(base_failed), pa.array(kept), pa.array(line_share), *(pa.array(x) for x in shares.values()), pa.array(failed, pa.string())]


def repetition_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs with the measures and the verdict of ADDED."""
    return map_texts(docs, text_col, ADDED, lambda: measure)
