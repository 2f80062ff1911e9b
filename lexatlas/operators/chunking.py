"""Chunkers and n-gram analysers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "clean_text", size: int = 180, overlap: int = 50, min_words: int = 40, stop_early: bool = True) -> DataFrame:
    """Sliding word windows of single-spaced texts, with exact character offsets.

    A window that reaches the last word ends the document unless ``stop_early`` is off; windows of fewer than ``min_words`` are skipped.
    Null and empty texts have none.  All windows of a text are cut within its row, each from the lengths of the steps before it, so the
    work grows with the text and its words aren't copied to every window.
    """
    step = max(1, size - overlap)
    w = docs.select(id_col, F.explode(bound(tokens(F.col(text_col)), lambda tk: windows_of(tk, size, overlap, min_words, stop_early))).alias("w")).select(id_col, "w.*")
    return w.select(id_col, (F.col("word_start") / step).cast("int").alias("chunk_index"), "word_start", "word_end", (F.col("word_end") - F.col("word_start")).alias("word_count"), "start_char", "chunk_text", (F.col("start_char") + F.length("chunk_text")).alias("end_char"))


def tokens(text: Column) -> Column:
    return F.split(F.trim(F.coalesce(text, F.lit(""))), " ")


def windows_of(tk: Column, size: int = 180, overlap: int = 50, min_words: int = 40, stop_early: bool = True) -> Column:
    """``windows`` of a text's tokens, a variable of ``bound``, as an array of structs (word_start, word_end, start_char, chunk_text)."""
    step = max(1, size - overlap)
    n = F.size(tk)
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    lengths = F.transform(starts, lambda a: F.length(F.array_join(F.slice(tk, a + 1, F.lit(step)), " ")) + 1)

    def keep(a: Column) -> Column:
        enough = (F.element_at(tk, 1) != "") & (F.least(a + size, n) - a >= min_words)
        return enough & ((a == 0) | (a - step + size < n)) if stop_early else enough

    def window(before: Callable[[Column], Column], a: Column) -> Column:
        end = F.least(a + size, n)
        return F.struct(a.alias("word_start"), end.alias("word_end"), before((a / step).cast("int")).alias("start_char"), F.array_join(F.slice(tk, a + 1, end - a), " ").alias("chunk_text"))

    return _with_prefix_sums(lengths, lambda before: F.transform(F.filter(starts, keep), lambda a: window(before, a)))


def _with_prefix_sums(values: Column, use: Callable[[Callable[[Column], Column]], Column], block: int = 64) -> Column:
    """``use(before)``, where before(i) is the sum of the first i values; sums of blocks keep it short for long arrays."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def within(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(block)), lambda b: total(F.slice(v, b, F.lit(block))))
        return bound(sums, lambda c: use(lambda i: total(F.slice(c, F.lit(1), (i / block).cast("int"))) + total(F.slice(v, (i / block).cast("int") * block + 1, i % block))))

    return bound(values, within)


def chunk_table(docs: DataFrame, size: int = 300, overlap: int = 150, min_words: int = 60) -> DataFrame:
    """Chunks with their ids and the parameters that made them."""
    w = windows(docs, size=size, overlap=overlap, min_words=min_words)
    return w.select(F.format_string("%s_c%04d", T.file_stem(F.col("doc_id").cast("string")), "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "chunk_text", "start_char", "end_char", "word_start", "word_end", "word_count", F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"), F.lit(min_words).alias("min_words"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once: as a lambda variable it isn't repeated for every element inside ``f``."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def _runs(items: Column, size: Column, n: int, take: Callable[[Column, Column], Column]) -> Column:
    """``take(items, i)`` for every place i where a run of n fits."""
    places = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
    return F.when(size >= n, F.transform(places, lambda i: take(items, i))).otherwise(F.array().cast("array<string>"))


def word_ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All word n-grams of an array of words, joined by a space."""
    if high == 1:
        return words

    def of(n: int, w: Column) -> Column:
        return _runs(w, F.size(w), n, lambda x, i: F.array_join(F.slice(x, i, n), " "))

    return bound(words, lambda w: F.concat(*(of(n, w) for n in range(low, high + 1))))


def char_ngrams_in_words(words: Column, low: int = 5, high: int = 7) -> Column:
    """Character n-grams within words padded by a space; a word no longer than n gives itself once."""

    def of(n: int, p: Column) -> Column:
        return _runs(p, F.length(p), n, lambda x, i: F.substring(x, i, F.lit(n)))

    def grams(p: Column) -> Column:
        return F.when(F.length(p) <= low, F.array(p)).otherwise(F.concat(*(of(n, p) for n in range(low, high + 1))))

    return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), lambda p: grams(p)))


def trigram_set(text: Column) -> Column:
    return bound(F.lower(text), lambda low: F.array_distinct(_runs(low, F.length(low), 3, lambda x, i: F.substring(x, i, F.lit(3)))))


def char_windows(docs: DataFrame, id_col: str, text_col: str, window: int = 800, stride: int = 400) -> DataFrame:
    """Windows at every ``stride`` characters; the tail after the last whole window may stay uncovered."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text_col) - window), F.lit(stride))
    return docs.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(starts).alias("start")).select(id_col, "start", F.least(F.col("start") + window, F.length(text_col)).alias("end"), F.substring(text_col, F.col("start") + 1, F.lit(window)).alias("part"))


def hashed(gram: Column, buckets: int = 1 << 20) -> Column:
    """Bucket of a feature; the same in any engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long"), F.lit(buckets))
