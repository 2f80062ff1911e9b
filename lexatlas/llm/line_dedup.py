"""Substring dedup by sentence, line or paragraph hashing.

Every document is cut into pieces at its line ends and sentence ends; pieces are joined, from the first on, until they have
``min_words`` words together, and what is left at the end joins the unit before.  So every character belongs to one unit and no unit
is exempt; a text of fewer words is one unit.  A unit is normalised (lower case, white space collapsed) and hashed to
128 bits.  Digests are grouped over the whole corpus with map-side combine, the occurrence with the lowest
(doc_id, unit) is kept and all others are removed; spans of what is removed are offsets (code points, end
exclusive) of the original text, with the white space after a unit.
Texts are parsed once.  The few digests that make up a notable share of all units are looked up by a broadcast, so
that no task gets all occurrences of one; the others meet their first occurrence by a shuffle.

Cases: a null or empty text has no unit and keeps its (empty) text; a blank text stays; a null doc_id ranks last;
within a document a repeated unit is removed but for its first occurrence; rows equal in doc_id and text
count as one occurrence, so both are treated alike.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_by_id, parts, staged

#: Words of a unit at least, but for texts of fewer: chosen on sf0.01 among five lengths.
MIN_WORDS = 15
_END = {"sentence": re.compile(r"[.!?][ \t\n\r\f]+|\n[ \t\n\r\f]*"), "line": re.compile(r"\n[ \t\n\r\f]*"), "paragraph": re.compile(r"\n[ \t\r\f]*\n[ \t\n\r\f]*")}
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_LAST = (1 << 63) - 1


def split_units(text: str, unit: str = "sentence", min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, end) of the units, which cover the text; ``unit``: where pieces end (a sentence ends at its line's end too)."""
    out, start, at, words = [], 0, 0, 0
    for end in [*(m.end() for m in _END[unit].finditer(text)), len(text)]:
        if end > at:
            words += len(normalise(text[at:end]).split(" ")) if text[at:end].strip(" \t\n\r\f\v") else 0
            at = end
            if words >= min_words:
                out.append((start, end))
                start, words = end, 0
    if start < len(text):
        out.append((out.pop()[0] if out else 0, len(text)))
    return out


def normalise(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ").lower()


def _units(unit: str, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, rank_id, text in zip(pdf["row_key"], pdf["rank_id"], pdf["text"]):
                for k, (a, b) in enumerate(split_units(text, unit, min_words)):
                    norm = normalise(text[a:b])
                    if norm:
                        d = xxhash.xxh3_128_intdigest(norm.encode())
                        rows.append((key, rank_id, k, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
            yield pd.DataFrame(rows, columns=["row_key", "rank_id", "unit", "d1", "d2"])

    return run


def _apply(unit: str, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, gone in zip(pdf["doc_id"], pdf["text"], pdf["gone"]):
                text = text or ""
                spans = split_units(text, unit, min_words)
                drop = set() if gone is None else {int(k) for k in gone}
                kept = "".join(text[a:b] for k, (a, b) in enumerate(spans) if k not in drop)
                rows.append((doc_id, kept, len(spans), [{"start": a, "end": b} for k, (a, b) in enumerate(spans) if k in drop]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_units", "removed"])

    return run


def dedup(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text`` (what is kept), ``n_units, removed`` (spans of the original text) of every document."""
    spark = docs.sparkSession
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    docs = documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", rank.alias("rank_id"), F.xxhash64("doc_id", "text").alias("row_key"))
    source = docs.where("text is not null and text <> ''").select("row_key", "rank_id", "text")
    units = staged(source.mapInPandas(_units(unit, min_words), "row_key long, rank_id long, unit int, d1 long, d2 long"), "units")
    # one row for each digest that occurs again, combined before the shuffle
    first = units.groupBy("d1", "d2").agg(F.min(F.struct("rank_id", "unit")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = staged(first, "first")
    # a digest is hot beyond this share of the repeated units, so there are at most ``most`` hot ones, whatever the corpus
    most = 4 * parts(spark)
    limit = (first.agg(F.sum("n")).first()[0] or 0) // most
    hot, cold = (first.where(x).select("d1", "d2", "first") for x in (F.col("n") > limit, F.col("n") <= limit))
    again = (F.col("rank_id") != F.col("first.rank_id")) | (F.col("unit") != F.col("first.unit"))
    later = units.join(F.broadcast(hot), ["d1", "d2"]).where(again).select("rank_id", "row_key", "unit")
    rest = units.join(F.broadcast(hot), ["d1", "d2"], "left_anti").join(cold, ["d1", "d2"]).where(again).select("rank_id", "row_key", "unit")
    gone = later.union(rest).groupBy("rank_id", "row_key").agg(F.collect_set("unit").alias("gone"))  # at most a document's units
    out = docs.join(gone, ["rank_id", "row_key"], "left").select("doc_id", "text", "gone")
    return map_by_id(out, _apply(unit, min_words), "doc_id long, text string, n_units int, removed array<struct<start:int,end:int>>")
