"""Text normalisers and scalar string functions, as column expressions.

Null texts count as empty.  Only Unicode composition needs Python (``nfkc``, an Arrow function that leaves
plain ASCII to the JVM).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The stopwords of the lexical branches.
STOPWORDS = ("a", "an", "the", "and", "or", "but", "if", "while", "is", "are", "was", "were", "be", "been", "being", "of", "to", "in", "on", "for", "with", "as", "by", "this", "that", "these", "those", "it", "its")


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    beyond = F.when(text.rlike(r"[^\x00-\x7F]"), text)  # a Python function runs on every row, whatever stands around it: send nulls
    return F.coalesce(_compose(beyond), text)


def _folded(text: Column, compose: bool) -> Column:
    filled = F.coalesce(text, F.lit(""))
    return nfkc(filled) if compose else filled


def clean(text: Column, compose: bool = True) -> Column:
    """Readable text: straight quotes and dashes, no headings or rules, words rejoined, spacing regular."""
    t = _folded(F.translate(text, "\x00", " "), compose)
    t = F.translate(t, "“”‘’–—", "\"\"''--")
    for pattern, put in (
        (r"(?s)\[Illustrated:.*?\]", " "),
        (r"(?iU)\bCHAPTER\s+[IVXLCDM]+\b", " "),
        (r"[-=_]{3,}", " "),
        (r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])", "$1$2"),
        (r"\s+", " "),
        (r"\s+([.,;:!?])", "$1"),
        (r"([.,;:!?])([A-Za-z])", "$1 $2"),
        ("﻿", ""),
    ):
        t = F.regexp_replace(t, pattern, put)
    return F.trim(t)


def lexical(text: Column, compose: bool = True) -> Column:
    """Lower-case words for the lexical branches: letters a-z, numbers as NUM, stopwords dropped."""
    t = F.lower(_folded(text, compose))
    for pattern, put in ((r"[^a-z0-9\s]", " "), (r"[0-9]+", " NUM "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, put)
    words = F.filter(F.split(F.trim(t), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return F.array_join(words, " ")


def for_embedding(text: Column, compose: bool = True) -> Column:
    return F.trim(F.regexp_replace(F.translate(_folded(text, compose), "\x00", " "), r"\s+", " "))


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    return F.floor(word_count(text) * F.lit(13) / F.lit(10)).cast("int")


def safe_id(path: Column) -> Column:
    return F.translate(F.replace(F.replace(path, F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("__")), " ", "_")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def base_name(doc_id: Column) -> Column:
    """The part after ``__``, or all of it."""
    return F.coalesce(F.try_element_at(F.split(doc_id, "__"), F.lit(2)), doc_id)


def document_number(doc_id: Column) -> Column:
    return F.regexp_extract(doc_id, r"document[^0-9]*([0-9]+)[^0-9]*$", 1).try_cast("int")


def substring(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], 0-based and half-open."""
    return F.substring(text, start + 1, end - start)


def find(text: Column, needle: Column) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.locate(needle, text) - 1 if isinstance(needle, str) else F.instr(text, needle) - 1


def snippet(text: Column, side: int = 200) -> Column:
    """Both ends of a long text."""
    return F.when(F.length(text) > 2 * side, F.concat(F.left(text, F.lit(side)), F.lit("[...omitted...]"), F.right(text, F.lit(side)))).otherwise(text)


def html_escape(text: Column) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, put in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(put))
    return t


def highlight(text: Column, spans: Column, most: int = 8000) -> Column:
    """The first ``most`` characters, escaped, with merged spans (array of start, end, ascending) in mark tags."""
    shown = F.left(text, F.lit(most))

    def step(acc: Column, s: Column) -> Column:
        a, b = F.least(s["start"], F.lit(most)), F.least(s["end"], F.lit(most))
        piece = F.concat(acc["out"], html_escape(substring(shown, acc["at"], a)), F.lit("<mark>"), html_escape(substring(shown, a, b)), F.lit("</mark>"))
        return F.struct(F.greatest(b, acc["at"]).cast("int").alias("at"), F.when(b > a, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], html_escape(substring(shown, acc["at"], F.length(shown)))))


def model_json(answer: Column, schema: str = "score double, is_likely_source boolean, reasoning string") -> Column:
    """The JSON object within a model's answer; stray backslashes are repaired first."""
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.from_json(F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\"), schema)
