"""Secret scans, built from DataFrame functions only.

Base patterns (assignments, access keys, hexadecimal runs) are found leftmost and non-overlapping.  The
method adds candidate strings whose Shannon entropy, over a window that slides along the string, reaches
the threshold of the string's character class.  Counts are kept incrementally: each step adds one character
and takes one off, and the sum of c * log2(c) follows both.  Strings on the allow list (letters of one case or
digits only, UUIDs, dates and times, paths, file names and dashed words whose words are of ordinary length)
are suppressed.  Folds run in blocks, so the time grows with the length of a text or string, not its square.

Cases: null texts are empty and have no spans; spans are in code points, end exclusive; an added span
that overlaps a base span is left out, base spans always stay; repeated rows are scanned each; a null
doc_id is kept.  Texts of any length are scanned whole, an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import bound
from .common import documents

#: The base patterns, with the least length of what must be long enough.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings: runs of at least WINDOW token characters with letters and digits, or letters of both cases.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy in bits of a window, by class of character.
LEAST_BITS = {"hex": 3.0, "letters": 4.0, "alnum": 3.6, "base64": 3.7}
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[A-Za-z0-9_-]*$",  # dates
    r"^(.)\1*$",
)
#: Parts of paths, slugs and dashed words: a word in one case or with a capital, and a short number.
WORD = r"^(([a-z]{1,16}|[A-Z]{1,16}|[A-Z][a-z]{1,15})[0-9]{0,4}|[0-9]{1,4}|)$"
#: Elements of a fold whose result is an array, and places of a string, that are taken at a time.
BLOCK = 256
#: Code points of the parts that a text is cut into before spans are taken out.
PART = 1024


def _running(rows: Column, kind: str, step, first: int = 0, block: int = BLOCK) -> Column:
    """Items (of SQL type ``kind``) of a fold that carries a number, ``first`` to begin with: step(at, x) gives the next number and the item.

    An array that grows by one element is copied each time, so items are gathered a block at a time.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, x: Column) -> Column:
        at, item = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    def whole(r: Column) -> Column:
        def outer(acc: Column, place: Column) -> Column:
            at = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(first))
            return F.concat(acc, F.array(F.aggregate(F.slice(r, place, F.lit(block)), F.struct(at.alias("at"), none.alias("out")), inner)))

        places = F.sequence(F.lit(1), F.greatest(F.size(r), F.lit(1)), F.lit(block))
        return F.flatten(F.transform(F.aggregate(places, F.array().cast(f"array<struct<at:int,out:array<{kind}>>>"), outer), lambda d: d["out"]))

    return bound(rows, whole)


_HIT = "struct<start:int,end:int,hit:string,value:int>"


def _spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Array of (start, end, hit) of leftmost matches: the text between matches gives their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = bound(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"), value.alias("values")), lambda r: F.arrays_zip(F.slice(r["gaps"], 1, F.size(r["hits"])).alias("gap"), r["hits"].alias("hit"), r["values"].alias("value")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.length(x["value"]).alias("value"))

    found = _running(rows, _HIT, step)
    found = F.filter(found, lambda x: x["value"] >= least) if least else found
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_HIT}>"))


def _rise(c: Column) -> Column:
    """What c * log2(c) gains when a count goes from ``c`` to ``c`` + 1; c under WINDOW."""
    gains = [(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(WINDOW)]
    return F.element_at(F.array(*map(F.lit, gains)), c + 1)


#: Counts are bytes of longs: eight characters of the token alphabet, which begins at "+", in each.
_BASE, _LONGS = ord("+"), 10


def window_entropy(s: Column, block: int = BLOCK) -> Column:
    """Largest Shannon entropy (bits a character) of any WINDOW consecutive characters of ``s``, a run of token characters.

    State of the fold: a count of each character, the sum of c * log2(c), and the least sum seen over a full
    window.  The entropy of a window of w characters is log2(w) - sum / w.  A long string is cut into blocks that
    overlap by a window less one, so that every window lies within a block.
    """

    def place(x: Column) -> Column:
        code = F.ascii(x) - _BASE
        bits = code.bitwiseAND(F.lit(7)) * 8
        return F.struct(F.shiftright(code, 3).alias("long"), bits.alias("bits"), F.call_function("shiftleft", F.lit(1).cast("long"), bits).alias("one"))

    def count(counts: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.element_at(counts, x["long"] + 1), x["bits"]).bitwiseAND(F.lit(255).cast("long")).cast("int")

    def lowest(at: Column) -> Column:
        def grow(acc: Column, i: Column) -> Column:
            return moved(acc, F.element_at(at, i), None)

        def slide(acc: Column, i: Column) -> Column:
            return moved(acc, F.element_at(at, i), F.element_at(at, i - WINDOW))

        def moved(acc: Column, new: Column, old: Column | None) -> Column:
            gain = _rise(count(acc["counts"], new))
            if old is None:
                counts = F.transform(acc["counts"], lambda c, k: F.when(k == new["long"], c + new["one"]).otherwise(c))
                return F.struct(counts.alias("counts"), (acc["total"] + gain).alias("total"), acc["low"].alias("low"))
            total = acc["total"] + gain - _rise(count(acc["counts"], old) - 1)
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == new["long"], new["one"]).otherwise(0) - F.when(k == old["long"], old["one"]).otherwise(0))
            changed = F.struct(counts.alias("counts"), total.alias("total"), F.least(acc["low"], total).alias("low"))
            return F.when((new["long"] == old["long"]) & (new["bits"] == old["bits"]), acc).otherwise(changed)

        empty = F.struct(F.array_repeat(F.lit(0).cast("long"), _LONGS).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("low"))
        full = F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW)), empty, grow, lambda acc: F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"), acc["total"].alias("low")))
        rest = F.when(F.size(at) > WINDOW, F.sequence(F.lit(WINDOW + 1), F.size(at))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rest, full, slide, lambda acc: acc["low"])

    def whole(at: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(at) - (WINDOW - 1), F.lit(1)), F.lit(block))
        lows = F.transform(places, lambda p: bound(F.slice(at, p, F.lit(block + WINDOW - 1)), lowest))
        return F.log2(F.lit(float(WINDOW))) - F.array_min(lows) / WINDOW

    return F.when(F.length(s) >= WINDOW, bound(F.transform(F.split(s, ""), place), whole)).otherwise(0.0)


def _suspicious(s: Column) -> Column:
    allowed = F.forall(F.split(s, "[/_=-]+"), lambda x: x.rlike(WORD))
    for p in ALLOWED:
        allowed = allowed | s.rlike(p)
    mixed = s.rlike("[A-Za-z]") & s.rlike("[0-9]") | s.rlike("[a-z]") & s.rlike("[A-Z]")
    least = F.when(s.rlike("^[0-9a-fA-F]+$"), LEAST_BITS["hex"]).when(s.rlike("^[A-Za-z]+$"), LEAST_BITS["letters"]).when(s.rlike("^[A-Za-z0-9]+$"), LEAST_BITS["alnum"]).otherwise(LEAST_BITS["base64"])
    return F.when(~mixed | allowed, False).otherwise(window_entropy(s) >= least)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")


_MARKED = "struct<start:int,k:int,end:int,hit:string,over:boolean>"


def _apart(base: Column, hits: Column) -> Column:
    """The hits that overlap no base span: one pass by start against the ends before, one back against the starts after."""
    mine = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("k"), x["end"].alias("end"), x["hit"].alias("hit"), F.lit(False).alias("over")))
    theirs = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), F.lit("").alias("hit"), F.lit(False).alias("over")))

    def marked(x: Column, over: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["hit"].alias("hit"), over.alias("over"))

    def ahead(at: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["k"] < len(KINDS) - 1, F.greatest(at, x["end"])).otherwise(at), marked(x, at > x["start"])

    def back(at: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["k"] < len(KINDS) - 1, x["start"]).otherwise(at), marked(x, x["over"] | (at < x["end"]))

    both = F.reverse(_running(F.array_sort(F.concat(theirs, mine)), _MARKED, ahead))
    free = F.filter(_running(both, _MARKED, back, (1 << 31) - 1), lambda x: (x["k"] == len(KINDS) - 1) & ~x["over"])
    return F.when(F.size(base) == 0, mine).when(F.size(hits) == 0, F.slice(mine, 1, 0)).otherwise(free)


def scan(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id, text, base, added``: arrays of (start, k, end) by start, ``k`` numbering KINDS; plus ``extra`` columns."""
    out = documents(docs, *extra).withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumns({"s_assign": _spans(F.col("text"), ASSIGN, 2, LEAST_VALUE), "s_access": _spans(F.col("text"), ACCESS), "s_hex": _spans(F.col("text"), HEX), "s_entropy": _spans(F.col("text"), CANDIDATE)})
    base = F.array_sort(F.concat(*(_named(F.col(f"s_{k}"), k) for k in KINDS[:3])))
    out = out.withColumn("base", base)
    added = _named(F.filter(_apart(F.col("base"), F.col("s_entropy")), lambda x: _suspicious(x["hit"])), "entropy")
    return out.select("doc_id", "text", "base", added.alias("added"), *extra)


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of their places, and all spans as text."""
    found = scan(docs)

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id, text`` with every span replaced by ``[SECRET]``; overlapping spans are replaced once."""
    found = scan(docs, *extra)
    spans, text = F.array_sort(F.concat("base", "added")), F.col("text")

    def cut(parts: Column) -> Column:
        """The text between two places, from parts of PART code points: none has to be sought from the start of the text."""

        def between(a: Column, b: Column) -> Column:
            first = F.call_function("div", a, F.lit(PART)).cast("int")
            some = F.slice(parts, first + 1, F.call_function("div", F.greatest(b - 1, a), F.lit(PART)).cast("int") - first + 1)
            return F.substring(F.array_join(some, ""), a - first * PART + 1, F.greatest(b - a, F.lit(0)))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.concat(between(at, x["start"]), F.lit("[SECRET]"))).otherwise("")

        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(_running(spans, "string", step), ""), between(last, F.length(text)))

    done = bound(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0)), cut)
    return found.select("doc_id", F.when(F.size(spans) > 0, done).otherwise(text).alias("text"), *extra)
