"""Ground truth: XML annotations, planted passages, pair roll-ups, validation of retrieval."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_ATTRIBUTES = ("name", "type", "obfuscation", "this_language", "source_language", "manual_obfuscation", "this_offset", "this_length", "source_reference", "source_offset", "source_length")
XML_SCHEMA = "struct<_reference:string,feature:array<struct<" + ",".join(f"_{a}:string" for a in _ATTRIBUTES) + ">>>"


def xml_spans(files: DataFrame) -> DataFrame:
    """``path, xml`` documents to one row for each plagiarism feature; a missing attribute is null."""
    parsed = files.select("path", F.from_xml("xml", XML_SCHEMA).alias("x"))
    f = parsed.select("path", F.col("x._reference").alias("suspicious_reference"), F.posexplode("x.feature").alias("plagiarism_index_in_xml", "f")).where("f._name = 'plagiarism'")
    num = lambda a: F.col(f"f._{a}").cast("int")
    out = f.select("path", "suspicious_reference", "plagiarism_index_in_xml", num("this_offset").alias("suspicious_offset"), num("this_length").alias("suspicious_length"), F.col("f._source_reference").alias("source_reference"), num("source_offset").alias("source_offset"), num("source_length").alias("source_length"), F.col("f._type").alias("plagiarism_type"), F.col("f._obfuscation").alias("obfuscation"), F.col("f._manual_obfuscation").alias("manual_obfuscation"), F.col("f._this_language").alias("this_language"), F.col("f._source_language").alias("source_language"))
    ends = {f"{s}_end": F.col(f"{s}_offset") + F.col(f"{s}_length") for s in ("suspicious", "source")}
    ranges = {f"{s}_range": F.concat_ws("-", f"{s}_offset", F.col(f"{s}_offset") + F.col(f"{s}_length")) for s in ("suspicious", "source")}
    return out.withColumns(ends | ranges)


def with_defaults(spans: DataFrame) -> DataFrame:
    """Missing attributes as the evaluation reads them."""
    return spans.fillna({"obfuscation": "none", "plagiarism_type": "", "manual_obfuscation": "false", "suspicious_offset": 0, "suspicious_length": 0, "source_offset": 0, "source_length": 0})


def regex_spans(files: DataFrame) -> DataFrame:
    """Offsets and lengths straight from the XML text, without a parser."""
    tag = F.explode(F.regexp_extract_all("xml", F.lit(r'<feature[^>]*name="plagiarism"[^>]*>'), F.lit(0)))
    attr = lambda a: F.regexp_extract("tag", rf'\b{a}="([^"]*)"', 1)
    return files.select("path", tag.alias("tag")).select("path", attr("this_offset").try_cast("int").alias("suspicious_offset"), attr("this_length").try_cast("int").alias("suspicious_length"), attr("source_reference").alias("source_reference"))


def to_xml_text(spans: DataFrame) -> DataFrame:
    """One XML document for each suspicious document (the ground-truth writer)."""
    attrs = [("type", "plagiarism_type"), ("obfuscation", "obfuscation"), ("this_offset", "suspicious_offset"), ("this_length", "suspicious_length"), ("source_reference", "source_reference"), ("source_offset", "source_offset"), ("source_length", "source_length")]
    feature = F.concat(F.lit('  <feature name="plagiarism"'), *(F.coalesce(F.concat(F.lit(f' {a}="'), T.html_escape(F.col(c).cast("string")), F.lit('"')), F.lit("")) for a, c in attrs), F.lit("/>"))
    one = spans.groupBy("suspicious_reference").agg(F.transform(F.array_sort(F.collect_list(F.struct("suspicious_offset", feature.alias("x")))), lambda s: s["x"]).alias("xs"))
    return one.select("suspicious_reference", F.concat(F.lit('<document reference="'), "suspicious_reference", F.lit('">\n'), F.array_join("xs", "\n"), F.lit("\n</document>")).alias("xml"))


#: Code points of a passage that the automaton looks for, and bounds of a portion of passages: their number and their characters, about.
ANCHOR, PASSAGES, CHARACTERS = 16, 1 << 16, 1 << 24


def planted(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """First place of every passage in every text that contains it, wherever it begins and however short it is.

    Every text is read once for each portion of passages: an automaton finds the beginnings of all of them at once, and the rest is
    compared in place.  Different passages go out in portions of bounded size; texts are never shuffled, and ids are joined to what was found.
    """
    import pandas as pd

    p = passages.select("item_id", F.col("text").alias("passage")).where(F.length("passage") > 0)
    texts = p.select("passage").distinct()
    n, chars = texts.agg(F.count("*"), F.sum(F.length("passage"))).first()
    portions = max(1, -(-n // PASSAGES), -(-(chars or 0) // CHARACTERS))
    source = docs.select("doc_id", "text").where("text is not null")
    hits = None
    for portion in range(portions):
        some = [r["passage"] for r in texts.where(F.pmod(F.xxhash64("passage"), F.lit(portions)) == portion).collect()]  # a portion's share

        def scan(batches: Iterator[pd.DataFrame], some: list[str] = some) -> Iterator[pd.DataFrame]:
            import ahocorasick

            begins: dict[str, list[str]] = {}
            for x in some:
                begins.setdefault(x[:ANCHOR], []).append(x)
            automaton = ahocorasick.Automaton()
            for anchor, mine in begins.items():
                automaton.add_word(anchor, (len(anchor), mine))
            automaton.make_automaton()
            for pdf in batches:
                rows = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    seen: dict[str, int] = {}
                    for end, (size, mine) in automaton.iter(text) if begins else ():
                        for x in mine:
                            if x not in seen and text.startswith(x, end + 1 - size):
                                seen[x] = end + 1 - size
                    rows += [(doc_id, x, at) for x, at in seen.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "passage", "at"])

        found = source.mapInPandas(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, passage string, at int")
        hits = found if hits is None else hits.unionByName(found)
    return hits.join(p, "passage").select(F.col("doc_id").alias("suspicious_doc_id"), F.col("item_id").alias("source_doc_id"), F.col("at").alias("suspicious_offset"), F.length("passage").alias("suspicious_length"), F.lit(0).alias("source_offset"), F.length("passage").alias("source_length"))


def pair_rollup(spans: DataFrame, keys: tuple[str, ...] = ("suspicious_doc_id", "source_doc_id")) -> DataFrame:
    """One row for each pair of documents: counts, extents, lengths and the passages as JSON, ordered by offset."""
    end = lambda s: F.col(f"{s}_offset") + F.col(f"{s}_length")
    passages = F.to_json(F.array_sort(F.collect_list(F.struct("suspicious_offset", "suspicious_length", "source_offset", "source_length"))))
    return spans.groupBy(*keys).agg(F.count("*").alias("true_plagiarism_passage_count"), F.min("suspicious_offset").alias("min_suspicious_offset"), F.max(end("suspicious")).alias("max_suspicious_end"), F.sum("suspicious_length").alias("total_suspicious_chars"), F.min("source_offset").alias("min_source_offset"), F.max(end("source")).alias("max_source_end"), F.sum("source_length").alias("total_source_chars"), passages.alias("passages_json")).withColumn("is_true_source_document", F.lit(True))


def validate(retrieved: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """Every retrieved pair with its truth; pairs without any are false and 0."""
    cols = ["is_true_source_document", "true_plagiarism_passage_count", "total_suspicious_chars"]
    out = retrieved.join(truth_pairs.select("suspicious_doc_id", "source_doc_id", *cols), ["suspicious_doc_id", "source_doc_id"], "left")
    return out.withColumns({cols[0]: F.coalesce(cols[0], F.lit(False)), cols[1]: F.coalesce(cols[1], F.lit(0).cast("long")), cols[2]: F.coalesce(cols[2], F.lit(0).cast("long"))})


def pair_order() -> list[Column]:
    """Order of the pairs of a document: two descending keys and an ascending one."""
    return [F.desc("true_plagiarism_passage_count"), F.desc("total_suspicious_chars"), F.asc("source_doc_id")]


def for_document(truth_pairs: DataFrame, doc_id) -> DataFrame:
    return truth_pairs.where(F.col("suspicious_doc_id") == F.lit(doc_id)).orderBy(*pair_order())


def official_category(kind: Column, obfuscation: Column, manual: Column) -> Column:
    """Category of a case by its type and obfuscation."""
    auto = kind.contains("artificial")
    return (
        F.when(kind.contains("translation"), F.when(manual == "true", "translation-manual").otherwise("translation-auto"))
        .when(kind == "", "none").when(kind == "simulated", "paraphrase-manual").when(obfuscation == "none", "none")
        .when((obfuscation == "low") & auto, "paraphrase-auto-low").when((obfuscation == "high") & auto, "paraphrase-auto-high").otherwise(obfuscation)
    )


def selection_category(kind: Column, obfuscation: Column) -> Column:
    return F.when((kind == "artificial") & obfuscation.isin("none", "low", "high"), obfuscation).when(kind == "simulated", "manual").when(kind == "translation", "translation").otherwise("other")


def distribution_category(kind: Column, obfuscation: Column, manual: Column) -> Column:
    auto = kind == "artificial"
    return (
        F.when(auto & (obfuscation == "none"), "none").when(auto & (obfuscation == "low"), "paraphrasing - automatic (low)").when(auto & (obfuscation == "high"), "paraphrasing - automatic (high)")
        .when(kind == "simulated", "paraphrasing - manual").when(kind == "translation", F.when(manual == "true", "translation - manual correction").otherwise("translation - automatic"))
        .otherwise(F.concat(F.lit("unknown ("), F.coalesce(kind, F.lit("")), F.lit("/"), F.coalesce(obfuscation, F.lit("")), F.lit(")")))
    )


def length_band(word_count: Column) -> Column:
    return F.when(word_count.isNull(), "unknown").when(word_count < 150, "short").when(word_count <= 1150, "medium").otherwise("long")
