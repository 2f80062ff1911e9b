"""The thin ``opN_<name>`` queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus_kmeans, bpe_pair_index, config_lp_packing, entropy_secrets, language_id, line_dedup, merkle_manifest, quality_cnn, quartile_digest, quote_linking, suffix_dedup, tensored_minhash, voronoi_knn
from .common import table

#: Vocabulary files are parameters; nothing of them is kept in this repository.
BPE_FILE = "byte_bpe_50k.json"


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.classify(docs, model)


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.edited_pairs(table(spark, sf_dir, "documents"))


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi_knn.integer_vectors(table(spark, sf_dir, "embeddings"))
    return voronoi_knn.knn(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", F.col("n_units").cast("long").alias("n_units"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_lp_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.reply_ordered(table(spark, sf_dir, "conversations"))


def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_pair_index.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_secrets.report(table(spark, sf_dir, "documents"))


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tensored_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


def op11_annulus_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus_kmeans.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3).drop("compared")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.document_manifest(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.classify(docs, language_id.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_cnn, op2_quartile_digest, op3_voronoi_knn, op4_line_dedup, op5_config_lp_packing, op6_quote_linking, op7_bpe_pair_index, op8_suffix_dedup, op9_entropy_secrets, op10_tensored_minhash, op11_annulus_kmeans, op12_merkle_manifest, op13_language_id)
}



def _kmeans_sql(rounds: int = 3) -> str:
    """One pair of expressions a round: the nearest centroid of each vector, and the floor of each cluster's mean."""
    out = ["""v as (
  select row_number() over () as r, vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), c0 as (
  select row_number() over (order by sha256('1:' || cast(vec_id as varchar)), e) - 1 as cluster, e from v
  qualify row_number() over (order by sha256('1:' || cast(vec_id as varchar)), e) <= 16
)"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} as (
  select r, vec_id, v.e, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.e, c.e)]) as distance from v cross join c{i} c
  qualify row_number() over (partition by r order by distance, cluster) = 1
)""")
        if i < rounds:
            out.append(f"""s{i} as (
  select cluster, place, sum(x) as s, count(*) as n from (select cluster, generate_subscripts(e, 1) as place, unnest(e) as x from a{i}) group by cluster, place
), m{i} as (
  select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as e from s{i} group by cluster
), c{i + 1} as (
  select c.cluster, coalesce(m.e, c.e) as e from c{i} c left join m{i} m on m.cluster = c.cluster
)""")
    return "with " + ", ".join(out) + f"""
select vec_id, cast(a.cluster as integer) as cluster, cast(distance as bigint) as distance,
  cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(c.e, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.cluster = a.cluster"""


def _merkle_sql(levels: int = 8) -> str:
    """One expression a level of the languages' trees and of the tree above; 8^levels leaves a tree at most."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = lambda c: f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = "list_reduce([4294967295] || [ascii(x) for x in string_split(cast(doc_id as varchar), '')], lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))"
    out = [f"""d as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n
  from (select doc_id, lang, {leaf("text")} as leaf, case when xor({crc}, 4294967295) % 3 = 0 then {leaf(lower)} end as other from documents)
), n0 as (
  select lang, i, n, leaf as h from d
)"""]

    def step(name: str, key: str, k: int) -> str:
        same = f"p.{key} is not distinct from q.{key} and p.i = q.i // 8" if key else "p.i = q.i // 8"
        by = f"{key}, " if key else ""
        return f"""{name}{k + 1} as (
  select {by}i // 8 as i, any_value((n + 7) // 8) as n, case when any_value(n) = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h from {name}{k} group by {by}i // 8
), {name}p{k} as (
  select {"q." + key + ", " if key else ""}q.i, coalesce(string_agg(s.h, '' order by s.i) filter (s.i < q.i), '') as before,
    coalesce(string_agg(s.h, '' order by s.i) filter (s.i > q.i), '') as after, any_value(q.n) as n
  from {name}{k} q join {name}{k} s on {"s." + key + " is not distinct from q." + key + " and " if key else ""}s.i // 8 = q.i // 8 group by {"q." + key + ", " if key else ""}q.i
)"""

    out += [step("n", "lang", k) for k in range(levels)]
    out.append(f"l as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as li, count(*) over () as n from n{levels}), t0 as (select li as i, n, subroot as h from l)")
    out += [step("t", "", k) for k in range(levels)]
    proof, joins = [], []
    for name, key, i in (("n", "lang", "d.i"), ("t", "", "l.li")):
        for k in range(levels):
            p = f"{name}p{k}"
            joins.append(f"join {p} on " + (f"{p}.lang is not distinct from d.lang and " if key else "") + f"{p}.i = {i} // {8**k}")
            proof.append(f"{p}.before || {p}.after")
    out.append(f"u as (select d.doc_id, d.leaf, d.other, d.i, l.li, l.subroot, (select h from t{levels}) as root, sha256({' || '.join(proof)}) as proof_sha256, coalesce(d.other, d.leaf) as f0, "
               + ", ".join(f"{n}p{k}.before as {n}b{k}, {n}p{k}.after as {n}a{k}, {n}p{k}.n as {n}n{k}" for n in "nt" for k in range(levels))
               + " from d join l on l.lang is not distinct from d.lang " + " ".join(joins) + ")")
    last = "u"
    for m, (n, k) in enumerate([(n, k) for n in "nt" for k in range(levels)]):
        out.append(f"f{m + 1} as (select *, case when {n}n{k} = 1 then f{m} else sha256({n}b{k} || f{m} || {n}a{k}) end as f{m + 1} from {last})")
        last = f"f{m + 1}"
    return "with " + ", ".join(out) + f"\nselect doc_id, leaf, subroot, root, proof_sha256, f{2 * levels} as folded_root, f{2 * levels} = root as verified from {last}"


ORACLE_SQL: dict[str, str] = {
    "op11_annulus_kmeans": _kmeans_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op3_voronoi_knn": """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5""",
    # pieces end at line and sentence ends; they are joined until they have 15 words, the rest of a text joins its last unit
    "op4_line_dedup": r"""
with recursive p as (
  select doc_id, text, string_split(regexp_replace(text, '([.!?][ \t\n\r\f]+|\n[ \t\n\r\f]*)', '\1' || chr(1), 'g'), chr(1)) as ps
  from (select doc_id, coalesce(text, '') as text from documents)
), a as (
  select doc_id, k, piece, sum(length(piece)) over (partition by doc_id order by k) - length(piece) as s,
    len([x for x in string_split_regex(piece, '[ \t\n\r\f\v]+') if x <> '']) as words
  from (select doc_id, generate_subscripts(ps, 1) as k, unnest(ps) as piece from p) where piece <> ''
), r(doc_id, k, e, start, words) as (
  select doc_id, k, s + length(piece), s, words from a where k = 1
  union all
  select a.doc_id, a.k, a.s + length(a.piece), case when r.words >= 15 then a.s else r.start end, case when r.words >= 15 then a.words else r.words + a.words end
  from r join a on a.doc_id = r.doc_id and a.k = r.k + 1
), u as (
  select doc_id, start, max(e) as e, max(words) >= 15 as whole from r group by doc_id, start
), v as (
  select doc_id, case when whole then start else coalesce(lag(start) over (partition by doc_id order by start), start) end as start, e from u
), t as (
  select v.doc_id, start::bigint as s, max(e)::bigint as e, substr(any_value(text), start::bigint + 1, (max(e) - start)::bigint) as unit from v join p using (doc_id) group by v.doc_id, start
), ranked as (
  select *, norm <> '' and row_number() over (partition by norm order by doc_id, s) > 1 as gone
  from (select *, lower(trim(regexp_replace(unit, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) as norm from t)
)
select p.doc_id, count(s) as n_units, count(*) filter (gone) as n_removed, coalesce(string_agg(s || ':' || e, ',' order by s) filter (gone), '') as removed,
  sha256(coalesce(string_agg(unit, '' order by s) filter (not gone), '')) as kept_sha256
from p left join ranked on ranked.doc_id = p.doc_id group by p.doc_id""",
    "op8_suffix_dedup": """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), w as (
  select doc_id, i, substr(h, 2 * i + 1, 100) as g from (select doc_id, h, unnest(range(0, greatest(n - 49, 0))) as i from d)
), m as (
  select g, min(doc_id) as f from w group by g
), r as (
  select w.doc_id, w.i from w join m on w.g = m.g where m.f < w.doc_id
), b as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from r
), g as (
  select doc_id, i, sum(new) over (partition by doc_id order by i) as run from b
), s as (
  select doc_id, run, min(i) as a, max(i) + 50 as z from g group by doc_id, run
), k as (
  select s.doc_id, s.run, s.a, s.z, substr(d.h, 2 * coalesce(lag(s.z) over (partition by s.doc_id order by s.run), 0) + 1,
    2 * (s.a - coalesce(lag(s.z) over (partition by s.doc_id order by s.run), 0))) as part
  from s join d on d.doc_id = s.doc_id
), c as (
  select doc_id, string_agg(part, '' order by run) as head, max(z) as z, sum(z - a) as cut, count(*) as runs from k group by doc_id
)
select d.doc_id, d.n as n_bytes, cast(coalesce(c.cut, 0) as bigint) as n_removed, coalesce(c.runs, 0) as n_spans,
  sha256(unhex(coalesce(c.head, '') || substr(d.h, 2 * coalesce(c.z, 0) + 1))) as kept_sha256
from d left join c on c.doc_id = d.doc_id""",
    "op10_tensored_minhash": r"""
with recursive t as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') if x <> ''] as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from t where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), e as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 75 * (x.n + y.n - p.c)
), reach(a, b) as (
  select doc_id, doc_id from t union select reach.a, e.b from reach join e on reach.b = e.a
), m as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select t.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, t.doc_id = m.component_id as kept
from t join m on m.doc_id = t.doc_id left join n on n.doc_id = t.doc_id""",
}
