"""SQL twins of the queries: named common table expressions and the statements over them."""

from __future__ import annotations

import re

from . import detection as D
from ..functions.text import STOPWORDS


def clean(col: str) -> str:
    e = f"translate(replace(coalesce({col}, ''), chr(0), ' '), '“”‘’–—', '\"\"''''--')"
    for pattern, put in ((r"(?s)\[Illustrated:.*?\]", " "), (r"(?i)\bCHAPTER\s+[IVXLCDM]+\b", " "), ("[-=_]{3,}", " "), (r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])", r"\1\2"), (r"\s+", " "), (r"\s+([.,;:!?])", r"\1"), ("([.,;:!?])([A-Za-z])", r"\1 \2")):
        e = f"regexp_replace({e}, '{pattern}', '{put}', 'g')"
    return f"trim({e}, ' ')"


def lexical(col: str) -> str:
    e = f"lower(coalesce({col}, ''))"
    for pattern, put in ((r"[^a-z0-9\s]", " "), ("[0-9]+", " NUM "), (r"\s+", " ")):
        e = f"regexp_replace({e}, '{pattern}', '{put}', 'g')"
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"array_to_string([x for x in string_split(trim({e}, ' '), ' ') if x <> '' and x not in ({stop})], ' ')"


def chunks(source: str, size: int = D.SIZE, overlap: int = D.OVERLAP, least: int = D.MIN_SUSPICIOUS, early: bool = True) -> str:
    step = max(1, size - overlap)
    stop = f" and (ws = 0 or ws - {step} + {size} < n)" if early else ""
    return f"""select *, start_char + length(chunk_text) as end_char, printf('%s_c%04d', doc_id::varchar, chunk_index) as chunk_id from (
    select doc_id, (ws // {step})::integer as chunk_index, ws::integer as word_start, least(ws + {size}, n)::integer as word_end, (least(ws + {size}, n) - ws)::integer as word_count,
      case when ws = 0 then 0 else length(array_to_string(tk[1:ws], ' ')) + 1 end as start_char, array_to_string(tk[ws + 1:least(ws + {size}, n)], ' ') as chunk_text
    from (select doc_id, tk, len(tk) as n, unnest(range(0, len(tk), {step})) as ws from (select doc_id, string_split(trim(clean_text, ' '), ' ') as tk from {source} where length(trim(clean_text, ' ')) > 0))
    where least(ws + {size}, n) - ws >= {least}{stop})"""


def grams(source: str, high: int) -> str:
    two = "list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])" if high == 2 else "w"
    return f"""select chunk_id as id, feature, count(*) as tf from (
    select chunk_id, unnest({two}) as feature from (select chunk_id, [x for x in string_split(lower({lexical('chunk_text')}), ' ') if length(x) >= 2] as w from {source})) group by all"""


def weights(tf: str, idf: str) -> str:
    return f"select id, feature, w / sqrt(sum(w * w) over (partition by id)) as w from (select id, feature, (1 + ln(tf)) * idf as w from {tf} join {idf} using (feature))"


def _lexical(n: str, high: int) -> dict[str, str]:
    return {
        f"tfa{n}": grams("cha", high), f"tfb{n}": grams("chb", high),
        f"idf{n}": f"select feature, count(*) as df, sum(tf) as total, ln((1.0e0 + (select count(distinct id) from tfb{n})) / (1 + count(*))) + 1 as idf from tfb{n} group by feature",
        f"wa{n}": weights(f"tfa{n}", f"idf{n}"), f"wb{n}": weights(f"tfb{n}", f"idf{n}"),
        f"sc{n}": f"select a.id as q, b.id as s, sum(a.w * b.w) as score from wa{n} a join wb{n} b using (feature) group by a.id, b.id",
        f"top{n}": f"select * from (select q, s, score, row_number() over (partition by q order by score desc, s) as rank from sc{n} where score > 0) where rank <= 500",
        f"cand{n}": f"""select t.q as suspicious_chunk_id, t.s as source_chunk_id, t.score, t.rank, a.doc_id as suspicious_doc_id, b.doc_id as source_doc_id,
    a.start_char as suspicious_start_char, a.end_char as suspicious_end_char, b.start_char as source_start_char, b.end_char as source_end_char
  from top{n} t join cha a on a.chunk_id = t.q join chb b on b.chunk_id = t.s""",
        f"roll{n}": f"""select suspicious_doc_id, source_doc_id, max(score) as max_score, avg(score) as mean_score, min(score) as min_score, count(*) as match_count,
    count(distinct source_chunk_id) as unique_source_chunks, count(distinct suspicious_chunk_id) as unique_suspicious_chunks from cand{n} group by all""",
    }


def _ranked(n: str, order: str, top: int = 50) -> str:
    return f"select * from (select *, row_number() over (partition by suspicious_doc_id order by {order}, source_doc_id) as source_doc_rank from roll{n}) where source_doc_rank <= {top}"


PAIR = "suspicious_doc_id, source_doc_id"
CTES: dict[str, str] = {
    "docs": f"select doc_id, {clean('text')} as clean_text from documents",
    "src": f"select item_id as doc_id, {clean('text')} as clean_text from benchmark",
    "cha": chunks("docs"), "chb": chunks("src", least=D.MIN_SOURCE),
    **_lexical("1", 1), **_lexical("2", 2),
    "rank1": _ranked("1", "max_score desc, unique_suspicious_chunks desc, match_count desc, mean_score desc"),
    "rank2": _ranked("2", "max_score desc, match_count desc, mean_score desc"),
    "long": "select *, 'tfidf' as branch from rank1 union all by name select *, 'esa' as branch from rank2",
    "wide": f"""select {PAIR}, max(mean_score) filter (branch = 'tfidf') as tfidf_mean_score, max(max_score) filter (branch = 'tfidf') as tfidf_max_score, max(source_doc_rank) filter (branch = 'tfidf') as tfidf_rank,
    max(mean_score) filter (branch = 'esa') as esa_mean_score, max(max_score) filter (branch = 'esa') as esa_max_score, max(source_doc_rank) filter (branch = 'esa') as esa_rank from long group by {PAIR}""",
    "summed": """select *, tfidf_max_score is not null as found_by_tfidf, esa_max_score is not null as found_by_esa, (tfidf_max_score is not null)::int + (esa_max_score is not null)::int as methods_found_count,
    coalesce(tfidf_mean_score, 0) * (0.1e0 / 0.25e0) + coalesce(esa_mean_score, 0) * (0.15e0 / 0.25e0) as weighted_mean_score, coalesce(tfidf_max_score, 0) * (0.1e0 / 0.25e0) + coalesce(esa_max_score, 0) * (0.15e0 / 0.25e0) as weighted_max_score from wide""",
    "scored": "select *, 0.2e0 * weighted_mean_score + 0.8e0 * weighted_max_score as final_score from summed",
    "fused": """select * from (select *, row_number() over (partition by suspicious_doc_id order by final_score desc, methods_found_count desc, weighted_mean_score desc, weighted_max_score desc, source_doc_id) as final_rank from scored) where final_rank <= 20""",
    "gated": f"""select {PAIR} from (select *, max(final_score) over (partition by suspicious_doc_id) as top1,
    greatest(coalesce(max(tfidf_max_score) over (partition by suspicious_doc_id), 0), coalesce(max(esa_max_score) over (partition by suspicious_doc_id), 0)) as top_branch from fused)
    where (top1 >= 0.25e0 or top_branch >= 0.5e0) and (final_score >= top1 * 0.85e0 or coalesce(tfidf_rank <= 3, false) or coalesce(esa_rank <= 3, false))""",
    "lm": "select feature, sum(tf) as total from tfa1 group by feature",
    "ppl": "select id, exp(-sum(tf * ln(total / (select sum(tf) from tfa1))) / sum(tf)) as perplexity from tfa1 join lm using (feature) group by id",
    "pairs": f"""select k.*, perplexity from (select *, row_number() over (partition by {PAIR} order by round(score, 9) desc, suspicious_chunk_id, source_chunk_id) as pair_rank from cand2) k
    left join ppl on ppl.id = k.suspicious_chunk_id where pair_rank <= 25""",
    **{f"tri{x}": f"select distinct chunk_id, unnest([substr(lower(chunk_text), i, 3) for i in range(1, length(chunk_text) - 1)]) as g from ch{x}" for x in "ab"},
    **{f"ntri{x}": f"select chunk_id, count(*) as n from tri{x} group by chunk_id" for x in "ab"},
    "met": "select distinct suspicious_chunk_id, source_chunk_id from pairs",
    "common": "select suspicious_chunk_id, source_chunk_id, count(*) as n from met join trib y on y.chunk_id = source_chunk_id join tria x on x.chunk_id = suspicious_chunk_id and x.g = y.g group by suspicious_chunk_id, source_chunk_id",
    "shared": f"""select {PAIR}, count(*) as n_pairs, max(coalesce(c.n, 0) / nullif(least(coalesce(x.n, 0), coalesce(y.n, 0)), 0)) as share, coalesce(avg((perplexity > 20000)::int) filter (pair_rank <= 10) >= 0.5, false) as capped
    from pairs p left join common c using (suspicious_chunk_id, source_chunk_id) left join ntria x on x.chunk_id = suspicious_chunk_id left join ntrib y on y.chunk_id = source_chunk_id group by {PAIR}""",
    "stepped": "select *, case when share >= 0.9e0 then 1e0 when share >= 0.8e0 then 0.95e0 when share >= 0.7e0 then 0.85e0 when share >= 0.5e0 then 0.5e0 when share >= 0.3e0 then 0.25e0 else 0e0 end as step from shared",
    "confirmed": "select *, case when capped then least(step, 0.25e0) else step end as llm_score from stepped",
    "final_best": f"""select * from (select *, row_number() over (partition by suspicious_doc_id, suspicious_start_char, suspicious_end_char order by score desc, source_doc_id, source_start_char) as p
    from cand2 where score >= 0.3 and ({PAIR}) in (select ({PAIR}) from gated) and ({PAIR}) in (select ({PAIR}) from confirmed where llm_score >= 0.85e0)) where p = 1""",
    "final_marked": f"""select *, case when reach is null or suspicious_start_char - reach > 1800 then 1 else 0 end as new from (
    select *, max(suspicious_end_char) over (partition by {PAIR} order by suspicious_start_char, suspicious_end_char rows between unbounded preceding and 1 preceding) as reach from final_best)""",
    "final_isl": f"select *, sum(new) over (partition by {PAIR} order by suspicious_start_char, suspicious_end_char rows unbounded preceding) as island from final_marked",
    "final_spans": f"select {PAIR}, min(suspicious_start_char) as suspicious_start_char, max(suspicious_end_char) as suspicious_end_char, max(score) as score from final_isl group by {PAIR}, island",
    "planted": """select d.doc_id as suspicious_doc_id, s.doc_id as source_doc_id, strpos(d.clean_text, s.clean_text) - 1 as suspicious_offset, length(s.clean_text) as suspicious_length,
    0 as source_offset, length(s.clean_text) as source_length from docs d join src s on length(s.clean_text) > 0 and contains(d.clean_text, s.clean_text)""",
    "best": f"""select * from (select *, row_number() over (partition by suspicious_doc_id, suspicious_start_char, suspicious_end_char order by score desc, source_doc_id, source_start_char) as p from cand2 where score >= 0.3) where p = 1""",
    "marked": f"""select *, case when reach is null or suspicious_start_char - reach > 1800 then 1 else 0 end as new from (
    select *, max(suspicious_end_char) over (partition by {PAIR} order by suspicious_start_char, suspicious_end_char rows between unbounded preceding and 1 preceding) as reach from best)""",
    "isl": f"select *, sum(new) over (partition by {PAIR} order by suspicious_start_char, suspicious_end_char rows unbounded preceding) as island from marked",
    "merged": f"""select {PAIR}, min(suspicious_start_char) as suspicious_start_char, max(suspicious_end_char) as suspicious_end_char, min(source_start_char) as source_start_char, max(source_end_char) as source_end_char,
    max(score) as score, count(*) as n_merged from isl group by {PAIR}, island""",
    "t": f"select {PAIR}, suspicious_offset as t0, suspicious_offset + suspicious_length as t1, source_offset as tr0, source_offset + source_length as tr1, row_number() over (order by {PAIR}, suspicious_offset) as k from planted",
    "d": f"select {PAIR}, suspicious_start_char as d0, suspicious_end_char as d1, source_start_char as dr0, source_end_char as dr1, row_number() over (order by {PAIR}, suspicious_start_char) as det from merged",
    "l1": f"select t.suspicious_doc_id, t.source_doc_id, k, det, t0, t1, d0, d1, greatest(t0, d0) as o0, least(t1, d1) as o1, tr0 < dr1 and dr0 < tr1 as two_sided from t join d using ({PAIR}) where t0 < d1 and d0 < t1",
    "l2": "select * from l1 where two_sided",
    "ck": "select k, sum(a) as covered, count(*) as n_links from (select k, greatest(0, o1 - greatest(o0, coalesce(max(o1) over (partition by k order by o0, o1 rows between unbounded preceding and 1 preceding), o0))) as a from l2) group by k",
    "cd": "select det, sum(a) as covered from (select det, greatest(0, o1 - greatest(o0, coalesce(max(o1) over (partition by det order by o0, o1 rows between unbounded preceding and 1 preceding), o0))) as a from l2) group by det",
    "gt": "select suspicious_doc_id, count(*) as gt_spans, sum(t1 - t0) as gt_chars from t group by 1",
    "dt": "select suspicious_doc_id, count(*) as det_spans, sum(d1 - d0) as det_chars from d group by 1",
    "hit": "select suspicious_doc_id, count(distinct k) as hit_cases, count(distinct det) as tp, sum(o1 - o0) as overlap_chars from l1 group by 1",
    "m0": """select doc_id as suspicious_doc_id, coalesce(gt_spans, 0) as gt_spans, coalesce(gt_chars, 0) as gt_chars, coalesce(det_spans, 0) as det_spans, coalesce(det_chars, 0) as det_chars, coalesce(tp, 0) as tp,
    coalesce(det_spans, 0) - coalesce(tp, 0) as fp, coalesce(gt_spans, 0) - coalesce(hit_cases, 0) as fn, coalesce(overlap_chars, 0) as overlap_chars, coalesce(gt_spans, 0) = 0 as is_clean
    from documents left join gt on gt.suspicious_doc_id = doc_id left join dt on dt.suspicious_doc_id = doc_id left join hit on hit.suspicious_doc_id = doc_id""",
    "m1": """select *, case when det_spans > 0 then tp / det_spans when is_clean then 1.0e0 else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 1.0e0 end as recall,
    case when det_chars > 0 then overlap_chars / det_chars when is_clean then 1.0e0 else 0 end as char_precision, case when gt_chars > 0 then overlap_chars / gt_chars else 1.0e0 end as char_recall from m0""",
    "m2": "select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1, case when char_precision + char_recall > 0 then 2 * char_precision * char_recall / (char_precision + char_recall) else 0 end as char_f1 from m1",
    "pc": "select suspicious_doc_id, sum(covered) as tp_chars, avg(n_links) as granularity from ck join t using (k) group by 1",
    "p0": """select doc_id as suspicious_doc_id, coalesce(gt_spans, 0) as gt_spans, coalesce(gt_chars, 0) as gt_chars, coalesce(det_spans, 0) as det_spans, coalesce(det_chars, 0) as det_chars, coalesce(tp_chars, 0) as tp_chars, coalesce(granularity, 1.0e0) as granularity
    from documents left join gt on gt.suspicious_doc_id = doc_id left join dt on dt.suspicious_doc_id = doc_id left join pc on pc.suspicious_doc_id = doc_id""",
    "p1": """select *, case when gt_spans = 0 then (det_spans = 0)::int::double when det_chars > 0 then tp_chars / det_chars else 0.0e0 end as precision, case when gt_spans = 0 then 1.0e0 when gt_chars > 0 then tp_chars / gt_chars else 1.0e0 end as recall from p0""",
    "p2": "select *, case when gt_spans = 0 and det_spans > 0 then 0.0e0 when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0e0 end as f1 from p1",
    "pd": "select *, case when f1 > 0 then f1 / log2(1 + granularity) else 0.0e0 end as plagdet from p2",
}


def statement(final: str) -> str:
    """``final`` with the expressions it needs, and those they need, in order."""
    used: set[str] = set()

    def need(sql: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b(from|join)\s+{name}\b", sql):
                used.add(name)
                need(CTES[name])

    need(final)
    parts = ",\n".join(f"{n} as (\n  {CTES[n]}\n)" for n in CTES if n in used)
    return f"with {parts}\n{final}" if parts else final
