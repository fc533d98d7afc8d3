"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, bpe, fingerprint, langid, lm, ngram_join, packing, pii, quality, search, secrets, substring


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1,
        "op2_lm_score": lm.op2,
        "op3_secret_scan": secrets.op3,
        "op4_length_buckets": packing.op4,
        "op5_contextual_pii": pii.op5,
        "op6_ngram_jaccard": ngram_join.op6,
        "op7_language_id": langid.op7,
        "op8_substring_dedup": substring.op8,
        "op9_learned_partitions": ann.op9,
        "op10_paragraph_sketch": fingerprint.op10,
        "op11_quality_boosting": quality.op11,
        "op12_tokenizer_alignment": align.op12,
        "op13_lexical_search": search.op13,
    }


_WORDS = r"""words as (
  select row_number() over () as rid, doc_id, list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents)"""

_OP6 = f"""with recursive {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
 grams as (
  select distinct rid, array_to_string(ws[i:i + 3], ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 2)) as i from words where len(ws) >= 4)
  union all select rid, array_to_string(ws, ' ') || ' ' || len(ws) from words where len(ws) between 1 and 3),
 sizes as (select rid, count(*) as n from grams group by rid),
 pairs as (select a.rid as x, b.rid as y, count(*) as n from grams a join grams b on a.g = b.g and a.rid <> b.rid group by 1, 2),
 links as (select x, y from pairs join sizes s on s.rid = x join sizes t on t.rid = y where 100 * pairs.n >= 85 * (s.n + t.n - pairs.n)),
 reach(x, y) as (select rid, rid from words union select reach.x, links.y from reach join links on reach.y = links.x)
select w.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, r.component_id
from words w left join sizes s using (rid) join (select x, min(o.doc_id) as component_id from reach join words o on o.rid = y group by x) r on r.x = w.rid"""

_OP8 = f"""with {_WORDS.format(text="coalesce(text, '')")},
 windows as (select rid, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select rid, ws, unnest(range(1, len(ws) - 33)) as i from words where len(ws) >= 35)),
 gone as (select rid, list(distinct j) as js from (
   select rid, unnest(range(i, i + 35)) as j from windows where h in (select h from windows group by h having count(*) > 1)) group by rid),
 kept as (select doc_id, ws, case when js is null then ws else list_filter(ws, lambda x, k: not list_contains(js, k)) end as ks from words left join gone using (rid))
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - len(ks) as bigint) as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256 from kept"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

_OP13 = f"""with docs as (select row_number() over () as rid, doc_id, {_TERMS} as ws from documents),
 items as (select row_number() over () as item, item_id, {_TERMS} as ws from benchmark),
 n as (select count(*) filter (len(ws) > 0) as n_docs, cast(sum(len(ws)) as bigint) as n_terms from docs),
 m as (select rid, doc_id, 100 - 75 + (75 * len(ws) * n_docs) // n_terms as m from docs, n where len(ws) > 0),
 tf as (select rid, t, count(*) as tf from (select rid, unnest(ws) as t from docs) group by rid, t),
 w as (select t, cast(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, n group by t),
 asked as (select item, t, count(*) as times from (select item, unnest(ws) as t from items) group by item, t),
 scored as (
  select item, rid, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join w using (t) join tf using (t) join m using (rid) group by item, rid),
 ranked as (select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from scored join m using (rid) where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked join items using (item) where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; hashes, models and searches of the others are tested against brute force."""
    return {"op6_ngram_jaccard": _OP6, "op8_substring_dedup": _OP8, "op13_lexical_search": _OP13}
