"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import chat, fingerprint, mixing, near_join, packing, passages, quality_model, quality_rules, secret_scan, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_secret_scan": secret_scan.query,
        "op3_mixing": mixing.query,
        "op4_passages": passages.query,
        "op5_near_join": near_join.query,
        "op6_fingerprint": fingerprint.query,
        "op7_packing": packing.query,
        "op8_quality_model": quality_model.query,
        "op9_chat": chat.query,
        "op10_toxicity": toxicity.query,
    }


#: Every pair of distinct texts by its shared shingles, and classes by reachability.
NEAR_JOIN = r"""
with recursive
  texts as (select text, min(doc_id) node, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents where doc_id is not null group by text),
  sh as (select distinct node, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
           else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from texts),
  n as (select node, count(*) n from sh group by node),
  meet as (select a.node a, b.node b, count(*) c from sh a join sh b on a.s = b.s and a.node < b.node group by all),
  link as (select a, b from meet join n x on x.node = a join n y on y.node = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
  edge as (select a, b from link union all select b, a from link),
  reach(node, root) as (select node, node from texts union select b, root from reach join edge on a = node),
  class as (select node, min(root) class_id from reach group by node),
  degree as (select a node, count(*) n_links from edge group by a)
select d.doc_id, class_id, coalesce(n_links, 0) n_links
from (select distinct doc_id, text from documents where doc_id is not null) d
join texts t on d.text is not distinct from t.text join class using (node) left join degree using (node)
"""

#: Sources by rising ratio of cap and weight: those below the level of the water are capped. Documents fill a source's fraction in the order of their hash.
MIXING = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size, md5('0:' || coalesce(cast(doc_id as varchar), '')) h from documents),
  s as (select source, cast(sum(size) as bigint) source_size, 2 * cast(sum(size) as bigint) cap, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by source),
  b as (select *, sum(source_size) over () * 3 budget2, cap / w ratio from s),
  o as (select *, sum(w) over (order by ratio, source rows between current row and unbounded following) rest,
          budget2 - 2 * coalesce(sum(cap) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0) left2 from b),
  c as (select *, 2 * cap * rest < left2 * w capped from o),
  t as (select *, budget2 - 2 * coalesce(sum(cap) filter (where capped) over (), 0) open2, coalesce(sum(w) filter (where not capped) over (), 0) open_w from c),
  f as (select source, source_size, case when capped then cap::double else (open2 * w)::double / (2 * open_w) end target,
          case when source_size = 0 then 0 when capped then 2 else cast(open2 * w // (2 * open_w * source_size) as bigint) end whole,
          case when capped or source_size = 0 then 0 else cast((open2 * w) // (2 * open_w) as bigint) end words from t),
  p as (select d.*, source_size, target, whole, words - whole * source_size part,
          coalesce(sum(size) over (partition by d.source order by h, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) before
        from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, target, cast(whole * size + case when whole < 2 then greatest(0, least(size, part - before)) else 0 end as bigint) as taken from p
"""

#: Digests of the turns as they are, and the length that the template gives the examples.
CHAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
  p as (select *, length(text) + length(text) - length(replace(text, '\', ''))
          + len(regexp_extract_all(replace(text, '\', '\\'), '<s>|</s>|\[/?SYS\]|\[/?INST\]|\[ANS\]|\[/?ROLE\]|\[/TURN\]'))
          + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 9 else 20 + length(role) end n from t),
  x as (select *, 3 + sum(n) over (partition by conv_id order by turn) up_to, row_number() over (partition by conv_id order by turn desc) from_end from p)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(up_to) filter (where role = 'assistant' or from_end = 1) as bigint) as formatted_chars
from x group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING, "op5_near_join": NEAR_JOIN, "op9_chat": CHAT}
