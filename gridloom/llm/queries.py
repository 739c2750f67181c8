"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .counts import op11_count_rtree
from .forest import op7_prefix_forest
from .middles import op12_scatter_middle
from .outliers import op2_mcd_outliers
from .packing import op8_vector_best_fit
from .phrases import op13_trie_collocations
from .pieces import op5_sentencepiece
from .quality import op1_ordinal_quality
from .sharding import op6_jump_shards
from .simhash import op9_simhash_links
from .templates import op3_template_text
from .urls import op10_association_urls
from .warc import op4_warc_salvage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ordinal_quality,
        op2_mcd_outliers,
        op3_template_text,
        op4_warc_salvage,
        op5_sentencepiece,
        op6_jump_shards,
        op7_prefix_forest,
        op8_vector_best_fit,
        op9_simhash_links,
        op10_association_urls,
        op11_count_rtree,
        op12_scatter_middle,
        op13_trie_collocations,
    )
}

#: Base32 of a SHA-1: every five hex digits are four letters.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(digest, cast(5 * (i // 4) + 1 as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31 as int) + 1, 1)), '')"

SQL: dict[str, str] = {
    "op4_warc_salvage": f"""with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as digest from pages), k as (select digest, max(page_id) as kept from p group by 1)
 select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, {_BASE32} as payload_digest, case when page_id <> kept then 'revisit' else 'response' end as record_type, case when page_id <> kept then kept end as refers_to from p join k using (digest)""",
    "op12_scatter_middle": """with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens, sha256('1:' || cast(doc_id as varchar)) as h from documents),
 d as (select doc_id, text, tokens, cast(len(tokens) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from t),
 c as (select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as p, greatest(h1 % (n + 1), h2 % (n + 1)) as q, tokens, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
 s as (select doc_id, text, n, form, array_to_string(tokens[1:p], '') as prefix, array_to_string(tokens[p + 1:q], '') as middle, array_to_string(tokens[q + 1:n], '') as suffix from c)
 select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from s""",
    "op13_trie_collocations": r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
 g as (select lang, len(words) as size, unnest(range(1, cast(len(words) as bigint) + 1)) as i, words from w),
 f1 as (select lang, words[i] as x, count(*) as f from g group by 1, 2),
 n as (select lang, cast(sum(f) as bigint) as n from f1 group by 1),
 f2 as (select lang, words[i] as x, words[i + 1] as y, count(*) as a from g where i < size group by 1, 2, 3 having count(*) >= 10),
 f3 as (select lang, words[i] as x, words[i + 1] as y, words[i + 2] as z, count(*) as a from g where i + 1 < size group by 1, 2, 3, 4 having count(*) >= 10),
 o as (select lang, x, y, max(a) as longer from (select lang, x, y, a from f3 union all select lang, y, z, a from f3) group by 1, 2, 3),
 two as (select f2.lang, f2.x || ' ' || f2.y as phrase, f2.a, l.f as l, r.f as r, 1000000::hugeint * f2.a * f2.a // (l.f::hugeint * r.f) as score from f2 join f1 l on l.lang = f2.lang and l.x = f2.x join f1 r on r.lang = f2.lang and r.x = f2.y left join o on o.lang = f2.lang and o.x = f2.x and o.y = f2.y where o.longer is null or 100 * o.longer < 50 * f2.a),
 cut as (select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z as phrase, f3.a, a1.f as l1, b1.a as r1, a2.a as l2, b2.f as r2, 1000000::hugeint * f3.a * f3.a // (a1.f::hugeint * b1.a) as s1, 1000000::hugeint * f3.a * f3.a // (a2.a::hugeint * b2.f) as s2
  from f3 join f1 a1 on a1.lang = f3.lang and a1.x = f3.x join f2 b1 on b1.lang = f3.lang and b1.x = f3.y and b1.y = f3.z join f2 a2 on a2.lang = f3.lang and a2.x = f3.x and a2.y = f3.y join f1 b2 on b2.lang = f3.lang and b2.x = f3.z),
 al as (select * from two union all select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from cut),
 k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from al)
 select k.lang, rank, phrase, a, l, r, n.n, cast(score as bigint) as score from k join n on n.lang = k.lang where rank <= 2000""",
}
