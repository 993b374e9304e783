"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, quality_rules as q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, {WORDS} w from documents),
chars as (select rid, list_transform(string_split(t, ''), lambda x: unicode(x)::bigint) c from d where length(t) > 2),
tri as (select rid, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * {q.MUL_1} + c[i + 1] * {q.MUL_2} + c[i + 2]) % {q.BUCKETS})) b from chars),
trusted as (select doc_id from (select distinct doc_id from labels where quality = 1 and doc_id is not null) order by md5(doc_id::varchar), doc_id limit {q.MAX_TRUSTED}),
counts as (select b, count(*) r, count(*) filter (d.doc_id in (select doc_id from trusted)) t from tri join d using (rid) group by b),
total as (select sum(r) nr, sum(t) nt from counts),
ratio as (select b, case when nt = 0 then 0 else ln({q.TRUST} * (t / nt) / (r / nr) + {1 - q.TRUST}) end v from counts, total),
score as (select rid, avg(v) score from tri join ratio using (b) group by rid),
pos as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select rid, w, unnest(range(1, len(w) - 1)) i from d)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) n from pos) where n > 1),
rep as (select rid, count(distinct i + k) n from again, (values (0), (1), (2)) v(k) group by rid),
lines as (select rid, count(*) - count(distinct l) n from (select rid, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
base as (select d.rid, doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(lines.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(score, 0) score
  from d left join lines using (rid) left join rep using (rid) left join score using (rid)),
failed as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and score >= {q.THRESHOLD} kept from failed
"""


OP2 = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, h, octet_length(encode(h))::bigint payload_bytes, sha1(h) x from p),
b as (select *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(x, i::bigint + 1, 1)) - 1) n from d),
o as (select *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((n[1 + (5 * k) // 4] * 16 + coalesce(n[2 + (5 * k) // 4], 0)) // [8, 4, 2, 1][1 + k % 4]) % 32)::bigint, 1)), '') payload_digest from b),
m as (select *, max(page_id) over (partition by h) w from o)
select page_id, payload_bytes, payload_digest, case when page_id = w then 'response' else 'revisit' end record_type, case when page_id = w then null else w end refers_to from m
"""


SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

OP3 = f"""
with t(k, name, text) as (values {", ".join("(%d, '%s', '%s')" % (k, n, x.replace("'", "''")) for k, (n, x) in enumerate(licenses.TEMPLATES))}),
tw as (select k, name, {SPLIT} w from t),
ts as (select distinct k, name, array_to_string(w[i : i + 4], ' ') s from (select k, name, w, unnest(range(1, greatest(len(w) - 3, 2))) i from tw)),
tn as (select k, count(*) n from ts group by k),
d as (select row_number() over () rid, doc_id, {SPLIT} w from documents),
ds as (select distinct rid, array_to_string(w[i : i + 4], ' ') s from (select rid, w, unnest(range(1, len(w) - 3)) i from d)),
m as (select rid, k, name, count(*) c from ds join ts using (s) group by all),
f as (select distinct rid, name from m join tn using (k) where c >= {licenses.CONTAINED} * n),
g as (select rid, count(*) n, string_agg(name, ',' order by name) l from f group by rid)
select doc_id, coalesce(n, 0)::bigint n_licenses, coalesce(l, '') licenses from d left join g using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_warc": OP2, "op3_licenses": OP3}
