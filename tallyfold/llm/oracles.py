"""DuckDB SQL for the operators whose results it can give on whole tables."""

from __future__ import annotations

_PLAIN = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
with d as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_ALNUM}') w from documents),
b as (select item_id::varchar item, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_ALNUM}') w from benchmark),
p as (select distinct item, least(10, len(w)) m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') k
      from b, lateral (select unnest(range(1, len(w) - least(10, len(w)) + 2)) i) where len(w) > 0),
x as (select doc_id, i, l.m, array_to_string(w[i:i + l.m - 1], ' ') k from d, (select distinct m from p) l, lateral (select unnest(range(1, len(w) - l.m + 2)) i)),
h as (select x.doc_id, x.i, x.m, p.item from x join p on p.m = x.m and p.k = x.k),
c as (select doc_id, count(distinct j) n from h, lateral (select unnest(range(i, i + m)) j) group by 1),
t as (select doc_id, count(distinct item) n, string_agg(distinct item, ',' order by item) s from h group by 1)
select d.doc_id, len(w) n_words, coalesce(c.n, 0) n_hit, coalesce(t.n, 0) n_items, sha256(coalesce(t.s, '')) items_sha256, c.n is not null contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""

OP2 = f"""
with recursive d as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_PLAIN}') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') k from d, lateral (select unnest(range(1, len(w) - 1)) i)
      union select doc_id, array_to_string(w, ' ') from d where len(w) in (1, 2)),
n as (select doc_id, count(*) n from s group by 1),
m as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from m join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
e as (select x, y from l union select y, x from l),
r(node, seen) as (select doc_id, doc_id from d union select e.x, r.seen from r join e on e.y = r.node)
select d.doc_id, coalesce(n.n, 0) n_shingles, min(r.seen) component_id, min(r.seen) = d.doc_id kept
from d left join n using (doc_id) join r on r.node = d.doc_id group by d.doc_id, n.n
"""

OP6 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
c as (select doc_id, 500 * n o, substr(h, 1000 * n + 1, 1098) s from d, lateral (select unnest(range(0, (length(h) // 2 + 499) // 500)) n)),
x as (select doc_id, o + j i, substr(s, 2 * j + 1, 100) k from c, lateral (select unnest(range(0, least(500, length(s) // 2 - 49))) j)),
f as (select k, min(doc_id) m from x group by 1),
g as (select doc_id, i, i > 50 + lag(i, 1, -100) over (partition by doc_id order by i) apart from x join f using (k) where f.m < doc_id),
r as (select doc_id, i, sum(apart::int) over (partition by doc_id order by i) run from g),
s as (select doc_id, run, min(i) a, max(i) + 50 b from r group by 1, 2),
t as (select *, lag(b, 1, 0) over (partition by doc_id order by a) p from s),
k as (select doc_id, sum(b - a)::bigint n, count(*) o, max(b) e, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) kept from t join d using (doc_id) group by 1)
select d.doc_id, length(h) // 2 n_bytes, coalesce(k.n, 0) n_removed, coalesce(k.o, 0) n_spans,
       sha256(unhex(case when k.n is null then h else kept || substr(h, 2 * e + 1) end)) kept_sha256
from d left join k using (doc_id)
"""

OP9 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') w from documents),
x as (select doc_id, i, array_to_string(w[i:i + 19], ' ') k from d, lateral (select unnest(range(1, len(w) - 18)) i)),
f as (select k, min((doc_id, i)) m from x group by 1),
c as (select distinct doc_id, j from x join f using (k), lateral (select unnest(range(i, i + 20)) j) where (doc_id, i) > f.m),
r as (select doc_id, count(*) n from c group by 1),
k as (select d.doc_id, string_agg(w[p], ' ' order by p) s from d, lateral (select unnest(range(1, len(w) + 1)) p)
      where not exists (select 1 from c where c.doc_id = d.doc_id and c.j = p) group by 1)
select d.doc_id, len(w) n_words, coalesce(r.n, 0) n_removed, sha256(coalesce(k.s, '')) kept_sha256
from d left join r using (doc_id) left join k using (doc_id)
"""

OP11 = """
with recursive v as (select vec_id, row_number() over () r, case when len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                            and len(list_filter(embedding, lambda x: x <> 0)) > 0 then embedding::double[] end e from embeddings),
u as (select vec_id, r, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) e from v where e is not null),
l as (select a.r a, b.r b, a.vec_id x, b.vec_id y from u a join u b on a.r <> b.r and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) >= 0.9),
n as (select a, count(distinct y) n from l where x <> y group by 1),
c(r, seen) as (select r, vec_id from v union select l.a, c.seen from c join l on l.b = c.r)
select v.vec_id, coalesce(any_value(n.n), 0) n_links, min(c.seen) component_id, min(c.seen) = v.vec_id kept
from v left join n on n.a = v.r join c on c.r = v.r group by v.r, v.vec_id
"""


OP12 = f"""
with d as (select doc_id, regexp_extract_all({_FOLD.format("text")}, '{_ALNUM}') w from documents where text is not null),
s as (select count(*) docs, sum(len(w))::bigint words from d where len(w) > 0),
b as (select distinct item_id, unnest(regexp_extract_all({_FOLD.format("text")}, '{_ALNUM}')) t from benchmark where item_id is not null and text is not null),
x as (select row_number() over () r, doc_id, len(w) n, w from d),
p as (select r, any_value(doc_id) doc_id, any_value(n) n, t, count(*) tf from (select r, doc_id, n, unnest(w) t from x) where t in (select t from b) group by r, t),
w as (select t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint w from (select t, count(*) df from p group by t), s),
c as (select item_id, r, any_value(doc_id) doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::bigint score
      from b join p using (t) join w using (t), s where doc_id is not null group by 1, 2),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int rank, doc_id, score from c where score > 0)
select * from k where rank <= 10
"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Vector codes: a book of entries for each round, all in whole numbers (doubles hold the products exactly)."""
    own = f"c[q * len(c) // {parts} + 1:(q + 1) * len(c) // {parts}]"
    sql = f"""
with v as materialized (select row_number() over (order by vec_id) r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) c from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select r, vec_id, label, q, {own} s from v, range({parts}) t(q)),
b0 as materialized (select q, r - 1 e, s t from s where r <= {entries})"""
    for k in range(rounds + 1):
        sql += f""",
a{k} as materialized (select r, any_value(vec_id) vec_id, any_value(label) label, q, any_value(s) s, arg_min(e, (d, e)) e, min(d) d
    from (select r, vec_id, label, s.q, s, e, list_inner_product(s, s) - 2 * list_inner_product(s, t) + list_inner_product(t, t) d from s join b{k} b on b.q = s.q) group by r, q)"""
        if k < rounds:
            sql += f""",
m{k} as (select q, e, list(m order by i) t from (select q, e, i, floor(sum(s[i]) / count(*)) m from a{k}, lateral (select unnest(range(1, len(s) + 1)) i) group by 1, 2, 3) group by 1, 2),
b{k + 1} as materialized (select b.q, b.e, coalesce(m.t, b.t) t from b{k} b left join m{k} m on m.q = b.q and m.e = b.e)"""
    return sql + f""",
h as (select sha256(string_agg(x::bigint::varchar, ',' order by q, e, i)) h from (select q, e, i, t[i] x from b{rounds}, lateral (select unnest(range(1, len(t) + 1)) i))),
f as (select vec_id, label, string_agg(printf('%02x', e), '' order by q) code, sum(d)::bigint error from a{rounds} group by r, vec_id, label)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, h codebooks_sha256 from f, h
"""


ORACLES = {"op1_benchmark_decontamination": OP1, "op2_minhash_near_dedup": OP2, "op6_suffix_array_dedup": OP6, "op9_substring_dedup": OP9, "op11_embedding_near_dedup": OP11, "op12_ranked_search": OP12, "op13_vector_codes": _codes()}
