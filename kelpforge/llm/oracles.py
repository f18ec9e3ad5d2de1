"""DuckDB SQL for the queries that SQL can express. All pairs are compared in it, so it suits small tables."""

from __future__ import annotations

#: The smallest node that links reach from each; expects the tables nodes(id) and links(a, b), both ways.
_REACH = """
reach(id, other) as (
  select id, id from nodes
  union
  select r.id, l.b from reach r join links l on l.a = r.other
)"""

SHARDING = """
with bytes as (
  select doc_id, strlen(coalesce(text, '')) + 1 as size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: (instr('123456789ABCDEF', x[1]) * 16 + instr('123456789ABCDEF', x[2]))::bigint) as b
  from documents
), crc_step as (
  -- the table of the reflected polynomial EDB88320 for four bits
  select list(c order by n) as t from (
    select n, list_reduce([n::bigint, 1, 1, 1, 1], lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(16) r(n))
), crcs as (
  select doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295::bigint], b), lambda c, x:
    xor(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) >> 4, t[(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) & 15) + 1]))) as text_crc32
  from bytes, crc_step
), summed as (
  select *, sum(size) over (order by doc_id rows unbounded preceding) - size as before, sum(size) over () as total from crcs
), placed as (
  select *, least(7, (2 * before + size) * 8 // (2 * total)) as s from summed
)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, s::int as shard,
  row_number() over (partition by s order by doc_id) - 1 as slot, null::int as grown_shard
from placed
"""

EMBEDDING_COPIES = f"""
with recursive sound as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select p.vec_id as a, q.vec_id as b from sound p join sound q on p.vec_id <> q.vec_id and len(p.v) = len(q.v) and list_cosine_similarity(p.v, q.v) >= 0.95
), nodes as (
  select vec_id as id from embeddings
), {_REACH.strip()}, roots as (
  select id, min(other) as component_id from reach group by id
)
select id as vec_id, (select count(*) from links where a = id) as n_links, component_id, id = component_id as kept from roots
"""

WARC = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages
), firsts as (
  select *, min(page_id) over (partition by digest) as first from payloads
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from firsts
"""

JACCARD = f"""
with recursive split as (
  select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), words as (
  select id, len(w) as n_words, unnest(w) as word, generate_subscripts(w, 1) as i from split
), runs as (
  select id, n_words, i, concat_ws(' ', word, lead(word, 1) over f, lead(word, 2) over f, lead(word, 3) over f, lead(word, 4) over f) as shingle
  from words window f as (partition by id order by i)
), kept as (
  select distinct id, shingle from runs where i <= greatest(1, n_words - 4)
), shingles as (
  select *, count(*) over (partition by id) as n from kept
), links as (
  select p.id as a, q.id as b from shingles p join shingles q on p.shingle = q.shingle and p.id <> q.id
  group by p.id, q.id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))
), nodes as (
  select id from split
), {_REACH.strip()}, roots as (
  select id, min(other) as component_id from reach group by id
)
select id as doc_id, (select count(*) from kept where kept.id = roots.id) as n_shingles, component_id from roots
"""

COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
  select lang, sum(len(w))::bigint as n from words group by lang
), phrases as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, range(1, 5) t(k) where len(w) >= k
), f as (
  select lang, k, phrase, count(*) as a from phrases group by lang, k, phrase
), candidates as (
  select *, string_split(phrase, ' ') as w from f where k > 1 and a >= 30
), within as (
  select lang, array_to_string(w[i + 1:i + m], ' ') as phrase, max(a) as over from candidates, range(2, 4) s(m), range(0, 3) t(i) where m < k and i + m <= k group by all
), kept as (
  select c.* from candidates c left join within w on w.lang = c.lang and w.phrase = c.phrase where w.over is null or 100 * w.over < 80 * c.a
), cuts as (
  select c.lang, c.phrase, c.a, j, p.a as l, q.a as r, (2000000::hugeint * c.a // (p.a + q.a))::bigint as score
  from kept c, range(1, 4) t(j), f p, f q
  where j < c.k and p.lang = c.lang and p.phrase = array_to_string(c.w[1:j], ' ') and q.lang = c.lang and q.phrase = array_to_string(c.w[j + 1:c.k], ' ')
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score
from lowest join totals using (lang) qualify rank <= 2000
"""

#: Six rounds of moving the codebooks' entries, written out.
_SOUND = """
with sound as materialized (
  select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select vec_id, (i - 1) // (len(v) // 8) as p, (i - 1) % (len(v) // 8) as i, floor(4096 * v[i])::bigint as x from (select vec_id, v, unnest(range(1, len(v) + 1)) as i from sound)
), book0 as materialized (
  select p, e, i, x from parts join (select vec_id, row_number() over (order by vec_id) - 1 as e from sound qualify e < 16) using (vec_id)
)"""

_ASSIGN = """, apart{k} as materialized (
  select vec_id, p, e, sum((parts.x - book{k}.x) * (parts.x - book{k}.x))::bigint as d from parts join book{k} using (p, i) group by vec_id, p, e
), assigned{k} as materialized (
  select * from apart{k} qualify row_number() over (partition by vec_id, p order by d, e) = 1
)"""

_MOVE = """, sums{k} as (
  select p, e, i, sum(x) as s, count(*) as n from assigned{k} join parts using (vec_id, p) group by p, e, i
), book{l} as materialized (
  select p, e, i, coalesce(((s - (s % n + n) % n) // n)::bigint, x) as x from book{k} left join sums{k} using (p, e, i)
)"""

_CODES = """
select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error, sum(sum(d)) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(x::varchar, ',' order by p, e, i)) from book6) as codebooks_sha256
from assigned6 join sound using (vec_id) group by vec_id, label
"""

VECTOR_CODES = _SOUND + "".join(_ASSIGN.format(k=k) + _MOVE.format(k=k, l=k + 1) for k in range(6)) + _ASSIGN.format(k=6) + _CODES

ORACLE_SQL = {"op1_sharding": SHARDING, "op3_embedding_copies": EMBEDDING_COPIES, "op6_warc": WARC, "op10_jaccard": JACCARD, "op11_collocations": COLLOCATIONS, "op13_vector_codes": VECTOR_CODES}
