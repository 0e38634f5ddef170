"""SQL for the queries that SQL can express at the size of the correctness check."""

from __future__ import annotations

from . import mixing

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""with recursive w as (select doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end) as s from w),
n as (select doc_id, count(*) as n from g group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from g a join g b on a.s = b.s and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach as (select doc_id as d, doc_id as r from documents union select l.a, reach.r from reach join links l on l.b = reach.d where reach.r < l.a)
select doc_id, coalesce(n, 0) as n_shingles, component_id from documents left join n using (doc_id) join (select d, min(r) as component_id from reach group by d) on d = doc_id"""

CHAT = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length(role) + 24 + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) as bigint) as formatted_chars
from c group by conv_id"""

MIXING = f"""with d as (select doc_id, source, cast(len({WORDS.format("coalesce(text, '')")}) as bigint) as size from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, [{", ".join(map(str, mixing.WEIGHTS))}][cast((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1 as integer)] as weight from s0),
s2 as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
  coalesce(sum(source_size) over f, 0) as filled, coalesce(sum(weight) over f, 0) as filled_weight
  from s1 window f as (order by source_size / cast(weight as double), source nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select *, cast({mixing.SHARE_PERCENT} * total - {100 * mixing.CAP} * filled as double) / (100.0::double * (weights - filled_weight)) as level from s2),
s4 as (select *, level * weight > {mixing.CAP} * source_size as is_full from s3),
s5 as (select *, (select level from s4 where not is_full order by filled_weight limit 1) as open_level from s4),
t as (select source, source_size, case when is_full then cast({mixing.CAP} * source_size as double) else least(weight * open_level, cast({mixing.CAP} * source_size as double)) end as target,
  cast('0x' || substr(md5('{mixing.SEED}' || coalesce('=' || source, 'null')), 1, 8) as bigint) / 4294967296.0::double as shift from s5),
r as (select d.*, t.source_size, t.target, t.shift, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
  row_number() over (partition by d.source order by d.size, d.doc_id) as k from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(floor(k * rate + shift) - floor((k - 1) * rate + shift) as bigint) * size as taken from r"""

SUBSTRINGS = f"""with w as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
p as (select doc_id, unnest(generate_series(1, len(w) - 12)) as i, w from w where len(w) >= 13),
q as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as s from p),
m as (select doc_id, i, min(doc_id) over (partition by s) as low from q),
gone as (select distinct doc_id, unnest(generate_series(i, i + 12)) as i from m where low < doc_id),
ws as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from w),
k as (select ws.doc_id, ws.i, ws.word, g.i is not null as removed from ws left join gone g on g.doc_id = ws.doc_id and g.i = ws.i),
a as (select doc_id, count(*) as n_words, count(*) filter (where removed) as n_removed, string_agg(word, ' ' order by i) filter (where not removed) as kept from k group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join a using (doc_id)"""

NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, a.label = b.label as same, b.vec_id as b, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b as p, score as ps from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.p, p.ps, s.b, s.score, row_number() over (partition by p.a, p.p order by s.score desc, s.b) as rank
  from p join s on s.a = p.a and not s.same and 50 * p.ps <= 100 * s.score and 100 * s.score <= 95 * p.ps)
select a as anchor_id, p as positive_id, cast(rank as integer) as rank, b as negative_id, ps as positive_score, score as negative_score from n where rank <= 3"""

ORACLE_SQL = {"op11_hard_negatives": NEGATIVES, "op3_jaccard_join": JACCARD, "op4_chat_formatting": CHAT, "op7_source_mixing": MIXING, "op10_substring_dedup": SUBSTRINGS}
