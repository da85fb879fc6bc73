"""SQL for the queries that SQL can express. It lists pairs, so it is for small tables only."""

#: All sets that share a shingle are counted together, in place of regions; links are followed step by step.
JACCARD = r"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from words),
classes as (select s, min(doc_id) as id, len(s) as n from sets where len(s) > 0 group by s),
items as (select id, n, unnest(s) as x from classes),
common as (select a.id as a, b.id as b, any_value(a.n) + any_value(b.n) as n, count(*) as both_ from items a join items b on a.x = b.x and a.id < b.id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from common where 100 * both_ >= 90 * (n - both_)),
edges as (select a, b from links union all select b, a from links),
reach as (select id, id as r from classes union select e.b, reach.r from reach join edges e on e.a = reach.id),
first as (select id, min(r) as c from reach group by id)
select doc_id, len(sets.s) as n_shingles, coalesce(c, doc_id) as component_id, coalesce(id, doc_id) as class_id from sets left join classes on sets.s = classes.s left join first using (id)"""

#: The dynamic program forwards over turns, then back from the best end. State 1 is system, 2 user, 3 assistant.
CHAT = r"""with recursive t as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i, count(*) over (partition by conv_id) as n, case lower(trim(coalesce(role, ''))) when 'system' then 1 when 'user' then 2 when 'human' then 2 when 'prompter' then 2 when 'assistant' then 3 when 'gpt' then 3 when 'bot' then 3 when 'model' then 3 when 'ai' then 3 else 0 end as r from conversations),
steps as (select distinct conv_id, 0::bigint as i, 0::bigint as c0, 1000000000::bigint as c1, 1000000000::bigint as c2, 1000000000::bigint as c3, {'t': 0::bigint, 'w': 0, 's': 0} as b1, {'t': 0::bigint, 'w': 0, 's': 0} as b2, {'t': 0::bigint, 'w': 0, 's': 0} as b3 from t union all
 select conv_id, i, 1000000000, b1.t, b2.t, b3.t, b1, b2, b3 from (select p.conv_id, t.i,
 list_min([{'t': c0 + if(r = 1, 0, 3), 'w': 0, 's': 0}, {'t': c1 + if(r = 1, 0, 3) + 1, 'w': 1, 's': 1}]) as b1,
 list_min([{'t': c0 + if(r = 2, 0, 3), 'w': 0, 's': 0}, {'t': c1 + if(r = 2, 0, 3), 'w': 0, 's': 1}, {'t': c3 + if(r = 2, 0, 3), 'w': 0, 's': 3}, {'t': c2 + if(r = 2, 0, 3) + 1, 'w': 1, 's': 2}]) as b2,
 list_min([{'t': c2 + if(r = 3, 0, 3), 'w': 0, 's': 2}, {'t': c3 + if(r = 3, 0, 3) + 1, 'w': 1, 's': 3}, {'t': c0 + if(r = 3, 0, 3) + 2, 'w': 2, 's': 0}, {'t': c1 + if(r = 3, 0, 3) + 2, 'w': 2, 's': 1}]) as b3
 from steps p join t on t.conv_id is not distinct from p.conv_id and t.i = p.i + 1)),
path as (select s.conv_id, s.i, if(c2 <= c3, 2, 3) as q, if(c2 <= c3, b2, b3) as b from steps s join t on t.conv_id is not distinct from s.conv_id and t.i = s.i and t.i = t.n union all
 select p.conv_id, s.i, p.b.s, case p.b.s when 1 then b1 when 2 then b2 else b3 end from path p join steps s on s.conv_id is not distinct from p.conv_id and s.i = p.i - 1 and s.i > 0),
done as (select t.*, q, b.s as s, b.w as w, q = b.s as merged, b.w = 2 as filled from path p join t on t.conv_id is not distinct from p.conv_id and t.i = p.i)
select conv_id, turn, role, case when merged then 'merge' when q = r then 'keep' else 'relabel' end as action, ['system', 'user', 'assistant'][q] as role_out, case when filled then 'user' end as inserted, cast(w + if(q = r, 0, 3) as int) as cost, cast(sum(case when merged then 0 when filled then 2 else 1 end) over (partition by conv_id order by i) as bigint) - 1 as out_turn,
 case when merged then chr(10) else case when s > 0 then '<|end|>' || chr(10) else '' end || case when filled then '<|user|>' || chr(10) || '<|end|>' || chr(10) else '' end || '<|' || ['system', 'user', 'assistant'][q] || '|>' || chr(10) end || coalesce(text, '') || case when i = n then '<|end|>' || chr(10) else '' end as rendered from done"""

#: All pairs of a label are compared.
LATTICE = r"""with recursive v as (select vec_id, label, case when label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 then cast(embedding as double[]) end as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as id, vec_id as r from v union select l.b, reach.r from reach join links l on l.a = reach.id),
first as (select id, min(r) as c from reach group by id),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept from v join first on id = vec_id left join counts on a = vec_id"""

#: All documents that share a term with an item are scored.
RANKED = r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
size as (select count(*) as nn, cast(coalesce(sum(len(w)), 0) as bigint) as ll from d where len(w) > 0),
post as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by r, term),
asked as (select row_number() over () as q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
terms as (select q, unnest(t) as term from asked),
weight as (select term, cast(floor(1000 * ln((2.0 * nn + 2) / (2.0 * df + 1))) as bigint) as weight from (select term, count(*) as df from post group by term), size),
value as (select p.r, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * nn) // ll)) as v from post p join d on p.r = d.r, size where term in (select term from terms)),
scored as (select q, r, cast(sum(weight * v) as bigint) as score from terms join weight using (term) join value using (term) group by q, r having sum(weight * v) > 0),
placed as (select q, doc_id, score, cast(row_number() over (partition by q order by score desc, doc_id nulls last, r) as int) as rank from scored join d using (r))
select item_id, rank, doc_id, score from placed join asked using (q) where rank <= 50"""

ORACLE_SQL: dict[str, str] = {"op1_jaccard_join": JACCARD, "op2_chat_format": CHAT, "op3_lattice_dedup": LATTICE, "op12_ranked_search": RANKED}
