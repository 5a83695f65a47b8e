"""DuckDB SQL that must give the rows of the queries, written from their contracts."""

ORACLES: dict[str, str] = {}

ORACLES["op9_decontamination"] = r"""
with words as (
  select doc_id, row_number() over () as r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
tests as (
  select cast(item_id as varchar) as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from tests where len(w) > 0)),
sizes as (select distinct size from windows),
places as (
  select r, size, i, array_to_string(w[i:i + size - 1], ' ') as win
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from words, sizes where len(w) >= size)),
hits as (select p.r, p.i, p.size, v.item from places p join windows v on p.size = v.size and p.win = v.win),
covered as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + size)) as x from hits) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (r) left join named using (r)
"""

ORACLES["op10_chat_formatting"] = r"""
with turns as (select distinct conv_id, turn, role, text from conversations),
ranked as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as rank from turns),
whole as (
  select conv_id, count(*) as n_turns,
         list(sha256(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-')) order by rank) as said
  from ranked group by conv_id),
once as (select min(conv_id) as conv_id, any_value(n_turns) as n_turns, count(*) as copies, said from whole group by said),
begun as (select distinct said[1:k] as said from (select said, unnest(range(1, n_turns)) as k from once)),
kept as (select o.* from once o anti join begun b on o.said = b.said)
select r.conv_id, k.n_turns, k.copies, r.rank,
       '<|im_start|>' || coalesce(role, 'user') || chr(10)
       || replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') || '<|im_end|>' || chr(10) as piece
from ranked r join kept k on r.conv_id = k.conv_id
"""

ORACLES["op5_jaccard_join"] = r"""
with recursive words as (
  select doc_id, row_number() over () as r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
grams as materialized (
  select distinct r, array_to_string(w[i:i + 2], ' ') as g
  from (select r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from words where len(w) > 0)),
sizes as materialized (select r, count(*) as n from grams group by r),
common as (select a.r as a, b.r as b, count(*) as c from grams a join grams b on a.g = b.g and a.r <> b.r group by a.r, b.r),
links as materialized (
  select a, b from common join sizes x on x.r = a join sizes y on y.r = b where 100 * c >= 90 * (x.n + y.n - c)),
reach as (
  select r as s, r as e from words union select reach.s, links.b from reach join links on links.a = reach.e),
lowest as (select s, min(doc_id) as component_id from reach join words on words.r = reach.e group by s)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from words left join sizes using (r) join lowest on lowest.s = words.r
"""

ORACLES["op1_one_bit_neighbours"] = r"""
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

_FINITE = """embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"""

ORACLES["op12_exact_top_k"] = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings where {_FINITE}),
s as (
  select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""

ORACLES["op13_hard_negatives"] = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where label is not null and {_FINITE}),
s as materialized (
  select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, cast(list_inner_product(a.e, v.e) as bigint) as score
  from v a join v on a.vec_id <> v.vec_id where a.vec_id % 50 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id)
  where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
