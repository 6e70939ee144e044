"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
         sha1(coalesce(html, '')) as payload_digest, sha256(coalesce(html, '')) as strong
  from pages),
best as (select strong, max(page_id) as top from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
       case when top is not null and page_id <> top then 'revisit' else 'response' end as record_type,
       case when page_id <> top then top end as refers_to
from p left join best using (strong)
"""

OP6 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') as ws from documents),
b as (select item_id::varchar as item_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') as ws
      from benchmark),
spot0 as (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as i from b where len(ws) > 0),
phrases as (select distinct item_id, list_slice(ws, i, i + 9) as w from spot0),
lengths as (select distinct len(w) as n from phrases),
spots as (select doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) as i from d, lengths where len(ws) >= n),
found as (select s.doc_id, s.i, s.n, p.item_id
          from spots s join phrases p on list_slice(s.ws, s.i, s.i + s.n - 1) = p.w and len(p.w) = s.n),
places as (select distinct doc_id, unnest(range(i, i + n)) as pos from found),
hits as (select doc_id, count(*) as n_hit from places group by 1),
items as (select doc_id, count(distinct item_id) as n_items,
                 string_agg(distinct item_id, ',' order by item_id) as names from found group by 1)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

OP7 = f"""
with n as (select doc_id, sha256({_LOWER.format('text')}) as text_sha256, {_LOWER.format('text')} as t
           from documents),
g as (select t, max(doc_id) as keep_id, count(*)::bigint as group_size from n group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from n join g using (t)
"""

OP8 = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
                  substr(md5('mix0:' || doc_id), 1, 16) as h from documents),
s as (select source, sum(size)::bigint as source_size,
             row_number() over (order by source nulls last) as k from d group by 1),
w as (select *, case (k - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
             (source_size * 3)::double as cap from s),
v as (select *, coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding),
                         0.0) as before,
             sum(w) over (order by cap / w, k rows between current row and unbounded following) as rest,
             (sum(source_size) over ())::double as total from w),
l as (select *, (total - before) / rest as level from v),
t as (select source, source_size, case when level >= cap / w then cap else
             max(case when level < cap / w then level end) over () * w end as target from l),
c as (select d.doc_id, d.size, t.source_size, t.target, round(t.target)::bigint as goal,
             sum(d.size) over (partition by d.source order by d.h, d.doc_id) - d.size as start
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size))
        + greatest(0, least(size, goal - start - 2 * source_size)))::bigint as taken
from c
"""

OP10 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
win_ as (select doc_id, i, list_slice(ws, i, i + 19) as w
        from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d where len(ws) >= 20)),
later as (select doc_id, i from (
            select doc_id, i, row_number() over (partition by w order by doc_id, i) as k from win_) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as pos from later),
toks as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from d),
kept as (select doc_id, count(g.pos)::bigint as n_removed,
                string_agg(word, ' ' order by w.pos) filter (where g.pos is null) as text
         from toks w left join gone g using (doc_id, pos) group by 1)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (doc_id)
"""

# crc32 from its polynomial: one table step a byte; letters of U+00C0-U+00FF are two bytes in UTF-8
_CRC_BYTE = "xor(c >> 8, t[(xor(c, {0}) & 255) + 1])"
OP13 = f"""
with recursive steps as (
  select i, list_reduce(list_prepend(i, range(8)),
                        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from range(256) r(i)),
tab as (select list(v order by i) as t from steps),
runs as (select doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) as run from documents),
pairs as (select coalesce(doc_id::varchar, '') || ':' || run as named, run, count(*) as c from runs group by all),
hashed as (
  select run, c, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(named, ''), lambda x: unicode(x)::bigint)),
           lambda c, x: case when x < 128 then {_CRC_BYTE.format('x')}
             else list_reduce([c, 195, x - 64], lambda c, x: {_CRC_BYTE.format('x')}) end)) as h
  from pairs, tab),
words as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint)
              || substr(run, (h % length(run))::bigint + 2) else run end as word, sum(c)::bigint as n
  from hashed group by 1 having sum(c) >= 3 and length(word) >= 5),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
        from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*)::bigint as n_near, max(n) as top, first(other order by n desc, other) as other
         from near group by 1),
forms as (select words.word, words.n, coalesce(n_near, 0) as n_near,
                 case when top >= 2 * words.n then other end as form,
                 case when top >= 2 * words.n then top end as form_n
          from words left join best using (word)),
chain as (select word, form as root, 1 as depth from forms where form is not null
          union all
          select c.word, f.form, c.depth + 1 from chain c join forms f on f.word = c.root
          where f.form is not null),
ends as (select word, arg_max(root, depth) as root from chain group by 1)
select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join ends using (word)
"""

ORACLE = {"op2_warc": OP2, "op6_decontamination": OP6, "op7_exact_dedup": OP7, "op8_mixing": OP8,
          "op10_substring_dedup": OP10, "op13_spelling_variants": OP13}
