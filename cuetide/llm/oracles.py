"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of ten words, or a short item's only one, as texts; a document's windows of each length are joined to them.
DECONTAMINATION = rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bs as (select item, w, least(10, len(w)) as size from bw where len(w) > 0),
bk as (select distinct item, size, array_to_string(w[k + 1 : k + size], ' ') as t from (select *, unnest(range(len(w) - size + 1)) as k from bs)),
sizes as (select distinct size from bk),
dk as (select doc_id, size, k, array_to_string(w[k + 1 : k + size], ' ') as t from (select doc_id, w, size, unnest(range(greatest(len(w) - size + 1, 0))) as k from dw, sizes)),
hits as (select doc_id, item, k, dk.size from dk join bk on bk.size = dk.size and bk.t = dk.t),
places as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(k, k + size)) as p from hits) group by 1),
items as (select doc_id, count(item) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hits) group by 1)
select dw.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, n_hit is not null as contaminated
from dw left join places using (doc_id) left join items using (doc_id)
"""

#: Windows of fifty words as texts, and the smallest document that has each.
SUBSTRING = r"""
with dw as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, k, array_to_string(w[k + 1 : k + 50], ' ') as t from (select doc_id, w, unnest(range(greatest(len(w) - 49, 0))) as k from dw)),
first as (select t, min(doc_id) as least from win group by 1),
bad as (select distinct doc_id, unnest(range(k, k + 50)) as p from win join first using (t) where win.doc_id > least),
words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from dw),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as kept, count(*) as n from words anti join bad on bad.doc_id = words.doc_id and bad.p = words.p group by 1)
select dw.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from dw left join kept using (doc_id)
"""

#: SHA-1 in base 32: each five hexadecimal digits are four digits of base 32.
WARC = """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
c as (select *, list_transform(range(8), lambda i: list_sum(list_transform(range(5), lambda j: (instr('0123456789abcdef', substr(h, i::int * 5 + j::int + 1, 1)) - 1) * (16 ** (4 - j))::bigint))::bigint) as v from p),
d as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(i // 4 + 1)::int] // (32 ** (3 - i % 4))::bigint) % 32)::int + 1, 1)), '') as digest from c),
m as (select body, max(page_id) as top from p group by 1)
select page_id, octet_length(encode(body)) as payload_bytes, digest as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to, null::varchar as fault
from d join m using (body)
"""

#: Phrases as texts, every cut of them, and what longer phrases hold.
COLLOCATIONS = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
totals as (select lang, sum(len(w))::bigint as n from w group by 1),
sized as (select lang, w, unnest(range(1, 6)) as size from w),
g as (select lang, size, w[i + 1 : i + size] as g from (select *, unnest(range(len(w) - size + 1)) as i from sized where len(w) >= size)),
f as (select lang, size, g, count(*) as f from g group by all having count(*) >= 100),
cuts as (select lang, size, g, f as a, unnest(range(1, size)) as k from f where size >= 2),
parts as (select c.*, l.f as l, r.f as r, n, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score from cuts c join f l on l.lang = c.lang and l.g = c.g[1:c.k] join f r on r.lang = c.lang and r.g = c.g[c.k + 1:] join totals t on t.lang = c.lang),
best as (select * from parts qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_sizes as (select lang, g, size, f, unnest(range(2, size)) as s from f where size > 2),
inner_g as (select lang, g[i + 1 : i + s] as g, max(f) as f from (select *, unnest(range(size - s + 1)) as i from inner_sizes) group by all),
kept as (select b.*, array_to_string(b.g, ' ') as phrase from best b left join inner_g i on i.lang = b.lang and i.g = b.g where i.f is null or 100 * i.f < 100 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""

#: Lines as texts, in place of their hashes.
LINES = r"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from t),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as top from k where length(key) >= 40 group by 1 having count(distinct doc_id) >= 5),
m as (select k.*, f.key is not null and doc_id <> top as lost from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256 from m group by 1
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as two steps: every part against every entry, and the means."""
    steps = [
        "k as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"p as (select vec_id, label, part, v[(part * (len(v) // {parts}) + 1)::int : ((part + 1) * (len(v) // {parts}))::int] as v from k, range({parts}) as parts(part))",
        f"c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from p qualify row_number() over (partition by part order by vec_id) <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as (select p.vec_id, p.label, p.part, any_value(p.v) as v, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := entry)) as b from p join c{r} c on c.part = p.part group by 1, 2, 3)")
        if r < rounds:
            steps.append(f"u{r} as (select part, b.e as entry, unnest(v) as x, unnest(range(len(v))) as i from a{r})")
            steps.append(f"m{r} as (select part, entry, list(x order by i) as v from (select part, entry, i, floor(sum(x)::double / count(*))::bigint as x from u{r} group by 1, 2, 3) group by 1, 2)")
            steps.append(f"c{r + 1} as (select c.part, c.entry, coalesce(m.v, c.v) as v from c{r} c left join m{r} m on m.part = c.part and m.entry = c.entry)")
    steps.append(f"books as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds})")
    steps.append(f"rows as (select vec_id, label, string_agg(format('{{:02x}}', b.e), '' order by part) as code, sum(b.d)::bigint as error from a{rounds} group by 1, 2)")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from rows, books"


VECTOR_CODES = _vector_codes()
