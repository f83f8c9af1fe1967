"""DuckDB SQL with the results of those registered queries that SQL can express, written from their contracts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CRLF = "chr(13)||chr(10)"
_UUID = "'<urn:uuid:'||h[1:8]||'-'||h[9:12]||'-'||h[13:16]||'-'||h[17:20]||'-'||h[21:32]||'>'"


def _uuid(text: str) -> str:
    return _UUID.replace("h[", f"sha256({text})[")


def _plain(html: str) -> str:
    out = rf"regexp_replace({html}, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"
    out = rf"regexp_replace({out}, '[\r\n]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|title|body|head|html)\b[^>]*>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '<[a-zA-Z/!][^>]*>', '', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    out = rf"regexp_replace({out}, '[ \t\x0B\f]+', ' ', 'g')"
    return rf"trim(regexp_replace({out}, ' ?\n[ \n]*', chr(10), 'g'), ' '||chr(10))"


OP1 = rf"""with s as (select page_id, coalesce(url, '') uri, coalesce(html, '') body from pages),
b as (select page_id, uri, body, {_uuid("'response|'||coalesce(page_id::varchar, '')||'|'||uri")} source_id,
        'Content-Length: '||strlen(body)::varchar size_line from s),
r as (select *, 'sha256:'||sha256('HTTP/1.1 200 OK'||{_CRLF}||'Content-Type: text/html; charset=utf-8'||{_CRLF}||size_line||{_CRLF}||{_CRLF}||body) source_digest,
        'sha256:'||sha256(body) payload_digest from b),
k as (select *, 'metadata' warc_type, 'application/warc-fields' content_type,
        'http-status: HTTP/1.1 200 OK'||{_CRLF}||'http-header: Content-Type: text/html; charset=utf-8'||{_CRLF}||'http-header: '||size_line||{_CRLF}
        ||'source-block-digest: '||source_digest||{_CRLF}||'source-payload-digest: '||payload_digest||{_CRLF} block from r
      union all select *, 'conversion', 'text/plain; charset=utf-8', {_plain("body")} from r)
select page_id, warc_type, {_uuid("warc_type||'|'||source_id")} record_id, source_id refers_to, uri target_uri, content_type, strlen(block)::bigint content_length,
  'sha256:'||sha256(block) block_digest, source_digest, payload_digest from k"""

#: Lines with the number of sites they stand on and their first document.
LINES = r"""lines as (select doc_id, text, coalesce('s'||source, 'none') site, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
spread as (select line, count(distinct site) sites, min(doc_id) first from lines where translate(line, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') <> '' group by line),
judged as (select l.*, coalesce(s.sites >= 8 and l.doc_id is distinct from s.first, false) gone from lines l left join spread s on l.line = s.line)"""

OP5 = rf"""with {LINES},
kept as (select doc_id, text, count(*) n_lines, sum(gone::int) n_removed, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') kept from judged group by doc_id, text)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, sha256(kept) text_sha256
from documents d left join kept k on d.doc_id is not distinct from k.doc_id and d.text = k.text"""


def contaminated(documents: str) -> str:
    """CTEs up to `hits` (doc_id, i, j: hit words) for a relation with doc_id and text."""
    words = lambda text: rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""iw as (select item_id, {words("text")} w from benchmark where text is not null),
im as (select *, least(10, len(w)) m from iw where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i:i+m-1], ' ') t from (select *, unnest(range(1, len(w)-m+2)) i from im)),
dw as (select doc_id, coalesce({words("text")}, []) w from {documents}),
dwin as (select doc_id, m, i, array_to_string(w[i:i+m-1], ' ') t from (select doc_id, w, m, unnest(range(1, len(w)-m+2)) i from dw, (select distinct m from im) where len(w) >= m)),
hits as (select doc_id, item_id, i, dwin.m from dwin join win on dwin.m = win.m and dwin.t = win.t)"""


OP6 = f"""with {contaminated("documents")},
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i+m)) p from hits) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) items from hits group by doc_id)
select dw.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join pos using (doc_id) left join its using (doc_id)"""


def linked(documents: str) -> str:
    """CTEs up to `comp` (doc_id, component_id) and `sized` (doc_id, n) for a relation with doc_id and text."""
    return rf"""sw as (select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') w from {documents} where text is not null),
sh as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i+4], ' ') end s
       from (select doc_id, w, unnest(range(1, greatest(len(w)-4, 1)+1)) i from sw where len(w) > 0)),
sized as (select doc_id, count(*) n from sh group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) o from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sized x on a = x.doc_id join sized y on b = y.doc_id where 100 * o >= 80 * (x.n + y.n - o)),
reach as (select doc_id, doc_id as r from {documents} union select doc_id, case when r = a then b else a end from reach join links on r = a or r = b),
comp as (select doc_id, min(r) component_id from reach group by doc_id)"""


OP8 = f"""with recursive {linked("documents")}
select d.doc_id, coalesce(n, 0)::bigint n_shingles, component_id from documents d join comp using (doc_id) left join sized using (doc_id)"""


def _level(name: str, keys: str, groups: str, above: str) -> str:
    """Counts of a level, its prior strength, and per group the posterior."""
    return f"""{name}_m as (select sum(n)::double n, sum(k)::double k, count(*) g, sum(k*k/n::double) s, sum(n*n)::double q from {groups}),
{name}_s as (select 1/least(0.5, greatest(0.001, coalesce(case when k/n*(1-k/n) > 0 then (s-n*(k/n)*(k/n)-k/n*(1-k/n)*(g-1))/(k/n*(1-k/n)*(n-q/n-(g-1))) end, 0.5)))-1 as s, coalesce(k/n, 0.5) p from {name}_m),
{name}_p as (select h.*, {name}_s.s*{above}+coalesce(c.k, 0) {name}_a, {name}_s.s*(1-{above})+coalesce(c.n, 0)-coalesce(c.k, 0) {name}_b, coalesce(c.n, 0) {name}_n, coalesce(c.k, 0) {name}_k"""


OP9 = rf"""with u as (select page_id, coalesce(url, '') url from pages),
r as (select page_id, case when contains(url, '://') then substring(url, instr(url, '://')+3) end rest from u),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') host, coalesce(regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*'))+1), '^[^?#]*'), '') path from r),
d as (select *, case when host like '%.%' then regexp_extract(host, '[^.]*\.[^.]*$') else host end dom, regexp_extract(host, '[^.]*$') suf from h),
c as (select suf, dom, host, count(*) n, sum(quality) k from d join labels on page_id = doc_id where quality is not null group by all),
cd as (select suf, dom, sum(n) n, sum(k) k from c group by all),
cs as (select suf, sum(n) n, sum(k) k from c group by all),
hosts as (select distinct host, dom, suf from d),
{_level("x", "suf", "cs", "x_s.p")} from hosts h cross join x_s left join cs c using (suf)),
{_level("y", "dom", "cd", "(x_a/(x_a+x_b))")} from x_p h cross join y_s left join cd c using (suf, dom)),
{_level("z", "host", "c", "(y_a/(y_a+y_b))")} from y_p h cross join z_s left join c c using (suf, dom, host)),
j as (select host, z_n, z_k, z_a/(z_a+z_b)-sqrt(z_a*z_b/((z_a+z_b)*(z_a+z_b)*(z_a+z_b+1))) bound from z_p),
rules(verdict, rh, rp) as (values ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
best as (select page_id, arg_max(rh||rp, length(rh||rp)) rule, arg_max(verdict, length(rh||rp)) verdict from d join rules on (host = rh or ends_with(host, '.'||rh)) and starts_with(path, rp) group by page_id)
select d.page_id, d.host, d.path, b.rule, coalesce(b.verdict, case when bound >= 0.5 then 'allow' else 'block' end) verdict, z_n::bigint labelled, z_k::bigint good
from d join j using (host) left join best b using (page_id)"""

_MARKS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>")


def _broken(text: str) -> str:
    out = f"replace({text}, chr(57344), chr(57344)||'0')"
    for mark in _MARKS:
        out = f"replace({out}, '{mark}', '{mark[0]}'||chr(57344)||'{mark[1:]}')"
    return out


OP10 = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
  sum(length({_broken("text")}) + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 26 + length({_broken("role")}) end)::bigint formatted_chars
from c group by conv_id"""

def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_CRC = "[" + ",".join(str(_crc_entry(byte)) for byte in range(256)) + "]"
_LETTERS = "A-Za-zÀ-ÿ"

#: CRC-32 byte by byte; near words share a string with one code point left out (at the same place, or one is the string itself).
OP11 = rf"""with recursive runs as (select coalesce(doc_id::varchar, '')||':' id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{_LETTERS}]+')) run from documents),
counted as (select id, run, count(*) c from runs group by all),
bytes as (select *, flatten(list_transform(string_split(id||run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] end)) b from counted),
hashed as (select run, c, xor(list_reduce([4294967295]||b, lambda h, x: xor(h >> 8, t.crc[(xor(h, x) & 255) + 1])), 4294967295) h from bytes, (select {_CRC}::bigint[] crc) t),
spoilt as (select case when h % 97 = 0 then run[:h % length(run)]||run[h % length(run) + 2:] else run end word, c from hashed),
vocab as (select word, sum(c)::bigint n from spoilt where length(word) >= 5 group by word having sum(c) >= 3),
cut as (select word, n, i, word[:i-1]||word[i+1:] rest from (select *, unnest(range(1, length(word) + 1)) i from vocab)),
pairs as (select a.word, a.n, b.word near, b.n m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, c.n, v.word, v.n from cut c join vocab v on c.rest = v.word union select v.word, v.n, c.word, c.n from cut c join vocab v on c.rest = v.word),
best as (select word, count(*) n_near, max(m) m from pairs group by word),
formed as (select v.word, v.n, coalesce(b.n_near, 0)::bigint n_near, case when b.m >= 2 * v.n then (select min(near) from pairs p where p.word = v.word and p.m = b.m) end form,
  case when b.m >= 2 * v.n then b.m end form_n from vocab v left join best b using (word)),
led as (select word, word root from formed union select l.word, f.form from led l join formed f on f.word = l.root where f.form is not null),
ends as (select l.word, l.root from led l join formed f on f.word = l.root where f.form is null)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n from formed f join ends e using (word)"""

OP12 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) w, row_number() over () r from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, q.r, c.vec_id, case when len(q.w) > 0 then list_dot_product(q.w, c.w) else 0 end::bigint score from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r and len(q.w) = len(c.w)),
o as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) rank from s)
select query_id, rank::int rank, vec_id, score from o where rank <= 5"""

SQL = {
    "op1_warc_derivatives": OP1,
    "op5_line_spread": OP5,
    "op6_contamination": OP6,
    "op8_trie_join": OP8,
    "op9_host_reputation": OP9,
    "op10_chat_log": OP10,
    "op11_spelling_variants": OP11,
    "op12_approximation_file": OP12,
}
