"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

from inventra.llm.rules import CUTOFFS, LENGTHS, LEVEL, RISK, RULES
from inventra.llm.shards import FACTOR, WORD

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

JACCARD_JOIN = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_WORDS}) as w from documents),
l as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as l from w),
n as (select doc_id, len(l) as n from l),
s as (select doc_id, unnest(l) as s from l),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
reach(id, other) as (select doc_id, doc_id from documents union select id, b from reach join link on other = a)
select n.doc_id, cast(n.n as bigint) as n_shingles, component_id from n join (select id, min(other) as component_id from reach group by 1) on id = n.doc_id
"""

# The checksum goes by half bytes, the lower one first, over a table of 16.
_NIBBLE = []
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLE.append(_c)
_STEP = "xor({c} >> 4, {t}[(xor({c}, {n}) & 15) + 1])"
_FIRST = _STEP.format(c="c", t=_NIBBLE, n="b")
_SECOND = _STEP.format(c=f"({_FIRST})", t=_NIBBLE, n="(b >> 4)")



def _crc(raw: str) -> str:
    """The unsigned checksum of a blob."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex({raw}), '..'), lambda s: ('0x' || s)::bigint)), lambda c, b: {_SECOND}))"


SHARDS = f"""
with recursive raw as (select doc_id, encode(coalesce(text, '')) as raw from documents),
own as (select doc_id, octet_length(raw) + 1 as size, {_crc("raw")} as text_crc32 from raw),
jump(doc_id, shards, state, shard, ahead) as (
 select distinct doc_id, shards, ((coalesce(doc_id, -1)::hugeint + {WORD}) % {WORD})::uhugeint, -1::bigint, 0::bigint from documents, (values (8), (9)) v(shards)
 union all
 select doc_id, shards, drawn, ahead, floor((ahead + 1)::double * (2147483648.0 / ((drawn // 8589934592) + 1)::double))::bigint from (select *, (state * {FACTOR}::uhugeint + 1::uhugeint) % {WORD}::uhugeint as drawn from jump where ahead < shards)),
landed as (select doc_id, shards, max(shard) as shard from jump group by 1, 2)
select o.doc_id, cast(size as bigint) as size, text_crc32, 'key' as law, cast(a.shard as int) as shard, row_number() over (partition by a.shard order by o.doc_id nulls first, text_crc32, size) - 1 as slot, cast(b.shard as int) as grown_shard
from own o join landed a on a.shards = 8 and a.doc_id is not distinct from o.doc_id join landed b on b.shards = 9 and b.doc_id is not distinct from o.doc_id
"""

REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
part as (select doc_id, 256 * k as begin, substr(h, 512 * k + 1, 610) as g from (select doc_id, h, unnest(range(0, len(h) // 512 + 1)) as k from d)),
w as (select doc_id, begin + i as p, md5(substr(g, 2 * i + 1, 100)) as w from (select doc_id, begin, g, unnest(range(0, least(256, len(g) // 2 - 49))) as i from part)),
least as (select w, min(doc_id) as first from w group by 1),
hit as (select doc_id, p, p > lag(p, 1, -1000) over (partition by doc_id order by p) + 50 as fresh from w join least using (w) where first < doc_id),
span as (select doc_id, min(p) as b, max(p) + 50 as e from (select *, count(*) filter (fresh) over (partition by doc_id order by p) as k from hit) group by doc_id, k),
piece as (select doc_id, b, e, lag(e, 1, 0) over (partition by doc_id order by b) as a from span),
cut as (select doc_id, sum(e - b) as removed, count(*) as spans, max(e) as last, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by b) as kept from piece join d using (doc_id) group by 1)
select doc_id, len(h) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join cut using (doc_id)
"""

_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_NEED = f"ceil(ln({LEVEL} / (m * {len(RULES)})) / ln(1 - {RISK}))"
_TAIL = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))"

RULES_SQL = rf"""
with t as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, {_WORDS}) as w, list_filter(string_split(t, chr(10)), lambda x: len(translate(x, {_WHITE}, '')) > 0) as l, translate(t, {_WHITE}, '') as bare from t),
rep as (select doc_id, sum(least(5, coalesce(lead_i - i, 5))) as n_repeat_words from (select doc_id, i, lead(i) over (partition by doc_id order by i) as lead_i from (select doc_id, i, count(*) over (partition by doc_id, s) as many from (select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w))) where many > 1) group by 1),
c as (select doc_id, lang, len(w) as n_words, len(bare) as word_chars, len(t) - len(translate(t, '#*$%&|<>', '')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines, len(list_distinct(w)) as n_distinct, len(bare) - len(regexp_replace(bare, '\p{{Lu}}', '', 'g')) as n_upper, len(bare) - len(translate(bare, '!?.,;:|*#$%&<>+=_', '')) as n_marks from w left join rep using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, coalesce(lang, '?') || '/' || case when n_words < 100 then 'short' when n_words < 1000 then 'middle' else 'long' end as stratum from c),
v as (select doc_id, stratum, base_failed, unnest({list(RULES)}) as rule, unnest([case when word_chars > 0 then n_symbols / word_chars else 0 end, case when n_lines > 0 then n_dup_lines / n_lines else 0 end, case when n_words > 0 then n_repeat_words / n_words else 0 end, case when word_chars > 0 then n_upper / word_chars else 0 end, case when n_words > 0 then 1 - n_distinct / n_words else 0 end, case when word_chars > 0 then n_marks / word_chars else 0 end]) as x from f),
known as (select doc_id, min(quality) as good from labels where quality in (0, 1) and doc_id is not null group by 1),
own as (select v.*, good from v join known using (doc_id) where not base_failed),
size as (select stratum, count(*) filter (good = 1) as n1 from own where rule = 'symbol_share' group by 1),
stands as (select stratum from (select *, 1 as m from size) where n1 >= {_NEED}),
named as (select case when stratum in (from stands) then stratum end as name, split_part(stratum, '/', -1) as length, n1 from size),
keys as (select name, length, sum(n1) as n1 from (select * from named union all select null, unnest({list(LENGTHS)}), 0) group by 1, 2),
need as (select m, {_NEED} as need from (select unnest(range(1, (select count(*) + 1 from keys))) as m)),
rest as (select *, not (name is not null and n1 >= need) as other from keys, need),
dealt as (select *, case when not other then 'n' || name when sum(n1) filter (other) over (partition by m, length) >= need then 'r' || list_position({list(LENGTHS)}, length) else 't' end as g from rest),
pool as (select m, need, g, sum(n1) as held, min(list_position({list(LENGTHS)}, length)) as place from dealt group by 1, 2, 3),
thin as (select m, arg_min(g, (held, left(g, 1), case when g[1] = 'n' then g else '' end, place)) filter (g <> 't') as taken, bool_or(g = 't' and held < need) as short from pool group by 1),
final as (select d.m, name, length, case when short and g = taken then 't' else g end as g from dealt d join thin using (m)),
pick as (select min(m) as m from (select m from final group by 1 having count(distinct g) <= m)),
pools as (select name, length, g, (select count(distinct g) from final where m = (select m from pick)) as many from final where m = (select m from pick)),
counts as (select g, many, rule, c, count(*) filter (good = 1) as n, count(*) filter (good = 1 and x >= c) as k, count(*) filter (good = 0 and x >= c) as bad from own join pools p on split_part(stratum, '/', -1) = p.length and ((p.name is null and stratum not in (from stands)) or p.name = stratum), (select unnest({CUTOFFS}) as c) group by 1, 2, 3, 4),
tested as (select *, n > 0 and (case when k >= n then 1.0 else {_TAIL} end) <= {LEVEL} / (many * {len(RULES)}) as safe from counts),
chosen as (select g, rule, arg_max(c, (bad, c)) as cutoff from (select *, bool_and(safe) over (partition by g, rule order by c desc) as all_safe from tested) where all_safe and bad > 0 group by 1, 2),
refused as (select distinct doc_id from v join pools p on split_part(stratum, '/', -1) = p.length and ((p.name is null and stratum not in (from stands)) or p.name = stratum) join chosen using (g, rule) where x >= cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and doc_id not in (from refused) as kept from f
"""


_DAY = 24 * 3_600_000_000

ASOF = f"""
with c as (select click_id, client_id, epoch_us(ts) as t, {_crc("encode(click_id::varchar)")} as h from clicks),
l as (select distinct on (click_id) click_id, client_id, case when h % 2 = 1 then t - ((t % {_DAY}) + {_DAY}) % {_DAY} else t end as t from c order by click_id, t nulls last, client_id nulls last),
s as (select sale_id, client_id, priority, cast(floor(100 * total + 0.5) as bigint) as cents, epoch_us(sold_at) as t, {_crc("encode(sale_id::varchar)")} as h from sales),
f as (select sale_id, client_id, priority, cents, h, case when h % 2 = 1 then t - ((t % {_DAY}) + {_DAY}) % {_DAY} else t end as t from s),
o as (select sale_id, client_id, priority, cents, t from f union all select -1 - sale_id, client_id, 6 - priority, cents, t from f where h % 3 <> 0),
r as (select *, row_number() over (partition by client_id, t order by priority desc nulls last, sale_id nulls last, cents nulls first) as place, count(*) over (partition by client_id, t) as n from o where client_id is not null and t is not null),
m as (select click_id, l.client_id, l.t, r.sale_id, l.t - r.t as lag, r.cents, r.n from l asof left join (select * from r where place = 1) r on l.client_id = r.client_id and l.t >= r.t)
select click_id, client_id, t as ts_us, case when lag <= {3 * _DAY} then sale_id end as sale_id, case when lag <= {3 * _DAY} then lag end as lag_us, case when lag <= {3 * _DAY} then cents end as total_cents, case when lag <= {3 * _DAY} then n else 0 end as n_tied from m
"""

DEDUP = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """All distances of every round, without bounds."""
    square = "list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = "a{i} as (select vec_id, x, unnest(best) from (select v.vec_id, v.x, arg_min({{'c': m.c, 'd': {s}}}, ({s}, m.c)) as best from v, m{i} m group by v.vec_id, v.x))"
    mean = "m{j} as (select m.c, coalesce(n.x, m.x) as x from m{i} m left join (select c, list((s - ((s % n) + n) % n) // n order by i) as x from (select c, i, sum(y)::bigint as s, count(*) as n from (select c, unnest(range(1, 65)) as i, unnest(x) as y from a{i}) group by 1, 2) group by 1) n using (c))"
    steps = [near.format(i=i, s=square) + ("" if i == rounds else ",\n" + mean.format(i=i, j=i + 1)) for i in range(rounds + 1)]
    last = f"a{rounds}"
    return f"""
with v as (select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e)))),
m0 as (select row_number() over (order by key) - 1 as c, x from (select sha256('2:' || vec_id) as key, x from v order by key limit {k})),
{", ".join(steps)}
select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m.x, ',')) as centroid_sha256
from {last} join m{rounds} m using (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": JACCARD_JOIN, "op5_shards": SHARDS, "op9_repeats": REPEATS, "op10_rules": RULES_SQL, "op11_asof": ASOF, "op12_exact_dedup": DEDUP, "op13_elkan": _clusters()}
