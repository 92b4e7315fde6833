"""DuckDB SQL for those operators that SQL can express over whole tables."""

from __future__ import annotations

from . import url_templates as U
from .quality_rules import Risk


def quality_rules_sql(risk: Risk = Risk()) -> str:  # noqa: B008
    last, p = len(risk.ladder), repr(risk.alpha)
    first_step = risk.first_step().replace("D then", "::double then")
    strata = ", ".join(f"'{s}'" for s in risk.strata)
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
u as (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w where len(w) >= 3),
g as (select rid, i, x, lead(x, 1) over (partition by rid order by i) as y, lead(x, 2) over (partition by rid order by i) as z from u),
g2 as (select rid, i, count(*) over (partition by rid, x, y, z) as c from g where z is not null),
cov as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from g2 where c > 1) group by rid),
b as (select w.doc_id, len(w.w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n_repeat_words, 0)::bigint as n_repeat_words,
      case when lang in ({strata}) then lang else 'other' end as stratum, t from w left join cov using (rid)),
bf as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
bb as (select *, case when not base_failed then {first_step} end as first_step from bf),
good as (select doc_id from labels group by doc_id having min(quality) = 1 and coalesce(max(toxic), 0) = 0),
g1 as (select distinct stratum, t, first_step from bb where not base_failed and doc_id in (select doc_id from good where doc_id is not null)),
g3 as (select stratum, first_step, count(*) as c from g1 group by all),
k as (select stratum, first_step, (sum(c) over (partition by stratum))::bigint as n, (sum(c) over (partition by stratum order by first_step))::bigint as k from g3),
zero as (select distinct stratum, -1 as first_step, n, 0::bigint as k from k),
tests as (select * from zero union all select * from k where first_step < {last}),
tails as (select stratum, first_step, k, n, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))) as tail
          from tests, lateral (select unnest(range(0, k + 1)) as j) group by all),
bad as (select stratum, min(first_step) as step from tails where tail > {risk.level!r} or k >= n * {p} group by stratum),
taken as (select distinct k.stratum, greatest(coalesce(bad.step, {last}), 0) as taken from k left join bad using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(first_step, 0) >= coalesce(taken, 0) as kept
from bb left join taken using (stratum)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of digits and signs."""
    step = "lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1))"
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda q: ascii(q)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})))"


def prefix_trie_sql() -> str:
    return f"""
with rows as (select conv_id as c, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} as t, turn from conversations where conv_id is not null),
own as (select c, list(t order by turn nulls first, t.r, t.x) as s from rows group by c),
h as (select c, s, {_crc32("c::varchar")} % 4 as h from own),
re as (select h.c, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) as s from h left join own b on b.c = h.c - h.c % 20),
pre as (select c, d, s[1:d] as p, d = len(s) as fin from (select c, s, unnest(range(0, len(s) + 1)) as d from re)),
node as (select p, d, min(c) as conv_id, count(*) as n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where fin), '')) as e,
         case when d > 0 then len(list_filter(regexp_split_to_array(p[-1].x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) else 0 end as words from pre group by p, d),
kids as (select p[1:d - 1] as p, d - 1 as d, count(*) as k from node where d > 0 group by all),
full_ as (select node.*, coalesce(k, 0) as k, up.conv_id as parent from node left join kids using (p, d) left join node up on up.d = node.d - 1 and up.p = node.p[1:node.d - 1]),
sub as (select a.p, a.d, count(*) filter (where b.k = 0) as leaves, sum((b.n - 1) * b.words) as saved from full_ a join full_ b on b.d >= a.d and b.p[1:a.d] = a.p group by a.p, a.d)
select conv_id, d::bigint as depth, parent as parent_conv_id, n::bigint as n_convs, k::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, e as ends_sha256
from full_ join sub using (p, d)"""


def merkle_sql() -> str:
    field = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    tree = """{0} as (select key, 0 as lvl, idx, digest, count(*) over (partition by key) as cnt from {1}
 union all select key, lvl + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), max((cnt + 2) // 3) from {0} where cnt > 1 group by key, lvl, idx // 3)"""
    # rid: the leaf's row; a climb meets the nodes of its run on each level
    climb = """{0} as (select rid, key, 0 as lvl, idx, x, '' as beside, false as done from {2}
 union all select f.rid, f.key, f.lvl + 1, f.idx // 3, sha256(string_agg(case when t.idx = f.idx then f.x else t.digest end, '' order by t.idx)),
  f.beside || coalesce(string_agg(t.digest, '' order by t.idx) filter (where t.idx <> f.idx), ''), false
 from {0} f join {1} t on t.key = f.key and t.lvl = f.lvl and t.cnt > 1 and t.idx // 3 = f.idx // 3 group by f.rid, f.key, f.lvl, f.idx, f.x, f.beside)"""
    last = "{0}_end as (select * from {0} qualify row_number() over (partition by rid order by lvl desc) = 1)"
    cut = field.format("replace(text, chr(10), '')")
    return f"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce('s' || source, '') as key, sha256({head} || {field.format("text")}) as digest,
 case when {_crc32("coalesce(doc_id, 0)::varchar")} % 2 = 0 and doc_id is not null then sha256({head} || {cut}) end as forged from documents),
lv as (select *, row_number() over (partition by key order by doc_id nulls first, digest) - 1 as idx from d),
{tree.format("t", "lv")},
subs as (select key as source, digest, idx from (select *, row_number() over (order by key) - 1 as idx from (select key, digest from t where cnt = 1)) ),
s0 as (select '' as key, idx, digest, source from subs),
{tree.format("u", "s0")},
lx as (select rid, key, idx, coalesce(forged, digest) as x from lv),
{climb.format("f", "t", "lx")},
{last.format("f")},
sx as (select f.rid, '' as key, s0.idx, f.x from f_end f join s0 on s0.source = f.key),
{climb.format("g", "u", "sx")},
{last.format("g")}
select lv.doc_id, lv.digest as leaf, s0.digest as subroot, r.digest as root, sha256(f_end.beside || g_end.beside) as proof_sha256, g_end.x as folded_root, g_end.x = r.digest as verified
from lv join f_end using (rid) join g_end using (rid) join s0 on s0.source = lv.key cross join (select digest from u where cnt = 1) r"""


def url_filters_sql(levels: int = U.DEPTH + 1) -> str:
    fits, verdict = [], []
    for rule in sorted(U.RULES, key=lambda r: (-len(r), r)):
        domain, slash, start = rule.partition("/")
        fits.append(f"when (host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '{slash + start}') then '{rule}'")
        verdict.append(f"when '{rule}' then '{U.RULES[rule]}'")
    ctes = []
    for k in range(levels):
        ctes.append(f"""
h{k} as (select *, segs[{k + 1}] as seg from t{k} where len(segs) > {k}),
b{k} as (select host, node, seg, sum(pages) as n, sum(labelled)::double as l, sum(bad)::double as b from h{k} group by all),
w{k} as (select *, sum(l) over (partition by host, node) as tl, sum(b) over (partition by host, node) as tb from b{k}),
x{k} as (select *, n >= {U.SUPPORT} and l * (tl - l) * tb * (tl - tb) > 0 and (b * (tl - l) - (tb - b) * l) * (b * (tl - l) - (tb - b) * l) * tl / (l * (tl - l) * tb * (tl - tb)) >= {U.DIFFERENT}::double as far from w{k}),
c{k} as (select host, node, seg, l, b, case when seg in ('{U.END}', '{U.DEEPER}') then '=' || seg when far and b * (tl - l) > (tb - b) * l then '+' when far then '-' else '' end as kind from x{k}),
m{k} as (select host, node, seg, kind, sum(l) over q as l, sum(b) over q as b, count(*) over q as branches, min(seg) over q as one from c{k} window q as (partition by host, node, kind)),
n{k} as (select *, case when starts_with(kind, '=') or (kind in ('+', '-') and branches = 1 and not starts_with(one, '*')) then one else '*' || kind end as name from m{k}),
t{k + 1} as (select host, segs, pages, labelled, bad, node || '/' || name as node, (n{k}.b + {U.WEIGHT}::double * share) / (n{k}.l + {U.WEIGHT}::double) as share from h{k} join n{k} using (host, node, seg)
 union all select * from t{k} where len(segs) <= {k})""")
    return f"""
with r as (select page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
s as (select *, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9A-Fa-f]{{16,}}', '#', 'g'), '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') as parts from p),
u as (select *, list_append(parts[1:{U.DEPTH}], case when len(parts) > {U.DEPTH} then '{U.DEEPER}' else '{U.END}' end) as segs from s),
lab as (select doc_id as page_id, max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as bad from labels group by doc_id),
a as (select host, segs, count(*) as pages, count(bad) as labelled, coalesce(sum(bad), 0) as bad from u left join lab using (page_id) group by all),
g as (select (sum(bad) + 0.5::double) / (sum(labelled) + 1.0::double) as overall from a),
hs as (select host, sum(labelled)::double as l, sum(bad)::double as b from a group by host),
t0 as (select host, segs, pages, labelled, bad, '' as node, (hs.b + {U.WEIGHT}::double * overall) / (hs.l + {U.WEIGHT}::double) as share from a join hs using (host) cross join g),
{",".join(ctes)},
j as (select page_id, host, path, case {" ".join(fits)} end as rule, node, share from u join t{levels} using (host, segs))
select page_id, host, path, rule, coalesce(case rule {" ".join(verdict)} end, case when share > {U.REJECT}::double then 'block' else 'allow' end) as verdict, node as template from j"""
