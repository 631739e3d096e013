"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op1_schema_fingerprint_chat
from . import secrets
from .decontaminate import op9_spaced_seed_decontamination
from .jaccard_join import op6_jaccard_join
from .langid import op4_language_id
from .packing import op10_best_fit_packing
from .pii import op7_feistel_pseudonyms
from .quality import op3_crf_quality
from .secrets import op2_ownership_secrets
from .templates import op8_template_extraction
from .toxicity import op5_factorization_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_schema_fingerprint_chat,
        op2_ownership_secrets,
        op3_crf_quality,
        op4_language_id,
        op5_factorization_toxicity,
        op6_jaccard_join,
        op7_feistel_pseudonyms,
        op8_template_extraction,
        op9_spaced_seed_decontamination,
        op10_best_fit_packing,
    )
}

_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
_CHAT = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
cast(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 24) as bigint) as formatted_chars from t group by conv_id"""
_NEAR = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select w.doc_id, count(s.g) as n from w left join s on s.doc_id = w.doc_id group by w.doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
r(doc_id, root) as (select doc_id, doc_id from n union select e.y, r.root from r join e on e.x = r.doc_id)
select n.doc_id, n.n as n_shingles, min(r.root) as component_id from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n"""
_LEAKS = r"""with d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from benchmark),
dw as (select doc_id, unnest(w) as w, unnest(range(0, len(w))) as i from d), bw as (select item_id, len(w) as n, unnest(w) as w, unnest(range(0, len(w))) as i from b),
m as (select doc_id, item_id, n, dw.i - bw.i as diag, count(*) as m from dw join bw on dw.w = bw.w group by doc_id, item_id, n, dw.i - bw.i),
k as (select *, row_number() over (partition by doc_id, item_id order by m desc, diag) as k from m where m >= least(8, n) and m >= 0.6 * n)
select doc_id, item_id, diag as word, m as n_matched, n as n_words, n - m as n_changed from k where k = 1"""


def _matches(kind: int, pattern: str, group: int) -> str:
    """(doc_id, source, a, b, kind, w, v) of all matches of a pattern, places from the lengths of what lies between."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, source, {kind} as kind, w[i] as w, v[i] as v,
coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as a
from (select *, unnest(range(1, len(w) + 1)) as i from (select doc_id, source, string_split_regex(coalesce(text, ''), '{p}') as p, regexp_extract_all(coalesce(text, ''), '{p}') as w, regexp_extract_all(coalesce(text, ''), '{p}', {group}) as v from documents) x) y"""


_KIND = "case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'owned' end || ':' || cast(a as varchar) || ':' || cast(b as varchar)"
_SECRETS = f"""with m as (select *, a + length(w) as b from ({_matches(0, secrets.ASSIGN, 2)} union all {_matches(1, secrets.ACCESS, 0)} union all {_matches(2, secrets.HEX, 0)} union all {_matches(3, '[A-Za-z0-9+/_-]{20,}', 0)}) z),
base as (select * from m where kind < 3 and case kind when 0 then length(v) >= 6 when 1 then length(w) >= 20 else true end),
s as (select * from base union all select * from m where kind = 3 and regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Za-z]') and not exists (select 1 from base where base.doc_id = m.doc_id and base.a < m.b and m.a < base.b)),
o as (select v, count(distinct coalesce(source, '')) as owners, count(distinct (coalesce(source, ''), doc_id)) as repos from s group by v),
t as (select s.*, owners, repos, case when owners >= {secrets.WIDE_OWNERS} then 1 when repos >= {secrets.WIDE_REPOSITORIES} then 2 else 0 end as verdict from s join o on o.v = s.v)
select d.doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
sha256(coalesce(string_agg({_KIND}, ',' order by a, kind) filter (where kind < 3), '')) as base_sha256,
coalesce(string_agg({_KIND}, ',' order by a, kind) filter (where kind < 3 or verdict = 0), '') as spans,
count(*) filter (where verdict = 0) as n_live, count(*) filter (where verdict = 1) as n_example, count(*) filter (where verdict = 2) as n_copied,
coalesce(max(owners), 0) as most_owners, coalesce(max(repos), 0) as most_repositories
from documents d left join t on t.doc_id = d.doc_id group by d.doc_id"""
SQL: dict[str, str] = {"op1_schema_fingerprint_chat": _CHAT, "op2_ownership_secrets": _SECRETS, "op6_jaccard_join": _NEAR, "op9_spaced_seed_decontamination": _LEAKS}
