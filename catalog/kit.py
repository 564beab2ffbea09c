"""Shared pieces of the query families: registration and SQL building blocks."""

from __future__ import annotations

from catalog.bindings import SQL_EPISODES
from runlens import rules


def registry():
    queries: dict[str, tuple] = {}

    def query(name: str, sql: str | None = None):
        def keep(fn):
            queries[name] = (fn, sql)
            return fn

        return keep

    return queries, query


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_hash8(text: str) -> str:
    return (
        f"format('{{:08x}}', list_reduce(list_prepend(0::bigint, list_transform(string_split({text}, ''), "
        "lambda c: unicode(c)::bigint)), lambda a, b: (a * 31 + b) & 4294967295))"
    )


P75 = """
p75 as (select session_uuid, min(gap_before_ms) p75_gap_ms from (
  select session_uuid, gap_before_ms, row_number() over (partition by session_uuid order by gap_before_ms) r,
    count(*) over (partition by session_uuid) n from ep where actor in ('human_active', 'think_pause'))
  where r >= ceil(0.75 * n) group by 1)"""

GOLD_ROWS = ", ".join(
    f"({i}, '{o}', '{tac}', {sql_list(m)}, {sql_list(dep)})" for i, (o, tac, m, _t, dep) in enumerate(rules.HOST_LADDER)
)
LAST = len(rules.HOST_LADDER) - 1
LOW = r"(?i)\b(no |not found|nothing|0 |zero|unreliable|rate.?limit|rejected|blocked|fail|invalid|denied)"

CLAIMS = SQL_EPISODES + f""",
gold(ordinal, objective, tactic, methods, depends_on) as (values {GOLD_ROWS}),
cand as (select session_uuid, ordinal, objective, seq, min(i)::int method_idx from (
  select ep.session_uuid, g.ordinal, g.objective, ep.seq, g.methods, lower(ep."binary") b,
    list_transform(string_split(lower(ep.cmd), ' '), lambda w: regexp_replace(w, '^.*[/\\\\]', '')) names,
    unnest(range(len(g.methods))) i
  from ep join gold g using (tactic) where ep.cmd <> '')
  where b = methods[i + 1] or list_contains(names, methods[i + 1]) group by 1, 2, 3, 4),
taking as (with recursive cl(session_uuid, ordinal, seq, used) as (
  select session_uuid, -1, null::bigint, []::bigint[] from (select distinct session_uuid from ep)
  union all
  select session_uuid, ordinal + 1, s, case when s is null then used else list_append(used, s) end from (
    select c.session_uuid, c.ordinal, c.used, min(case when not list_contains(c.used, d.seq) then d.seq end) s
    from cl c left join cand d on d.session_uuid = c.session_uuid and d.ordinal = c.ordinal + 1
    where c.ordinal < {LAST} group by 1, 2, 3))
  select session_uuid, ordinal, seq from cl where ordinal >= 0),
claims as (select t.session_uuid, t.ordinal, c.objective, t.seq, c.method_idx from taking t join cand c using (session_uuid, ordinal, seq)),
board as (select s.session_uuid, g.*, c.seq user_satisfied_by_seq, c.method_idx from (select distinct session_uuid from ep) s
  cross join gold g left join claims c on c.session_uuid = s.session_uuid and c.ordinal = g.ordinal)"""

WEB_ROWS = ", ".join(f"({i}, '{o}', '{tac}', {sql_list(tech)})" for i, (o, tac, _m, tech, _d) in enumerate(rules.WEB_LADDER))
WEB_CLAIMS = SQL_EPISODES + f""",
wgold(ordinal, objective, tactic, techniques) as (values {WEB_ROWS}),
wcand as (select ep.session_uuid, g.ordinal, ep.seq from ep join wgold g using (tactic) where ep.cmd <> '' and list_contains(g.techniques, upper(ep.technique))),
wtaking as (with recursive cl(session_uuid, ordinal, seq, used) as (
  select session_uuid, -1, null::bigint, []::bigint[] from (select distinct session_uuid from ep)
  union all
  select session_uuid, ordinal + 1, s, case when s is null then used else list_append(used, s) end from (
    select c.session_uuid, c.ordinal, c.used, min(case when not list_contains(c.used, d.seq) then d.seq end) s
    from cl c left join wcand d on d.session_uuid = c.session_uuid and d.ordinal = c.ordinal + 1
    where c.ordinal < {len(rules.WEB_LADDER) - 1} group by 1, 2, 3))
  select session_uuid, ordinal, seq from cl where ordinal >= 0),
wboard as (select * from wtaking)"""

ALIGNED = CLAIMS + f""",
early as (select distinct b.session_uuid, b.user_satisfied_by_seq seq from (
    select session_uuid, user_satisfied_by_seq, unnest(depends_on) dep from board) b
  join board d on d.session_uuid = b.session_uuid and d.objective = b.dep where b.user_satisfied_by_seq < d.user_satisfied_by_seq),
flagged as (select ep.*, c.method_idx, e.seq is not null early_one, c.seq is not null claimed,
  coalesce(exit_code <> 0, false) or coalesce(regexp_matches(output_digest, '{LOW}'), false) failed,
  actor not in ('think_pause', 'idle') runs
  from ep left join claims c using (session_uuid, seq) left join early e using (session_uuid, seq)),
running as (select *, row_number() over w rpos, lead("binary") over w nb, lead(seq) over w ns, lag("binary") over w pb, lag(seq) over w ps
  from flagged where runs window w as (partition by session_uuid order by seq)),
loops as (with recursive lw(session_uuid, rpos, loop_of_seq) as (
  select session_uuid, rpos, case when not claimed and failed and nb = "binary" then ns end from running where rpos = 1
  union all
  select r.session_uuid, r.rpos, case when r.claimed or not r.failed then null when r.nb = r."binary" then r.ns
    when r.pb = r."binary" and lw.loop_of_seq is null then r.ps end
  from lw join running r on r.session_uuid = lw.session_uuid and r.rpos = lw.rpos + 1)
  select * from lw),
al as (select f.* exclude (method_idx, early_one, claimed, failed, runs), l.loop_of_seq,
  case when claimed and early_one then 'out_of_order' when claimed and method_idx = 0 then 'match' when claimed then 'alternative'
    when not runs or l.loop_of_seq is not null then null when failed then 'detour' else 'alternative' end alignment, f.failed, f.runs
  from flagged f left join (select r.session_uuid, r.seq, lw.loop_of_seq from running r join loops lw using (session_uuid, rpos)) l
    using (session_uuid, seq))"""

_F = {
    "url": r"""https?://[^\s"''<>]+""",
    "hash": r"\b[a-f0-9]{32,}\b|\$[0-9a-z]\$[^\s:]+",
    "cred": r"(?i)(?:password|passwd|pwd|user(?:name)?)\s*[:=]\s*(?:\S+)",
    "vuln": r"CVE-\d{4}-\d{3,}",
}


def _found(kind: str, ident: str, tactic: str) -> str:
    return (
        f"select session_uuid, {ident} id, '{kind}' kind, v as \"value\", seq, {tactic} tactic, null::boolean proven from ("
        f"select session_uuid, seq, unnest(regexp_extract_all(output_digest, '{_F[kind]}')) v from ep)"
    )


FINDINGS = f""",
hit as (
  select session_uuid, 'port:' || regexp_extract(v, '^([0-9]+)', 1) || '-' || regexp_extract(v, '/(tcp|udp)', 1) id, 'port' kind,
    regexp_extract(v, '^[0-9]+/(?:tcp|udp)') as "value", seq, 'TA0007' tactic, null::boolean proven
  from (select session_uuid, seq, unnest(regexp_extract_all(output_digest, '[0-9]{{1,5}}/(?:tcp|udp)\\s+open(?:\\s+\\S+)?')) v from ep)
  union all {_found('url', "'url:' || " + sql_hash8('v'), "'TA0007'")}
  union all {_found('hash', "'hash:' || " + sql_hash8('v'), 'null')}
  union all {_found('cred', "'cred:' || " + sql_hash8('v'), "'TA0006'")}
  union all {_found('vuln', "'vuln:' || v", "'TA0001'")}
  union all select session_uuid, 'flag:' || coalesce(name, {sql_hash8("coalesce(nullif(token, ''), '[redacted-flag]')")}), 'flag',
    coalesce(nullif(token, ''), case when sentinel then '[redacted-flag]' else name || '.txt' end), seq, null, token <> '' or sentinel
  from (select session_uuid, seq, case when regexp_matches(cmd, '(?i)(?:user|root|proof)\\.txt')
      then case when regexp_matches(cmd, '(?i)root|proof') then 'root' else 'user' end end name,
      regexp_extract(coalesce(output_digest, ''), '(?i)\\b[a-f0-9]{{32}}\\b|(?:HTB|THM|flag)\\{{[^}}]*\\}}') token,
      contains(coalesce(output_digest, ''), '[redacted-flag]') sentinel from ep)
  where name is not null or token <> '' or sentinel),
found as (select session_uuid, id, any_value(kind) kind, arg_min("value", seq) as "value", min(seq) source_seq,
  any_value(tactic) tactic, arg_min(proven, seq) proven from hit group by 1, 2),
used as (select f.session_uuid, f.id, e.seq used_seq from found f join ep e on e.session_uuid = f.session_uuid and e.seq > f.source_seq
  where case when f.kind = 'port' then regexp_matches(e.cmd, ':' || split_part(f."value", '/', 1) || '([^0-9]|$)')
    else contains(e.cmd, f."value") end)"""

STATUS = FINDINGS + """,
links as (select session_uuid, source_seq seq, id from found union select session_uuid, used_seq, id from used),
status as (select b.session_uuid, b.ordinal, b.objective, b.tactic, b.user_satisfied_by_seq,
  case when b.user_satisfied_by_seq is not null then coalesce(
    (select min(f.source_seq) from links l join found f using (session_uuid, id) where l.session_uuid = b.session_uuid
      and l.seq = b.user_satisfied_by_seq and f.kind = 'flag' and f.proven),
    case when b.tactic = 'TA0004' and regexp_matches(b.objective, '(?i)root|admin|system') then
      (select min(e.seq) from ep e where e.session_uuid = b.session_uuid and e.seq >= b.user_satisfied_by_seq
        and regexp_matches(e.output_digest, '\\buid=0\\b|\\beuid=0\\b|(^|\\n)\\s*root\\s*(\\r?$|\\n)')) end) end proven_by_seq,
  (select count(*) from links l where l.session_uuid = b.session_uuid and l.seq = b.user_satisfied_by_seq) finding_refs,
  (select coalesce(bool_or(a.alignment = 'detour' or a.loop_of_seq is not null), false) from al a
    where a.session_uuid = b.session_uuid and a.tactic = b.tactic) tried
  from board b)"""

UKC_ROWS = ", ".join(f"('{t}', '{p}', {rules.UKC_ORDER.index(p)})" for t, p in rules.TACTIC_UKC.items())
UKC = f"ukc(tactic, ukc, ukc_rank) as (values {UKC_ROWS})"
CWE_ROWS = ", ".join(f"('{b}', '{c[0]}')" for b, c in rules.BINARY_CWE.items())
CWE = f"weak(b, cwe) as (values {CWE_ROWS})"

ACTIVE = "case when actor = 'idle' then 0 else duration_ms + gap_before_ms end"
WASTE = P75 + f""",
w as (select al.*, a, case when alignment = 'detour' then a else 0 end detour, case when coalesce(alignment, '') <> 'detour' and loop_of_seq is not null then a else 0 end lp,
  case when coalesce(alignment, '') <> 'detour' and loop_of_seq is null and actor = 'think_pause' and a > 0 then greatest(0, gap_before_ms - coalesce(p75_gap_ms, 0)) else 0 end stuck
  from (select *, {ACTIVE} a from al) al left join p75 using (session_uuid))"""
NOISE = (
    f"case when noise_weight = 0 then 0 else noise_weight * (1 + log10(greatest(1, volume))) * case when not regexp_matches(context_path, '(?i)ssh:') "
    f"then 1 when lower(\"binary\") in {sql_in(rules.ON_TARGET_LOUD)} then 1.6 else 0.7 end end"
)
