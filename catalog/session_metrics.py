"""Noise, kill chain, deviations, analysis and counterfactual on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bindings import IDLE_MS, SQL_EPISODES, SQL_RAW, THINK_MS, Run, raw_commands
from catalog.kit import ALIGNED, CLAIMS, CWE, FINDINGS, NOISE, STATUS, UKC, WASTE, registry, sql_in
from catalog.timeline import FOLD, TIMED
from runlens import rules
from runlens.functions import text as t
from runlens.operators import align, analysis, audits, classify, coaching, ghost, grade, metrics, privesc, report, timeline
from runlens.plans import debrief
from runlens.schemas import SESSION

QUERIES, query = registry()


def r6(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


# --- classification ---------------------------------------------------------------------------------


@query("binary_priors", f"""with {SQL_EPISODES} select session_uuid, seq, coalesce(p.tactic, 'TA0007') tactic, coalesce(p.technique, 'T1059') technique,
  coalesce(p.confidence, 0.2)::double confidence from ep left join priors p on p.b = lower(ep."binary") where ep.cmd <> ''""")
def binary_priors(spark, sf):
    df = Run(spark, sf).segmented.where("cmd <> ''").select(SESSION, "seq", "binary")
    return classify.classify_binary(df).drop("binary")


@query("frameworks", f"""with {SQL_EPISODES}, {UKC}, {CWE} select session_uuid, seq, ukc.ukc, weak.cwe from ep left join ukc using (tactic)
  left join weak on weak.b = lower(ep."binary")""")
def frameworks(spark, sf):
    return classify.with_frameworks(Run(spark, sf).segmented).select(SESSION, "seq", "ukc", F.get("cwe", 0).alias("cwe"))


@query("noise_weights", f"with {SQL_EPISODES} select session_uuid, seq, noise_weight from ep where cmd <> ''")
def noise_weights(spark, sf):
    df = Run(spark, sf).segmented.where("cmd <> ''").select(SESSION, "seq", "binary")
    return classify.with_noise_weight(df).drop("binary")


@query("on_target_steps", f"with {SQL_RAW} select session_uuid, ord, regexp_matches(context_path, '(?i)ssh:') on_target from raw")
def on_target(spark, sf):
    return raw_commands(spark, sf).select(SESSION, "ord", t.on_target(F.col("context_path")).alias("on_target"))


# --- noise and stealth ------------------------------------------------------------------------------


@query("stealth", f"""with {SQL_EPISODES}, n as (select session_uuid, sum({NOISE}) total from ep group by 1)
select session_uuid, round(total, 6)::double total_noise, round(greatest(0, 100 - least(100, total / 400 * 100)), 6)::double stealth_score from n""")
def stealth(spark, sf):
    return r6(metrics.stealth(Run(spark, sf).segmented), "total_noise", "stealth_score")


@query("loud_moments", f"""with {SQL_EPISODES}, n as (select session_uuid, seq, "binary", {NOISE} noise from ep),
r as (select *, row_number() over (partition by session_uuid order by noise desc, seq)::int "rank" from n where noise > 0)
select session_uuid, seq, "binary", round(noise, 6)::double noise, "rank" from r where "rank" <= 3""")
def loud_moments(spark, sf):
    return r6(metrics.loud_moments(Run(spark, sf).segmented), "noise")


@query("noise_burn", f"""with {SQL_EPISODES}, n as (select session_uuid, seq, {NOISE} noise from ep)
select session_uuid, seq, round(sum(noise) over (partition by session_uuid order by seq), 6)::double cumulative_noise from n""")
def noise_burn(spark, sf):
    df = metrics.noise_burn(Run(spark, sf).segmented).select(SESSION, "seq", "cumulative_noise")
    return r6(df, "cumulative_noise")


@query("exposure_decay", f"""with {SQL_EPISODES}, {TIMED}, len as (select session_uuid, max(t1) total, greatest(max(t1) / 8.0, 120000) tau from tl group by 1),
loads as (select session_uuid, t1::double m, {NOISE} n from tl where noise_weight <> 0),
pt as (select session_uuid, m from loads union select session_uuid, i / 90.0::double * total from len, unnest(range(91)) g(i))
select pt.session_uuid, round(pt.m, 3)::double at_ms, round(coalesce(sum(loads.n * exp(-(pt.m - loads.m) / tau)), 0), 6)::double exposure
from pt join len using (session_uuid) left join loads on loads.session_uuid = pt.session_uuid and loads.m <= pt.m group by pt.session_uuid, pt.m""")
def exposure(spark, sf):
    df = metrics.exposure(timeline.timeline(Run(spark, sf).segmented))
    return df.select(SESSION, F.round("at_ms", 3).alias("at_ms"), F.round("exposure", 6).alias("exposure"))


# --- techniques, kill chain, tools ------------------------------------------------------------------


@query("technique_breadth", f"with {SQL_EPISODES} select session_uuid, count(distinct technique) technique_breadth from ep group by 1")
def technique_breadth(spark, sf):
    return metrics.technique_breadth(Run(spark, sf).segmented)


@query("technique_sequences", f"""with {SQL_EPISODES}, f as (select session_uuid, technique, min(seq) first_seq, count(*) uses from ep where technique is not null group by 1, 2)
select session_uuid, technique, seq, first_seq, uses, dense_rank() over (partition by session_uuid order by first_seq)::int technique_order
from ep join f using (session_uuid, technique)""")
def technique_sequences(spark, sf):
    return metrics.technique_sequences(Run(spark, sf).segmented)


@query("ukc_coverage", f"""with {CLAIMS}, {UKC}, need as (select distinct ukc from gold join ukc using (tactic)),
got as (select distinct session_uuid, ukc from ep join ukc using (tactic))
select session_uuid, round(count(need.ukc) * 100.0 / (select count(*) from need), 6)::double ukc_coverage_pct from got left join need using (ukc) group by 1""")
def ukc_coverage(spark, sf):
    run = Run(spark, sf)
    return r6(metrics.ukc_coverage(run.segmented, run.objectives), "ukc_coverage_pct")


@query("ukc_progression", f"""with {SQL_EPISODES}, {UKC}, r as (select session_uuid, ukc_rank, lag(ukc_rank) over (partition by session_uuid order by seq) p from ep join ukc using (tactic))
select session_uuid, round(case when count(p) = 0 then 100 else count(*) filter (ukc_rank >= p) * 100.0 / count(p) end, 6)::double ukc_progression from r group by 1""")
def ukc_progression(spark, sf):
    return r6(metrics.ukc_progression(Run(spark, sf).segmented), "ukc_progression")


@query("weaknesses", f"""with {SQL_EPISODES}, {CWE}, f as (select session_uuid, cwe, min(seq) first_seq from ep join weak on weak.b = lower("binary") group by 1, 2)
select *, row_number() over (partition by session_uuid order by first_seq)::int "position" from f""")
def weaknesses(spark, sf):
    return metrics.weaknesses(Run(spark, sf).segmented)


@query("weakness_breadth", f"""with {SQL_EPISODES}, {CWE} select session_uuid, count(distinct cwe) weakness_breadth from ep left join weak on weak.b = lower("binary") group by 1""")
def weakness_breadth(spark, sf):
    return metrics.weakness_breadth(Run(spark, sf).segmented)


@query("reached_phases", f"with {SQL_EPISODES}, {UKC} select distinct session_uuid, ukc, ukc_rank from ep join ukc using (tactic)")
def reached_phases(spark, sf):
    return metrics.reached_phases(Run(spark, sf).segmented)


@query("kill_chain_trajectory", f"""with {SQL_EPISODES}, {UKC}, p as (select session_uuid, seq, ukc, ukc_rank from ep join ukc using (tactic) where "binary" <> ''),
q as (select *, dense_rank() over (partition by session_uuid order by ukc_rank)::int - 1 "row", max(ukc_rank) over (partition by session_uuid) mx,
  min(seq) over (partition by session_uuid, ukc_rank) fs, count(*) over (partition by session_uuid) n from p)
select session_uuid, seq, ukc, ukc_rank, "row", ukc_rank = mx and seq = fs furthest from q where n >= 2""")
def trajectory(spark, sf):
    return metrics.trajectory(Run(spark, sf).segmented)


@query("tool_loadout", f"""with {SQL_EPISODES} select session_uuid, "binary", count(*) uses, min(seq) first_seq from ep where "binary" <> '' group by 1, 2""")
def loadout(spark, sf):
    return metrics.loadout(Run(spark, sf).segmented)


# --- deviations -------------------------------------------------------------------------------------

KIND = "case when loop_of_seq is not null then 'loop' when alignment = 'detour' or coalesce(exit_code <> 0, false) then 'dead-end' else 'ontrack' end"


@query("deviations", f"""with {ALIGNED}, k as (select *, {KIND} kind, case when "binary" <> '' then "binary" else 'a command' end b from al)
select session_uuid, seq, kind, duration_ms cost_ms, case kind when 'dead-end' then b || ' — ' || coalesce(nullif(output_digest, ''),
  case when exit_code <> 0 then 'exited ' || exit_code end, 'no useful result') else b || ' — retried after it failed' end description from k where kind <> 'ontrack'
union all select session_uuid, seq, 'stall', gap_before_ms, 'paused before ' || b from k where gap_before_ms >= 90000""")
def deviations(spark, sf):
    return metrics.deviations(Run(spark, sf).aligned)


@query("deviation_summary", f"""with {ALIGNED}, {WASTE}, k as (select *, {KIND} kind from w)
select session_uuid, count(*) filter (kind = 'dead-end') dead_ends, count(*) filter (kind = 'loop') loops, count(*) filter (gap_before_ms >= 90000) stalls,
  max(gap_before_ms) filter (gap_before_ms >= 90000) biggest_stall_ms, sum(detour + stuck + lp)::bigint lost_ms, sum(a)::bigint active_ms,
  floor(sum(detour + stuck + lp) / greatest(1, sum(a))::double * 100 + 0.5)::bigint lost_pct from k group by 1""")
def deviation_summary(spark, sf):
    return metrics.deviation_summary(Run(spark, sf).aligned)


@query("deviation_suggestions", f"""with {ALIGNED}, k as (select *, {KIND} kind from al)
select k.session_uuid, k.seq, k.kind,
  coalesce((select arg_min(objective, user_satisfied_by_seq) from board b where b.session_uuid = k.session_uuid and b.user_satisfied_by_seq > k.seq),
    (select arg_min(objective, ordinal) from board b where b.session_uuid = k.session_uuid and b.user_satisfied_by_seq is null)) suggested_objective,
  coalesce((select arg_min(methods[1], user_satisfied_by_seq) from board b where b.session_uuid = k.session_uuid and b.user_satisfied_by_seq > k.seq),
    (select arg_min(methods[1], ordinal) from board b where b.session_uuid = k.session_uuid and b.user_satisfied_by_seq is null)) suggested_method
from k where kind <> 'ontrack' or gap_before_ms >= 90000""")
def suggestions(spark, sf):
    run = Run(spark, sf)
    return metrics.suggestions(run.aligned, run.board)


@query("live_glance", f"""with {ALIGNED}, b as (select session_uuid, count(user_satisfied_by_seq) objectives_done, count(*) objectives from board group by 1)
select session_uuid, count(*) filter (alignment = 'detour') detours, count(loop_of_seq) loops, count(*) filter (actor = 'think_pause') stalls,
  coalesce(max(duration_ms + gap_before_ms) filter (actor = 'think_pause'), 0) longest_stall_ms, any_value(objectives_done) objectives_done, any_value(objectives) objectives
from al join b using (session_uuid) group by 1""")
def glance(spark, sf):
    run = Run(spark, sf)
    return metrics.glance(run.aligned, run.board).drop("user_seq", "system_seq")


@query("radar_from_efficiency", f"""with {ALIGNED}, {WASTE}, e as (select session_uuid, tactic, {FOLD} from w group by 1, 2),
n as (select session_uuid, sum({NOISE}) total from ep group by 1)
select session_uuid, floor(coalesce(max(efficiency_pct) filter (tactic = 'TA0007'), 50) + 0.5) recon, floor(coalesce(max(efficiency_pct) filter (tactic = 'TA0001'), 50) + 0.5) web,
  floor(coalesce(max(efficiency_pct) filter (tactic = 'TA0002'), 50) + 0.5) exploit, floor(coalesce(max(efficiency_pct) filter (tactic = 'TA0004'), 50) + 0.5) privesc,
  floor(greatest(0, 100 - least(100, any_value(total) / 400 * 100)) + 0.5) opsec from e join n using (session_uuid) group by 1""")
def radar_efficiency(spark, sf):
    return metrics.radar_from_efficiency(Run(spark, sf).aligned)


RADAR = " ".join(f"when '{k}' then '{v}'" for k, v in rules.RADAR_BY_TACTIC.items())


@query("radar_from_counts", f"""with {SQL_EPISODES}, s as (select session_uuid, case tactic {RADAR} else 'exploit' end k from ep)
select session_uuid, least(100, 25 * count(*) filter (k = 'recon'))::bigint recon, least(100, 25 * count(*) filter (k = 'web'))::bigint web,
  least(100, 25 * count(*) filter (k = 'exploit'))::bigint exploit, least(100, 25 * count(*) filter (k = 'privesc'))::bigint privesc,
  least(100, 25 * count(*) filter (k = 'opsec'))::bigint opsec from s group by 1""")
def radar_counts(spark, sf):
    return metrics.radar_from_counts(Run(spark, sf).segmented)


# --- analysis ---------------------------------------------------------------------------------------

CHECKS = """
ctx as (select s.session_uuid,
  bool_or(lower("binary") in ('nmap','rustscan','masscan')) scan, bool_or(lower("binary") in ('gobuster','ffuf','feroxbuster','dirb','wfuzz')) web,
  bool_or(lower("binary") in ('enum4linux','enum4linux-ng','smbclient','crackmapexec','cme')) smb,
  bool_or(lower("binary") in ('linpeas','linpeas.sh','pspy','pspy64','getcap') or regexp_matches(cmd, '\\bsudo\\s+-l\\b')) priv,
  min(seq) filter (regexp_matches(context_path, '(?i)ssh:')) landed from ep s group by 1),
fnd as (select session_uuid, min(source_seq) filter (kind = 'port') p, min(source_seq) filter (kind = 'url') u,
  min(source_seq) filter (kind = 'port' and split_part("value", '/', 1) = '80') p80, min(source_seq) filter (kind = 'port' and split_part("value", '/', 1) = '443') p443,
  min(source_seq) filter (kind = 'port' and split_part("value", '/', 1) = '8080') p8080, min(source_seq) filter (kind = 'port' and split_part("value", '/', 1) = '8000') p8000,
  min(source_seq) filter (kind = 'port' and split_part("value", '/', 1) = '8443') p8443,
  coalesce(min(source_seq) filter (kind = 'port' and split_part("value", '/', 1) = '445'), min(source_seq) filter (kind = 'port' and split_part("value", '/', 1) = '139')) s,
  count(*) filter (kind in ('url', 'path')) paths, count(*) filter (kind = 'version') versions from found group by 1),
foot as (select session_uuid, arg_min(user_satisfied_by_seq, ordinal) f from board where tactic = 'TA0002' and user_satisfied_by_seq is not null group by 1),
facts as (select ctx.*, fnd.* exclude (session_uuid), coalesce(f, landed) foothold, coalesce(p80, p443, p8080, p8000, p8443, u) webseq
  from ctx left join fnd using (session_uuid) left join foot using (session_uuid)),
chk as (
  select session_uuid, 1 check_order, 'port_scan' check_id, true applicable, scan or p is not null done, null::bigint evidence_seq from facts
  union all select session_uuid, 2, 'service_version_enum', p is not null, p is not null and coalesce(versions, 0) > 0, p from facts
  union all select session_uuid, 3, 'web_content_enum', webseq is not null, webseq is not null and (web or coalesce(paths, 0) >= 2), webseq from facts
  union all select session_uuid, 4, 'smb_enum', s is not null, s is not null and smb, s from facts
  union all select session_uuid, 5, 'priv_enum', foothold is not null, foothold is not null and priv, foothold from facts)"""


@query("methodology_checks", f"with {ALIGNED} {FINDINGS}, {CHECKS} select * from chk")
def methodology_checks(spark, sf):
    run = Run(spark, sf)
    df = analysis.methodology_checks(run.staged, run.board, run.findings)
    return df.select(SESSION, "check_order", "check_id", "applicable", "done", "evidence_seq")


@query("methodology_coverage", f"""with {ALIGNED} {FINDINGS}, {CHECKS}
select session_uuid, round(count(*) filter (done) * 100.0 / count(*) filter (applicable), 6)::double methodology_coverage_pct from chk group by 1""")
def methodology_coverage(spark, sf):
    run = Run(spark, sf)
    return r6(analysis.methodology_coverage(analysis.methodology_checks(run.staged, run.board, run.findings)), "methodology_coverage_pct")


@query("top_unmet_check", f"""with {ALIGNED} {FINDINGS}, {CHECKS} select session_uuid, arg_min(check_id, check_order) check_id, min(check_order) check_order
from chk where applicable and not done group by 1""")
def top_unmet(spark, sf):
    run = Run(spark, sf)
    df = analysis.top_unmet_check(analysis.methodology_checks(run.staged, run.board, run.findings))
    return df.select(SESSION, "check_id", "check_order")


HOLES = """
hr as (select *, row_number() over (partition by session_uuid order by seq) p, lower("binary") b,
  (coalesce(alignment = 'detour', false) or loop_of_seq is not null or failed) and "binary" <> '' low from al where runs),
hi as (select *, p - row_number() over (partition by session_uuid, b, low order by seq) island from hr),
holes as (select session_uuid, b "binary", min(seq) start_seq, max(seq) end_seq, count(*) attempts, sum(duration_ms + gap_before_ms)::bigint wasted_ms
  from hi where low group by session_uuid, b, island having count(*) >= 3)"""


@query("rabbit_holes", f"with {ALIGNED}, {HOLES} select * from holes")
def rabbit_holes(spark, sf):
    return analysis.rabbit_holes(Run(spark, sf).aligned)


@query("focus_discipline", f"""with {ALIGNED}, {HOLES}, a as (select session_uuid, sum(case when actor = 'idle' then 0 else duration_ms + gap_before_ms end) t from al group by 1),
h as (select session_uuid, sum(wasted_ms) x from holes group by 1)
select session_uuid, round(greatest(0, least(100, 100 - coalesce(x, 0) / greatest(t, 1)::double * 100)), 6)::double focus_discipline_pct from a left join h using (session_uuid)""")
def focus(spark, sf):
    return r6(analysis.focus(Run(spark, sf).aligned), "focus_discipline_pct")


RECOVERIES = """
rr as (select al.*, coalesce(alignment = 'detour', false) or loop_of_seq is not null stuck, coalesce(alignment in ('match', 'alternative'), false)
    or exists (select 1 from board b where b.session_uuid = al.session_uuid and b.user_satisfied_by_seq = al.seq) adv,
  sum(duration_ms + gap_before_ms) over (partition by session_uuid order by seq) cum from al where runs),
ed as (select *, lag(stuck, 1, false) over (partition by session_uuid order by seq) ps, lead(stuck, 1, false) over (partition by session_uuid order by seq) ns from rr),
cs as (select session_uuid, seq stuck_seq, cum - duration_ms - gap_before_ms c0,
  (select min(e.seq) from ed e where e.session_uuid = ed.session_uuid and e.stuck and not e.ns and e.seq >= ed.seq) last_seq from ed where stuck and not ps),
rec as (select cs.session_uuid, stuck_seq, b.seq recovered_seq, (b.cum - c0)::bigint latency_ms from cs join rr b on b.session_uuid = cs.session_uuid
  and b.seq = (select min(r.seq) from rr r where r.session_uuid = cs.session_uuid and r.adv and r.seq > cs.last_seq))"""


@query("recoveries", f"with {ALIGNED}, {RECOVERIES} select * from rec")
def recoveries(spark, sf):
    run = Run(spark, sf)
    return analysis.recoveries(run.aligned, run.board)


@query("recovery_median", f"""with {ALIGNED}, {RECOVERIES} select session_uuid, floor(median(latency_ms) + 0.5)::bigint recovery_median_ms from rec group by 1""")
def recovery_median(spark, sf):
    run = Run(spark, sf)
    df = analysis.recovery_median(analysis.recoveries(run.aligned, run.board))
    return df.select(SESSION, F.col("recovery_median_ms").cast("bigint").alias("recovery_median_ms"))


# --- escalation -------------------------------------------------------------------------------------


ESCALATION = """
rt as (select session_uuid, least(min(seq) filter (regexp_matches(output_digest, 'uid=0\\(root\\)')),
  (select min(source_seq) from found f where f.session_uuid = ep.session_uuid and f.kind = 'flag' and f.proven and regexp_matches(f.id, '(?i)root|proof'))) rooted_seq,
  coalesce(min(seq) filter (regexp_matches(cmd, '\\b(id|groups)\\b')), 0) id_seq from ep group by session_uuid),
pth as (
  select session_uuid, 'sudo:find' path_id, 'sudo' vector, 'confirmed' severity, min(seq) evidence_seq from ep where output_digest = '(root) NOPASSWD: /usr/bin/find' group by 1
  union all select ep.session_uuid, 'group:docker', 'group', 'confirmed', any_value(id_seq) from ep join rt using (session_uuid) where output_digest like '%999(docker)%' group by 1),
esc as (select session_uuid, any_value(rooted_seq) rooted_seq, count(path_id) confirmed, 0::bigint likely, min(evidence_seq) first_confirmed_seq from rt left join pth using (session_uuid) group by 1)"""


@query("escalation_paths", f"with {ALIGNED} {FINDINGS}, {ESCALATION} select * from pth")
def escalation_paths(spark, sf):
    return Run(spark, sf).paths.select(SESSION, "path_id", "vector", "severity", "evidence_seq")


SLOW = """
slow as (select esc.*, coalesce(rooted_seq > first_confirmed_seq, false) and (select count(*) from al where al.session_uuid = esc.session_uuid and seq > first_confirmed_seq and seq < rooted_seq
  and (coalesce(alignment = 'detour', false) or loop_of_seq is not null or coalesce(exit_code <> 0, false))) >= 2 slow_line from esc)"""


@query("escalation_summary", f"with {ALIGNED} {FINDINGS}, {ESCALATION}, {SLOW} select * from slow")
def escalation_summary(spark, sf):
    run = Run(spark, sf)
    return run.escalation.select(SESSION, "rooted_seq", "confirmed", "likely", "first_confirmed_seq", "slow_line")


# --- counterfactual ---------------------------------------------------------------------------------

GHOST = f"""
en as (
  select session_uuid, 'TA0007' tactic, coalesce(min(seq) filter (actor not in ('think_pause', 'idle')), min(seq)) s from ep group by 1
  union all select session_uuid, k.tactic, min(source_seq) from found join (values {", ".join(f"('{tac}', '{k}')" for tac, ks in rules.ENABLING_KINDS.items() for k in ks)}) k(tactic, kind) using (kind) group by 1, 2),
anc as (with recursive up(session_uuid, objective, ancestor) as (
  select session_uuid, objective, objective from board union select up.session_uuid, up.objective, d.dep from up
    join (select session_uuid, objective o, unnest(depends_on) dep from board) d on d.session_uuid = up.session_uuid and d.o = up.ancestor)
  select * from up),
ul as (select a.session_uuid, a.objective, max(en.s) u from anc a join board b on b.session_uuid = a.session_uuid and b.objective = a.ancestor
  left join en on en.session_uuid = a.session_uuid and en.tactic = b.tactic group by 1, 2),
pos as (select session_uuid, seq, alignment, runs::int r, sum(runs::int) over w rc, sum(gap_before_ms + duration_ms) over w el from al window w as (partition by session_uuid order by seq)),
gi0 as (select b.session_uuid, b.ordinal, b.objective, b.tactic, ul.u unlock_seq, b.user_satisfied_by_seq actual_seq, pa.alignment, pa.rc - pa.r - pu.rc btw, greatest(0, pa.el - pu.el) lag
  from board b join ul using (session_uuid, objective) left join pos pa on pa.session_uuid = b.session_uuid and pa.seq = b.user_satisfied_by_seq
  left join pos pu on pu.session_uuid = b.session_uuid and pu.seq = ul.u),
gi1 as (select *, case when actual_seq is not null and alignment = 'alternative' then 'off_path_win' when actual_seq <= unlock_seq then 'ahead'
  when actual_seq is null and unlock_seq is not null then 'skipped' when btw > 2 then 'late_pivot' else 'on_time' end verdict from gi0),
gi as (select session_uuid, ordinal, objective, tactic, verdict, unlock_seq, actual_seq, case when verdict = 'late_pivot' then lag else 0 end::bigint lag_ms from gi1)"""


NOTE = """case verdict when 'late_pivot' then 'Unlocked at step ' || unlock_seq || ', met at step ' || actual_seq || '.' when 'skipped' then 'Unlocked at step ' || unlock_seq || ', never met.'
  when 'ahead' then replace(objective, '_', ' ') || ' was met before anything unlocked it.' when 'off_path_win' then replace(objective, '_', ' ') || ' was met by another method.'
  else 'In time: ' || replace(objective, '_', ' ') || '.' end"""


@query("ghost_path_items", f"with {ALIGNED} {FINDINGS}, {GHOST} select session_uuid, objective, verdict, unlock_seq, actual_seq, lag_ms, {NOTE} note from gi")
def path_items(spark, sf):
    run = Run(spark, sf)
    return ghost.path_items(run.aligned, run.board, run.findings).select(SESSION, "objective", "verdict", "unlock_seq", "actual_seq", "lag_ms", "note")


SIGNALS = """
sg as (
  select c.session_uuid, 'reuse_found_cred' objective, 'TA0006' tactic, 'skipped' verdict, c.u unlock_seq, null::bigint actual_seq, 0::bigint lag_ms from
    (select session_uuid, min(source_seq) u from found where kind = 'cred' group by 1) c
    where not exists (select 1 from ep e where e.session_uuid = c.session_uuid and e.seq > c.u and (e."binary" = 'ssh' or (e."binary" = 'curl' and regexp_matches(e.cmd, '(^|\\s)-u(\\s|=|[^\\s=-])'))))
  union all select l.session_uuid, 'audit_smb_shares', 'TA0007', 'skipped', l.u, null, 0 from
    (select session_uuid, min(seq) u from ep where "binary" = 'smbclient' and cmd like '%-L%' and cmd like '%-N' and exit_code = 0 group by 1) l
  union all select s.session_uuid, 'escalate_via_confirmed_path', 'TA0004', 'late_pivot', first_confirmed_seq, rooted_seq, greatest(0, pr.el - pc.el)::bigint from slow s
    join pos pr on pr.session_uuid = s.session_uuid and pr.seq = rooted_seq join pos pc on pc.session_uuid = s.session_uuid and pc.seq = first_confirmed_seq where slow_line),
sk as (select * from sg where not exists (select 1 from gi where gi.session_uuid = sg.session_uuid and (gi.objective = sg.objective or (gi.tactic = sg.tactic and
  (select count(*) from al where al.session_uuid = sg.session_uuid and runs and seq > least(gi.unlock_seq, sg.unlock_seq) and seq < greatest(gi.unlock_seq, sg.unlock_seq)) <= 2
  and gi.unlock_seq is not null)))),
items as (select session_uuid, objective, verdict, unlock_seq, actual_seq, lag_ms from gi union all select session_uuid, objective, verdict, unlock_seq, actual_seq, lag_ms from sk)"""
ITEMS = f"with {ALIGNED} {FINDINGS}, {ESCALATION}, {SLOW}, {GHOST}, {SIGNALS}"


@query("ghost_items", f"{ITEMS} select * from items")
def ghost_items(spark, sf):
    return Run(spark, sf).ghost.select(SESSION, "objective", "verdict", "unlock_seq", "actual_seq", "lag_ms")


@query("ghost_totals", f"""{ITEMS} select session_uuid, sum(case when verdict = 'late_pivot' then lag_ms else 0 end)::bigint ghost_time_lost_ms,
  count(*) filter (verdict in ('ahead', 'off_path_win')) ghost_human_wins from items group by 1""")
def ghost_totals(spark, sf):
    return ghost.totals(Run(spark, sf).ghost)


@query("ghost_headline", f"""{ITEMS}, g as (select session_uuid, unlock_seq, count(*) n, max(coalesce(actual_seq, 0)) last_seq from items where verdict = 'late_pivot' and unlock_seq is not null group by 1, 2),
b as (select *, row_number() over (partition by session_uuid order by n desc, unlock_seq) r from g),
t as (select session_uuid, count(*) total, count(*) filter (verdict = 'ahead') ahead, count(*) filter (verdict = 'off_path_win') off_path_win, count(*) filter (verdict = 'on_time') on_time,
  count(*) filter (verdict = 'late_pivot') late_pivot, count(*) filter (verdict = 'skipped') skipped from items group by 1)
select t.*, b.n pivots, b.unlock_seq, b.last_seq, case when b.n is null then 'clean' else 'pivots' end headline from t left join b on b.session_uuid = t.session_uuid and r = 1""")
def ghost_headline(spark, sf):
    return ghost.headline(Run(spark, sf).ghost)


@query("ghost_markers", f"""{ITEMS.replace("items as (", "items as materialized (")}, {TIMED.replace("tl as (", "tl as materialized (")},
place as materialized (select session_uuid, seq, any_value(t0) t0 from tl group by 1, 2)
select session_uuid, objective, verdict, max(case when w = 'u' then t0 end) unlock_ms, max(case when w = 'a' then t0 end) actual_ms from (
  select session_uuid, objective, verdict, unlock_seq seq, 'u' w from items union all select session_uuid, objective, verdict, actual_seq, 'a' from items)
join place using (session_uuid, seq) group by all""")
def ghost_markers(spark, sf):
    run = Run(spark, sf)
    return ghost.markers(run.ghost, timeline.timeline(run.staged))
