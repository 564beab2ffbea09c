"""Grades, chains, progress and investigations on orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bindings import SQL_EPISODES, Run, table
from catalog.kit import ACTIVE, ALIGNED, CWE, FINDINGS, NOISE, UKC, WASTE, registry
from catalog.session_metrics import CHECKS, ESCALATION, HOLES, ITEMS, RECOVERIES, SLOW
from catalog.timeline import FOLD, LABELS, TIMED
from runlens import rules
from runlens.operators import analysis, audits, classify, coaching, defense, grade, metrics, progress, report, timeline
from runlens.plans import debrief
from runlens.schemas import SESSION
from runlens.session import stage

QUERIES, query = registry()

# --- grades -----------------------------------------------------------------------------------------

RAWS = {"coverage": "r1", "breadth": "r2", "efficiency": "r3", "progression": "r4", "discipline": "r5", "independence": "r6", "methodology": "r7", "focus": "r8"}


def _score(rubric) -> str:
    """The weighted sum in rubric order, with and without independence."""
    every, without = sum(w for _k, w in rubric), sum(w for k, w in rubric if k != "independence")
    full, part = "0::double", "0::double"
    for name, w in rubric:
        full = f"({full} + {RAWS[name]} * '{w / every!r}'::double)"
        part = f"({part} + {RAWS[name]} * '{(0.0 if name == 'independence' else w / without)!r}'::double)"
    return f"case when meas then {full} else {part} end"


SCORES = f"""
m as (select l_orderkey::varchar session_uuid, max(l_discount) * 1000 coverage, count(distinct l_suppkey) breadth, max(l_tax) * 1000 efficiency,
  max(l_quantity) * 2 progression, min(l_quantity) * 2 stealth, case when l_orderkey % 3 <> 0 then max(l_quantity) * 2 end methodology, 70.0 focus,
  case when l_orderkey % 4 = 0 then min(l_quantity) * 3 end independence, count(*) filter (l_returnflag = 'R') pulls,
  coalesce(sum(case l_linenumber % 3 + 1 when 1 then 3 when 2 then 6 else 10 end) filter (l_returnflag = 'R'), 0) penalty from lineitem group by l_orderkey),
c as (select *, greatest(0, least(100, coverage)) r1, greatest(0, least(100, breadth / 12.0 * 100)) r2, greatest(0, least(100, efficiency)) r3, greatest(0, least(100, progression)) r4,
  greatest(0, least(100, stealth)) r5, independence is not null or pulls > 0 meas, case when independence is not null or pulls > 0 then greatest(0, least(100, coalesce(independence, 100) - penalty)) else 0 end r6,
  greatest(0, least(100, coalesce(methodology, 0))) r7, focus r8 from m),
g as (select *, case when methodology is not null then {_score(rules.RUBRIC_V2)} else {_score(rules.RUBRIC_V1)} end s from c)"""


def _order_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.groupBy("l_orderkey").agg(
        (F.max("l_discount") * 1000).alias("objective_coverage_pct"), F.countDistinct("l_suppkey").alias("technique_breadth"),
        (F.max("l_tax") * 1000).alias("efficiency_pct"), (F.max("l_quantity") * 2).alias("ukc_progression"), (F.min("l_quantity") * 2).alias("stealth_score"),
        (F.max("l_quantity") * 2).alias("_m"), (F.min("l_quantity") * 3).alias("_i"))
    m = rows.select(
        F.col("l_orderkey").cast("string").alias(SESSION), "objective_coverage_pct", "technique_breadth", "efficiency_pct", "ukc_progression", "stealth_score",
        F.when(F.col("l_orderkey") % 3 != 0, F.col("_m")).alias("methodology_coverage_pct"), F.lit(70.0).alias("focus_discipline_pct"),
        F.when(F.col("l_orderkey") % 4 == 0, F.col("_i")).alias("independence_score"))
    pulls = li.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").cast("string").alias(SESSION), (F.col("l_linenumber") % 3 + 1).alias("tier"), F.col("l_linenumber").alias("at_ms"),
        F.when(F.col("l_linestatus") == "F", "ai:golden").otherwise("rule").alias("source"))
    return m, pulls


@query("run_grades", f"""with {SCORES} select session_uuid, case when methodology is not null then 2 else 1 end "version", meas measured, coalesce(independence < 40, false) flagged,
  case when coalesce(independence < 40, false) then 'integrity_queue' else 'grade' end routed_to, round(r6, 3)::double independence from g where abs(r6 * 10 - floor(r6 * 10) - 0.5) > 1e-6""".replace("round(r6, 3)", "floor(r6 * 10 + 0.5) / 10"))
def run_grades(spark, sf):
    m, pulls = _order_metrics(spark, sf)
    out = grade.grade(m, grade.hint_summary(pulls))
    return out.select(SESSION, "version", "measured", "flagged", "routed_to", "independence")


@query("run_scores", f"""with {SCORES} select session_uuid, floor(s * 10 + 0.5) / 10 score, case when floor(s * 10 + 0.5) / 10 >= 90 then 'A' when floor(s * 10 + 0.5) / 10 >= 80 then 'B' when floor(s * 10 + 0.5) / 10 >= 70 then 'C'
  when floor(s * 10 + 0.5) / 10 >= 60 then 'D' else 'F' end letter from g""")
def run_scores(spark, sf):
    m, pulls = _order_metrics(spark, sf)
    return grade.grade(m, grade.hint_summary(pulls)).select(SESSION, "score", "letter")


@query("hint_penalties", """select l_orderkey::varchar session_uuid, count(*) hint_pulls, sum(case l_linenumber % 3 + 1 when 1 then 3 when 2 then 6 else 10 end)::bigint hint_penalty,
  count(*) filter (l_linestatus = 'F') ai_pulls, least(3, max(l_linenumber % 3 + 1) + 1)::int next_tier from lineitem where l_returnflag = 'R' group by 1""")
def hint_penalties(spark, sf):
    return grade.hint_summary(_order_metrics(spark, sf)[1])


@query("merged_pulls", """with s as (select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'), m as (select l_orderkey, max(l_linenumber) x from s group by 1)
select l_orderkey::varchar session_uuid, l_linenumber at_ms from s union all select l.l_orderkey::varchar, l.l_linenumber from lineitem l left join m using (l_orderkey) where l.l_returnflag <> 'R' and l.l_linenumber > coalesce(x, 0)""")
def merged_pulls(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias(SESSION), F.col("l_linenumber").alias("at_ms"), "l_returnflag")
    saved = li.where("l_returnflag = 'R'").drop("l_returnflag")
    return grade.merge_pulls(saved, li.where("l_returnflag <> 'R'").drop("l_returnflag"))


CONTENT = """'{"price":' || o_orderkey || ',"status":"' || o_orderstatus || '"}'"""


def _contents(spark, sf):
    content = F.to_json(F.struct(F.col("o_orderkey").alias("price"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("chain"), F.col("o_orderkey").alias("position"), content.alias("content"))


@query("attestation_chain", f"""with recursive r as (select o_custkey, o_orderkey, {CONTENT} c, row_number() over (partition by o_custkey order by o_orderkey) n from orders),
h(o_custkey, n, o_orderkey, prev_hash, hash) as (
  select o_custkey, n, o_orderkey, null::varchar, sha256('{{"content":' || c || ',"prev_hash":null}}') from r where n = 1
  union all select r.o_custkey, r.n, r.o_orderkey, h.hash, sha256('{{"content":' || r.c || ',"prev_hash":"' || h.hash || '"}}') from h join r on r.o_custkey = h.o_custkey and r.n = h.n + 1)
select o_custkey::varchar chain, o_orderkey as "position", prev_hash, hash from h""")
def attestation_chain(spark, sf):
    return grade.build_chain(_contents(spark, sf), "chain").select("chain", "position", "prev_hash", "hash")


@query("chain_verification", """select o_custkey::varchar chain, min(o_orderkey) filter (o_orderkey % 7 = 0) broken_at, count(*) links, count(*) filter (o_orderkey % 7 = 0) = 0 ok from orders group by 1""")
def chain_verification(spark, sf):
    made = grade.build_chain(_contents(spark, sf), "chain")
    edited = made.withColumn("content", F.when(F.col("position") % 7 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    return grade.verify_chain(edited, "chain")


@query("attestation_bundles", f"""with {SCORES} select session_uuid, 'HTB 1.2.3.x' scope_mask, floor(s * 10 + 0.5) / 10 score from g""".replace("'HTB 1.2.3.x' scope_mask", "'box x.x.x.x' scope_mask"))
def attestation_bundles(spark, sf):
    m, pulls = _order_metrics(spark, sf)
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias(SESSION), F.lit("box 10.2.3.4").alias("target_scope"), F.col("o_orderdate").alias("started_at"),
        F.col("o_orderdate").alias("ended_at"))
    board = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias(SESSION), F.col("l_linenumber").alias("ordinal"), F.lit("goal").alias("objective"),
        F.lit("TA0007").alias("tactic"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("bigint")).alias("user_satisfied_by_seq"))
    out = grade.bundle(orders, m, grade.grade(m, grade.hint_summary(pulls)), board)
    return out.select(SESSION, F.col("content.session.target_scope").alias("scope_mask"), F.col("content.grade.score").alias("score"))


# --- history ----------------------------------------------------------------------------------------


def _cards(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias(SESSION), F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("timestamp").alias("ended_at"),
        (F.floor(F.col("o_totalprice") / 50) / 10).alias("grade"), (F.col("o_orderstatus") == "F").alias("rooted"), F.col("o_orderpriority").alias("platform"),
        (F.col("o_orderkey") % 10 == 0).alias("demo"), (F.col("o_orderkey") % 13 == 0).alias("recording"), (F.col("o_orderkey") % 50).alias("episodes"))


@query("progress_series", """select o_custkey "owner", o_orderkey::varchar session_uuid, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey::varchar) as "position"
from orders where o_orderkey % 10 <> 0""")
def progress_series(spark, sf):
    return progress.progress_series(_cards(spark, sf), "owner").select("owner", SESSION, "position")


@query("progress_summaries", """with g as (select o_custkey "owner", floor(o_totalprice / 50) / 10 grade, o_orderstatus, o_orderpriority from orders where o_orderkey % 10 <> 0)
select "owner", count(*) runs, round(avg((o_orderstatus = 'F')::int) * 100, 6)::double rooted_rate, max(grade) best_grade,
  case when count(*) % 2 = 1 then median(grade) else floor(median(grade) + 0.5) end::double median_grade, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) platforms from g group by 1""")
def progress_summaries(spark, sf):
    series = progress.progress_series(_cards(spark, sf), "owner")
    out = progress.progress_summary(series, "owner")
    return out.withColumn("rooted_rate", F.round("rooted_rate", 6)).withColumn("platforms", F.array_join("platforms", ","))


@query("latest_runs", """select o_orderkey::varchar session_uuid, o_orderkey::varchar = arg_max(o_orderkey::varchar, (o_orderdate, o_orderkey::varchar)) over (partition by o_custkey) is_latest from orders""")
def latest_runs(spark, sf):
    return progress.mark_latest(_cards(spark, sf), "owner").select(SESSION, "is_latest")


@query("default_runs", """select o_custkey "owner", arg_max(o_orderkey::varchar, (o_orderkey % 50, o_orderdate, o_orderkey::varchar)) session_uuid from orders group by 1""")
def default_runs(spark, sf):
    return progress.default_session(_cards(spark, sf), "owner")


# --- investigations ---------------------------------------------------------------------------------

STOPS = ", ".join(f"'{w}'" for w in rules.INDICATOR_STOPWORDS)
PHASES = " ".join(f"when '{k}' then {v}" for k, v in rules.ARTIFACT_PHASE_WEIGHTS.items())
CASES = f"""
us as (select distinct session_uuid from ep),
cases as (select a.session_uuid || '-case' case_id, a.session_uuid inc, b.session_uuid run from us a join us b on b.session_uuid::int = a.session_uuid::int + 1),
tk as (select ep.*, list_filter(string_split_regex(cmd || ' ' || coalesce(output_digest, ''), '[\\s''"();]+'), lambda w: length(w) >= 4 and not list_contains([{STOPS}], lower(w)) and (regexp_matches(w, '[/.]') or regexp_matches(w, '(?i)^CVE-\\d') or length(w) > 6)) ws,
  regexp_extract_all(cmd, '[\\w.-]+\\.(?:conf|sh|service|txt|php|py|exe)\\b') files, (select max(f."value") from found f where f.session_uuid = ep.session_uuid and f.kind = 'vuln' and f.source_seq = ep.seq) cve from ep),
il as (select *, list_distinct(list_transform(ws, lambda w: regexp_replace(w, '^\\.*', ''))) d, list_transform(ws, lambda w: regexp_replace(w, '^\\.*', '')) o from tk),
ord as (select *, list_filter(o, lambda x, i: list_position(o, x) = i) firsts from il),
al2 as (select *, list_concat(list_concat(firsts, files), case when cve is null then [] else [cve] end) alls from ord),
ind as (select *, list_filter(alls, lambda x, i: list_position(alls, x) = i) inds from al2),
arts as (select session_uuid, seq source_seq, 'art:seq' || seq artifact_id, inds, case when cve is not null then "binary" || ' (' || cve || ')' else "binary" || ': ' || cmd end "label",
  case coalesce(ukc.ukc, 'unknown') {PHASES} else 2 end + case when cve is not null then 2 else 0 end weight, lag('art:seq' || seq) over (partition by session_uuid order by seq) depends_on
  from ind left join ukc using (tactic) where len(inds) > 0)"""


def _cases(run):
    """Each user's session investigated by the next user."""
    users = run.sessions
    after = users.select(F.col(SESSION).alias("run_session"), (F.col(SESSION).cast("bigint") - 1).cast("string").alias("incident_session"))
    pairs = users.select(F.concat(SESSION, F.lit("-case")).alias("case_id"), F.col(SESSION).alias("incident_session"))
    return pairs.join(after, "incident_session").select("case_id", "incident_session", "run_session")


def _artifacts(run):
    return defense.artifacts(classify.with_frameworks(run.staged), run.findings)


@query("incident_artifacts", f"""with {SQL_EPISODES} {FINDINGS}, {UKC}, {CASES} select session_uuid, artifact_id, "label", weight, depends_on, array_to_string(inds, '|') indicators from arts""")
def incident_artifacts(spark, sf):
    return _artifacts(Run(spark, sf)).select(SESSION, "artifact_id", "label", "weight", "depends_on", F.array_join("indicators", "|").alias("indicators"))


HITS = """
need as (select case_id, run, artifact_id, unnest(inds) x, generate_subscripts(inds, 1) i from cases join arts on arts.session_uuid = cases.inc),
txt as (select session_uuid, seq, started_at_ms, lower(cmd || ' ' || coalesce(output_digest, '')) h from ep),
loc as (select n.case_id, n.artifact_id, n.x, n.i, t.seq, t.h, lower(n.x) nd, strpos(t.h, lower(n.x)) p from need n join txt t on t.session_uuid = n.run where contains(t.h, lower(n.x))),
okk as (select * from loc where not (p > 1 and regexp_matches(substr(h, p - 1, 1), '^[a-z0-9]$') and regexp_matches(left(nd, 1), '^[a-z0-9]$'))
  and not (regexp_matches(substr(h, p + length(nd), 1), '^[a-z0-9]$') and regexp_matches(right(nd, 1), '^[a-z0-9]$'))),
ht as (select case_id, artifact_id, min(seq) s, arg_min(x, (seq, i)) ind from okk group by 1, 2),
hits as (select c.case_id, c.run, a.artifact_id, a."label", a.weight, a.source_seq, a.depends_on, ht.s found_by_seq, ht.s is not null found, ht.ind matched_indicator,
  case when ht.s is not null then (select started_at_ms from txt where session_uuid = c.run and seq = ht.s) - (select min(started_at_ms) from txt where session_uuid = c.run and seq = 1) end found_at_ms
  from cases c join arts a on a.session_uuid = c.inc left join ht on ht.case_id = c.case_id and ht.artifact_id = a.artifact_id)"""
DEF = f"with {SQL_EPISODES} {FINDINGS}, {UKC}, {CASES}, {HITS}"


def _hits(run):
    cases = stage(_cases(run), "cases")
    arts = stage(defense.case_artifacts(cases, _artifacts(run)), "artifacts")
    steps = stage(defense.case_steps(cases, run.staged), "steps")
    return cases, stage(defense.hits(arts, steps), "hits"), steps


@query("investigation_hits", f"{DEF} select case_id, artifact_id, found, found_by_seq, found_at_ms, matched_indicator from hits")
def investigation_hits(spark, sf):
    return _hits(Run(spark, sf))[1].select("case_id", "artifact_id", "found", "found_by_seq", "found_at_ms", "matched_indicator")


@query("investigation_steps", f"""{DEF} select c.case_id, t.seq, exists (select 1 from hits h where h.case_id = c.case_id and h.found_by_seq = t.seq) advancing from cases c join txt t on t.session_uuid = c.run""")
def investigation_steps(spark, sf):
    _c, found, steps = _hits(Run(spark, sf))
    return defense.step_roles(found, steps)


@query("investigation_ghost", f"""{DEF} select h.case_id, h.source_seq unlock_seq, h."label" objective, h.found_by_seq actual_seq, case when not h.found then 'skipped'
  when h.depends_on is not null and (d.found_by_seq is null or d.found_by_seq > h.found_by_seq) then 'late_pivot' else 'on_time' end verdict
from hits h left join hits d on d.case_id = h.case_id and d.artifact_id = h.depends_on""")
def investigation_ghost(spark, sf):
    return defense.defense_ghost(_hits(Run(spark, sf))[1])


@query("investigation_lessons", f"""{DEF} select case_id, 'Missed: ' || arg_max("label", (weight, -source_seq)) || '. No other missed artifact weighs more; follow the hits you have back to it.' as "text",
  arg_max(source_seq, (weight, -source_seq)) evidence_seq from hits where not found group by 1""")
def investigation_lessons(spark, sf):
    return defense.defense_lesson(_hits(Run(spark, sf))[1])


GRADES = f"""{DEF}, st as (select c.case_id, count(*) n, max(t.seq) mx, count(*) filter (exists (select 1 from hits h where h.case_id = c.case_id and h.found_by_seq = t.seq)) adv from cases c join txt t on t.session_uuid = c.run group by 1),
ln as (select h.*, d.found df, d.found_by_seq ds from hits h left join hits d on d.case_id = h.case_id and d.artifact_id = h.depends_on),
pt as (select case_id, sum(weight) filter (found) * 100.0 / sum(weight) cov, count(*) filter (found and depends_on is not null) ch, count(*) filter (found and depends_on is not null and df and ds <= found_by_seq) io, count(*) filter (found) f, sum(found_by_seq) sq from ln group by 1),
p2 as (select case_id, floor(coalesce(cov, 0) * 10 + 0.5) / 10 a, floor(case when ch > 0 then io * 100.0 / ch else 100 end * 10 + 0.5) / 10 b, floor(case when f > 0 then greatest(0, (1 - sq / mx::double / f) * 100) else 0 end * 10 + 0.5) / 10 c, 100.0 d,
  floor(adv * 100.0 / n * 10 + 0.5) / 10 e from pt join st using (case_id)),
sc as (select case_id, floor((floor(a * 0.34 * 10 + 0.5) / 10 + floor(b * 0.2 * 10 + 0.5) / 10 + floor(c * 0.16 * 10 + 0.5) / 10 + floor(d * 0.16 * 10 + 0.5) / 10 + floor(e * 0.14 * 10 + 0.5) / 10) * 10 + 0.5) / 10 score from p2)""".replace("100.0 d,", "100.0::double d,")


@query("investigation_grades", f"{GRADES} select case_id, score from sc")
def investigation_grades(spark, sf):
    _c, found, steps = _hits(Run(spark, sf))
    return defense.defense_grade(found, defense.step_roles(found, steps)).select("case_id", "score")


@query("defense_reports", f"""{GRADES}, tot as (select case_id, count(*) artifacts, count(*) filter (found) found,
  count(*) filter (found and not (depends_on is not null and (ds is null or ds > found_by_seq))) human_wins from ln group by 1),
les as (select case_id, 'Missed: ' || arg_max("label", (weight, -source_seq)) || '. No other missed artifact weighs more; follow the hits you have back to it.' lesson,
  arg_max(source_seq, (weight, -source_seq)) lesson_seq from hits where not found group by 1)
select case_id, score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end letter, artifacts, found, human_wins, lesson, lesson_seq
from sc join tot using (case_id) left join les using (case_id)""")
def defense_reports(spark, sf):
    run = Run(spark, sf)
    cases = stage(_cases(run), "cases")
    out = defense.defense_report(cases, classify.with_frameworks(run.staged), run.findings)
    return out.select("case_id", "score", "letter", "artifacts", "found", "human_wins", "lesson", "lesson_seq")


# --- coaching, audits and reports -------------------------------------------------------------------


@query("coaching_steps", f"""with {ALIGNED}, {WASTE}, wz as (select session_uuid, {FOLD} from w group by 1),
n as (select session_uuid, seq, "binary", {NOISE} noise from ep), top as (select session_uuid, arg_min(seq, (-noise, seq)) seq, arg_min("binary", (-noise, seq)) b from n where noise > 0 group by 1),
st as (select session_uuid, ordinal step_order, 'Attempt **' || replace(objective, '_', ' ') || '**' as "action", null::bigint evidence_seq from board where user_satisfied_by_seq is null
  union all select session_uuid, 10000, 'Quiet down `' || b || '`', seq from top
  union all select session_uuid, 10001, 'Trim ~' || floor(detour_ms / 60000.0 + 0.5)::bigint || ' min spent on detours', null from wz where floor(detour_ms / 60000.0 + 0.5) >= 1)
select * from st union all select session_uuid, 0, 'Clean run', null from wz where session_uuid not in (select session_uuid from st)""")
def coaching_steps(spark, sf):
    run = Run(spark, sf)
    return coaching.coaching_steps(run.aligned, run.board).select(SESSION, "step_order", "action", "evidence_seq")


@query("one_lesson", f"""{ITEMS}, {CHECKS}, {HOLES}, late as (select session_uuid, arg_max(coalesce(actual_seq, unlock_seq), lag_ms) e from items where verdict = 'late_pivot' group by 1),
un as (select session_uuid, arg_min(evidence_seq, check_order) e, count(*) n from chk where applicable and not done group by 1), hh as (select session_uuid, arg_max(start_seq, (wasted_ms, -start_seq)) e from holes group by 1)
select s.session_uuid, case when late.session_uuid is not null then 1 when un.session_uuid is not null then 2 when hh.session_uuid is not null then 3 else 4 end priority from (select distinct session_uuid from ep) s
left join late using (session_uuid) left join un using (session_uuid) left join hh using (session_uuid)""")
def one_lesson(spark, sf):
    run = Run(spark, sf)
    checks = analysis.methodology_checks(run.aligned, run.board, run.findings)
    steps = coaching.coaching_steps(run.aligned, run.board)
    return coaching.one_lesson(run.ghost, checks, analysis.rabbit_holes(run.aligned), steps).select(SESSION, "priority")


AUDIT = f"""with {ALIGNED}, {WASTE}, {CWE}, e as (select session_uuid, tactic, {FOLD} from w group by 1, 2),
pn as (select session_uuid, tactic, seq, noise_weight * (1 + log10(greatest(1, volume))) n from ep where noise_weight > 0), lm as (select session_uuid, tactic, round(max(n), 6)::double loudest_noise, arg_min(seq, (-n, seq)) loudest_seq from pn group by 1, 2),
u as (select session_uuid, tactic, count(*) commands, count(distinct technique) techniques, string_agg(distinct cwe, ',' order by cwe) cwe from ep left join weak on weak.b = lower("binary") group by 1, 2),
gb as (select session_uuid, tactic, count(user_satisfied_by_seq) satisfied, count(*) objectives from board group by 1, 2),
au as (select e.session_uuid, e.tactic, floor(efficiency_pct + 0.5)::bigint efficiency, detour_ms + loop_ms + stuck_ms wasted_ms, commands, techniques, coalesce(cwe, '') cwe, coalesce(satisfied, 0) satisfied, coalesce(objectives, 0) objectives, loudest_noise, loudest_seq
  from e join u using (session_uuid, tactic) left join gb using (session_uuid, tactic) left join lm using (session_uuid, tactic))"""


def _phase_audits(run):
    phases = stage(timeline.phases(run.aligned), "phases")
    return phases, audits.phase_audits(run.aligned, phases, run.board)


@query("phase_audits", f"{AUDIT} select * from au")
def phase_audits(spark, sf):
    df = _phase_audits(Run(spark, sf))[1]
    return df.select(SESSION, "tactic", "efficiency", "wasted_ms", "commands", F.col("techniques").cast("bigint").alias("techniques"), F.array_join("cwe", ",").alias("cwe"),
                     "satisfied", "objectives", F.round("loudest_noise", 6).alias("loudest_noise"), "loudest_seq")


@query("phase_stats", f"""{AUDIT} select session_uuid, tactic, case when objectives > 0 then satisfied end reached, case when objectives > 0 then objectives end total, wasted_ms < 30000 lost_is_zero from au""")
def phase_stats(spark, sf):
    return audits.phase_stats(_phase_audits(Run(spark, sf))[1]).drop("lost")


@query("phase_lead", f"""{AUDIT} select session_uuid, count(*) filter (efficiency >= 100) as "full", count(*) total from au group by 1""")
def phase_lead(spark, sf):
    return audits.phase_lead(_phase_audits(Run(spark, sf))[1])


_TEXT = "replace(b.objective, '_', ' ')"
_LABELS = " ".join(f"when regexp_matches({_TEXT} || ' ' || g.methods[1], '{pattern}') then '{name}'" for pattern, name in rules.COACHING_RULES)
_HOMES = " ".join(f"when '{category}' then '{tactic}'" for category, tactic in rules.CATEGORY_TACTIC.items())
_PHASES = " ".join(f"when '{tactic}' then '{name}'" for tactic, name in rules.TACTIC_CATEGORY.items())
_CHECKS = ", ".join(f"('{check}', '{tactic}', '{label}', '{hint}')" for _order, check, tactic, label, hint in rules.METHODOLOGY_CHECKS)
AUDIT_ITEMS = f"""with {ALIGNED} {FINDINGS}, {ESCALATION}, {SLOW}, {CHECKS}, {HOLES}, {RECOVERIES}, {WASTE}, present as (select distinct session_uuid, tactic from ep),
wz as (select session_uuid, sum(detour) detour_ms from w group by 1), plain as (select session_uuid, tactic, seq, noise_weight * (1 + log10(greatest(1, volume))) n from ep where noise_weight > 0),
loudest as (select session_uuid, arg_max(tactic, (n, -f, tactic)) loud from (select session_uuid, tactic, max(n) n, min(seq) f from plain group by 1, 2) group by 1),
nz as (select session_uuid, seq, "binary", {NOISE} noise from ep), top as (select session_uuid, arg_min(seq, (-noise, seq)) seq, arg_min("binary", (-noise, seq)) b from nz where noise > 0 group by 1),
told as (select b.session_uuid, b.ordinal step_order, 'Attempt **' || {_TEXT} || '**' title, 'No command of the session fits; the path lists `' || g.methods[1] || '` for it.' detail, case {_LABELS} else 'Tactics' end category, null::bigint e
    from board b join gold g using (ordinal) where b.user_satisfied_by_seq is null
  union all select session_uuid, 10000, 'Quiet down `' || b || '`', 'This step made more noise than any other of the session.', 'OpSec', seq from top
  union all select session_uuid, 10001, 'Trim ~' || floor(detour_ms / 60000.0 + 0.5)::bigint || ' min spent on detours', 'These steps met no objective; look for new leads before repeating them.', 'Tactics', null
    from wz where floor(detour_ms / 60000.0 + 0.5) >= 1),
step as (select told.*, row_number() over (partition by told.session_uuid order by step_order) - 1 i, coalesce(ep.tactic, case category {_HOMES} end) want from told left join ep on ep.session_uuid = told.session_uuid and ep.seq = told.e),
placed as (select step.*, coalesce(present.tactic, case when category = 'OpSec' then loud end) place from step left join loudest using (session_uuid)
  left join present on present.session_uuid = step.session_uuid and present.tactic = step.want),
losses as (select session_uuid, tactic, count(*) filter (alignment = 'detour') d, sum(a) filter (alignment = 'detour') dm, min(seq) filter (alignment = 'detour') df, arg_min(cmd, seq) filter (alignment = 'detour') dc,
  count(loop_of_seq) l, sum(a) filter (loop_of_seq is not null) lm, min(seq) filter (loop_of_seq is not null) lf, sum(stuck) st from w group by 1, 2),
shell as (select session_uuid, min(seq) filter ("binary" = 'ssh' and duration_ms >= 60000) e, bool_or(coalesce(regexp_matches(context_path, '(?i)ssh:'), false)) landed from ep group by 1),
rule(check_id, tactic, label, hint) as (values {_CHECKS}),
worst as (select session_uuid, max(wasted_ms) wasted_ms, arg_max(start_seq, (wasted_ms, -start_seq)) e, arg_max("binary", (wasted_ms, -start_seq)) b, arg_max(attempts, (wasted_ms, -start_seq)) n from holes group by 1),
late as (select session_uuid, floor(median(latency_ms) + 0.5)::bigint ms from rec group by 1 having floor(median(latency_ms) + 0.5) > 300000),
first_path as (select session_uuid, arg_min(replace(path_id, ':', ' '), (evidence_seq, path_id)) title from pth where severity = 'confirmed' group by 1),
led as (select slow.*, first_path.title, present.tactic have, case when slow_line then 'privesc-slow-line' when confirmed > 0 and rooted_seq is null then 'privesc-unrealized' when confirmed > 0 then 'privesc-clean-take' end line,
    (select sum(duration_ms + gap_before_ms) from al where al.session_uuid = slow.session_uuid and seq > first_confirmed_seq and seq < rooted_seq) between_ms
  from slow left join first_path using (session_uuid) left join present on present.session_uuid = slow.session_uuid and present.tactic = 'TA0004')
select session_uuid, place tactic, 10 item_order, coalesce(place, 'general') || '-coach-' || i item_id, 'insight' kind, title, detail, null::bigint savings_ms, e evidence_seq, category from placed
union all select session_uuid, tactic, 20, tactic || '-detour', 'insight', d || ' dead-end ' || case when d = 1 then 'command' else 'commands' end || ' during the phase',
  case when d = 1 then '`' || dc || '` met no objective.' else 'None of these steps met an objective or revealed anything.' end, dm::bigint, df, null from losses where d > 0
union all select session_uuid, tactic, 21, tactic || '-loop', 'insight', l || ' repeated ' || case when l = 1 then 'attempt' else 'attempts' end || ' (loops)', 'Each of these repeats a command that had just failed.', lm::bigint, lf, null from losses where l > 0
union all select session_uuid, tactic, 22, tactic || '-stuck', 'insight', 'Long stalls: ' || floor(st / 60000.0 + 0.5)::bigint || ' min of pauses beyond the usual gap', 'Gaps longer than the session typically has between commands.', st::bigint, null, null from losses where st >= 60000
union all select session_uuid, tactic, 30, tactic || '-noref', 'manual', 'Compare this phase with a reference path', 'The session has no intended path, so nothing here can be checked off.', null, null, null from present where session_uuid not in (select session_uuid from board)
union all select session_uuid, null, 40, 'ssh-opaque-block', 'insight', 'The remote shell was recorded as one step', 'Nothing that ran inside the `ssh` session is known. Tap the session to record its commands.', null, e, 'Tactics' from shell where e is not null and not landed
union all select chk.session_uuid, present.tactic, 50, 'methodology-' || check_id, 'insight', label, hint, null, evidence_seq, case rule.tactic {_PHASES} end
  from chk join rule using (check_id) left join present on present.session_uuid = chk.session_uuid and present.tactic = rule.tactic where applicable and not done
union all select worst.session_uuid, ep.tactic, 60, 'focus-rabbit-hole', 'insight', 'Rabbit hole: ' || n || ' low-yield `' || b || '` without progress', 'The same tool ran again and again without a result that led on.', wasted_ms, e, null
  from worst join ep on ep.session_uuid = worst.session_uuid and ep.seq = worst.e
union all select session_uuid, null, 70, 'recovery-slow', 'insight', 'Median time to recover: ' || floor(ms / 60000.0 + 0.5)::bigint || ' min', 'Half of the detours and loops took at least this long until a step moved an objective.', null, null, null from late
union all select session_uuid, have, 80, line, case when line = 'privesc-clean-take' then 'pass' else 'insight' end, case line when 'privesc-slow-line' then 'Confirmed path (' || title || ') visible from step ' || first_confirmed_seq || '; root came at step ' || rooted_seq
  when 'privesc-unrealized' then 'Confirmed escalation path left unused: ' || title else 'Took the confirmed escalation path (' || title || ') directly' end, null,
  case when line = 'privesc-slow-line' and between_ms > 0 then between_ms end::bigint, first_confirmed_seq, 'PrivEsc' from led where line is not null"""


@query("audit_items", AUDIT_ITEMS)
def audit_items(spark, sf):
    run = Run(spark, sf)
    steps = coaching.coaching_steps(run.aligned, run.board)
    checks = analysis.methodology_checks(run.aligned, run.board, run.findings)
    recovery = analysis.recovery_median(analysis.recoveries(run.aligned, run.board))
    return audits.audit_items(run.aligned, run.board, steps, checks, analysis.rabbit_holes(run.aligned), recovery, run.paths, run.escalation)


@query("audit_waste_items", f"""with {ALIGNED}, {WASTE}, s as (select session_uuid, tactic, count(*) filter (alignment = 'detour') d, sum(a) filter (alignment = 'detour') dm, min(seq) filter (alignment = 'detour') df,
  count(loop_of_seq) l, sum(a) filter (loop_of_seq is not null) lm, min(seq) filter (loop_of_seq is not null) lf, sum(stuck) st from w group by 1, 2)
select session_uuid, tactic, tactic || '-detour' item_id, dm::bigint savings_ms, df evidence_seq from s where d > 0 union all select session_uuid, tactic, tactic || '-loop', lm::bigint, lf from s where l > 0
union all select session_uuid, tactic, tactic || '-stuck', st::bigint, null from s where st >= 60000""")
def audit_waste_items(spark, sf):
    df = audit_items(spark, sf)
    return df.where("item_order between 20 and 22").select(SESSION, "tactic", "item_id", "savings_ms", "evidence_seq")


REPORTS = f"""with {ALIGNED} {FINDINGS}, {ESCALATION}, {CWE}, ev0 as (
  select session_uuid, 'cve-' || lower("value") finding_id, 'unset' severity, source_seq seq, 0 r from found where kind = 'vuln'
  union all select session_uuid, 'vector-' || vector, case vector when 'sudo' then 'high' else 'medium' end, evidence_seq, 0 from pth
  union all select session_uuid, 'cwe-' || lower(cwe), 'high', seq, 0 from ep join weak on weak.b = lower("binary") where cwe = 'CWE-89'),
rf as (select session_uuid, finding_id, any_value(severity) severity, min(seq) first_seq, count(*) evidence from ev0 group by 1, 2),
rs as (select *, row_number() over (partition by session_uuid order by case severity when 'high' then 1 when 'medium' then 2 else 5 end, first_seq, finding_id)::int as "position" from rf)"""


def _reports(run):
    eps = classify.with_frameworks(run.aligned)
    evidence = stage(report.finding_evidence(eps, run.findings, run.paths), "evidence")
    return eps, evidence, stage(report.report_findings(evidence), "reports")


@query("report_findings", f"{REPORTS} select * from rs")
def report_findings(spark, sf):
    return _reports(Run(spark, sf))[2].select(SESSION, "finding_id", "severity", "first_seq", "evidence", "position")


@query("report_reproduction", f"""{REPORTS} select rs.session_uuid, finding_id, e.seq, e.cmd from rs join ep x on x.session_uuid = rs.session_uuid and x.seq = rs.first_seq
join ep e on e.session_uuid = rs.session_uuid and e.tactic = x.tactic and e.seq <= rs.first_seq""")
def report_reproduction(spark, sf):
    eps, _e, reports = _reports(Run(spark, sf))
    return report.reproduction(reports, eps)


@query("report_severities", f"""{REPORTS} select session_uuid, 0::bigint critical, count(*) filter (severity = 'high') high, count(*) filter (severity = 'medium') medium, 0::bigint low, 0::bigint info,
  count(*) filter (severity = 'unset') unset, count(*) findings from rs group by 1""")
def report_severities(spark, sf):
    return report.severity_counts(_reports(Run(spark, sf))[2])


@query("report_lines")
def report_lines(spark, sf):
    from runlens.operators import align

    run = Run(spark, sf)
    eps, evidence, reports = _reports(run)
    status = align.objective_status(run.aligned, run.board, run.findings, run.uses)
    none = F.lit(None).cast("string")
    sessions = run.sessions.select(SESSION, F.concat(F.lit("Box "), SESSION).alias("target_name"), F.lit("htb").alias("platform"), none.alias("difficulty"),
                                   F.lit("host").alias("context_path"), F.lit("2024-01-01").alias("started_at"), F.lit("2024-01-31").alias("ended_at"))
    return report.report_lines(sessions, eps, stage(timeline.phases(run.aligned), "phases"), status, reports, evidence, run.findings)


WALK = f"""with {ALIGNED} {FINDINGS}, {TIMED}, lb as (select al.*, case tactic {LABELS} else tactic end "label" from al), wk as (select *, lag("label") over (partition by session_uuid order by seq) before from lb),
ph as (select session_uuid, string_agg("label", ' → ' order by first_seq) p from (select session_uuid, "label", tactic, min(seq) first_seq from lb group by 1, 2, 3) group by 1),
se as (select distinct session_uuid, 'Box ' || session_uuid n from al), kd as (select session_uuid, kind, "value", source_seq, min(source_seq) over (partition by session_uuid, kind) k from found where kind in ('port', 'service', 'cred')),
gr as (select session_uuid, "binary" b, count(*) n, min(seq) q from al group by 1, 2), lines("section", place, sub, session_uuid, line) as (
select 1, 0, 0, session_uuid, '# ' || n || ': session report' || chr(10) || chr(10) || '**Target:** ' || n || ' (htb)  ' || chr(10) || '**From, to:** 2024-01-01 → 2024-01-31  ' || chr(10) || '> Profile `full`: secrets are shown as recorded. Mask them before passing this on.' from se
union all select 4, 0, 0, session_uuid, '## Scope' || chr(10) || chr(10) || '- **Target:** ' || n || chr(10) || '- **Platform:** htb' || chr(10) || '- **Context:** host' || chr(10) || '- **Window:** 2024-01-01 → 2024-01-31' from se
union all select 5, 0, 0, session_uuid, '## Methodology' || chr(10) || 'Commands were tagged with ATT&CK techniques, kill-chain phases and CWE classes.' || chr(10) || 'Phases exercised: ' || p || '.' from ph
union all select 7, -1, 0, session_uuid, '## Walkthrough' || chr(10) from se
union all select 7, seq, 0, session_uuid, '### ' || "label" || chr(10) from wk where before is distinct from "label"
union all select 7, seq, 1, session_uuid, '- `#' || seq || '` `' || cmd || '`' || case when coalesce(output_digest, '') <> '' then ': ' || output_digest else '' end from al
union all select 8, -1, 0, session_uuid, '## Appendix' || chr(10) || chr(10) || '### Command log' || chr(10) || chr(10) || '| # | Time | Command |' || chr(10) || '| --- | --- | --- |' from se
union all select 8, seq, 0, session_uuid, '| ' || seq || ' | ' || (ms // 60000) || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || ' | `' || cmd || '` |' from (select *, started_at_ms - arg_min(started_at_ms, seq) over (partition by session_uuid) ms from al)
union all select 9, -1, 0, session_uuid, chr(10) || '### Findings ledger' || chr(10) || chr(10) || '| Kind | Value |' || chr(10) || '| --- | --- |' from se
union all select 9, k, source_seq, session_uuid, '| ' || kind || ' | ' || case when kind = 'cred' then '••••' else "value" end || ' |' from kd
union all select 9, 0, 0, session_uuid, '| — | — |' from se where session_uuid not in (select session_uuid from kd)
union all select 10, -1152921504606846976, 0, session_uuid, chr(10) || '### Tool loadout' || chr(10) || chr(10) || '| Tool | Count |' || chr(10) || '| --- | --- |' from se
union all select 10, -n, q, session_uuid, '| `' || b || '` | ' || n || ' |' from gr)"""


@query("report_walkthrough", f"{WALK} select session_uuid, \"section\", place::bigint \"at\", sub::bigint sub, line from lines")
def report_walkthrough(spark, sf):
    """Header, scope, methodology, walkthrough and appendix of the written report, line by line; findings have their own queries."""
    return report_lines(spark, sf).where(F.col("section").isin(1, 4, 5, 7, 8, 9, 10))


@query("session_metric_rows", f"""{ITEMS}, {UKC}, {CWE}, {WASTE}, {HOLES}, {RECOVERIES}, wz as (select session_uuid, {FOLD} from w group by 1),
n as (select session_uuid, sum({NOISE}) total from ep group by 1), rm as (select session_uuid, floor(median(latency_ms) + 0.5)::bigint recovery_median_ms from rec group by 1),
gt as (select session_uuid, sum(case when verdict = 'late_pivot' then lag_ms else 0 end)::bigint ghost_time_lost_ms, count(*) filter (verdict in ('ahead', 'off_path_win')) ghost_human_wins from items group by 1),
cv as (select session_uuid, floor(count(user_satisfied_by_seq) * 100.0 / count(*) + 0.5) objective_coverage_pct from board group by 1)
select session_uuid, floor(efficiency_pct + 0.5) efficiency_pct, floor(greatest(0, 100 - least(100, total / 400 * 100)) + 0.5) stealth_score, objective_coverage_pct, recovery_median_ms, ghost_time_lost_ms, ghost_human_wins,
  productive_ms, detour_ms, stuck_ms, loop_ms, active_ms, technique_breadth
from wz join (select session_uuid, count(distinct technique) filter (technique <> '') technique_breadth from al group by 1) tb using (session_uuid) join n using (session_uuid) join cv using (session_uuid) left join rm using (session_uuid) left join gt using (session_uuid)""")
def session_metric_rows(spark, sf):
    from runlens.operators import ghost

    run = Run(spark, sf)
    row = debrief.metric_row(run.aligned, run.board, ghost.totals(run.ghost))
    return row.select(SESSION, "efficiency_pct", "stealth_score", "objective_coverage_pct", F.col("recovery_median_ms").cast("bigint").alias("recovery_median_ms"),
                      "ghost_time_lost_ms", "ghost_human_wins", "productive_ms", "detour_ms", "stuck_ms", "loop_ms", "active_ms", "technique_breadth")


_LOW = "case when {c} < 50 then 'Low {name} (' || {c}::bigint || ').' end"
GRADED = f"""{ALIGNED}, found as (select null::varchar session_uuid, null::bigint source_seq, null::varchar kind, null::varchar "value" where false), {CHECKS}, {UKC}, {WASTE}, {HOLES},
wz as (select session_uuid, {FOLD} from w group by 1), nz as (select session_uuid, sum({NOISE}) total from ep group by 1),
tb as (select session_uuid, count(distinct technique) filter (technique <> '') breadth from al group by 1),
cv as (select session_uuid, floor(count(user_satisfied_by_seq) * 100.0 / count(*) + 0.5) coverage from board group by 1),
ranked as (select session_uuid, ukc_rank, lag(ukc_rank) over (partition by session_uuid order by seq) p from ep join ukc using (tactic)),
pr as (select session_uuid, floor(case when count(p) = 0 then 100 else count(*) filter (ukc_rank >= p) * 100.0 / count(p) end + 0.5) progression from ranked group by 1),
me as (select session_uuid, floor(count(*) filter (done) * 100.0 / count(*) filter (applicable) + 0.5) methodology from chk group by 1),
spent as (select session_uuid, sum({ACTIVE}) t from al group by 1), sunk as (select session_uuid, sum(wasted_ms) x from holes group by 1),
fo as (select session_uuid, floor(greatest(0, least(100, 100 - coalesce(x, 0) / greatest(t, 1)::double * 100)) + 0.5) focus from spent left join sunk using (session_uuid)),
c as (select session_uuid, false meas, coverage::double r1, least(100, breadth / {rules.BREADTH_TARGET}.0 * 100)::double r2, floor(efficiency_pct + 0.5)::double r3,
  coalesce(progression, 100)::double r4, floor(greatest(0, 100 - least(100, total / 400 * 100)) + 0.5)::double r5, 0::double r6, methodology::double r7, focus::double r8
  from wz join nz using (session_uuid) join tb using (session_uuid) join cv using (session_uuid) join me using (session_uuid) join fo using (session_uuid) left join pr using (session_uuid)),
g as (select *, floor(({_score(rules.RUBRIC_V2)}) * 10 + 0.5) / 10 score,
  concat_ws(' ', {", ".join(_LOW.format(c=RAWS[name], name=name) for name in ("coverage", "efficiency", "progression", "discipline", "methodology", "focus"))}) said from c)"""


@query("session_grades", f"""with {GRADED} select session_uuid, score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end letter, 2 "version",
  'grade' routed_to, case when said = '' then 'All parts of the rubric are met and the integrity gate is passed.' else said end rationale from g""")
def session_grades(spark, sf):
    run = Run(spark, sf)
    return grade.grade(debrief.metric_row(run.aligned, run.board)).select(SESSION, "score", "letter", "version", "routed_to", F.array_join("rationale", " ").alias("rationale"))
