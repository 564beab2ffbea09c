"""Segmentation, timeline and waste on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bindings import SQL_EPISODES, SQL_RAW, Run, raw_commands, table
from catalog.kit import ALIGNED, P75, WASTE, registry
from runlens import rules
from runlens.operators import metrics, segment, timeline
from runlens.schemas import SESSION

QUERIES, query = registry()

EP_COLUMNS = [
    SESSION, "seq", "cmd", "binary", "started_at_ms", "duration_ms", "gap_before_ms", "exit_code", "actor", "output_digest",
    "tactic", "technique", "confidence", "noise_weight", "volume", "context_path",
]


@query("session_think_gaps", f"""with {SQL_RAW}
select session_uuid, ord, coalesce(greatest(0, started_at_ms - lag(ended_at_ms) over (
  partition by session_uuid, regexp_matches(context_path, 'ssh:') order by started_at_ms, ord)), 0)::bigint gap_ms from raw""")
def think_gaps(spark, sf):
    return segment.think_gaps(raw_commands(spark, sf)).select(SESSION, "ord", "gap_ms")


@query("session_episodes", f"with {SQL_EPISODES} select * from ep")
def episodes(spark, sf):
    return Run(spark, sf).segmented.select(*EP_COLUMNS)


@query("session_think_baseline", f"with {SQL_EPISODES}, {P75} select * from p75")
def baseline(spark, sf):
    return metrics.think_baseline(Run(spark, sf).segmented)


FOLD = """sum(a - detour - lp - stuck)::bigint productive_ms, sum(detour)::bigint detour_ms, sum(stuck)::bigint stuck_ms, sum(lp)::bigint loop_ms,
  sum(a)::bigint active_ms, round(case when sum(a) = 0 then 100 else (1 - sum(detour + lp + stuck) / sum(a)::double) * 100 end, 6)::double efficiency_pct"""


@query("session_waste", f"with {ALIGNED}, {WASTE} select session_uuid, {FOLD} from w group by 1")
def waste(spark, sf):
    return metrics.waste(Run(spark, sf).aligned).withColumn("efficiency_pct", F.round("efficiency_pct", 6))


@query("tactic_waste", f"with {ALIGNED}, {WASTE} select session_uuid, tactic, {FOLD} from w group by 1, 2")
def tactic_waste(spark, sf):
    return metrics.waste_by_tactic(Run(spark, sf).aligned).withColumn("efficiency_pct", F.round("efficiency_pct", 6))


TIMED = """
timed as (select *, started_at_ms - min(started_at_ms) over (partition by session_uuid) t0 from ep),
tl as (select *, t0 + duration_ms t1, greatest(0, t0 - gap_before_ms) gap_start from timed)"""
CUMULATIVE = """
cum as (select *, sum(gap_before_ms + duration_ms) over (partition by session_uuid order by seq)::bigint t1 from ep)"""


@query("timeline_absolute", f"with {SQL_EPISODES}, {TIMED} select session_uuid, seq, gap_start, t0, t1 from tl")
def timeline_absolute(spark, sf):
    return timeline.timeline(Run(spark, sf).segmented).select(SESSION, "seq", "gap_start", "t0", "t1")


@query("timeline_cumulative", f"""with {SQL_EPISODES}, {CUMULATIVE}
select session_uuid, seq, t1 - duration_ms - gap_before_ms gap_start, t1 - duration_ms t0, t1 from cum""")
def timeline_cumulative(spark, sf):
    untimed = Run(spark, sf).segmented.withColumn("started_at_ms", F.lit(None).cast("bigint"))
    return timeline.timeline(untimed).select(SESSION, "seq", "gap_start", "t0", "t1")


@query("timeline_length", f"with {SQL_EPISODES}, {TIMED} select session_uuid, max(t1) total_ms from tl group by 1")
def timeline_length(spark, sf):
    return timeline.timeline_length(timeline.timeline(Run(spark, sf).segmented))


LABELS = " ".join(f"when '{k}' then '{v}'" for k, v in rules.TACTIC_LABELS.items())


@query("session_phases", f"""with {ALIGNED}, {TIMED}, {WASTE}, e as (select session_uuid, tactic, {FOLD} from w group by 1, 2),
s as (select session_uuid, tactic, min(seq) first_seq, min(gap_start) t0, max(t1) t1 from tl group by 1, 2)
select session_uuid, tactic mitre_tactic, case tactic {LABELS} else tactic end "label", first_seq, t0, t1, floor(efficiency_pct + 0.5) efficiency_pct
from s join e using (session_uuid, tactic)""")
def phases(spark, sf):
    return timeline.phases(Run(spark, sf).aligned).drop("started_at", "ended_at")


@query("trimmed_waste", f"""with {ALIGNED}, bounds as (select session_uuid, max(seq) hi from al group by 1),
cut as (select al.* from al join bounds using (session_uuid) where seq between 3 and hi - 2), kept as (select * from cut), {WASTE.replace('from ep', 'from kept').replace('from al)', 'from kept)')}
select session_uuid, {FOLD} from w group by 1""")
def trimmed(spark, sf):
    run = Run(spark, sf)
    bounds = timeline.seq_bounds(run.aligned).select(SESSION, (F.col("last_seq") - 2).alias("from_seq"), F.lit(3).alias("to_seq"))
    wide = bounds.where("from_seq >= to_seq")
    kept, _board = timeline.trim(run.aligned.join(wide.select(SESSION), SESSION, "left_semi"), run.board, wide)
    return metrics.waste(kept).withColumn("efficiency_pct", F.round("efficiency_pct", 6))


@query("seq_bounds", f"with {SQL_EPISODES} select session_uuid, min(seq) first_seq, max(seq) last_seq from ep group by 1")
def bounds(spark, sf):
    return timeline.seq_bounds(Run(spark, sf).segmented)


@query("episode_at_playhead", f"""with {SQL_EPISODES}, {TIMED},
probe as (select distinct o_custkey % 150 c, (o_orderkey * 977 % 2592000)::bigint * 1000 at_ms from orders),
pr as (select c::varchar session_uuid, at_ms from probe where c::varchar in (select session_uuid from ep))
select pr.session_uuid, pr.at_ms, (select arg_max(seq, (gap_start, seq)) from tl where tl.session_uuid = pr.session_uuid and gap_start <= pr.at_ms) seq from pr""")
def episode_at(spark, sf):
    run = Run(spark, sf)
    probes = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 150).cast("string").alias(SESSION), ((F.col("o_orderkey") * 977 % 2592000) * 1000).alias("at_ms")
    ).join(run.sessions, SESSION, "left_semi")
    return timeline.episode_at(timeline.timeline(run.segmented), probes)


FLAGS = r"""
fl as (select session_uuid, min(case when u then seq end) user_seq, min(case when s then seq end) system_seq from (
  select session_uuid, seq, regexp_matches(cmd, '(?i)\b(user|local)\.txt\b') u, regexp_matches(cmd, '(?i)\b(root|proof|system)\.txt\b') s,
    regexp_matches(cmd, '(?i)\b(cat|type|more|less|head|tail|nl|strings|gc|get-content|powershell|xxd|base64)\b')
      or regexp_matches(coalesce(output_digest, ''), '(?i)\[redacted-flag\]|flags?\s+captured|\b[0-9a-f]{32}\b') r from ep)
  where (u or s) and r group by 1)"""


@query("flag_reads", f"with {SQL_EPISODES}, {FLAGS} select * from fl")
def flag_reads(spark, sf):
    return timeline.flag_reads(Run(spark, sf).segmented)


@query("flag_milestones", f"""with {SQL_EPISODES}, {FLAGS}, k as (
  select session_uuid, user_seq seq, 'user' kind from fl where user_seq is not null union all select session_uuid, system_seq, 'system' from fl where system_seq is not null)
select session_uuid, seq, string_agg(kind, ',' order by kind desc) kinds, any_value(cmd) cmd from k join ep using (session_uuid, seq) group by 1, 2""")
def flag_milestones(spark, sf):
    return timeline.flag_events(Run(spark, sf).segmented).select(SESSION, "seq", F.array_join("kinds", ",").alias("kinds"), "cmd")
