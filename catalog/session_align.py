"""Alignment, findings and objective status on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bindings import Run
from catalog.kit import ALIGNED, CLAIMS, FINDINGS, SQL_EPISODES, STATUS, registry
from runlens.operators import align, findings
from runlens.schemas import SESSION

QUERIES, query = registry()


@query("objective_candidates", f"with {CLAIMS} select session_uuid, ordinal, objective, seq, method_idx from cand")
def candidates(spark, sf):
    run = Run(spark, sf)
    return align.candidates(run.segmented, run.objectives, run.golden)


@query("objective_claims", f"with {CLAIMS} select session_uuid, ordinal, objective, seq, method_idx from claims")
def claims(spark, sf):
    run = Run(spark, sf)
    return align.claims(run.staged, run.objectives, run.golden)


@query("objective_order_breaks", f"with {ALIGNED} select session_uuid, seq from early")
def order_breaks(spark, sf):
    return align.early_satisfiers(Run(spark, sf).board)


@query("aligned_episodes", f"with {ALIGNED} select session_uuid, seq, alignment, loop_of_seq from al")
def aligned(spark, sf):
    return Run(spark, sf).aligned.select(SESSION, "seq", "alignment", "loop_of_seq")


@query("low_yield_steps", f"with {ALIGNED} select session_uuid, seq, failed low_yield from al")
def low_yield(spark, sf):
    return Run(spark, sf).segmented.select(SESSION, "seq", align.low_yield().alias("low_yield"))


@query("objective_status", f"""with {ALIGNED} {STATUS}
select session_uuid, ordinal, objective, user_satisfied_by_seq, proven_by_seq, finding_refs,
  case when user_satisfied_by_seq is not null then case when proven_by_seq is not null then 'proven' else 'reached' end
    when tried then 'attempted' else 'untouched' end status from status""")
def status(spark, sf):
    run = Run(spark, sf)
    df = align.objective_status(run.aligned, run.board, run.findings, run.uses)
    return df.select(SESSION, "ordinal", "objective", "user_satisfied_by_seq", "proven_by_seq",
                     F.size("finding_refs").cast("bigint").alias("finding_refs"), "status")


@query("objective_coverage", f"""with {CLAIMS} select session_uuid,
  round(count(user_satisfied_by_seq) * 100.0 / count(*), 6)::double objective_coverage_pct from board group by 1""")
def coverage(spark, sf):
    return align.coverage(Run(spark, sf).board).withColumn("objective_coverage_pct", F.round("objective_coverage_pct", 6))


ROUTE = f"""with {ALIGNED}, steps as (select b.session_uuid, b.ordinal, b.objective,
  case when b.user_satisfied_by_seq is null then 'skipped' when a.alignment in ('alternative', 'out_of_order') then a.alignment else 'match' end status,
  b.user_satisfied_by_seq seq, b.methods[1] suggestion, a."binary" from board b
  left join al a on a.session_uuid = b.session_uuid and a.seq = b.user_satisfied_by_seq)"""


@query("route_steps", f"{ROUTE} select * from steps")
def route_steps(spark, sf):
    run = Run(spark, sf)
    return align.route_steps(run.board, run.aligned)


@query("route_counts", f"""{ROUTE} select session_uuid, count(*) filter (status = 'match') "match", count(*) filter (status = 'alternative') alternative,
  count(*) filter (status = 'out_of_order') out_of_order, count(*) filter (status = 'skipped') skipped from steps group by 1""")
def route_counts(spark, sf):
    run = Run(spark, sf)
    return align.route_counts(align.route_steps(run.board, run.aligned))


@query("objective_depths", f"""with recursive {CLAIMS}, deep(session_uuid, objective, depth) as (
  select session_uuid, objective, 0 from board
  union all select w.session_uuid, c.objective, w.depth + 1 from deep w join board c on c.session_uuid = w.session_uuid and list_contains(c.depends_on, w.objective))
select session_uuid, objective, max(depth) depth from deep group by 1, 2""")
def depths(spark, sf):
    return Run(spark, sf).board.select(SESSION, "objective", "depth")


@query("session_findings", f"""with {SQL_EPISODES} {FINDINGS} select session_uuid, id, kind, "value", source_seq, tactic, proven from found""")
def session_findings(spark, sf):
    return Run(spark, sf).findings.select(SESSION, "id", "kind", "value", "source_seq", "tactic", "proven")


@query("finding_uses", f"with {SQL_EPISODES} {FINDINGS} select * from used")
def finding_uses(spark, sf):
    return Run(spark, sf).uses


@query("masked_findings", f"""with {SQL_EPISODES} {FINDINGS} select session_uuid, id,
  case when kind in ('cred', 'hash', 'flag') then '••••' || right("value", 2) else "value" end as "value", kind in ('cred', 'hash', 'flag') masked from found""")
def masked(spark, sf):
    return findings.mask(Run(spark, sf).findings, "public_safe").select(SESSION, "id", "value", "masked")


@query("findings_by_kind", f"""with {SQL_EPISODES} {FINDINGS}, g as (select session_uuid, kind, count(*) findings, min((source_seq, id)) f from found group by 1, 2)
select session_uuid, kind, findings, row_number() over (partition by session_uuid order by f)::int "position", f[1] first_seq from g""")
def by_kind(spark, sf):
    return findings.by_kind(Run(spark, sf).findings)
