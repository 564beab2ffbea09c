"""Composition: raw commands to a full set of session tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import display as d
from runlens.operators import (
    align, analysis, classify, coaching, findings as ledger, ghost, golden as paths_of, grade as grading, metrics, privesc,
    segment, timeline,
)
from runlens.schemas import SESSION
from runlens.session import stage
from runlens.sources import envelopes, store
from runlens.streaming import live


@dataclass
class Debrief:
    episodes: DataFrame
    board: DataFrame
    phases: DataFrame
    findings: DataFrame
    uses: DataFrame
    status: DataFrame
    escalation_facts: DataFrame
    escalation_paths: DataFrame
    escalation: DataFrame
    ghost: DataFrame
    metrics: DataFrame
    grades: DataFrame
    coaching: DataFrame


def metric_row(
    episodes: DataFrame, board: DataFrame, ghost_totals: DataFrame | None = None, baselines: DataFrame | None = None,
    findings: DataFrame | None = None, rounded: bool = True,
) -> DataFrame:
    """One row per session. The methodology share is computed without findings unless they are passed."""
    checks = analysis.methodology_checks(episodes, board, findings)
    loud = metrics.loud_moments(episodes)
    noise = d.js_round(F.col("noise"), 1) if rounded else F.col("noise")
    loudest = loud.groupBy(SESSION).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "seq", noise.alias("noise")))),
                    lambda x: F.struct(x["seq"].alias("seq"), x["noise"].alias("noise"))).alias("loud_moments")
    )
    parts = [
        metrics.waste(episodes), metrics.stealth(episodes, baselines), loudest, align.coverage(board), metrics.technique_breadth(episodes),
        metrics.ukc_coverage(episodes, board), metrics.ukc_progression(episodes), metrics.weakness_breadth(episodes),
        metrics.think_baseline(episodes), analysis.methodology_coverage(checks), analysis.focus(episodes),
        analysis.recovery_median(analysis.recoveries(episodes, board)),
    ]
    if ghost_totals is not None:
        parts.append(ghost_totals)
    df = parts[0]
    for part in parts[1:]:
        df = df.join(part, SESSION, "left")
    df = df.withColumn("objective_coverage_pct", F.coalesce("objective_coverage_pct", F.lit(0.0))).withColumn(
        "p75_gap_ms", F.coalesce("p75_gap_ms", F.lit(0).cast("bigint"))
    )
    if rounded:
        for c in ("efficiency_pct", "stealth_score", "objective_coverage_pct", "ukc_coverage_pct", "ukc_progression",
                  "methodology_coverage_pct", "focus_discipline_pct"):
            df = df.withColumn(c, d.js_round(F.col(c)))
    return df


def debrief(
    raw: DataFrame, session_golden: DataFrame, golden: DataFrame, config: segment.SegmentConfig = segment.SegmentConfig(),
    profile: str = "full", hints: DataFrame | None = None, baselines: DataFrame | None = None, session_start: DataFrame | None = None,
    staged: bool = True,
) -> Debrief:
    """All tables of all sessions. Tables that many operators read are staged in the cluster's shared folder once,
    which keeps plans short and lets a lost executor recompute from files."""
    keep = stage if staged else (lambda df, _name: df)
    if "lineage_tactics" not in golden.columns:
        golden = paths_of.with_lineage(golden)
    objectives = align.session_objectives(session_golden, golden)
    segmented = keep(segment.segment_episodes(raw, config), "segmented")
    board = keep(align.board(objectives, align.claims(segmented, objectives, golden)), "board")
    episodes = keep(classify.with_frameworks(align.mark(segmented, board)), "episodes")
    found = keep(ledger.extract(episodes), "findings")
    uses = keep(ledger.link_uses(episodes, found), "uses")
    status = keep(align.objective_status(episodes, board, found, uses), "status")
    facts = keep(privesc.host_facts(episodes, found), "facts")
    escalations = keep(privesc.escalation_paths(episodes, found, facts), "escalations")
    summary = keep(privesc.escalation_summary(episodes, escalations, facts), "summary")
    items = keep(ghost.ghost_items(episodes, status, found, summary), "ghost")
    row = metric_row(episodes, board, ghost.totals(items), baselines)
    if session_start is None:
        session_start = episodes.groupBy(SESSION).agg(F.min("started_at_ms").alias("start_ms"))
    return Debrief(
        episodes=episodes, board=board, phases=timeline.phases(episodes, session_start), findings=ledger.mask(found, profile), uses=uses,
        status=status, escalation_facts=facts, escalation_paths=escalations, escalation=summary, ghost=items, metrics=row,
        grades=grading.grade(row, grading.hint_summary(hints) if hints is not None else None),
        coaching=coaching.coaching_steps(episodes, board),
    )


def finalize_live(
    episodes: DataFrame, objectives: DataFrame | None = None, recording: bool = True, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _name: df,
) -> dict[str, DataFrame]:
    """Alignment, phases, metrics, radar and the recap line of sessions still being recorded. Running it twice changes nothing.

    ``keep`` may write the aligned episodes, which everything else reads, and give them back from there.
    """
    if objectives is None:
        aligned = align.align_without_path(episodes)
        empty = episodes.select(SESSION).where("false")
        board = empty.select(
            SESSION, F.lit(0).alias("ordinal"), F.lit("").alias("objective"), F.lit("").alias("tactic"),
            F.array().cast("array<string>").alias("satisfied_by"), F.array().cast("array<string>").alias("depends_on"),
            F.lit(None).cast("bigint").alias("user_satisfied_by_seq"),
        )
    else:
        aligned, board = align.align(episodes, objectives)
    aligned = keep(classify.with_frameworks(aligned), "episodes")
    return {
        "episodes": aligned, "board": board, "phases": timeline.phases(aligned), "metrics": metric_row(aligned, board, rounded=False),
        "radar": metrics.radar_from_counts(aligned), "recap": coaching.recap_step(aligned, recording),
    }


def live_refresh(
    spark: SparkSession, folder: str, write: Callable[[str, DataFrame, int], None], objectives: DataFrame | None = None,
    tapped: DataFrame | None = None, config: segment.SegmentConfig = segment.SegmentConfig(), recording: bool = True,
    buckets: int = store.BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function from envelopes to finished tables: the batch joins the store in ``folder``, and every
    session it touched is segmented, given its tapped episodes, finalized and written under its batch number. Of the store
    only the buckets of touched sessions are opened."""
    def run(batch: DataFrame, number: int) -> None:
        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/work/{name}/{number}")
            return spark.read.schema(df.schema).parquet(f"{folder}/work/{name}/{number}")

        def recompute(raw: DataFrame) -> dict[str, DataFrame]:
            raw = keep(raw, "raw")
            episodes = segment.segment_episodes(raw, config)
            if tapped is not None:
                own = tapped.join(raw.select(SESSION).distinct(), SESSION, "left_semi")
                episodes = segment.append_episodes(episodes, own)
            return finalize_live(keep(episodes, "segmented"), objectives, recording, keep)

        store.write_batch(batch, folder, number, buckets)
        # Whom it touched is read from what was just written, so the batch itself is computed once.
        touched = keep(store.read_batch(spark, folder, number).select(SESSION).distinct(), "touched")
        live.refresh_touched(lambda: envelopes.raw_commands(store.read_batches(spark, folder, touched, buckets), "first"), recompute, write)(touched, number)

    return run


#: Metrics that depend on the intended path; the others of a session stay as they were.
PATH_METRICS = ["objective_coverage_pct", "ukc_coverage_pct", "methodology_coverage_pct", "recovery_median_ms"]


def realign(
    episodes: DataFrame, session_golden: DataFrame, golden: DataFrame, findings: DataFrame | None = None, uses: DataFrame | None = None,
    metrics_before: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Another intended path for finished sessions: new alignment, board and metric row.

    With the ledger (``findings``, ``uses``) the board carries status, references and proofs. With the row computed before,
    only the time split and what depends on the path is replaced.
    """
    objectives = align.session_objectives(session_golden, golden)
    aligned, board = align.align(episodes.drop("alignment", "loop_of_seq"), objectives, golden)
    aligned = classify.with_frameworks(aligned)
    if findings is not None and uses is not None:
        board = align.objective_status(aligned, board, findings, uses)
    row = metric_row(aligned, board)
    if metrics_before is not None:
        split = [c for c in metrics.waste(aligned).columns if c != SESSION]
        new = [c for c in dict.fromkeys(split + PATH_METRICS) if c in row.columns]
        row = metrics_before.drop(*new).join(row.select(SESSION, *new), SESSION, "left")
    return aligned, board, row


def trimmed(episodes: DataFrame, board: DataFrame, ranges: DataFrame) -> dict[str, DataFrame]:
    """Sessions restricted to a sequence window, with phases and metrics recomputed."""
    kept, scoped = timeline.trim(episodes, board, ranges)
    return {"episodes": kept, "board": scoped, "phases": timeline.phases(kept), "metrics": metric_row(kept, scoped)}
