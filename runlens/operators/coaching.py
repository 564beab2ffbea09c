"""Coaching steps and the single lesson of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import display as d
from runlens.functions import text as t
from runlens.operators import metrics
from runlens.schemas import SESSION

COLUMNS = [SESSION, "step_order", "action", "why", "category", "evidence_seq"]


def coaching_steps(episodes: DataFrame, objectives_board: DataFrame, waste: DataFrame | None = None) -> DataFrame:
    """Unmet objectives in path order, then the loudest step, then detours worth a minute; else a clean run."""
    waste = waste if waste is not None else metrics.waste(episodes)
    name = F.replace("objective", F.lit("_"), F.lit(" "))
    first = F.get("satisfied_by", 0)
    null = F.lit(None).cast("bigint")
    missed = objectives_board.where("user_satisfied_by_seq is null").select(
        SESSION, F.col("ordinal").alias("step_order"), F.concat(F.lit("Attempt **"), name, F.lit("**")).alias("action"),
        F.concat(F.lit("No command of the session fits; the path lists `"), F.coalesce(first, F.lit("undefined")),
                 F.lit("` for it.")).alias("why"),
        t.coaching_category(F.concat(name, F.lit(" "), F.coalesce(first, F.lit("undefined")))).alias("category"),
        null.alias("evidence_seq"),
    )
    loud = metrics.loud_moments(episodes, 1).select(
        SESSION, F.lit(10_000).alias("step_order"), F.concat(F.lit("Quiet down `"), "binary", F.lit("`")).alias("action"),
        F.lit("This step made more noise than any other of the session.").alias("why"),
        F.lit("OpSec").alias("category"), F.col("seq").alias("evidence_seq"),
    )
    lost = d.minutes(F.col("detour_ms"))
    detours = waste.where(lost >= 1).select(
        SESSION, F.lit(10_001).alias("step_order"),
        F.concat(F.lit("Trim ~"), lost.cast("string"), F.lit(" min spent on detours")).alias("action"),
        F.lit("These steps met no objective; look for new leads before repeating them.").alias("why"),
        F.lit("Tactics").alias("category"), null.alias("evidence_seq"),
    )
    steps = missed.unionByName(loud).unionByName(detours)
    clean = waste.select(SESSION).join(steps.select(SESSION).distinct(), SESSION, "left_anti").select(
        SESSION, F.lit(0).alias("step_order"), F.lit("Clean run").alias("action"),
        F.lit("Every objective was met and little time was lost.").alias("why"), F.lit("Recap").alias("category"),
        null.alias("evidence_seq"),
    )
    return steps.unionByName(clean)


def recap_step(episodes: DataFrame, recording: bool) -> DataFrame:
    """The lead line of a live session."""
    counts = episodes.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct(F.when(F.col("technique") != "", F.col("technique"))).alias("_t")
    )
    n, k = F.col("_n").cast("string"), F.col("_t").cast("string")
    live = F.concat(F.lit("Recording: "), n, F.lit(" commands so far, techniques: "), k, F.lit("."))
    done = F.concat(n, F.lit(" commands, techniques: "), k, F.lit("."))
    return counts.select(
        SESSION, F.lit(-1).alias("step_order"), (live if recording else done).alias("action"), F.lit("").alias("why"),
        F.lit("Recap").alias("category"), F.lit(None).cast("bigint").alias("evidence_seq"),
    )


def one_lesson(items: DataFrame, checks: DataFrame, holes: DataFrame, steps: DataFrame) -> DataFrame:
    """The one thing to take away: worst late pivot, else unmet check, else worst rabbit hole, else first step."""
    null = F.lit(None).cast("bigint")
    late = items.where("verdict = 'late_pivot'").groupBy(SESSION).agg(
        F.max(F.struct("lag_ms", (-F.col("item_order")).alias("_o"), "note", "unlock_seq", "actual_seq")).alias("w")
    ).select(
        SESSION, F.lit(1).alias("priority"), F.col("w.note").alias("text"),
        F.coalesce("w.actual_seq", "w.unlock_seq").alias("evidence_seq"), F.col("w.unlock_seq").alias("unlock_seq"),
        F.col("w.actual_seq").alias("acted_seq"),
    )
    unmet = checks.where("applicable and not done").groupBy(SESSION).agg(
        F.min(F.struct("check_order", "label", "hint", "evidence_seq")).alias("c")
    ).select(
        SESSION, F.lit(2).alias("priority"), F.concat("c.label", F.lit(": "), "c.hint").alias("text"), F.col("c.evidence_seq").alias("evidence_seq"),
        null.alias("unlock_seq"), null.alias("acted_seq"),
    )
    worst = holes.groupBy(SESSION).agg(F.max(F.struct("wasted_ms", (-F.col("start_seq")).alias("_s"), "binary")).alias("h")).select(
        SESSION, F.lit(3).alias("priority"),
        F.concat(F.lit("Several `"), F.col("h.binary"),
                 F.lit("` commands in a row led nowhere; gather more information first.")).alias("text"),
        (-F.col("h._s")).alias("evidence_seq"), null.alias("unlock_seq"), null.alias("acted_seq"),
    )
    step = steps.where("category <> 'Recap'").groupBy(SESSION).agg(
        F.min(F.struct("step_order", "action", "why", "evidence_seq")).alias("s")
    ).select(
        SESSION, F.lit(4).alias("priority"), t.plain_step(F.col("s.action"), F.col("s.why")).alias("text"),
        F.col("s.evidence_seq").alias("evidence_seq"), null.alias("unlock_seq"), null.alias("acted_seq"),
    )
    every = late.unionByName(unmet).unionByName(worst).unionByName(step)
    picked = every.groupBy(SESSION).agg(F.min(F.struct("priority", "text", "evidence_seq", "unlock_seq", "acted_seq")).alias("p"))
    return picked.select(SESSION, "p.*")
