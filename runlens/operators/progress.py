"""Across sessions: cards, history order, progress series and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import display as d
from runlens.operators import ordered
from runlens.schemas import SESSION


def session_cards(
    sessions: DataFrame, metrics: DataFrame, grades: DataFrame, objectives_board: DataFrame, episodes: DataFrame,
    now, owner: str | None = None,
) -> DataFrame:
    """One card per session. ``sessions`` carries target, times, source, recording and demo marks.

    The latest session is the one that ended last, of each owner when an owner column is named.
    """
    goal = F.col("objective").rlike(r"(?i)escalate_to_root|capture_flags|root(?!\w)")
    rooted = objectives_board.groupBy(SESSION).agg(
        F.bool_or(goal & F.col("user_satisfied_by_seq").isNotNull()).alias("rooted")
    )
    steps = episodes.groupBy(SESSION).agg(F.count(F.lit(1)).alias("episodes"))
    df = (
        sessions.join(metrics.select(SESSION, F.col("objective_coverage_pct").alias("coverage"), F.col("efficiency_pct").alias("efficiency"),
                                     F.col("technique_breadth").alias("breadth"), F.col("methodology_coverage_pct").alias("methodology")), SESSION)
        .join(grades.select(SESSION, F.col("score").alias("grade"), "letter"), SESSION)
        .join(rooted, SESSION, "left").join(steps, SESSION, "left")
    )
    live = d.is_live(F.col("recording"), F.col("ended_at"), F.col("started_at"), now)
    df = df.withColumn("rooted", F.coalesce("rooted", F.lit(False))).withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    return mark_latest(df.withColumn("recording", live), owner)


def mark_latest(cards: DataFrame, owner: str | None = None) -> DataFrame:
    last = cards.groupBy(*([owner] if owner else [])).agg(F.max_by(SESSION, F.struct("ended_at", SESSION)).alias("_latest"))
    latest = last.select(F.col("_latest").alias(SESSION), F.lit(True).alias("_is"))
    return cards.join(latest, SESSION, "left").withColumn("is_latest", F.coalesce("_is", F.lit(False))).drop("_is")


def defense_cards(sessions: DataFrame, cases: DataFrame, reports: DataFrame) -> DataFrame:
    """Cards of investigations: coverage is the share of artifacts surfaced."""
    share = d.js_round(F.when(F.col("artifacts") > 0, F.col("found") / F.col("artifacts") * 100).otherwise(0.0))
    run = reports.select(F.col("run_session").alias(SESSION), "case_id", F.col("score").alias("grade"), "letter",
                         share.alias("coverage"), share.alias("efficiency"), F.col("artifacts").alias("episodes"))
    return sessions.join(run, SESSION).withColumn("rooted", F.lit(False)).withColumn("recording", F.lit(False)).withColumn(
        "mode", F.lit("defense")
    )


def progress_series(cards: DataFrame, owner: str) -> DataFrame:
    """Graded runs in date order, demos and undated runs left out."""
    df = cards.where(~F.coalesce("demo", F.lit(False)) & F.col("ended_at").isNotNull())
    df = df.withColumn("date_ms", F.unix_millis(F.col("ended_at").cast("timestamp")))
    df = ordered.with_slices(df, [owner], "date_ms")
    return ordered.scan(df, [owner], ["date_ms", SESSION], {"position": ordered.position()})


def progress_summary(series: DataFrame, owner: str) -> DataFrame:
    """Runs, rooted rate, best and rounded median grade, platforms seen."""
    base = series.groupBy(owner).agg(
        F.count(F.lit(1)).alias("runs"), (F.avg(F.col("rooted").cast("int")) * 100).alias("rooted_rate"),
        F.max("grade").alias("best_grade"), F.sort_array(F.collect_set("platform")).alias("platforms"),
    )
    return base.join(ordered.rounded_median(series, [owner], "grade", "median_grade"), owner)


def history(cards: DataFrame) -> DataFrame:
    """Live sessions first, then the latest, then the most recent."""
    return cards.orderBy(F.col("recording").desc(), F.col("is_latest").desc(), F.col("ended_at").desc(), SESSION)


def default_session(cards: DataFrame, owner: str | None = None) -> DataFrame:
    """The session to open first: most episodes, then most recent."""
    return cards.groupBy(*([owner] if owner else [])).agg(
        F.max_by(SESSION, F.struct("episodes", "ended_at", SESSION)).alias(SESSION)
    )
