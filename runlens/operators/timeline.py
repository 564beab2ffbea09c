"""Positions on the time axis, phases, trims, as-of lookups and flag milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import display as d
from runlens.functions import text as t
from runlens.operators import metrics, ordered
from runlens.schemas import SESSION


def timeline(episodes: DataFrame) -> DataFrame:
    """Add ``gap_start``, ``t0``, ``t1``: absolute if every episode of the session is timed, else cumulative."""
    episodes = ordered.with_slices(episodes, [SESSION], "seq")
    base = episodes.groupBy(SESSION).agg(
        F.min("started_at_ms").alias("_base"),
        (F.count("started_at_ms") == F.count(F.lit(1))).alias("_timed"),
    )
    spent = F.col("gap_before_ms") + F.col("duration_ms")
    df = ordered.scan(episodes, [SESSION], ["seq"], {"_until": ordered.running_sum(spent)}).join(base, SESSION)
    t0 = F.when(F.col("_timed"), F.col("started_at_ms") - F.col("_base")).otherwise(
        F.col("_until") - F.col("duration_ms")
    )
    return (
        df.withColumn("t0", t0)
        .withColumn("t1", F.col("t0") + F.col("duration_ms"))
        .withColumn(
            "gap_start",
            F.when(
                F.col("_timed"), F.greatest(F.lit(0).cast("bigint"), F.col("t0") - F.col("gap_before_ms"))
            ).otherwise(F.col("_until") - spent),
        )
        .drop("_until", "_base", "_timed")
    )


def timeline_length(timed: DataFrame) -> DataFrame:
    return timed.groupBy(SESSION).agg(F.max("t1").alias("total_ms"))


def phases(episodes: DataFrame, session_start: DataFrame | None = None) -> DataFrame:
    """One row per (session, tactic): window on the axis, label, efficiency, first-seen order.

    ``session_start(session_uuid, start_ms)`` shifts the windows; without it they start at zero.
    """
    timed = timeline(episodes)
    spans = timed.groupBy(SESSION, "tactic").agg(
        F.min("seq").alias("first_seq"), F.min("gap_start").alias("t0"), F.max("t1").alias("t1")
    )
    waste = metrics.waste_by_tactic(episodes).select(SESSION, "tactic", "efficiency_pct")
    out = spans.join(waste, [SESSION, "tactic"], "left")
    if session_start is not None:
        out = out.join(session_start, SESSION, "left")
        start = F.coalesce("start_ms", F.lit(0))
    else:
        start = F.lit(0)
    return out.select(
        SESSION, F.col("tactic").alias("mitre_tactic"), d.tactic_label(F.col("tactic")).alias("label"), "first_seq", "t0", "t1",
        F.timestamp_millis(start + F.col("t0")).alias("started_at"),
        F.timestamp_millis(start + F.col("t1")).alias("ended_at"),
        d.js_round(F.coalesce("efficiency_pct", F.lit(100.0))).alias("efficiency_pct"),
    )


def trim(episodes: DataFrame, objectives: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restrict sessions to an inclusive sequence window; the bounds may come in either order.

    Sessions without a range row are kept whole. Satisfiers outside the window become null.
    """
    bounds = ranges.select(
        SESSION, F.least("from_seq", "to_seq").alias("_lo"), F.greatest("from_seq", "to_seq").alias("_hi")
    )
    inside = lambda c: F.col("_lo").isNull() | F.col(c).between(F.col("_lo"), F.col("_hi"))
    kept = episodes.join(bounds, SESSION, "left").where(inside("seq")).drop("_lo", "_hi")
    board = (
        objectives.join(bounds, SESSION, "left")
        .withColumn("user_satisfied_by_seq", F.when(inside("user_satisfied_by_seq"), F.col("user_satisfied_by_seq")))
        .drop("_lo", "_hi")
    )
    return kept, board


def seq_bounds(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(SESSION).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def episode_at(timed: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of lookup: for each probe (session, at_ms), the episode whose window opened last at or before it.

    Probes and episodes are merged into one ordered stream and scanned once, so nothing is paired.
    """
    opened = timed.select(
        SESSION, F.col("gap_start").alias("_at"), F.lit(0).alias("_side"), F.col("seq").alias("_tie"),
        F.col("seq").alias("_seq"),
    )
    asked = probes.select(
        SESSION, F.col("at_ms").alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"),
        F.lit(None).cast("bigint").alias("_seq"),
    ).distinct()
    checked = ordered.with_slices(asked, [SESSION], "_at")
    like = timed if ordered.is_whole(timed) and ordered.is_whole(checked) else asked
    merged = ordered.with_slices(opened.unionByName(asked), [SESSION], "_at", like=like)
    found = ordered.scan(
        merged, [SESSION], ["_at", "_side", "_tie"], {"seq": ordered.last_seen(F.col("_seq"))}
    )
    return found.where(F.col("_side") == 1).select(SESSION, F.col("_at").alias("at_ms"), "seq")


READ_VERB = r"(?i)\b(cat|type|more|less|head|tail|nl|strings|gc|get-content|powershell|xxd|base64)\b"
FLAG_OUTPUT = r"(?i)\[redacted-flag\]|flags?\s+captured|\b[0-9a-f]{32}\b"


def flag_reads(episodes: DataFrame) -> DataFrame:
    """First user-level and first system-level flag read of each session."""
    cmd = F.coalesce("cmd", F.lit(""))
    out = F.coalesce("output_digest", F.lit(""))
    user = cmd.rlike(t.rx(r"(?i)\b(user|local)\.txt\b"))
    system = cmd.rlike(t.rx(r"(?i)\b(root|proof|system)\.txt\b"))
    read = cmd.rlike(t.rx(READ_VERB)) | out.rlike(t.rx(FLAG_OUTPUT))
    return (
        episodes.where((user | system) & read)
        .groupBy(SESSION)
        .agg(F.min(F.when(user, F.col("seq"))).alias("user_seq"), F.min(F.when(system, F.col("seq"))).alias("system_seq"))
    )


def flag_events(episodes: DataFrame) -> DataFrame:
    """Milestone rows: one per episode that is a first flag read, with the kinds it completed."""
    firsts = flag_reads(episodes)
    kinds = firsts.select(
        SESSION, F.expr("stack(2, 'user', user_seq, 'system', system_seq) as (kind, seq)")
    ).where("seq is not null")
    grouped = kinds.groupBy(SESSION, "seq").agg(F.reverse(F.sort_array(F.collect_set("kind"))).alias("kinds"))
    return grouped.join(episodes.select(SESSION, "seq", "cmd"), [SESSION, "seq"])
