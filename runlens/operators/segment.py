"""Raw commands to episodes: think gaps per lane, pause rows, actor, sequence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens import rules
from runlens.functions import text as t
from runlens.operators import classify, ordered
from runlens.schemas import SESSION


@dataclass(frozen=True)
class SegmentConfig:
    idle_gap_ms: int = 1_800_000
    think_pause_ms: int = 300_000
    machine_min_ms: int = 20_000
    machine_min_lines: int = 500
    scanning_binaries: tuple = field(default_factory=lambda: tuple(rules.SCANNING_BINARIES))


ORDER = ["started_at_ms", "ord"]


def segment_episodes(
    raw: DataFrame, config: SegmentConfig = SegmentConfig(), priors: DataFrame | None = None,
    noise: DataFrame | None = None,
) -> DataFrame:
    """Episodes numbered from 1 per session; a long gap becomes its own pause row before the command."""
    raw = ordered.colocate(ordered.with_slices(raw, [SESSION], "started_at_ms"), [SESSION])
    df = classify.with_noise_weight(classify.classify_commands(raw, priors), noise)
    df = df.withColumn("lane", F.when(t.on_target(F.col("context_path")), "target").otherwise("host"))
    ended = F.col("ended_at_ms")
    df = ordered.scan(df, [SESSION], ORDER, {
        "_pos": ordered.position(),
        "_prev": ordered.previous(F.col("prior.tactic").alias("tactic")),
        "_host_end": ordered.last_seen(F.when(F.col("lane") == "host", ended), inclusive=False),
        "_target_end": ordered.last_seen(F.when(F.col("lane") == "target", ended), inclusive=False),
    })
    before = F.when(F.col("lane") == "host", F.col("_host_end")).otherwise(F.col("_target_end"))
    gap = F.coalesce(F.greatest(F.lit(0).cast("bigint"), F.col("started_at_ms") - before), F.lit(0).cast("bigint"))
    stageable = F.coalesce(
        F.col("may_stage") & F.col("_prev.tactic").isin(rules.STAGING_PREVIOUS_TACTICS), F.lit(False)
    )
    df = df.withColumn("_gap", gap).withColumn("_stageable", stageable)
    df = df.withColumn("_pause", F.col("_gap") >= config.think_pause_ms)
    # A staged command is no longer in a staging tactic, so inside a run of stageable rows every other one is staged.
    df = ordered.scan(df, [SESSION], ORDER, {
        "_run_start": ordered.last_seen(F.when(~F.col("_stageable"), F.col("_pos"))),
        "_seq": ordered.running_sum(F.when(F.col("_pause"), 2).otherwise(1).cast("bigint")),
    })
    staged = F.col("_stageable") & ((F.col("_pos") - F.coalesce("_run_start", F.lit(0))) % 2 == 1)
    prior = F.when(staged, classify._prior(*rules.STAGING_PRIOR)).otherwise(F.col("prior"))
    duration = F.greatest(F.lit(0).cast("bigint"), ended - F.col("started_at_ms"))
    busy = (duration >= config.machine_min_ms) & (
        F.lower("binary").isin(list(config.scanning_binaries))
        | (F.coalesce("output_line_count", F.lit(0)) >= config.machine_min_lines)
    )
    df = df.withColumn("_prior", prior)
    idle = F.col("_gap") >= config.idle_gap_ms

    def row(is_pause: bool):
        if is_pause:
            values = {
                "seq": F.col("_seq") - 1, "cmd": F.lit(""), "binary": F.lit(""), "duration_ms": F.lit(0).cast("bigint"),
                "gap_before_ms": F.col("_gap"), "exit_code": F.lit(None).cast("int"),
                "actor": F.when(idle, "idle").otherwise("think_pause"),
                "output_digest": F.when(idle, "walked away").otherwise("long pause - reasoning or stuck"),
                "technique": F.lit(None).cast("string"), "confidence": F.lit(0.0), "noise_weight": F.lit(0.0),
                "volume": F.lit(0).cast("bigint"), "cwe": F.lit(None).cast("array<string>"),
            }
        else:
            values = {
                "seq": F.col("_seq"), "cmd": F.col("cmd"), "binary": F.col("binary"), "duration_ms": duration,
                "gap_before_ms": F.when(F.col("_pause"), F.lit(0).cast("bigint")).otherwise(F.col("_gap")),
                "exit_code": F.col("exit_code").cast("int"),
                "actor": F.when(busy, "machine_bound").otherwise("human_active"),
                "output_digest": F.col("output_digest"),
                "technique": F.col("_prior.technique"), "confidence": F.col("_prior.confidence"),
                "noise_weight": F.col("noise_weight"), "volume": F.coalesce("volume", F.lit(1)).cast("bigint"),
                "cwe": F.when(F.col("_prior.cwe").isNotNull(), F.array("_prior.cwe")),
            }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    rows = F.when(F.col("_pause"), F.array(row(True), row(False))).otherwise(F.array(row(False)))
    out = df.select(
        SESSION, ordered.SLICE, "started_at_ms", "context_path", F.col("_prior.tactic").alias("tactic"),
        F.explode(rows).alias("e"),
    )
    return out.select(
        SESSION, "e.seq", "e.cmd", "e.binary", "started_at_ms", "e.duration_ms", "e.gap_before_ms", "e.exit_code",
        "e.actor", "e.output_digest", "tactic", "e.technique", "e.confidence", "e.noise_weight", "e.volume",
        "context_path", F.lit(None).cast("string").alias("alignment"), F.lit(None).cast("bigint").alias("loop_of_seq"),
        "e.cwe", ordered.SLICE,
    )


def think_gaps(raw: DataFrame) -> DataFrame:
    """The gap before each raw command within its lane; zero for the first."""
    raw = ordered.with_slices(raw, [SESSION], "started_at_ms")
    df = raw.withColumn("lane", F.when(t.on_target(F.col("context_path")), "target").otherwise("host"))
    df = ordered.scan(df, [SESSION], ORDER, {
        "_h": ordered.last_seen(F.when(F.col("lane") == "host", F.col("ended_at_ms")), inclusive=False),
        "_t": ordered.last_seen(F.when(F.col("lane") == "target", F.col("ended_at_ms")), inclusive=False),
    })
    before = F.when(F.col("lane") == "host", F.col("_h")).otherwise(F.col("_t"))
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("started_at_ms") - before)
    return df.withColumn("gap_ms", F.coalesce(gap, F.lit(0).cast("bigint"))).drop("_h", "_t")


def append_episodes(episodes: DataFrame, tapped: DataFrame) -> DataFrame:
    """Tapped-session episodes numbered after the session's last one."""
    last = episodes.groupBy(SESSION).agg(F.max("seq").alias("_last"))
    shifted = (
        tapped.join(last, SESSION, "left")
        .withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0)))
        .drop("_last", ordered.SLICE)
    )
    return episodes.drop(ordered.SLICE).unionByName(shifted, allowMissingColumns=True)
