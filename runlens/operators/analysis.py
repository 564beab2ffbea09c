"""Methodology checklist, rabbit holes and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import rules
from runlens.functions import display as d
from runlens.functions import text as t
from runlens.operators import ordered
from runlens.operators.align import low_yield
from runlens.operators.metrics import active_ms, is_running
from runlens.schemas import SESSION


def methodology_checks(
    episodes: DataFrame, objectives_board: DataFrame, findings: DataFrame | None = None
) -> DataFrame:
    """Five rules per session: applicable, done and evidence. Without findings, port and url rules cannot apply."""
    name = F.lower("binary")

    def used(binaries: list[str]) -> Column:
        return F.bool_or(F.coalesce(name.isin(binaries), F.lit(False)))

    facts = episodes.groupBy(SESSION).agg(
        used(rules.PORT_SCANNERS).alias("_scan"), used(rules.WEB_ENUMERATORS).alias("_web"),
        used(rules.SMB_ENUMERATORS).alias("_smb"), used(rules.PRIV_ENUMERATORS).alias("_priv"),
        F.bool_or(F.coalesce(F.col("cmd").rlike(t.rx(r"\bsudo\s+-l\b")), F.lit(False))).alias("_sudo_l"),
        F.min(F.when(t.on_target(F.col("context_path")), F.col("seq"))).alias("_landed"),
    )
    foothold = objectives_board.where("tactic = 'TA0002' and user_satisfied_by_seq is not null").groupBy(SESSION).agg(
        F.min_by("user_satisfied_by_seq", "ordinal").alias("_foothold")
    )
    df = facts.join(foothold, SESSION, "left").withColumn("_foothold", F.coalesce("_foothold", "_landed"))
    if findings is not None:
        port = F.get(F.split("value", "/"), 0)
        at = lambda cond: F.min(F.when(cond, F.col("source_seq")))
        is_port = F.col("kind") == "port"
        known = findings.groupBy(SESSION).agg(
            at(is_port).alias("_port"), at(F.col("kind") == "url").alias("_url"),
            *[at(is_port & (port == p)).alias(f"_p{p}") for p in rules.WEB_PORTS + rules.SMB_PORTS],
            F.count(F.when(F.col("kind") == "version", 1)).alias("_versions"),
            F.count(F.when(F.col("kind").isin("url", "path"), 1)).alias("_paths"),
        )
        df = df.join(known, SESSION, "left")
    else:
        none = F.lit(None).cast("bigint")
        for c in ["_port", "_url", "_versions", "_paths"] + [f"_p{p}" for p in rules.WEB_PORTS + rules.SMB_PORTS]:
            df = df.withColumn(c, none)
    web_seq = F.coalesce(*[F.col(f"_p{p}") for p in rules.WEB_PORTS], F.col("_url"))
    smb_seq = F.coalesce(*[F.col(f"_p{p}") for p in rules.SMB_PORTS])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    outcome = {
        "port_scan": (F.lit(True), F.lit(None).cast("bigint"), F.col("_scan") | F.col("_port").isNotNull()),
        "service_version_enum": (F.col("_port").isNotNull(), F.col("_port"), zero("_versions") > 0),
        "web_content_enum": (web_seq.isNotNull(), web_seq, F.col("_web") | (zero("_paths") >= 2)),
        "smb_enum": (smb_seq.isNotNull(), smb_seq, F.col("_smb")),
        "priv_enum": (F.col("_foothold").isNotNull(), F.col("_foothold"), F.col("_priv") | F.col("_sudo_l")),
    }
    rows = []
    for order, check, tactic, label, hint in rules.METHODOLOGY_CHECKS:
        applicable, evidence, done = outcome[check]
        rows.append(
            F.struct(
                F.lit(order).alias("check_order"), F.lit(check).alias("check_id"), F.lit(tactic).alias("tactic"),
                F.lit(label).alias("label"), F.lit(hint).alias("hint"), applicable.alias("applicable"),
                (applicable & done).alias("done"), F.when(applicable, evidence).alias("evidence_seq"),
            )
        )
    return df.select(SESSION, F.explode(F.array(*rows)).alias("c")).select(SESSION, "c.*")


def methodology_coverage(checks: DataFrame) -> DataFrame:
    fit = F.col("applicable")
    out = checks.groupBy(SESSION).agg(F.count(F.when(fit, 1)).alias("_n"), F.count(F.when(fit & F.col("done"), 1)).alias("_d"))
    return out.select(
        SESSION, F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_d") / F.col("_n") * 100).alias("methodology_coverage_pct")
    )


def top_unmet_check(checks: DataFrame) -> DataFrame:
    unmet = checks.where(F.col("applicable") & ~F.col("done"))
    first = unmet.groupBy(SESSION).agg(
        F.min(F.struct("check_order", "check_id", "tactic", "label", "hint", "evidence_seq")).alias("c")
    )
    return first.select(SESSION, "c.*")


def unproductive() -> Column:
    return F.coalesce(F.col("alignment") == "detour", F.lit(False)) | F.col("loop_of_seq").isNotNull() | low_yield()


RUN_MIN = 3


def rabbit_holes(episodes: DataFrame, run_min: int = RUN_MIN) -> DataFrame:
    """Runs of at least three unproductive episodes in a row on one tool."""
    running = ordered.with_slices(episodes, [SESSION], "seq").where(is_running())
    df = running.select(
        SESSION, ordered.SLICE, "seq", F.lower("binary").alias("binary"),
        (unproductive() & (F.col("binary") != "")).alias("_low"), (F.col("duration_ms") + F.col("gap_before_ms")).alias("_spent"),
    )
    df = ordered.scan(df, [SESSION], ["seq"], {"_prev": ordered.previous(F.col("_low").alias("low"), F.col("binary").alias("name"))})
    goes_on = F.coalesce(F.col("_low") & F.col("_prev.low") & (F.col("_prev.name") == F.col("binary")), F.lit(False))
    df = ordered.scan(df, [SESSION], ["seq"], {"_island": ordered.running_sum(F.when(goes_on, 0).otherwise(1))})
    return (
        df.where("_low")
        .groupBy(SESSION, "_island", "binary")
        .agg(
            F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("attempts"),
            F.sum("_spent").alias("wasted_ms"),
        )
        .where(F.col("attempts") >= run_min)
        .drop("_island")
    )


def focus(episodes: DataFrame, holes: DataFrame | None = None) -> DataFrame:
    holes = holes if holes is not None else rabbit_holes(episodes)
    active = episodes.groupBy(SESSION).agg(F.sum(active_ms()).alias("_active"))
    wasted = holes.groupBy(SESSION).agg(F.sum("wasted_ms").alias("_wasted"))
    total = F.when(F.col("_active") == 0, 1).otherwise(F.col("_active"))
    return active.join(wasted, SESSION, "left").select(
        SESSION, d.clamp(100 - F.coalesce("_wasted", F.lit(0)) / total * 100).alias("focus_discipline_pct")
    )


def recoveries(episodes: DataFrame, objectives_board: DataFrame) -> DataFrame:
    """Each stuck cluster with the next advancing step and the time from cluster start through that step."""
    met = objectives_board.where("user_satisfied_by_seq is not null").select(
        SESSION, F.col("user_satisfied_by_seq").alias("seq")
    ).distinct().withColumn("_met", F.lit(True))
    df = ordered.with_slices(episodes, [SESSION], "seq").where(is_running()).join(met, [SESSION, "seq"], "left")
    stuck = F.coalesce(F.col("alignment") == "detour", F.lit(False)) | F.col("loop_of_seq").isNotNull()
    advances = F.coalesce("_met", F.lit(False)) | F.coalesce(F.col("alignment").isin("match", "alternative"), F.lit(False))
    df = df.select(
        SESSION, ordered.SLICE, "seq", stuck.alias("_stuck"), advances.alias("_adv"),
        (F.col("duration_ms") + F.col("gap_before_ms")).alias("_spent"),
    )
    df = ordered.scan(df, [SESSION], ["seq"], {
        "_prev": ordered.previous(F.col("_stuck").alias("stuck")), "_next": ordered.following(F.col("_stuck").alias("stuck")),
        "_cum": ordered.running_sum(F.col("_spent")),
    })
    opens = F.col("_stuck") & ~F.coalesce("_prev.stuck", F.lit(False))
    closes = F.col("_stuck") & ~F.coalesce("_next.stuck", F.lit(False))
    df = ordered.scan(df.withColumn("_closes", closes), [SESSION], ["seq"], {
        "_open": ordered.last_seen(F.when(opens, F.struct("seq", (F.col("_cum") - F.col("_spent")).alias("cum")))),
        "_back": ordered.next_seen(F.when(F.col("_adv"), F.struct("seq", F.col("_cum").alias("cum"))), inclusive=False),
    })
    return df.where(F.col("_closes") & F.col("_back").isNotNull()).select(
        SESSION, F.col("_open.seq").alias("stuck_seq"), F.col("_back.seq").alias("recovered_seq"),
        (F.col("_back.cum") - F.col("_open.cum")).alias("latency_ms"),
    )


def recovery_median(recovered: DataFrame) -> DataFrame:
    return ordered.rounded_median(recovered, [SESSION], "latency_ms", "recovery_median_ms")
