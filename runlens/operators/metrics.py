"""Session metrics: think baseline, waste, noise and stealth, coverage, kill-chain and tool usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import rules
from runlens.functions import display as d
from runlens.functions import text as t
from runlens.operators import classify, ordered
from runlens.schemas import SESSION


def is_running() -> Column:
    return ~F.col("actor").isin("think_pause", "idle")


def active_ms() -> Column:
    return F.when(F.col("actor") == "idle", F.lit(0).cast("bigint")).otherwise(
        F.col("duration_ms") + F.col("gap_before_ms")
    )


def think_baseline(episodes: DataFrame) -> DataFrame:
    """Nearest-rank 75th percentile of human think gaps; sessions without any are absent (baseline 0)."""
    human = episodes.where(F.col("actor").isin("human_active", "think_pause"))
    return ordered.nearest_rank(human, [SESSION], "gap_before_ms", 0.75, "p75_gap_ms")


def waste_rows(episodes: DataFrame) -> DataFrame:
    """Add the disjoint buckets of each episode: detour before loop before stuck, the rest productive."""
    df = episodes.join(think_baseline(episodes), SESSION, "left").withColumn(
        "p75_gap_ms", F.coalesce("p75_gap_ms", F.lit(0).cast("bigint"))
    )
    zero = F.lit(0).cast("bigint")
    df = df.withColumn("active_ms", active_ms())
    detour = F.coalesce(F.col("alignment") == "detour", F.lit(False))
    loop = ~detour & F.col("loop_of_seq").isNotNull()
    stuck = ~detour & ~loop & (F.col("actor") == "think_pause")
    df = (
        df.withColumn("detour_ms", F.when(detour, F.col("active_ms")).otherwise(zero))
        .withColumn("loop_ms", F.when(loop, F.col("active_ms")).otherwise(zero))
        .withColumn(
            "stuck_ms",
            F.when(
                stuck & (F.col("active_ms") > 0), F.greatest(zero, F.col("gap_before_ms") - F.col("p75_gap_ms"))
            ).otherwise(zero),
        )
    )
    return df.withColumn(
        "productive_ms", F.col("active_ms") - F.col("detour_ms") - F.col("loop_ms") - F.col("stuck_ms")
    )


BUCKETS = ["productive_ms", "detour_ms", "stuck_ms", "loop_ms", "active_ms"]


def _fold(df: DataFrame, keys: list[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(*[F.sum(b).alias(b) for b in BUCKETS])
    wasted = F.col("detour_ms") + F.col("stuck_ms") + F.col("loop_ms")
    return out.withColumn(
        "efficiency_pct",
        F.when(F.col("active_ms") == 0, 100.0).otherwise((1 - wasted / F.col("active_ms")) * 100),
    )


def waste(episodes: DataFrame) -> DataFrame:
    return _fold(waste_rows(episodes), [SESSION])


def waste_by_tactic(episodes: DataFrame) -> DataFrame:
    """Per tactic, against the baseline of the whole session."""
    return _fold(waste_rows(episodes), [SESSION, "tactic"])


def context_factor() -> Column:
    loud = F.lower(F.coalesce("binary", F.lit(""))).isin(rules.ON_TARGET_LOUD)
    return F.when(~t.on_target(F.col("context_path")), 1.0).when(loud, 1.6).otherwise(0.7)


def episode_noise(with_context: bool = True) -> Column:
    volume = F.greatest(F.lit(1), F.coalesce("volume", F.lit(1)))
    weight = F.coalesce("noise_weight", F.lit(0.0))
    noise = weight * (1 + F.log10(volume.cast("double")))
    if with_context:
        noise = noise * context_factor()
    return F.when(weight == 0, F.lit(0.0)).otherwise(noise)


def stealth(episodes: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Total noise and stealth score; ``baselines(session_uuid, baseline)`` replaces the default reference."""
    out = episodes.groupBy(SESSION).agg(F.sum(episode_noise()).alias("total_noise"))
    if baselines is not None:
        out = out.join(baselines, SESSION, "left")
        base = F.coalesce("baseline", F.lit(rules.NOISE_BASELINE))
    else:
        base = F.lit(rules.NOISE_BASELINE)
    score = F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), F.col("total_noise") / base * 100))
    return out.select(SESSION, "total_noise", score.alias("stealth_score"))


def loud_moments(episodes: DataFrame, top: int = 3) -> DataFrame:
    """Loudest episodes of a session. The rank limit is applied before the shuffle by the optimizer."""
    noisy = episodes.select(SESSION, "seq", "binary", episode_noise().alias("noise")).where(F.col("noise") > 0)
    rank = F.row_number().over(Window.partitionBy(SESSION).orderBy(F.col("noise").desc(), "seq"))
    return noisy.withColumn("rank", rank).where(F.col("rank") <= top)


def technique_breadth(episodes: DataFrame) -> DataFrame:
    named = F.when(F.col("technique") != "", F.col("technique"))
    return episodes.groupBy(SESSION).agg(F.count_distinct(named).alias("technique_breadth"))


def technique_sequences(episodes: DataFrame) -> DataFrame:
    """Which episodes used each technique, in long form, with the first-seen order of the technique."""
    named = episodes.where(F.col("technique").isNotNull() & (F.col("technique") != "")).select(SESSION, "technique", "seq")
    first = named.groupBy(SESSION, "technique").agg(F.min("seq").alias("first_seq"), F.count("seq").alias("uses"))
    order = F.row_number().over(Window.partitionBy(SESSION).orderBy("first_seq"))
    return named.join(first.withColumn("technique_order", order), [SESSION, "technique"])


def ukc_coverage(episodes: DataFrame, objectives: DataFrame) -> DataFrame:
    """Share of the phases the intended path requires that the session reached; 0 when none is required."""
    table = classify.ukc_table(episodes.sparkSession)
    required = objectives.join(table, "tactic").groupBy(SESSION).agg(F.collect_set("ukc").alias("required"))
    reached = episodes.select(SESSION, "tactic").distinct().join(table, "tactic").groupBy(SESSION).agg(
        F.collect_set("ukc").alias("reached")
    )
    everyone = episodes.select(SESSION).distinct()
    df = everyone.join(required, SESSION, "left").join(reached, SESSION, "left")
    hit = F.size(F.array_intersect("required", F.coalesce("reached", F.array().cast("array<string>"))))
    pct = F.when(F.col("required").isNull(), 0.0).otherwise(hit / F.size("required") * 100)
    return df.select(SESSION, pct.alias("ukc_coverage_pct"))


def ukc_progression(episodes: DataFrame) -> DataFrame:
    """Share of kill-chain transitions that do not move backward; 100 below two mapped episodes."""
    table = classify.ukc_table(episodes.sparkSession)
    ranked = ordered.with_slices(episodes, [SESSION], "seq").join(table.select("tactic", "ukc_rank"), "tactic", "left")
    df = ordered.scan(ranked, [SESSION], ["seq"], {"_before": ordered.last_seen(F.col("ukc_rank"), inclusive=False)})
    moved = F.col("ukc_rank").isNotNull() & F.col("_before").isNotNull()
    forward = moved & (F.col("ukc_rank") >= F.col("_before"))
    out = df.groupBy(SESSION).agg(
        F.count(F.when(moved, 1)).alias("_moves"), F.count(F.when(forward, 1)).alias("_forward")
    )
    pct = F.when(F.col("_moves") == 0, 100.0).otherwise(F.col("_forward") / F.col("_moves") * 100)
    return out.select(SESSION, pct.alias("ukc_progression"))


def weaknesses(episodes: DataFrame) -> DataFrame:
    """Distinct tool-implied weakness classes in first-seen order."""
    df = classify.with_binary_cwe(episodes.select(SESSION, "seq", "binary"))
    found = df.select(SESSION, "seq", F.explode("binary_cwe").alias("cwe")).groupBy(SESSION, "cwe").agg(
        F.min("seq").alias("first_seq")
    )
    order = F.row_number().over(Window.partitionBy(SESSION).orderBy("first_seq", "cwe"))
    return found.withColumn("position", order)


def weakness_breadth(episodes: DataFrame) -> DataFrame:
    found = weaknesses(episodes).groupBy(SESSION).agg(F.count("cwe").alias("weakness_breadth"))
    return episodes.select(SESSION).distinct().join(found, SESSION, "left").select(
        SESSION, F.coalesce("weakness_breadth", F.lit(0)).cast("bigint").alias("weakness_breadth")
    )


def reached_phases(episodes: DataFrame) -> DataFrame:
    table = classify.ukc_table(episodes.sparkSession)
    return episodes.select(SESSION, "tactic").distinct().join(table, "tactic").select(SESSION, "ukc", "ukc_rank")


def noise_burn(timed: DataFrame) -> DataFrame:
    """Cumulative noise along the sequence."""
    df = ordered.with_slices(timed, [SESSION], "seq").withColumn("noise", episode_noise())
    return ordered.scan(df, [SESSION], ["seq"], {"cumulative_noise": ordered.running_sum(F.col("noise"))})


def exposure(timed: DataFrame, steps: int = 90) -> DataFrame:
    """Decaying exposure at every noisy episode end and on an even grid over the session.

    The decayed sum is a running sum of noise grown by e^(t/tau), scaled back by e^(-t/tau) at each point;
    tau is at least an eighth of the session, so the exponent stays at or below 8.
    """
    length = timed.groupBy(SESSION).agg(F.max("t1").alias("total_ms"))
    tau = F.greatest(F.col("total_ms") / 8, F.lit(120_000.0))
    noisy = timed.select(SESSION, F.col("t1").cast("double").alias("at_ms"), episode_noise().alias("noise")).where(
        F.col("noise") > 0
    )
    grid = length.select(
        SESSION,
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / float(steps) * F.col("total_ms"))).alias("at_ms"),
    )
    loads = noisy.groupBy(SESSION, "at_ms").agg(F.sum("noise").alias("noise"))
    points = loads.unionByName(grid.withColumn("noise", F.lit(0.0))).groupBy(SESSION, "at_ms").agg(
        F.sum("noise").alias("noise")
    )
    df = points.join(length, SESSION).withColumn("tau_ms", tau)
    df = ordered.with_slices(df, [SESSION], "at_ms", like=timed)
    df = ordered.scan(
        df, [SESSION], ["at_ms"], {"_grown": ordered.running_sum(F.col("noise") * F.exp(F.col("at_ms") / F.col("tau_ms")))}
    )
    return df.select(SESSION, "at_ms", "noise", (F.col("_grown") * F.exp(-F.col("at_ms") / F.col("tau_ms"))).alias("exposure"))


def trajectory(episodes: DataFrame) -> DataFrame:
    """Ranked kill-chain points, the dense row of each reached rank and whether the point is the furthest."""
    table = classify.ukc_table(episodes.sparkSession)
    points = episodes.where(F.col("binary") != "").select(SESSION, "seq", "tactic").join(table, "tactic")
    ranks = points.groupBy(SESSION, "ukc_rank").agg(F.count("seq").alias("_n"), F.min("seq").alias("_first"))
    by_session = Window.partitionBy(SESSION)
    rows = (
        ranks.withColumn("_points", F.sum("_n").over(by_session))
        .withColumn("_top", F.max("ukc_rank").over(by_session))
        .withColumn("row", F.row_number().over(by_session.orderBy("ukc_rank")) - 1)
        .where(F.col("_points") >= 2)
    )
    return points.join(rows, [SESSION, "ukc_rank"]).select(
        SESSION, "seq", "ukc", "ukc_rank", "row",
        ((F.col("ukc_rank") == F.col("_top")) & (F.col("seq") == F.col("_first"))).alias("furthest"),
    )


def loadout(episodes: DataFrame, include_blank: bool = False) -> DataFrame:
    df = episodes if include_blank else episodes.where(F.col("binary") != "")
    return df.groupBy(SESSION, "binary").agg(F.count(F.lit(1)).alias("uses"), F.min("seq").alias("first_seq"))


STALL_MS = 90_000


def deviation_kind() -> Column:
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(False))
    return (
        F.when(F.col("loop_of_seq").isNotNull(), "loop")
        .when(F.coalesce(F.col("alignment") == "detour", F.lit(False)) | failed, "dead-end")
        .otherwise("ontrack")
    )


def deviations(episodes: DataFrame, stall_ms: int = STALL_MS) -> DataFrame:
    """Dead ends, loops and stalls with their cost; an episode may be both a dead end and a stall."""
    kind = deviation_kind()
    shown = F.when(F.col("binary") != "", F.col("binary")).otherwise("a command")
    why = F.when(F.col("output_digest") != "", F.col("output_digest")).when(
        F.col("exit_code") != 0, F.concat(F.lit("exited "), F.col("exit_code").cast("string"))
    ).otherwise("no useful result")
    text = F.when(kind == "dead-end", F.concat(shown, F.lit(" — "), why)).otherwise(
        F.concat(shown, F.lit(" — retried after it failed"))
    )
    cases = F.array(
        F.when(kind != "ontrack", F.struct(kind.alias("kind"), F.col("duration_ms").alias("cost_ms"), text.alias("description"))),
        F.when(
            F.col("gap_before_ms") >= stall_ms,
            F.struct(F.lit("stall").alias("kind"), F.col("gap_before_ms").alias("cost_ms"),
                     F.concat(F.lit("paused before "), shown).alias("description")),
        ),
    )
    return episodes.select(SESSION, "seq", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c")).select(
        SESSION, "seq", "c.kind", "c.cost_ms", "c.description"
    )


def deviation_summary(episodes: DataFrame, stall_ms: int = STALL_MS) -> DataFrame:
    rows = waste_rows(episodes)
    kind = deviation_kind()
    stalled = F.col("gap_before_ms") >= stall_ms
    out = rows.groupBy(SESSION).agg(
        F.count(F.when(kind == "dead-end", 1)).alias("dead_ends"),
        F.count(F.when(kind == "loop", 1)).alias("loops"),
        F.count(F.when(stalled, 1)).alias("stalls"),
        F.max(F.when(stalled, F.col("gap_before_ms"))).alias("biggest_stall_ms"),
        F.sum(F.col("detour_ms") + F.col("stuck_ms") + F.col("loop_ms")).alias("lost_ms"),
        F.sum("active_ms").alias("active_ms"),
    )
    pct = d.js_round(F.col("lost_ms") / F.greatest(F.lit(1), F.col("active_ms")) * 100).cast("bigint")
    return out.withColumn("lost_pct", pct)


def suggestions(episodes: DataFrame, objectives: DataFrame, stall_ms: int = STALL_MS) -> DataFrame:
    """The intended objective for every deviating step: the next one satisfied later, else the first unmet."""
    met = objectives.where(F.col("user_satisfied_by_seq").isNotNull())
    marks = met.groupBy(SESSION, F.col("user_satisfied_by_seq").alias("seq")).agg(
        F.min_by(F.struct("objective", F.get("satisfied_by", 0).alias("method")), "ordinal").alias("_mark")
    )
    unmet = objectives.where(F.col("user_satisfied_by_seq").isNull()).groupBy(SESSION).agg(
        F.min_by(F.struct("objective", F.get("satisfied_by", 0).alias("method")), "ordinal").alias("_unmet")
    )
    df = ordered.with_slices(episodes, [SESSION], "seq").join(marks, [SESSION, "seq"], "left")
    df = ordered.scan(df, [SESSION], ["seq"], {"_next": ordered.next_seen(F.col("_mark"), inclusive=False)})
    off = (deviation_kind() != "ontrack") | (F.col("gap_before_ms") >= stall_ms)
    target = F.coalesce("_next", "_unmet")
    return df.where(off).join(unmet, SESSION, "left").select(
        SESSION, "seq", deviation_kind().alias("kind"), target["objective"].alias("suggested_objective"),
        target["method"].alias("suggested_method"),
    )


def glance(episodes: DataFrame, objectives: DataFrame) -> DataFrame:
    """Counters of the live view."""
    from runlens.operators import timeline

    pause = F.col("actor") == "think_pause"
    base = episodes.groupBy(SESSION).agg(
        F.count(F.when(F.col("alignment") == "detour", 1)).alias("detours"),
        F.count(F.when(F.col("loop_of_seq").isNotNull(), 1)).alias("loops"),
        F.count(F.when(pause, 1)).alias("stalls"),
        F.coalesce(F.max(F.when(pause, F.col("duration_ms") + F.col("gap_before_ms"))), F.lit(0)).cast("bigint").alias(
            "longest_stall_ms"
        ),
    )
    done = objectives.groupBy(SESSION).agg(
        F.count("user_satisfied_by_seq").alias("objectives_done"), F.count(F.lit(1)).alias("objectives")
    )
    return base.join(done, SESSION, "left").join(timeline.flag_reads(episodes), SESSION, "left")


def radar_from_efficiency(episodes: DataFrame) -> DataFrame:
    """Skill radar read from per-tactic efficiency, 50 where a tactic never occurred."""
    per = waste_by_tactic(episodes)
    skills = {"recon": "TA0007", "web": "TA0001", "exploit": "TA0002", "privesc": "TA0004"}
    pick = [
        d.js_round(F.coalesce(F.max(F.when(F.col("tactic") == tac, F.col("efficiency_pct"))), F.lit(50.0))).alias(skill)
        for skill, tac in skills.items()
    ]
    opsec = stealth(episodes).select(SESSION, d.js_round(F.col("stealth_score")).alias("opsec"))
    return per.groupBy(SESSION).agg(*pick).join(opsec, SESSION)


def radar_from_counts(episodes: DataFrame) -> DataFrame:
    """Skill radar of a live session: 25 points per episode of a skill, capped at 100."""
    pairs = [F.lit(x) for item in rules.RADAR_BY_TACTIC.items() for x in item]
    skill = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("tactic")), F.lit("exploit"))
    return episodes.groupBy(SESSION).agg(
        *[
            F.least(F.lit(100), 25 * F.count(F.when(skill == s, 1))).cast("bigint").alias(s)
            for s in ("recon", "web", "exploit", "privesc", "opsec")
        ]
    )
