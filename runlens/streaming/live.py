"""Live status per session, and the micro-batch refresh that recomputes the sessions it touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import display as d
from runlens.operators import analysis
from runlens.schemas import SESSION

STALE_MS = 600_000


def live_status(
    sessions: DataFrame, episodes: DataFrame, phases: DataFrame, findings: DataFrame, uses: DataFrame, metric_row: DataFrame, now: Column,
    most_recent: int | None = None,
) -> DataFrame:
    """One row per session: phase, elapsed, stealth, ports, loose ends, finds (newest first; ``most_recent``: so many) and a nudge.

    ``sessions(session_uuid, target_name, started_at, ended_at, recording)``.
    """
    last = episodes.groupBy(SESSION).agg(
        F.max_by(F.struct("seq", "tactic", "started_at_ms"), "seq").alias("_l"), F.count(F.lit(1)).alias("commands"))
    label = phases.select(SESSION, F.col("mitre_tactic").alias("_tactic"), "label")
    used = findings.join(uses.select(SESSION, "id").distinct().withColumn("_used", F.lit(True)), [SESSION, "id"], "left").withColumn(
        "_used", F.coalesce("_used", F.lit(False)))
    counts = used.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("findings"), F.count(F.when(F.col("kind") == "port", 1)).alias("ports_found"),
        F.count(F.when((F.col("kind") == "port") & F.col("_used"), 1)).alias("ports_engaged"),
        F.count(F.when((F.col("kind") == "cred") & ~F.col("_used"), 1)).alias("_creds"),
        F.count(F.when(F.col("kind").isin("url", "path") & ~F.col("_used"), 1)).alias("_paths"))
    times = episodes.select(SESSION, F.col("seq").alias("source_seq"), "started_at_ms")
    found_at = findings.select(SESSION, "source_seq").distinct().join(times, [SESSION, "source_seq"], "left").groupBy(SESSION).agg(
        F.max(F.coalesce("started_at_ms", F.lit(0))).alias("_found_at"))
    shown = F.when(F.col("kind").isin("cred", "hash"), "••••").otherwise(F.col("value"))
    rank = F.row_number().over(Window.partitionBy(SESSION).orderBy(F.col("source_seq").desc(), "id"))
    recent = findings.select(SESSION, "kind", "source_seq", "id", shown.alias("value")).withColumn("_r", rank).where("true" if most_recent is None else f"_r <= {most_recent}").groupBy(SESSION).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "kind", "value"))), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))).alias("recent"))
    hole = analysis.rabbit_holes(episodes).groupBy(SESSION).agg(F.max(F.struct("end_seq", "binary")).alias("_h"))
    df = sessions.join(last, SESSION, "left")
    df = df.withColumn("_tactic", F.col("_l.tactic")).join(label, [SESSION, "_tactic"], "left")
    for part in (counts, found_at, recent, hole, metric_row.select(SESSION, "stealth_score")):
        df = df.join(part, SESSION, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    upto = F.when(F.coalesce("recording", F.lit(False)), now).otherwise(F.col("ended_at"))
    elapsed = F.coalesce(F.greatest(F.lit(0), F.unix_millis(upto) - F.unix_millis("started_at")), F.lit(0))
    last_at = F.coalesce("_l.started_at_ms", F.lit(0))
    since = F.when((zero("_found_at") != 0) & (last_at != 0), F.greatest(F.lit(0), last_at - F.col("_found_at")))
    creds, paths = F.col("_creds"), F.col("_paths")
    threads = F.filter(F.array(
        F.when(creds == 1, "An unused credential is sitting in your loot.").when(
            creds > 1, F.concat(creds.cast("string"), F.lit(" unused credentials are sitting in your loot."))),
        F.when(paths == 1, "A path you found was never revisited.").when(
            paths > 1, F.concat(paths.cast("string"), F.lit(" paths you found were never revisited."))),
    ), lambda x: x.isNotNull())
    at_tail = F.col("_h.end_seq") == F.col("_l.seq")
    nudge = F.when(at_tail, F.concat(F.lit("Long run on "), F.col("_h.binary"), F.lit(" with little to show. Step back and re-enumerate?"))).when(
        since > STALE_MS, F.concat(F.lit("Nothing new in "), d.minutes(since).cast("string"), F.lit("m. Widen the search?")))
    return df.select(
        SESSION, F.col("target_name").alias("target"),
        F.when(F.col("_l").isNull(), "Not started").otherwise(F.coalesce("label", "_l.tactic")).alias("phase"), elapsed.alias("elapsed_ms"),
        d.js_round(F.col("stealth_score")).alias("stealth"), zero("ports_found").alias("ports_found"), zero("ports_engaged").alias("ports_engaged"),
        zero("findings").alias("findings"), threads.alias("threads"), nudge.alias("nudge"), "recent", zero("commands").alias("commands"),
        since.alias("since_last_find_ms"))


def refresh_touched(
    stored: Callable[[], DataFrame], recompute: Callable[[DataFrame], dict[str, DataFrame]], write: Callable[[str, DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: recompute in full every session the micro-batch touched.

    ``stored`` reads the commands kept so far (including this batch), ``recompute`` builds the tables of the touched
    sessions, ``write`` stores them by name and batch number, so a replayed batch overwrites its own output.
    """
    def run(batch: DataFrame, number: int) -> None:
        touched = batch.select(SESSION).distinct()
        for name, table in recompute(stored().join(touched, SESSION, "left_semi")).items():
            write(name, table, number)

    return run
