"""Tapped remote shells: keystroke logs, screen masking, echo scrubbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.operators import ordered
from runlens.schemas import SESSION, WEB
from runlens.session import stage

# fixed values: terminal control sequences
CSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
ESC = r"\x1b[@-Z\\-_]"
ALT_ENTER = r"\x1b\[\?(?:1049|1047|47)h"
ALT_LEAVE = r"\x1b\[\?(?:1049|1047|47)l"


BACKSPACE = "[\x7f\x08]"
PAIR_PASSES = 4
CONTROL = "[\x00-\x1f\x7f]"


def replay_line(line: Column) -> Column:
    """The text left after escape sequences are removed and backspaces are applied.

    A character followed by a backspace cancels out, which a few pattern passes do for whole lines at once. Only
    longer runs of backspaces, and backspaces on an empty line, are left to a fold over the remaining pieces. A line
    without control characters has nothing to replay.
    """
    plain = F.regexp_replace(F.regexp_replace(line, CSI, ""), ESC, "")
    text = F.regexp_replace(F.replace(plain, F.lit("\t"), F.lit(" ")), "[\x00-\x07\x09-\x1f]", "")
    for _ in range(PAIR_PASSES):
        text = F.regexp_replace(text, f"[^\x7f\x08]{BACKSPACE}", "")
    pieces = F.split(text, BACKSPACE)
    folded = F.aggregate(
        F.slice(pieces, F.lit(2), F.size(pieces)), F.get(pieces, 0),
        lambda held, piece: F.concat(F.left(held, F.greatest(F.length(held) - 1, F.lit(0))), piece),
    )
    replayed = F.when(text.rlike(BACKSPACE), folded).otherwise(text)
    return F.when(line.rlike(CONTROL), t.trim(replayed)).otherwise(t.trim_ends(line))


def parse_keystrokes(logs: DataFrame, column: str = "input_log") -> DataFrame:
    """(session_uuid, line_no, cmd): entered lines, aborted and empty ones dropped."""
    lines = logs.select(SESSION, F.posexplode(F.split(F.col(column), "\r\n|\r|\n")).alias("line_no", "line"))
    replayed = t.once(lines.where(~F.col("line").contains("\x03")), "cmd", replay_line(F.col("line")))
    return replayed.select(SESSION, "line_no", "cmd").where("cmd <> ''")


def strip_alt_screen(taps: DataFrame) -> DataFrame:
    """Replace ``input_log`` by the keystrokes typed outside full-screen programs.

    ``taps(session_uuid, input_log, output_log, timing_log)``. The screen depth may not fall below zero, so it is
    the running sum minus its lowest value so far (when that is negative). A tap is one file per session, read whole.
    """
    timed_taps = taps.where("output_log is not null and output_log <> '' and timing_log is not null and timing_log <> ''")
    lines = timed_taps.select(SESSION, F.posexplode(F.split("timing_log", r"\r?\n")).alias("n", "line"))
    pattern = r"^([IO])\s+[\d.]+\s+(\d+)"
    steps = lines.where(F.col("line").rlike(pattern)).select(
        SESSION, "n", F.regexp_extract("line", pattern, 1).alias("side"), F.regexp_extract("line", pattern, 2).cast("int").alias("size"),
    )
    w = Window.partitionBy(SESSION).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_side = Window.partitionBy(SESSION, "side").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("_at", (F.sum("size").over(by_side) - F.col("size") + 1).cast("int"))
    # Positions come from the small timing rows alone. The places of a tap meet its logs in one row and cut them there, so
    # only the pieces go on.
    places = steps.groupBy(SESSION).agg(F.sort_array(F.collect_list(F.struct("n", "side", "_at", "size"))).alias("_places"))
    cut = lambda x: F.struct(
        x["n"].alias("n"), x["side"].alias("side"),
        F.substr(F.when(x["side"] == "O", F.col("output_log")).otherwise(F.col("input_log")), x["_at"], x["size"]).alias("chunk"))
    pieces = timed_taps.join(places, SESSION).select(SESSION, F.explode(F.transform("_places", cut)).alias("x"))
    steps = pieces.select(SESSION, "x.*")
    # Enter and leave marks of one chunk are counted first and clamped once, as one step.
    step = F.when(
        F.col("side") == "O",
        F.size(F.regexp_extract_all("chunk", F.lit(ALT_ENTER), 0)) - F.size(F.regexp_extract_all("chunk", F.lit(ALT_LEAVE), 0)),
    ).otherwise(0)
    steps = steps.withColumn("_sum", F.sum(step).over(w))
    steps = steps.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    kept = steps.where("side = 'I' and _depth = 0").groupBy(SESSION).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk"))), lambda x: x["chunk"]), "").alias("_kept")
    )
    timed = F.coalesce("output_log", F.lit("")) != ""
    timed = timed & (F.coalesce("timing_log", F.lit("")) != "")
    return taps.join(kept, SESSION, "left").withColumn(
        "input_log", F.when(timed, F.coalesce("_kept", F.lit(""))).otherwise(F.col("input_log"))
    ).drop("_kept")


def scrub_unechoed(commands: DataFrame, outputs: DataFrame) -> DataFrame:
    """Drop input the terminal never echoed (typed secrets); very short lines and sessions without output are kept."""
    echoed = outputs.where("output_log is not null and output_log <> ''").select(
        SESSION, F.regexp_replace("output_log", f"{CSI}|{ESC}", "").alias("_echo")
    )
    # The commands of a session were one input log; they meet the output log in one row instead of a copy of it each.
    held = commands.groupBy(SESSION).agg(F.collect_list(F.struct(*commands.columns)).alias("_c")).join(echoed, SESSION, "left")
    needle = lambda x: t.trim_ends(x["cmd"])
    kept = F.filter("_c", lambda x: F.col("_echo").isNull() | (F.length(needle(x)) < 3) | F.col("_echo").contains(needle(x)))
    return held.select(F.explode(kept).alias("x")).select("x.*")


def pair_tap_files(files: DataFrame) -> DataFrame:
    """``<id>.in/.out/.tm/.meta`` files to one row per tap. ``files(file, body)``."""
    pattern = r"([^/]+)\.(in|out|tm|meta)\z"
    named = files.select(
        F.regexp_extract("file", pattern, 1).alias(SESSION), F.regexp_extract("file", pattern, 2).alias("part"), "body"
    ).where("part <> ''")
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("body")))
    rows = named.groupBy(SESSION).agg(
        of("in").alias("input_log"), of("out").alias("output_log"), of("tm").alias("timing_log"), of("meta").alias("_meta")
    )
    meta = F.from_json("_meta", "struct<target:string,startedAtMs:bigint>")
    return rows.where(t.trim(F.coalesce("input_log", F.lit(""))) != "").select(
        SESSION, "input_log", "output_log", "timing_log", F.coalesce(meta["target"], F.lit("target")).alias("target"),
        F.coalesce(meta["startedAtMs"], F.lit(0)).cast("bigint").alias("started_at_ms"),
    )


def read_taps(spark: SparkSession, path: str) -> DataFrame:
    from runlens.sources.captures import read_files

    return pair_tap_files(read_files(spark, path))


def tap_to_raw(taps: DataFrame, step_ms: int = 1000) -> DataFrame:
    """Commands of tapped shells; a plain log has no timing, so they are spaced by a fixed step."""
    shell = strip_alt_screen(taps)
    commands = stage(scrub_unechoed(parse_keystrokes(shell), taps.select(SESSION, "output_log")), "commands")
    placed = ordered.scan(ordered.with_slices(commands, [SESSION], "line_no"), [SESSION], ["line_no"], {"i": ordered.position()})
    df = placed.withColumn("i", F.col("i") - 1).join(taps.select(SESSION, "target", F.col("started_at_ms").alias("_t0")), SESSION)
    at = F.col("_t0") + F.col("i") * step_ms
    return df.select(
        SESSION, F.col("i").cast("bigint").alias("ord"), t.redact_text(F.col("cmd")).alias("cmd"), at.alias("started_at_ms"),
        at.alias("ended_at_ms"), F.lit(None).cast("int").alias("exit_code"), F.lit(0).cast("bigint").alias("output_line_count"),
        F.lit(None).cast("string").alias("output_digest"), F.concat(F.lit("host->ssh:"), "target").alias("context_path"),
        F.lit(None).cast("bigint").alias("volume"), F.lit(None).cast(WEB).alias("web"),
    )
