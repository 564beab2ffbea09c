"""Telemetry envelopes: reading, capability fill, and joining into raw commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.schemas import ENVELOPE, HANDSHAKE, SESSION, WEB

WEB_ORD = 1 << 40
REQUIRED = ["source", "session_uuid", "ts_utc_us", "kind"]


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelope columns out of JSON lines; lines that do not parse or lack a required field are dropped.

    The requirement is an explicit filter, so pruning columns later cannot bring a bad line back. Fields come out of a
    generator, which filters do not pass: a plain projection would parse the line again for every condition on a field.
    """
    kept = [c for c in lines.columns if c != column]
    parsed = lines.select(*kept, F.inline(F.array(F.from_json(column, ENVELOPE))))
    complete = None
    for name in REQUIRED:
        complete = F.col(name).isNotNull() if complete is None else complete & F.col(name).isNotNull()
    return parsed.where(complete).withColumn("seq", F.coalesce("seq", F.lit(0).cast("bigint")))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of newline-delimited JSON files, with ``line_at`` giving the position in the file.

    A block of a file is always read by one task in order, so (file, block start, row counter) orders lines
    even where one file is split over many tasks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_at"),
    )
    return parse_lines(lines)


def read_handshakes(spark: SparkSession, path: str) -> DataFrame:
    """Handshake lines of capture files: one row per file that opens with one."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    marked = F.col("value").rlike(r'"\w+_handshake"\s*:')
    return (
        lines.where(marked)
        .select("file", F.from_json("value", HANDSHAKE).alias("h")).select("file", "h.*")
        .where("plugin is not null and capabilities is not null")
    )


def apply_handshake(envelopes: DataFrame, handshakes: DataFrame, key: str = "source") -> DataFrame:
    """Fill missing provenance from the sender's handshake. Of several handshakes of a sender one counts, the first by content."""
    order = F.struct("plugin", "context_template", F.col("capabilities.boundary_confidence").alias("boundary_confidence"))
    side = handshakes.groupBy(key).agg(F.min(order).alias("_h")).select(
        key, "_h.plugin", "_h.context_template", F.struct(F.col("_h.boundary_confidence").alias("boundary_confidence")).alias("capabilities"))
    side = side.select(
        key, F.col("context_template").alias("_context"), F.col("plugin").alias("_plugin"),
        F.when(F.col("capabilities.boundary_confidence") == "exact", 1.0).otherwise(0.7).alias("_confidence"),
    )
    return _filled(envelopes.join(side, key, "left"))


def _filled(joined: DataFrame) -> DataFrame:
    """Provenance out of _plugin, _context and _confidence where a row's own leaves it out."""
    known = F.col("_plugin").isNotNull()
    p = F.col("provenance")
    filled = F.struct(
        F.coalesce(p["boundary_confidence"], F.when(known, F.col("_confidence"))).alias("boundary_confidence"),
        p["redaction_method"].alias("redaction_method"),
        F.coalesce(p["context_path"], F.col("_context")).alias("context_path"),
        F.coalesce(p["platform"], F.col("_plugin")).alias("platform"),
    )
    return joined.withColumn("provenance", filled).drop("_context", "_plugin", "_confidence")


def with_handshakes(lines: DataFrame) -> DataFrame:
    """Envelopes out of (file, ord, line), each filled from the handshake in force where it stands: the last one of its file
    before it. Lines before the first handshake stay as they are. One sliced scan per file."""
    from runlens.operators import ordered

    marked = F.col("line").rlike(r'"\w+_handshake"\s*:')
    told = F.when(marked, F.from_json("line", HANDSHAKE))
    told = F.when(told["plugin"].isNotNull() & told["capabilities"].isNotNull(), F.struct(
        told["plugin"].alias("plugin"), told["context_template"].alias("context"), told["capabilities"]["boundary_confidence"].alias("confidence")))
    rows = ordered.with_slices(lines.withColumn("_told", told), ["file"], "ord")
    rows = ordered.scan(rows, ["file"], ["ord"], {"_h": ordered.last_seen(F.col("_told"))})
    at = F.struct("file", F.lit(0).cast("bigint").alias("block"), F.col("ord").alias("row")).alias("line_at")
    parsed = parse_lines(rows.where("_told is null").select("line", at, "_h"), "line")
    return _filled(parsed.select(
        *[c for c in parsed.columns if c != "_h"], F.col("_h.plugin").alias("_plugin"), F.col("_h.context").alias("_context"),
        F.when(F.col("_h.confidence") == "exact", 1.0).otherwise(0.7).alias("_confidence")))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of capture files, each line filled from the handshake in force where it stands."""
    from runlens.sources import captures

    return with_handshakes(captures.read_lines(spark, path))


def _at(df: DataFrame) -> list[str]:
    return ["line_at"] if "line_at" in df.columns else ["ts_utc_us"]


def _pick(df: DataFrame, keys: list[str], on_duplicate: str, body: Column) -> DataFrame:
    """One row per key, first or last by position; aggregated before the shuffle, so repeats never pile up."""
    chooser = F.max_by if on_duplicate == "last" else F.min_by
    at = _at(df)[0]
    return df.groupBy(*keys).agg(chooser(body, F.struct(F.col(at), F.col("ts_utc_us"))).alias("r"))


def join_command_output(envelopes: DataFrame, on_duplicate: str = "last", redact: bool = True) -> DataFrame:
    """Commands joined to their output by (session, seq). A missing output ends the command where it began."""
    mask = t.redact_text if redact else (lambda c: c)
    body = F.struct("ts_utc_us", "payload", "provenance")
    keys = [SESSION, "seq"]
    commands = _pick(envelopes.where("kind = 'command'"), keys, on_duplicate, body).select(*keys, F.col("r").alias("c"))
    outputs = _pick(envelopes.where("kind in ('output', 'stdin_masked')"), keys, on_duplicate, body).select(*keys, F.col("r").alias("o"))
    started = F.floor(F.col("c.ts_utc_us") / 1000).cast("bigint")
    ended = F.floor(F.col("o.ts_utc_us") / 1000).cast("bigint")
    return commands.join(outputs, keys, "left").select(
        SESSION, F.col("seq").alias("ord"), mask(F.coalesce("c.payload.cmd", F.lit(""))).alias("cmd"),
        started.alias("started_at_ms"), F.greatest(started, F.coalesce(ended, started)).alias("ended_at_ms"),
        F.col("c.payload.exit_code").cast("int").alias("exit_code"),
        F.coalesce("o.payload.line_count", F.lit(0)).cast("bigint").alias("output_line_count"),
        mask(F.col("o.payload.text")).alias("output_digest"), F.col("c.provenance.context_path").alias("context_path"),
        F.lit(None).cast("bigint").alias("volume"), F.lit(None).cast(WEB).alias("web"),
    )


def join_http_pairs(envelopes: DataFrame, on_duplicate: str = "last") -> DataFrame:
    """Requests joined to their responses by (session, pair_id), as web commands."""
    body = F.struct("ts_utc_us", "payload", "provenance", *[c for c in ("line_at",) if c in envelopes.columns])
    paired = envelopes.where(F.coalesce("payload.pair_id", F.lit("")) != "").withColumn("pair_id", F.col("payload.pair_id"))
    keys = [SESSION, "pair_id"]
    asked = _pick(paired.where("kind = 'http_request'"), keys, on_duplicate, body).select(*keys, F.col("r").alias("q"))
    answered = _pick(paired.where("kind = 'http_response'"), keys, on_duplicate, body).select(*keys, F.col("r").alias("a"))
    started = F.floor(F.col("q.ts_utc_us") / 1000).cast("bigint")
    ended = F.floor(F.col("a.ts_utc_us") / 1000).cast("bigint")
    method = F.coalesce("q.payload.method", F.lit("GET"))
    url = t.redact_text(F.coalesce("q.payload.url", F.lit("")))
    # Web commands follow shell commands of the same millisecond; among themselves they keep microsecond order.
    # Within a microsecond the place in the file decides where it is known, else a fixed order of the pairs.
    known = "line_at" in envelopes.columns
    arrival = F.col("q.line_at.row") if known else F.xxhash64("pair_id")
    tie = (F.col("q.ts_utc_us") % 1000) * (1 << 22) + F.pmod(arrival, F.lit(1 << 22))
    return asked.join(answered, keys, "left").select(
        SESSION, (F.lit(WEB_ORD) + tie).cast("bigint").alias("ord"), F.concat(method, F.lit(" "), t.url_path(url)).alias("cmd"),
        started.alias("started_at_ms"), F.greatest(started, F.coalesce(ended, started)).alias("ended_at_ms"),
        F.lit(None).cast("int").alias("exit_code"), F.lit(0).cast("bigint").alias("output_line_count"),
        F.lit(None).cast("string").alias("output_digest"),
        F.coalesce("q.provenance.context_path", F.lit("web:burp")).alias("context_path"), F.lit(None).cast("bigint").alias("volume"),
        F.struct(
            method.alias("method"), url.alias("url"), t.redact_text(F.col("q.payload.req_body")).alias("req_body"),
            F.col("a.payload.status").alias("status"), t.redact_text(F.col("a.payload.resp_body")).alias("resp_body"),
            F.col("a.payload.mime").alias("mime"),
        ).alias("web"),
    )


def merge_raw(*streams: DataFrame) -> DataFrame:
    """Raw commands of several sources; ``ord`` keeps each source's own order and ranks sources as given."""
    out = None
    for rank, df in enumerate(streams):
        shifted = df.withColumn("ord", F.col("ord") + F.lit(rank * (1 << 52)))
        out = shifted if out is None else out.unionByName(shifted, allowMissingColumns=True)
    return out


def raw_commands(envelopes: DataFrame, on_duplicate: str = "last") -> DataFrame:
    return join_command_output(envelopes, on_duplicate).unionByName(join_http_pairs(envelopes, on_duplicate))


def expand_steps(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Scripted steps to timestamped commands: ``steps(session_uuid, ord, cmd, gap, dur, out, lines, volume)``."""
    from runlens.operators import ordered

    df = ordered.with_slices(steps, [SESSION], "ord")
    df = ordered.scan(df, [SESSION], ["ord"], {"_end": ordered.running_sum(F.col("gap") + F.col("dur"))})
    ended = F.col("start_ms") + F.col("_end")
    return df.join(starts, SESSION).select(
        SESSION, "ord", "cmd", (ended - F.col("dur")).alias("started_at_ms"), ended.alias("ended_at_ms"),
        F.lit(0).alias("exit_code"), F.col("lines").cast("bigint").alias("output_line_count"), F.col("out").alias("output_digest"),
        F.lit("host").alias("context_path"), F.col("volume").cast("bigint").alias("volume"), F.lit(None).cast(WEB).alias("web"),
    )


def dedupe_web(stream: DataFrame, hosts: list[str] | DataFrame | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Each pair once, in-scope hosts only. Works on streams (bounded by the watermark) and on batches."""
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)
    df = stream
    if isinstance(hosts, DataFrame):
        df = df.join(hosts.select(F.col("host").alias("_host")).distinct(), host == F.col("_host"), "left_semi")
    elif hosts:
        df = df.where(host.isin(hosts))
    if df.isStreaming:
        return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([SESSION, "pair_id"])
    first = Window.partitionBy(SESSION, "pair_id").orderBy("ts")
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def attach_sidecars(sessions: DataFrame, hints: DataFrame | None = None, golden: DataFrame | None = None) -> DataFrame:
    """Add ``hints`` and ``hint_golden`` from JSON sidecars; a broken sidecar is ignored.

    Both are ``(session_uuid, body)`` with one row per session.
    """
    out = sessions
    if hints is not None:
        pulls = F.from_json("body", "array<struct<tier:int,atMs:bigint,phase:string,source:string>>")
        ok = F.trim("body").startswith("[")
        out = out.join(hints.select(SESSION, F.when(ok, pulls).alias("hints")), SESSION, "left")
    if golden is not None:
        shape = (
            "struct<source:string,confidence:double,golden:array<struct<objective:string,tactic:string,"
            "satisfied_by:array<string>,techniques:array<string>,depends_on:array<string>>>>"
        )
        ok = F.trim("body").startswith("{")
        out = out.join(golden.select(SESSION, F.when(ok, F.from_json("body", shape)).alias("hint_golden")), SESSION, "left")
    return out
