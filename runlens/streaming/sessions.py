"""Live sessions: the stateful controller, its batch twin, and stream joins and tallies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from runlens.functions import text as t
from runlens.operators import ordered
from runlens.schemas import SESSION

IDLE_US = 600_000_000
DRIVING = ["command", "output", "stdin_masked", "session_start", "session_end"]
STORED = ["command", "output", "stdin_masked", "http_request", "http_response"]
EVENT_SCHEMA = "source_key string, event string, session_uuid string, label string, at_us bigint, reason string"


def controller_input(envelopes: DataFrame, source_key: str = "source") -> DataFrame:
    """What drives the controller. The flag test runs on the text as captured, before any redaction."""
    seen = F.when(F.col("kind") == "command", F.col("payload.cmd")).when(
        F.col("kind").isin("output", "stdin_masked"), F.col("payload.text")
    )
    label = F.when(F.col("kind") == "session_start", F.coalesce("payload.text", F.lit("")))
    return envelopes.where(F.col("kind").isin(DRIVING)).select(
        F.col(source_key).alias("source_key"), SESSION, "kind", "seq", F.greatest("ts_utc_us", F.lit(0)).alias("at_us"),
        t.contains_flag(F.coalesce(seen, F.lit(""))).alias("has_flag"), label.alias("label"),
    )


class Controller:
    """Session rules for one source: explicit start and end, start on a command, idle close, one flag per session."""

    def __init__(self, idle_us: int, auto_start: bool, active: tuple | None = None):
        self.idle_us, self.auto_start, self.active = idle_us, auto_start, active

    def close(self, at: int, reason: str) -> list[tuple]:
        if self.active is None:
            return []
        uuid, started, _last, _flagged = self.active
        self.active = None
        return [("end", uuid, None, max(at, started), reason)]

    def open(self, uuid: str, label: str, at: int) -> list[tuple]:
        out = self.close(at, "manual")
        self.active = (uuid, at, at, False)
        return [*out, ("start", uuid, label, at, None)]

    def feed(self, key: str, kind: str, uuid: str, at: int, has_flag: bool, label: str | None) -> list[tuple]:
        if kind == "session_start":
            return self.open(uuid, label or "", at)
        if kind == "session_end":
            return self.close(at, "manual")
        out = []
        if self.active is not None and at - self.active[2] > self.idle_us:
            out += self.close(self.active[2] + self.idle_us, "idle")
        if self.active is None and self.auto_start and kind == "command":
            out += self.open(f"{key}-{at}", "", at)
        if self.active is not None:
            name, started, _last, flagged = self.active
            if has_flag and not flagged:
                flagged = True
                out.append(("flag", name, None, at, None))
            self.active = (name, started, at, flagged)
        return out


class SessionProcessor(StatefulProcessor):
    """The controller as keyed streaming state, fed in event order.

    Rows wait in the state until the watermark has passed them, so what arrives out of order within the watermark is fed
    in order, whatever the chunks and batches it came in. A timer wakes a source for its earliest waiting row and for the
    end of a silent session. A source's waiting rows are those of one watermark's span; its session is one small row.
    """

    def __init__(self, idle_us: int = IDLE_US, auto_start: bool = True):
        self.idle_us, self.auto_start = idle_us, auto_start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("active", "uuid string, started bigint, last bigint, flagged boolean")
        self.waiting = handle.getListState("waiting", "at_us bigint, seq bigint, kind string, uuid string, has_flag boolean, label string")

    def _wake(self, earliest: int | None, active: tuple | None) -> None:
        """One timer: when the watermark passes the earliest waiting row or the timeout of the session."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [earliest // 1000 + 1] if earliest is not None else []
        # One millisecond past the timeout, so that a row exactly at it still belongs to the session.
        due += [(active[2] + self.idle_us) // 1000 + 1] if active is not None else []
        if due:
            self.handle.registerTimer(min(due))

    def _active(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [
            (int(r.at_us), int(r.seq), r.kind, r.session_uuid, bool(r.has_flag), r.label)
            for batch in rows for r in batch.itertuples(index=False)
        ]
        self.waiting.appendList(new)
        earliest = min([r[0] for r in self.waiting.get()], default=None)
        self._wake(earliest, self._active())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # rows from here on may still come
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        controller, events = Controller(self.idle_us, self.auto_start, self._active()), []
        for at, _seq, kind, uuid, has_flag, label in ready:
            events += controller.feed(key[0], kind, uuid, at, has_flag, label)
        # With a row waiting, that row tells how the session ends; only a source that fell silent is closed by the clock.
        if not rest and controller.active is not None and controller.active[2] + self.idle_us < passed:
            events += controller.close(controller.active[2] + self.idle_us, "idle")
        if controller.active is None:
            self.state.clear()
        else:
            self.state.update(tuple(controller.active))
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self._wake(rest[0][0] if rest else None, controller.active)
        if events:
            yield pd.DataFrame(
                [(key[0], *e) for e in events], columns=["source_key", "event", "session_uuid", "label", "at_us", "reason"]
            ).astype({"at_us": "int64"})

    def close(self) -> None:
        pass


def session_events(
    envelopes: DataFrame, idle_us: int = IDLE_US, auto_start: bool = True, watermark: str = "10 minutes", source_key: str = "source",
) -> DataFrame:
    """Start, flag and end events of a live stream, keyed by source."""
    driven = controller_input(envelopes, source_key).withColumn("ts", F.timestamp_micros("at_us")).withWatermark("ts", watermark)
    return driven.groupBy("source_key").transformWithStateInPandas(
        SessionProcessor(idle_us, auto_start), outputStructType=T._parse_datatype_string(EVENT_SCHEMA), outputMode="append", timeMode="EventTime"
    )


def controller_rows(envelopes: DataFrame, idle_us: int = IDLE_US, auto_start: bool = True, source_key: str = "source") -> DataFrame:
    """Batch twin, row by row and without per-group Python: each driving row with the session it belongs to.

    A session opens at an explicit start, or at a command when nothing is active. Nothing is active before the
    first row of a source, after an explicit end, and after a gap above the timeout; so within the stretch since
    the last such point the first command opens, and an explicit start always does. Both are prefix scans.
    """
    rows = controller_input(envelopes, source_key)
    rows = ordered.with_slices(rows, ["source_key"], "at_us")
    order = ["at_us", "seq", "kind", SESSION]
    df = ordered.scan(rows, ["source_key"], order, {
        "_pos": ordered.position(), "_prev": ordered.previous(F.col("at_us").alias("at_us"), F.col("kind").alias("kind")),
    })
    explicit = F.col("kind") == "session_start"
    ends = F.col("kind") == "session_end"
    quiet = ~explicit & ~ends & F.coalesce(F.col("at_us") - F.col("_prev.at_us") > idle_us, F.lit(False))
    breaks = F.col("_prev").isNull() | (F.col("_prev.kind") == "session_end") | quiet | explicit
    df = df.withColumn("_quiet", quiet).withColumn("_explicit", explicit).withColumn("_breaks", breaks)
    df = ordered.scan(df, ["source_key"], order, {"_stretch": ordered.running_sum(F.col("_breaks").cast("int"))})
    can_open = F.col("_explicit") | ((F.col("kind") == "command") & F.lit(auto_start))
    opened = df.where(can_open).groupBy("source_key", "_stretch").agg(F.min(F.struct(
        "_pos", "at_us", F.col("_explicit").alias("explicit"), SESSION, "label")).alias("_open"))
    joined = df.join(opened, ["source_key", "_stretch"], "left")
    active = F.col("_open").isNotNull() & (F.col("_pos") >= F.col("_open._pos"))
    uuid = F.when(F.col("_open.explicit"), F.col(f"_open.{SESSION}")).otherwise(
        F.concat("source_key", F.lit("-"), F.col("_open.at_us").cast("string"))
    )
    return joined.withColumn("active_uuid", F.when(active, uuid))


def session_events_batch(envelopes: DataFrame, idle_us: int = IDLE_US, auto_start: bool = True, source_key: str = "source") -> DataFrame:
    """The events the stream would emit, computed over a finished set of envelopes."""
    rows = controller_rows(envelopes, idle_us, auto_start, source_key)
    live = rows.where("active_uuid is not null")
    speaks = F.col("kind").isin("command", "output", "stdin_masked")
    per = live.groupBy("source_key", "_stretch", "active_uuid").agg(
        F.min("at_us").alias("_start"), F.max(F.when(F.col("kind") != "session_end", F.col("at_us"))).alias("_last"),
        F.min(F.when(F.col("has_flag") & speaks, F.col("at_us"))).alias("_flag"),
        F.min(F.when(F.col("kind") == "session_end", F.col("at_us"))).alias("_end"),
        F.first("_open.label").alias("_label"),
    )
    # What closed the stretch is its own end marker, or whatever began the next stretch.
    heads = rows.where("_breaks").select(
        "source_key", (F.col("_stretch") - 1).cast("bigint").alias("_stretch"), F.col("_explicit").alias("_next_explicit"),
        F.col("_quiet").alias("_next_quiet"), F.col("at_us").alias("_next_at"),
    )
    df = per.withColumn("_stretch", F.col("_stretch").cast("bigint")).join(heads, ["source_key", "_stretch"], "left")
    ended = F.when(F.col("_end").isNotNull(), F.col("_end")).when(F.col("_next_explicit"), F.col("_next_at")).otherwise(F.col("_last") + idle_us)
    manual = F.col("_end").isNotNull() | F.coalesce("_next_explicit", F.lit(False))
    none = F.lit(None).cast("string")
    event = lambda name, at, label=none, reason=none: F.struct(
        F.lit(name).alias("event"), F.col("active_uuid").alias(SESSION), label.alias("label"), at.alias("at_us"), reason.alias("reason"))
    events = F.array(
        event("start", F.col("_start"), F.coalesce("_label", F.lit(""))),
        F.when(F.col("_flag").isNotNull(), event("flag", F.col("_flag"))),
        event("end", F.greatest(ended, F.col("_start")), reason=F.when(manual, "manual").otherwise("idle")),
    )
    return df.select("source_key", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("source_key", "e.*")


def stamp(envelopes: DataFrame, idle_us: int = IDLE_US, auto_start: bool = True, source_key: str = "source") -> DataFrame:
    """Envelopes to store, under the session that was active when they arrived; those with none are dropped.

    Rows arrive by time, then by sequence number; a row sees the session its own arrival opened, not a later one of the
    same microsecond. Web exchanges do not drive sessions; they take the session of the last driving row before them.
    """
    arrival = F.coalesce("seq", F.lit(-1)).cast("bigint").alias("_seq")
    rows = controller_rows(envelopes, idle_us, auto_start, source_key).where("kind <> 'session_end'").select(
        F.col("source_key").alias("_key"), F.col("at_us").alias("_at"), arrival, F.lit(0).alias("_side"), F.struct("active_uuid").alias("_session"))
    ends = controller_input(envelopes, source_key).where("kind = 'session_end'").select(
        F.col("source_key").alias("_key"), F.col("at_us").alias("_at"), arrival, F.lit(0).alias("_side"),
        F.struct(F.lit(None).cast("string").alias("active_uuid")).alias("_session"))
    every = envelopes.where(F.col("kind").isin(STORED)).select(
        "*", F.col(source_key).alias("_key"), F.greatest("ts_utc_us", F.lit(0)).alias("_at"), arrival, F.lit(1).alias("_side"))
    merged = every.unionByName(rows.unionByName(ends), allowMissingColumns=True)
    merged = ordered.with_slices(merged, ["_key"], "_at")
    found = ordered.scan(merged, ["_key"], ["_at", "_seq", "_side"], {"_now": ordered.last_seen(F.col("_session"))})
    return found.where((F.col("_side") == 1) & F.col("_now.active_uuid").isNotNull()).withColumn(SESSION, F.col("_now.active_uuid")).select(
        *envelopes.columns
    )


def idle_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """Sessions cut only by silence; a gap of exactly the timeout stays inside. A finished table is scanned in slices, so
    that a key with very many events is not one task."""
    if not events.isStreaming:
        span = F.expr(f"interval {gap}")
        rows = events.where(F.col(ts).isNotNull()).select(key, F.col(ts).alias("_ts"), F.unix_micros(ts).alias("_us"))
        rows = ordered.scan(ordered.with_slices(rows, [key], "_us"), [key], ["_us"], {"_prev": ordered.previous(F.col("_ts"))})
        opens = F.coalesce(F.col("_ts") > F.col("_prev._ts") + span, F.lit(True)).cast("int")
        # Of the rows of one instant the one that opens comes first, so that they share its session.
        rows = rows.withColumn("_opens", opens).withColumn("_later", 1 - opens)
        rows = ordered.scan(rows, [key], ["_us", "_later"], {"_session": ordered.running_sum(F.col("_opens"))})
        out = rows.groupBy(key, "_session").agg(F.min("_ts").alias("started_at"), (F.max("_ts") + span).alias("closes_at"), F.count(F.lit(1)).alias("events"))
        return out.drop("_session")
    df = events.withWatermark(ts, watermark) if watermark else events
    out = df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closes_at"), "events")


def redact_envelopes(envelopes: DataFrame) -> DataFrame:
    """Redacted payload plus ``redacted``: whether anything changed. Headers, url and bodies only on web kinds."""
    p = F.col("payload")
    web = F.col("kind").isin("http_request", "http_response")
    masked = {"text": t.redact_text(p["text"]), "cmd": t.redact_text(p["cmd"])}
    for name in ("req_headers", "resp_headers"):
        masked[name] = F.when(web, t.redact_headers(p[name])).otherwise(p[name])
    for name in ("url", "req_body", "resp_body"):
        masked[name] = F.when(web, t.redact_text(p[name])).otherwise(p[name])
    changed = F.lit(False)
    payload = p
    for name, value in masked.items():
        changed = changed | F.coalesce(value != p[name], F.lit(False))
        payload = payload.withField(name, value)
    return envelopes.withColumn("redacted", changed).withColumn("payload", payload)


def tally(envelopes: DataFrame, source_key: str = "source") -> DataFrame:
    """Running counts per source: commands, other stored rows, redactions. Usable on streams in update mode."""
    checked = redact_envelopes(envelopes)
    return checked.groupBy(F.col(source_key).alias("source_key")).agg(
        F.count(F.when(F.col("kind") == "command", 1)).alias("commands"),
        F.count(F.when(F.col("kind").isin(STORED) & (F.col("kind") != "command"), 1)).alias("outputs"),
        F.count(F.when(F.col("redacted"), 1)).alias("redactions"),
    )


def tally_events(events: DataFrame) -> DataFrame:
    return events.groupBy("source_key").agg(
        F.count(F.when(F.col("event") == "start", 1)).alias("sessions"), F.count(F.when(F.col("event") == "flag", 1)).alias("nudges")
    )


def join_live(envelopes: DataFrame, watermark: str = "10 minutes", wait: str = "1 hour") -> DataFrame:
    """Commands with their output on a stream. A command whose output does not come within ``wait`` is kept without it."""
    timed = envelopes.withColumn("ts", F.timestamp_micros("ts_utc_us"))
    c = timed.where("kind = 'command'").withWatermark("ts", watermark).select(
        F.col(SESSION), "seq", F.col("ts").alias("c_ts"), F.col("ts_utc_us").alias("c_us"), F.col("payload.cmd").alias("cmd"),
        F.col("payload.exit_code").alias("exit_code"), F.col("provenance.context_path").alias("context_path"))
    o = timed.where("kind in ('output', 'stdin_masked')").withWatermark("ts", watermark).select(
        F.col(SESSION).alias("o_session"), F.col("seq").alias("o_seq"), F.col("ts").alias("o_ts"), F.col("ts_utc_us").alias("o_us"),
        F.col("payload.text").alias("text"), F.col("payload.line_count").alias("line_count"))
    near = (F.col(SESSION) == F.col("o_session")) & (F.col("seq") == F.col("o_seq")) & (
        F.col("o_ts") >= F.col("c_ts") - F.expr(f"interval {wait}")) & (F.col("o_ts") <= F.col("c_ts") + F.expr(f"interval {wait}"))
    start = F.floor(F.col("c_us") / 1000)
    return c.join(o, near, "left_outer").select(
        SESSION, F.col("seq").alias("ord"), t.redact_text(F.col("cmd")).alias("cmd"), start.alias("started_at_ms"),
        F.greatest(start, F.coalesce(F.floor(F.col("o_us") / 1000), start)).alias("ended_at_ms"), F.col("exit_code").cast("int").alias("exit_code"),
        F.coalesce("line_count", F.lit(0)).alias("output_line_count"), t.redact_text(F.col("text")).alias("output_digest"), "context_path")


_COMMAND = "at_us bigint, cmd string, exit_code bigint, context_path string"
_OUTPUT = "at_us bigint, text string, line_count bigint"
REVISION = (f"{SESSION} string, ord bigint, command struct<at_us:bigint,cmd:string,exit_code:bigint,context_path:string>, "
            "output struct<at_us:bigint,text:string,line_count:bigint>")


class CommandProcessor(StatefulProcessor):
    """One command and its output as keyed state with two timers.

    A command is told as soon as its output is there. If none comes within ``wait`` it is told without; the key is held on for
    ``hold``, and whatever comes until then is told as a correction. A key that is given up tells what it has not told yet,
    and one that wakes again after that starts anew: its rows are corrections too, which ``commands_of`` puts together.
    """

    def __init__(self, wait_us: int, hold_us: int):
        self.wait_us, self.hold_us = wait_us, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.command = handle.getValueState("command", _COMMAND)
        self.output = handle.getValueState("output", _OUTPUT)
        self.told = handle.getValueState("told", "command_us bigint, output_us bigint")

    @staticmethod
    def _of(state) -> tuple | None:
        return tuple(state.get()) if state.exists() else None

    def _tell(self, key, command: tuple | None, output: tuple | None) -> Iterator[pd.DataFrame]:
        self.told.update((command[0] if command else -1, output[0] if output else -1))
        names = [[f.split()[0] for f in kind.split(", ")] for kind in (_COMMAND, _OUTPUT)]
        parts = [dict(zip(n, x)) if x else None for n, x in zip(names, (command, output))]
        yield pd.DataFrame({SESSION: [key[0]], "ord": [int(key[1])], "command": [parts[0]], "output": [parts[1]]})

    def _wake(self, command: tuple | None, output: tuple | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max(x[0] for x in (command, output) if x)
        due = [last + self.hold_us]
        if command and not output and not self.told.exists():
            due.append(command[0] + self.wait_us)
        self.handle.registerTimer(min(due) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        command, output = self._of(self.command), self._of(self.output)
        number = lambda x: None if pd.isna(x) else int(x)
        word = lambda x: None if x is None or isinstance(x, float) else x
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.kind == "command":
                    command = max(filter(None, (command, (int(r.at_us), word(r.cmd), number(r.exit_code), word(r.context_path)))), key=lambda x: x[0])
                else:
                    output = max(filter(None, (output, (int(r.at_us), word(r.text), number(r.line_count)))), key=lambda x: x[0])
        if command:
            self.command.update(command)
        if output:
            self.output.update(output)
        told = self._of(self.told)
        now = (command[0] if command else -1, output[0] if output else -1)
        if told != now and (told or command and output):
            yield from self._tell(key, command, output)
        self._wake(command, output)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        command, output = self._of(self.command), self._of(self.output)
        if not self.told.exists():
            yield from self._tell(key, command, output)
        if timerValues.getCurrentWatermarkInMs() * 1000 >= max(x[0] for x in (command, output) if x) + self.hold_us:
            for state in (self.command, self.output, self.told):
                state.clear()
        else:
            self._wake(command, output)

    def close(self) -> None:
        pass


def command_revisions(envelopes: DataFrame, watermark: str = "10 minutes", wait: str = "1 hour", hold: str = "24 hours") -> DataFrame:
    """A stream of (session, ord, command, output): commands as far as they are known, and corrections of them. Sinks append
    the rows; ``commands_of`` reads them."""
    us = lambda text: int(pd.Timedelta(text).total_seconds() * 1_000_000)
    own = envelopes.where("kind in ('command', 'output', 'stdin_masked')").select(
        SESSION, "seq", "kind", F.col("ts_utc_us").alias("at_us"), F.timestamp_micros("ts_utc_us").alias("ts"), "payload.cmd", "payload.exit_code",
        "provenance.context_path", "payload.text", "payload.line_count").withWatermark("ts", watermark)
    return own.groupBy(SESSION, "seq").transformWithStateInPandas(
        CommandProcessor(us(wait), us(hold)), outputStructType=T._parse_datatype_string(REVISION), outputMode="append", timeMode="EventTime")


def commands_of(revisions: DataFrame) -> DataFrame:
    """Raw commands out of revisions: the latest command and the latest output that any revision of a key knows. The same
    rows as the batch join of commands to their output, however late the output came."""
    last = revisions.groupBy(SESSION, "ord").agg(F.max_by("command", "command.at_us").alias("c"), F.max_by("output", "output.at_us").alias("o")).where("c is not null")
    started, ended = F.floor(F.col("c.at_us") / 1000).cast("bigint"), F.floor(F.col("o.at_us") / 1000).cast("bigint")
    return last.select(
        SESSION, "ord", t.redact_text(F.coalesce("c.cmd", F.lit(""))).alias("cmd"), started.alias("started_at_ms"),
        F.greatest(started, F.coalesce(ended, started)).alias("ended_at_ms"), F.col("c.exit_code").cast("int").alias("exit_code"),
        F.coalesce("o.line_count", F.lit(0)).cast("bigint").alias("output_line_count"), t.redact_text(F.col("o.text")).alias("output_digest"), F.col("c.context_path").alias("context_path"))


def bracket(envelopes: DataFrame, label: str = "") -> DataFrame:
    """Add start, end and first-flag markers around each recorded session."""
    flagged = F.col("kind").isin("output", "stdin_masked") & t.contains_flag(F.coalesce("payload.text", F.lit("")))
    spans = envelopes.groupBy(SESSION).agg(
        F.min("ts_utc_us").alias("_a"), F.max("ts_utc_us").alias("_z"), F.min(F.when(flagged, F.col("ts_utc_us"))).alias("_f"),
        F.min("source").alias("source"), F.max("provenance.platform").alias("_platform"))
    marks = F.array(
        F.struct(F.lit("session_start").alias("kind"), F.col("_a").alias("ts_utc_us"), F.lit(label).alias("text")),
        F.when(F.col("_f").isNotNull(), F.struct(F.lit("session_flag").alias("kind"), F.col("_f").alias("ts_utc_us"), F.lit("").alias("text"))),
        F.struct(F.lit("session_end").alias("kind"), F.col("_z").alias("ts_utc_us"), F.lit("manual").alias("text")),
    )
    rows = spans.select(SESSION, "source", "_platform", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    payload = envelopes.schema["payload"].dataType
    origin = envelopes.schema["provenance"].dataType
    made = rows.select(
        "source", SESSION, F.lit(0).cast("bigint").alias("seq"), "m.ts_utc_us", "m.kind",
        F.struct(*[(F.col("m.text") if f.name == "text" else F.lit(None)).cast(f.dataType).alias(f.name) for f in payload.fields]).alias("payload"),
        F.struct(*[(F.col("_platform") if f.name == "platform" else F.lit(None)).cast(f.dataType).alias(f.name) for f in origin.fields]).alias("provenance"),
    )
    return envelopes.unionByName(made, allowMissingColumns=True)
