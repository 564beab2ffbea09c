import json

from pyspark.sql import functions as F

from helpers import episodes
from runlens.operators import golden
from runlens.plans import debrief
from runlens.sources import captures, contracts, envelopes, store, taps
from runlens.streaming import sessions


def _line(kind, seq, ts, session="s", **payload):
    return json.dumps(dict(source="local_pty", session_uuid=session, seq=seq, ts_utc_us=ts, kind=kind, payload=payload, provenance={"context_path": "host"}))


LINES = [
    json.dumps({"x_handshake": "1", "plugin": "p", "class": "shell", "capabilities": {"has_exit_codes": True, "has_stdin": False, "boundary_confidence": "exact", "redaction": "none"}}),
    _line("command", 1, 1_000_500, cmd="nmap 10.0.0.1"), _line("output", 1, 3_000_000, text="22/tcp open ssh", line_count=1), "{broken", "",
    _line("command", 2, 4_000_000, cmd="old"), _line("command", 2, 4_500_000, cmd="new"), _line("output", 9, 5_000_000, text="orphan"),
    _line("http_request", 0, 6_000_000, method="POST", url="http://h/login?x=1", pair_id="p1"), _line("http_response", 0, 6_200_000, status=302, pair_id="p1"),
    _line("http_request", 0, 7_000_000, url="notaurl", pair_id="p2"),
]


def test_ndjson_to_raw(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join(LINES))
    env = envelopes.read_envelopes(spark, str(tmp_path))
    assert env.count() == 8
    assert envelopes.read_handshakes(spark, str(tmp_path)).select("plugin").first().plugin == "p"
    rows = envelopes.raw_commands(env).orderBy("started_at_ms", "ord").collect()
    assert [(r.cmd, r.started_at_ms, r.ended_at_ms) for r in rows] == [
        ("nmap x.x.x.x", 1000, 3000), ("new", 4500, 4500), ("POST /login?x=1", 6000, 6200), ("GET notaurl", 7000, 7000)]
    first = envelopes.join_command_output(env, on_duplicate="first").where("ord = 2").first()
    assert first.cmd == "old" and rows[2].web.status == 302 and rows[2].context_path == "host"


def test_store_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text("\n".join(LINES))
    store.write_store(envelopes.read_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "store"))
    back = store.export_envelopes(store.read_store(spark, str(tmp_path / "store"))).collect()
    assert [(r.kind, r.seq, r.ts_utc_us) for r in back] == [
        ("command", 1, 1_000_500), ("output", 1, 3_000_000), ("command", 2, 4_000_000), ("http_request", 0, 6_000_000),
        ("http_response", 0, 6_200_000), ("http_request", 0, 7_000_000), ("http_response", 0, 7_000_000)]
    assert contracts.validate(envelopes.parse_lines(spark.createDataFrame([(LINES[1],)], "value string")), contracts.ENVELOPE_CONTRACT, ["seq"]).count() == 0


def test_process_event_shapes(spark):
    nested = {"Event": {"System": {"EventID": "1"}, "EventData": {"Data": [{"@Name": "UtcTime", "#text": "2024-01-01 00:00:01.5"}, {"@Name": "CommandLine", "#text": "cmd /c dir"}, {"@Name": "User", "#text": "bob"}]}}}
    flat = {"EventID": 1, "UtcTime": "2024-01-01T00:00:02Z", "Image": "x.exe", "ParentImage": "p.exe"}
    files = spark.createDataFrame([("/c/a.json", json.dumps([nested, flat, {"EventID": 3}])), ("/c/b.ndjson", json.dumps(flat) + "\nbad\n" + json.dumps(nested))], "file string, body string")
    got = sorted((r.file, r.cmd, r.started_at_ms, r.output_digest) for r in captures.parse_process_events(files).collect())
    assert got == [("/c/a.json", "cmd /c dir", 1704067201500, "user bob"), ("/c/a.json", "x.exe", 1704067202000, "parent p.exe"),
                   ("/c/b.ndjson", "cmd /c dir", 1704067201500, "user bob"), ("/c/b.ndjson", "x.exe", 1704067202000, "parent p.exe")]


def test_transcript_pairs_first_result(spark):
    use = lambda i, c, at: json.dumps({"timestamp": at, "message": {"content": [{"type": "tool_use", "name": "Bash", "id": i, "input": {"command": c}}]}})
    res = lambda i, c, at, err=False: json.dumps({"timestamp": at, "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": err, "content": c}]}})
    body = "\n".join([use("a", "ls", "2024-01-01T00:00:00Z"), res("a", [{"type": "text", "text": "one\n"}, {"text": "“two”"}], "2024-01-01T00:00:01Z"), res("a", "again", "2024-01-01T00:00:02Z"),
                      "junk", use("b", "cat x", "2024-01-01T00:00:03Z"), res("c", "?", "2024-01-01T00:00:04Z"), use("d", "false", "2024-01-01T00:00:05Z"), res("d", "no", "2024-01-01T00:00:06Z", True)])
    rows = captures.parse_agent_transcript(spark.createDataFrame([("/c/t.jsonl", body)], "file string, body string")).orderBy("ord").collect()
    assert [(r.cmd, r.exit_code, r.output_line_count, r.output_digest) for r in rows] == [("ls", 0, 2, 'one\n"two"'), ("false", 1, 1, "no")]


def test_keystrokes_and_screen(spark):
    keys = "lx\x7fs -la\r\nsecret\x03\r\x1b[A\x7f\x7fwho\tami\nab\x7f\x7f\x7fcd\n"
    df = spark.createDataFrame([("s", keys)], "session_uuid string, input_log string")
    assert [r.cmd for r in taps.parse_keystrokes(df).orderBy("line_no").collect()] == ["ls -la", "who ami", "cd"]
    out = "$ \x1b[?1049l\x1b[?1049h....\x1b[?1049l$ "
    timing = "O 0.1 2\nI 0.1 3\nO 0.1 8\nO 0.1 8\nI 0.1 4\nO 0.1 12\nI 0.1 3\n"
    tap = spark.createDataFrame([("s", "ls\n:wq\nid\n", out, timing), ("n", "x\n", None, None)], "session_uuid string, input_log string, output_log string, timing_log string")
    got = {r.session_uuid: r.input_log for r in taps.strip_alt_screen(tap).collect()}
    assert got == {"s": "ls\nid\n", "n": "x\n"}
    commands = spark.createDataFrame([("s", "ls -la"), ("s", "hunter2"), ("s", "id"), ("n", "zzz")], "session_uuid string, cmd string")
    echo = spark.createDataFrame([("s", "$ l\x1b[0ms -la")], "session_uuid string, output_log string")
    assert {r.cmd for r in taps.scrub_unechoed(commands, echo).collect()} == {"ls -la", "id", "zzz"}
    # Several lines, repeated commands, a command over two lines, a log without text, further columns.
    rows = [("s", " cat  x ", 1), ("s", "cat  x", 2), ("s", "cat  x", 2), ("s", "catx", 3), ("s", "one\ntwo", 4), ("s", "one\nsix", 5),
            ("e", "secret", 6), ("t", "cat  x", 7), ("t", "a longer command line, with words", 8)]
    commands = spark.createDataFrame(rows, "session_uuid string, cmd string, line_no int")
    echo = spark.createDataFrame([("s", "$ cat  x\r\none\ntwo\r$ "), ("e", ""), ("t", "> a longer command line, with words\r\n")], "session_uuid string, output_log string")
    kept = sorted(tuple(r) for r in taps.scrub_unechoed(commands, echo).collect())
    logs = {r.session_uuid: r.output_log for r in echo.collect()}
    assert kept == sorted(r for r in rows if not logs[r[0]] or r[1].strip() in logs[r[0]]) and len(kept) == 6
    assert taps.scrub_unechoed(commands.limit(0), echo).count() == 0 and taps.scrub_unechoed(commands, echo.limit(0)).count() == len(rows)


def test_tap_files(spark, tmp_path):
    for name, body in (("k-1.in", "whoami\n"), ("k-1.meta", '{"target": "box", "startedAtMs": 5}'), ("k-2.in", "id\n"), ("k-2.meta", "{bad"), ("k-3.in", "  ")):
        (tmp_path / name).write_text(body)
    rows = taps.tap_to_raw(taps.read_taps(spark, str(tmp_path))).orderBy("session_uuid").collect()
    assert [(r.session_uuid, r.cmd, r.started_at_ms, r.context_path) for r in rows] == [("k-1", "whoami", 5, "host->ssh:box"), ("k-2", "id", 0, "host->ssh:target")]


def test_debrief_end_to_end(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join(LINES))
    raw = envelopes.raw_commands(envelopes.read_envelopes(spark, str(tmp_path)))
    out = debrief.debrief(raw, raw.select("session_uuid").distinct().withColumn("golden_id", F.lit("host")), golden.ladders(spark))
    assert contracts.validate(out.episodes, contracts.EPISODE_CONTRACT, ["seq"]).count() == 0
    status = {r.objective: r.status for r in out.status.collect()}
    assert status["enumerate_services"] == "reached" and status["escalate_to_root"] == "untouched"
    assert out.metrics.first().objective_coverage_pct == 14.0 and out.grades.first().version == 2
    assert out.ghost.count() >= 7 and out.coaching.count() >= 6


def test_finalize_is_idempotent(spark):
    eps = episodes(spark, [dict(cmd="nmap"), dict(cmd="curl", exit_code=1), dict(cmd="id")])
    once = debrief.finalize_live(eps.drop("ukc", "cwe"))
    twice = debrief.finalize_live(once["episodes"])
    keys = ["seq", "alignment", "loop_of_seq", "ukc"]
    assert sorted(map(str, once["episodes"].select(keys).collect())) == sorted(map(str, twice["episodes"].select(keys).collect()))
    assert twice["recap"].first().action.startswith("Recording: 3 commands")


def test_controller_batch_equals_walk(spark):
    import random

    rng = random.Random(8)
    kinds = ["command", "output", "session_start", "session_end", "stdin_masked"]
    rows, want = [], []
    for s in range(30):
        walker, t = sessions.Controller(100, True), 0
        for i in range(rng.randint(1, 60)):
            t += rng.choice([1, 5, 50, 100, 101, 300])
            kind, flag = rng.choice(kinds), rng.random() < 0.2
            rows.append((f"k{s}", f"u{s}-{i}", i, t, kind, ("x" if not flag else "0" * 32)))
            want += [(f"k{s}", *e) for e in walker.feed(f"k{s}", kind, f"u{s}-{i}", t, flag, "0" * 32 if flag else "x")]
        if walker.active:
            want += [(f"k{s}", *e) for e in walker.close(walker.active[2] + 100, "idle")]
    df = spark.createDataFrame(rows, "source string, session_uuid string, seq int, ts_utc_us bigint, kind string, body string")
    df = df.select("source", "session_uuid", "seq", "ts_utc_us", "kind", F.struct(F.col("body").alias("cmd"), F.col("body").alias("text")).alias("payload"))
    got = sessions.session_events_batch(df, 100, True).select("source_key", "event", "session_uuid", "label", "at_us", "reason").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
