import contextlib
import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.sources import captures, envelopes

HAR = {"log": {"entries": [{"startedDateTime": "2024-01-01T00:00:01Z", "time": 5, "request": {"method": "GET", "url": "http://h/a"}, "response": {"status": 200, "content": {"text": "x"}}}]}}
EVENT = {"EventID": 1, "UtcTime": "2024-01-01 00:00:02", "CommandLine": "dir"}


def use(i, command, at):
    return {"timestamp": at, "message": {"content": [{"type": "tool_use", "name": "Bash", "id": i, "input": {"command": command}}]}}


def result(i, text, at, failed=False):
    return {"timestamp": at, "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": failed, "content": text}]}}


def stamp(n):
    return f"2024-01-01T{n // 3600:02}:{n // 60 % 60:02}:{n % 60:02}Z"


@contextlib.contextmanager
def small_blocks(spark, size):
    """Files are read in blocks of so many bytes."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in old:
        spark.conf.set(c, str(size))
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def walked(lines):
    """Calls and results one after the other, as one reader would pair them."""
    waiting, out = {}, []
    for n, line in enumerate(lines):
        try:
            parts = json.loads(line)["message"]["content"]
        except ValueError:
            continue
        for p in parts:
            if p["type"] == "tool_use":
                waiting[p["id"]] = (n, p["input"]["command"])
            elif p["tool_use_id"] in waiting:
                at, command = waiting.pop(p["tool_use_id"])
                out.append((at, command, p["content"], int(p["is_error"])))
    return sorted(out)


def random_lines(rng, n):
    out = []
    for k in range(n):
        i = f"id{rng.randrange(6)}"
        kind = rng.random()
        out.append("{cut" if kind < 0.1 else json.dumps(use(i, f"run {k}", stamp(k)) if kind < 0.5 else result(i, f"out {k}", stamp(k), kind > 0.9)))
    return out


def test_transcript_of_many_blocks(spark, tmp_path):
    rng = random.Random(4)
    files = {f"t{k}.jsonl": random_lines(rng, n) for k, n in enumerate((300, 40, 1, 0))}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines))
    with small_blocks(spark, 2048):
        lines = captures.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        found = lines.withColumn("name", F.element_at(F.split("file", "/"), -1)).collect()
        for name, want in files.items():
            assert [r.line for r in sorted((r for r in found if r.name == name), key=lambda r: r.ord)] == want
        rows = captures.parse_transcript_lines(captures.read_lines(spark, str(tmp_path))).collect()
    for name, want in files.items():
        own = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.ord)
        assert [(r.cmd, r.output_digest, r.exit_code) for r in own] == [x[1:] for x in walked(want)]


def test_one_id_in_many_slices(spark):
    """All calls share an id: the scan runs over slices of some 40 rows."""
    rng = random.Random(5)
    lines = [json.dumps(use("same", f"run {k}", stamp(k)) if rng.random() < 0.5 else result("same", f"out {k}", stamp(k))) for k in range(600)]
    frame = spark.createDataFrame([("/c/x.jsonl", k, line) for k, line in enumerate(lines)], "file string, ord long, line string")
    rows = captures.parse_transcript_lines(frame).orderBy("ord").collect()
    assert [(r.cmd, r.output_digest, r.exit_code) for r in rows] == [x[1:] for x in walked(lines)]


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_routing_of_a_folder(spark, tmp_path, block):
    bodies = {
        "a.har": json.dumps(HAR), "pretty.har": json.dumps(HAR, indent=2), "one.json": json.dumps(EVENT), "pretty.json": json.dumps([EVENT, EVENT], indent=1),
        "listed.json": "[\n" + json.dumps(EVENT) + ",\n" + json.dumps(EVENT) + "\n]", "lines.ndjson": "\n".join([json.dumps(EVENT)] * 3),
        "broken.ndjson": "{cut\n" + json.dumps(EVENT) + "\n\n" + json.dumps(EVENT), "talk.jsonl": json.dumps(use("a", "ls", stamp(1))) + "\n" + json.dumps(result("a", "one", stamp(2))) + "\n",
        "both.jsonl": "\n".join(json.dumps(x) for x in (use("a", "ls", stamp(1)), EVENT, result("a", "one", stamp(2)))), "note.txt": "nothing\nhere", "empty.txt": "", "open.jsonl": json.dumps(use("a", "ls", stamp(1))),
        "other.json": json.dumps({"EventID": 3}),
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    want = {"a.har": ("http-proxy", 1), "pretty.har": ("http-proxy", 1), "one.json": ("sysmon", 1), "pretty.json": ("sysmon", 2), "listed.json": ("sysmon", 2), "lines.ndjson": ("sysmon", 3),
            "broken.ndjson": ("sysmon", 2), "talk.jsonl": ("claude-code", 1), "both.jsonl": ("sysmon", 1)}
    with small_blocks(spark, block):
        chosen, rejected = captures.read_captures(spark, str(tmp_path))
        found = {r.file.rsplit("/", 1)[1]: (r.capture_kind, r.n) for r in chosen.groupBy("file", "capture_kind").agg(F.count("*").alias("n")).collect()}
        assert found == want
        left = {r.file.rsplit("/", 1)[1] for r in rejected.collect()}
    assert left == set(bodies) - set(want) - {"empty.txt"}  # a file without a line is not seen
    whole, _ = captures.route_captures(spark.createDataFrame([(f"/{k}", v) for k, v in bodies.items()], "file string, body string"))
    assert {r.file[1:]: (r.capture_kind, r.n) for r in whole.groupBy("file", "capture_kind").agg(F.count("*").alias("n")).collect()} == want


def test_registered_format(spark, tmp_path):
    """A format of one's own is tried after the built-in ones and sees only what they leave."""
    (tmp_path / "a.hist").write_text("10 whoami\n20 id\n")
    (tmp_path / "b.json").write_text(json.dumps(EVENT))

    def history(capture):
        parts = F.regexp_extract("line", r"^(\d+) (.+)$", 1), F.regexp_extract("line", r"^(\d+) (.+)$", 2)
        rows = capture.lines.where(parts[1] != "")
        at = parts[0].cast("bigint") * 1000
        return captures._web(rows, ord=F.col("ord"), cmd=parts[1], started_at_ms=at, ended_at_ms=at, context_path=F.lit("host"))

    captures.register_adapter("history", history, "host", "Shell history")
    try:
        chosen, rejected = captures.read_captures(spark, str(tmp_path))
        assert sorted((r.capture_kind, r.cmd) for r in chosen.collect()) == [("history", "id"), ("history", "whoami"), ("sysmon", "dir")] and rejected.count() == 0
        scopes = {r.shell: (r.target_scope, r.source) for r in captures.derive_sessions(chosen).collect()}
        assert scopes == {"history": ("Shell history", "plugin"), "sysmon": ("Sysmon capture", "plugin")}
    finally:
        captures.forget_adapter("history")


def test_document_too_long(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps([EVENT] * 20, indent=1))
    monkeypatch.setattr(captures, "MOST_DOCUMENT", 100)
    with pytest.raises(Exception, match="too long for a value"):
        captures.read_captures(spark, str(tmp_path))


def test_handshake_in_force(spark, tmp_path):
    """Lines take the last handshake before them, in files of many blocks; their own provenance goes first."""
    hello = lambda name, sure: json.dumps({"x_handshake": "1", "plugin": name, "class": "shell", "context_template": f"at-{name}", "capabilities": {"has_exit_codes": True, "has_stdin": False, "boundary_confidence": sure, "redaction": "none"}})
    line = lambda n, **more: json.dumps({"source": "a", "session_uuid": "s", "seq": n, "ts_utc_us": n, "kind": "command", "payload": {"cmd": f"c{n}"}, **more})
    (tmp_path / "a.ndjson").write_text("\n".join([line(0), hello("one", "exact"), *[line(n) for n in range(1, 40)], "{cut", hello("two", "heuristic"), *[line(n) for n in range(40, 60)], line(60, provenance={"context_path": "own"})]))
    (tmp_path / "b.ndjson").write_text("\n".join([line(100), line(101)]))
    with small_blocks(spark, 512):
        rows = {r.seq: (r.provenance.platform, r.provenance.context_path, r.provenance.boundary_confidence) if r.provenance else None for r in envelopes.read_capture(spark, str(tmp_path)).collect()}
    assert len(rows) == 63 and rows[0] == rows[100] == (None, None, None)
    assert all(rows[n] == ("one", "at-one", 1.0) for n in range(1, 40)) and all(rows[n] == ("two", "at-two", 0.7) for n in range(40, 60))
    assert rows[60] == ("two", "own", 0.7)
