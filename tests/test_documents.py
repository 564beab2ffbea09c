"""Which files are one JSON document: told from their lines, without putting together a file that is none."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.sources import captures

EVENT = {"EventID": 1, "UtcTime": "2024-01-01 00:00:02", "CommandLine": "dir"}


def frame(spark, bodies):
    return captures.lines_of(spark.createDataFrame(list(bodies.items()), "file string, body string"))


# A record cut within a word, a string, and at places where a document could go on.
CUT = ["{cut", '{"CommandLine":"di', '{"EventID":1,', '{"Event":{"System":', "[", '[{"EventID":1},', '{"a":[1, 2', ' {"a\\"[": "}"']


@pytest.mark.parametrize("n", [3, 150])
def test_lines_after_a_cut_record_are_not_put_together(spark, monkeypatch, n):
    """A file put together here would be too long for a value; 150 lines are several slices of 40 rows."""
    monkeypatch.setattr(captures, "MOST_DOCUMENT", 150)
    monkeypatch.setattr(captures, "LARGE_DOCUMENT", 100)
    lines = [json.dumps({**EVENT, "CommandLine": f"run {k}"}) for k in range(n)]
    bodies = {f"/c/{k}.ndjson": "\n".join([cut, *lines]) for k, cut in enumerate(CUT)}
    bodies |= {"/c/open.json": json.dumps([EVENT] * n, indent=1)[:-2], "/c/blank.ndjson": "\n".join(["{cut", "", *lines, " ", "{cut"])}
    got = captures.from_lines(frame(spark, bodies))
    assert got.documents.count() == 0
    commands = captures.parse_event_records(got.records)
    found = {r.file: r.n for r in commands.groupBy("file").agg(F.countDistinct("cmd").alias("n")).collect()}
    assert found == {k: n for k in bodies if k != "/c/open.json"}


def test_a_large_document_stays_one(spark, monkeypatch):
    monkeypatch.setattr(captures, "LARGE_DOCUMENT", 100)
    events = [{**EVENT, "CommandLine": f'say "{{[{k}\\' + "é\t"} for k in range(70)]
    bodies = {"/c/a.json": json.dumps(events, indent=1), "/c/b.json": "\n[\n" + "\n,\n".join(json.dumps(e, ensure_ascii=False) for e in events) + "\n] \n", "/c/c.json": "[\n" + ",\n".join(map(json.dumps, events)) + "\n];\nrest {"}
    got = captures.from_lines(frame(spark, bodies))
    assert {r.file: r.body for r in got.documents.collect()} == bodies
    assert {r.file: r.n for r in captures.parse_event_records(got.records).groupBy("file").agg(F.countDistinct("cmd").alias("n")).collect()} == dict.fromkeys(bodies, 70)


def test_sessions_of_files_with_a_cut_record(spark, monkeypatch):
    """Each is larger than a value may be; files of other formats lie beside them."""
    monkeypatch.setattr(captures, "MOST_DOCUMENT", 500)
    monkeypatch.setattr(captures, "LARGE_DOCUMENT", 100)
    part = lambda k, kind, **more: json.dumps({"timestamp": f"2024-01-01T00:00:{k:02}Z", "message": {"content": [{"type": kind, **more}]}})
    talk = [x for k in range(9) for x in (part(k, "tool_use", name="Bash", id=f"i{k}", input={"command": f"run {k}"}), part(k + 20, "tool_result", tool_use_id=f"i{k}", content="x"))]
    har = {"log": {"entries": [{"startedDateTime": "2024-01-01T00:00:01Z", "time": 5, "request": {"url": "http://h/a"}}]}}
    events = [json.dumps({**EVENT, "UtcTime": f"2024-01-01 00:00:{k:02}"}) for k in range(9)]
    bodies = {"/c/e.ndjson": "\n".join(['{"EventID":1,', *events]), "/c/t.jsonl": "\n".join(["{cut", *talk]), "/c/a.har": json.dumps(har, indent=1), "/c/x.ndjson": '["\n' * 200}
    chosen, rejected = captures.route(captures.from_lines(frame(spark, bodies)))
    got = {r.session_uuid: (r.shell, r.start, r.end) for r in captures.derive_sessions(chosen).select("session_uuid", "shell", F.second("started_at").alias("start"), F.second("ended_at").alias("end")).collect()}
    assert got == {"e": ("sysmon", 0, 8), "t": ("claude-code", 0, 28), "a": ("http-proxy", 1, 1)} and [r.file for r in rejected.collect()] == ["/c/x.ndjson"]


def test_names_written_as_code_points(spark):
    """Formats are found by names that JSON may write with escapes, or in single quotes."""
    escaped = lambda value, name: json.dumps(value).replace(f'"{name}"', f'"\\u{ord(name[0]):04x}{name[1:]}"')
    nested = {"Event": {"System": {"EventID": "1"}, "EventData": {"Data": [{"@Name": "UtcTime", "#text": "2024-01-01 00:00:01"}, {"@Name": "Image", "#text": "n.exe"}]}}}
    docs = [escaped(EVENT, "EventID"), escaped(nested, "Event"), escaped(nested, "EventID"), json.dumps(EVENT).replace('"', "'"), json.dumps(nested).replace('"', "'"), json.dumps({**EVENT, "EventID": 2, "Id": 1}), json.dumps({"event_id": "1", **{k: v for k, v in EVENT.items() if k != "EventID"}}), "{cut", "{}"]
    rows = spark.createDataFrame([("/c/a", k, d) for k, d in enumerate(docs)], "file string, ord bigint, doc string")
    assert [(r.ord, r.cmd) for r in captures.parse_event_records(rows).orderBy("ord").collect()] == [(0, "dir"), (1, "n.exe"), (2, "n.exe"), (3, "dir"), (4, "n.exe"), (6, "dir")]
    use = {"timestamp": "2024-01-01T00:00:01Z", "message": {"content": [{"type": "tool_use", "name": "Bash", "id": "a", "input": {"command": "ls"}}]}}
    result = {"timestamp": "2024-01-01T00:00:02Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "a", "content": "one"}]}}
    lines = spark.createDataFrame([("/c/t", 0, escaped(use, "content")), ("/c/t", 1, escaped(result, "content"))], "file string, ord bigint, line string")
    assert [(r.cmd, r.output_digest) for r in captures.parse_transcript_lines(lines).collect()] == [("ls", "one")]
    har = {"log": {"entries": [{"startedDateTime": "2024-01-01T00:00:01Z", "request": {"url": "http://h/a"}}]}}
    files = spark.createDataFrame([("/c/a.har", escaped(har, "entries")), ("/c/b.har", json.dumps({"log": {}}))], "file string, body string")
    assert [r.cmd for r in captures.parse_har(files).collect()] == ["GET /a"]


def any_text(rng):
    def value(d):
        k = rng.random()
        if d and k < 0.6:
            items = [value(d - 1) for _ in range(rng.randrange(4))]
            return items if k < 0.3 else {rng.choice(["a", 'b"c', "[x", "}{", ", :", "\\"]) + str(i): v for i, v in enumerate(items)}
        return rng.choice([1, -2.5e-7, True, False, None, "", "x", "tr ue [", '\\"', "a\nb", "é z", 1e300])

    out = json.dumps([value(3), value(2)] if rng.random() < 0.5 else {"k": value(3), "l": value(2)}, indent=rng.choice([None, 0, 1]), ensure_ascii=rng.random() < 0.5, separators=rng.choice([None, (",", ":"), (" ,", " : ")]))
    kind, at = rng.random(), rng.randrange(len(out) + 1)
    if kind < 0.25:
        return out[:at] + rng.choice(["", "\n", "x", "}", "]", "{", ",", '"', ":", "0", " ", "\t", "[1]\n{"]) + out[at + rng.randrange(3):]
    if kind < 0.4:
        return out + rng.choice(["\n", "\n\n", " x", "]", "\n{}", "\n;", ";\n{cut", " ", "\n]]"])
    if kind < 0.55:
        return rng.choice([*CUT, '"', "\n\n[", " \t\n{"]) + "\n" + out + "\n" + json.dumps(value(2))
    return out if kind < 0.8 else out[:at]


@pytest.mark.parametrize("large", [-1, 1 << 20])
def test_the_same_files_are_documents(spark, monkeypatch, large):
    """Against putting every file together: a first line complete by itself, with more after it, or a text that parses."""
    monkeypatch.setattr(captures, "LARGE_DOCUMENT", large)
    rng = random.Random(7)
    bodies = {f"/c/{k}": any_text(rng) for k in range(600)}
    parsed = spark.createDataFrame(list(bodies.items()), "file string, body string")
    filled = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    first, body = F.get(filled, F.lit(0)), t.trim(F.col("body"))
    whole = parsed.where(t.trim(first).rlike(r"^[\[{]") & ((F.size(filled) == 1) | F.try_parse_json(first).isNull()) & F.try_parse_json(body).isNotNull())
    want = {r.file: r.body for r in whole.collect()}
    got = {r.file: r.body for r in captures.from_lines(captures.lines_of(parsed)).documents.collect()}
    assert got == want and 200 < len(want) < 500
