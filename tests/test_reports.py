import json
import random

from helpers import episodes, findings
from pyspark.sql import functions as F

from runlens.operators import report
from runlens.sources import sinks


def test_covering_ranges(spark):
    """Each command once, with the range of findings it helps to reproduce; written out it is every pair."""
    rng = random.Random(6)
    steps = [dict(session_uuid=s, seq=i, cmd=f"run {i}", tactic=rng.choice(["TA0001", "TA0007", "TA0004"])) for s, n in (("big", 300), ("small", 12)) for i in range(1, n + 1)]
    reports = [(s, f"f{k}", rng.randint(1, n)) for s, n, m in (("big", 300, 80), ("small", 12, 3)) for k in range(m)] + [("small", "nowhere", 99)]
    eps, found = episodes(spark, steps), spark.createDataFrame(reports, "session_uuid string, finding_id string, first_seq bigint")
    tactic = {(e["session_uuid"], e["seq"]): e["tactic"] for e in steps}
    want = sorted((s, f, e["seq"], e["cmd"]) for s, f, until in reports for e in steps if e["session_uuid"] == s and e["seq"] <= until and tactic.get((s, until)) == e["tactic"])
    assert sorted(map(tuple, report.reproduction(found, eps).collect())) == want
    ranges = report.coverage(report.ranked(found, eps), eps)
    assert ranges.count() <= len(steps) and ranges.agg(F.sum(F.col("last_rank") - F.col("first_rank") + 1)).first()[0] == len(want) > 3 * len(steps)


def texts(folder):
    return "\n".join(p.read_text().rstrip("\n") for p in sorted(folder.glob("part-*")) if p.stat().st_size)


def test_written_report(spark, tmp_path):
    """Files in order of their names read as the lines do."""
    rows = [(s, section, at, sub, f"{s} {section} {at} {sub}\nmore") for s in ("a", "b") for section in (1, 7) for at in range(-1, 60) for sub in (0, 1)]
    lines = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "session_uuid string, section int, at bigint, sub bigint, line string")
    report.write_reports(lines, str(tmp_path / "out"))
    assert texts(tmp_path / "out") == "\n".join(r[-1] for r in sorted(rows))
    assert not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]


def test_documents(spark, tmp_path):
    """Documents over many slices and files, a session without rows, and rows that tie in their place."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sessions = spark.createDataFrame([("a", "x"), ("b", None), ("c", "é\"")], "session_uuid string, target string")
        steps = spark.createDataFrame([("a", i // 2, f"run, {i}") for i in range(400)] + [("c", 1, "[")], "session_uuid string, seq bigint, cmd string")
        finds = findings(spark, [dict(session_uuid="a", id=f"id{k}", source_seq=k) for k in range(3)]).select("session_uuid", "id", "source_seq")
        lines = sinks.report_documents({"commands": (steps, "seq"), "findings": (finds, "source_seq")}, sessions)
        sinks.write_documents(lines, str(tmp_path / "out"))
        assert sum(p.stat().st_size > 0 for p in (tmp_path / "out").glob("part-*")) > 1
        found, text, reader = {}, texts(tmp_path / "out"), json.JSONDecoder()
        while text:
            document, end = reader.raw_decode(text)
            found[document["session"]["session_uuid"]] = document
            text = text[end:].lstrip()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert list(found) == ["a", "b", "c"] and all(d["schema_version"] == "1.4" for d in found.values())
    assert sorted(x["cmd"] for x in found["a"]["commands"]) == sorted(f"run, {i}" for i in range(400)) and [x["seq"] for x in found["a"]["commands"]] == [i // 2 for i in range(400)]
    assert [x["id"] for x in found["a"]["findings"]] == ["id0", "id1", "id2"]
    assert found["b"] == {"schema_version": "1.4", "session": {"session_uuid": "b", "target": None}, "commands": [], "findings": []}
    assert found["c"]["commands"] == [{"seq": 1, "cmd": "["}] and found["c"]["session"]["target"] == 'é"'
