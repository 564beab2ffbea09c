"""Costly row expressions are computed once, whatever is filtered on what they give."""

from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.operators import align
from runlens.sources import captures, envelopes, taps


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_parsed_once(spark):
    lines = spark.range(1).select(F.concat(F.lit('{"source":"a","session_uuid":"s","kind":"command","ts_utc_us":'), F.col("id").cast("string"), F.lit("}")).alias("value"))
    df = envelopes.parse_lines(lines).where("kind = 'command' and seq = 0")
    assert plan(df).count("from_json(") == 1
    assert df.select("source", "ts_utc_us").collect() == [("a", 0)]
    broken = spark.createDataFrame([("{cut",), (None,), ("{}",)], "value string")
    assert envelopes.parse_lines(broken).count() == 0


def test_spaces_are_the_same_class(spark):
    chars = spark.range(1, 0xD800).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    listed = f"[{t.SPACES}]"
    assert chars.where(F.col("c").rlike(t.WS) != F.col("c").rlike(listed)).count() == 0
    assert chars.where(F.col("c").rlike(t.WS)).count() >= 20
    edge = chars.select(F.concat("c", F.lit("a b"), "c").alias("x")).unionByName(spark.createDataFrame([("",), (None,)], "x string"))
    assert edge.where(~t.trim("x").eqNullSafe(t.trim_ends(F.col("x")))).count() == 0


def test_a_keystroke_line_is_replayed_once(spark):
    logs = spark.createDataFrame([("s", " plain  \nab\x7fc\n　\n\tx\n\x1b[31mred")], "session_uuid string, input_log string")
    df = taps.parse_keystrokes(logs)
    marks = plan(df.where("length(cmd) > 0")).count("@-Z")  # the pattern of escapes, once a replay
    assert marks <= plan(logs.select(taps.replay_line(F.col("input_log")))).count("@-Z")
    assert [r["cmd"] for r in df.orderBy("line_no").collect()] == ["plain", "ac", "x", "red"]


def test_a_record_is_parsed_once(spark):
    docs = spark.createDataFrame([("/c/a.json", 0, '{"EventID":1,"UtcTime":"2024-01-01 00:00:00","CommandLine":"x"}'), ("/c/b.json", 0, "{cut")], "file string, ord bigint, doc string")
    df = captures.parse_event_records(docs)
    assert plan(df).count("from_json(") == 2  # nested, and flat where it is not nested
    assert [r["cmd"] for r in df.collect()] == ["x"]


def test_methods_are_matched_once(spark):
    steps = spark.createDataFrame([("s", 1, "nmap -sV x", "nmap", "TA0007", "T1", "human_active")], "session_uuid string, seq bigint, cmd string, binary string, tactic string, technique string, actor string")
    own = spark.createDataFrame([("s", 0, "scan", "TA0007", ["nmap -sV"], ["T9"])], "session_uuid string, ordinal int, objective string, tactic string, satisfied_by array<string>, techniques array<string>")
    df = align.candidates(steps, own)
    assert plan(df).count("array_except") == 1
    assert [tuple(r) for r in df.collect()] == [("s", 0, "scan", 1, 0)]
