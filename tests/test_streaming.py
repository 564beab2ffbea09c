"""Streams must give what their batch twins give."""

import random

from pyspark.sql import functions as F

from runlens.schemas import ENVELOPE
from runlens.sources import envelopes
from runlens.streaming import live, sessions


def _envelopes(spark, rows):
    df = spark.createDataFrame(rows, "source string, session_uuid string, seq bigint, ts_utc_us bigint, kind string, body string, pair_id string")
    fields = dict(cmd="body", text="body", pair_id="pair_id", url="body")
    payload = "named_struct(" + ", ".join(
        f"'{n}', cast({fields.get(n, 'null')} as {kind})" for n, kind in
        (x.split(":") for x in ENVELOPE.split("payload struct<")[1].split(">")[0].split(","))) + ")"
    return df.select("source", "session_uuid", "seq", "ts_utc_us", "kind", F.expr(payload).alias("payload"),
                     F.expr("named_struct('boundary_confidence', cast(null as double), 'redaction_method', cast(null as string), 'context_path', 'host', 'platform', 'p')").alias("provenance"))


def _replay(spark, df, tmp_path, name, order="ts_utc_us", files=4):
    """Write the rows as files in time order and read them back as a stream."""
    folder = str(tmp_path / name)
    rows = df.orderBy(order).collect()
    step = max(1, -(-len(rows) // files))
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(query_df, name, tmp_path, mode="append"):
    q = (query_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return query_df.sparkSession.table(name)


def test_controller_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = []
    for s in range(4):
        t = 1_000_000_000
        for i in range(60):
            t += rng.choice([10, 100, 500, 1200]) * 1_000_000
            rows.append((f"k{s}", f"u{s}-{i}", i, t, rng.choice(["command", "output", "command", "session_start", "session_end"]), rng.choice(["x", "0" * 32]), None))
    # a late row far in the future lets the watermark pass every timer
    rows.append(("tail", "z", 0, 10**13, "command", "x", None))
    df = _envelopes(spark, rows)
    stream = _replay(spark, df, tmp_path, "ctl")
    got = _drain(sessions.session_events(stream, 600_000_000, True, "1 second"), "ctl_out", tmp_path).where("source_key <> 'tail'")
    want = sessions.session_events_batch(df, 600_000_000, True).where("source_key <> 'tail'")
    cols = ["source_key", "event", "session_uuid", "at_us", "reason"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_controller_takes_shuffled_arrival(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(6)
    rows = []
    for s in range(3):
        t = 1_000_000_000
        for i in range(50):
            t += rng.choice([0, 10, 100, 500, 1200]) * 1_000_000  # equal times are told apart by seq
            rows.append((f"k{s}", f"u{s}-{i}", i, t, rng.choice(["command", "output", "session_start", "session_end"]), rng.choice(["x", "0" * 32]), None))
    rng.shuffle(rows)
    df = _envelopes(spark, rows).withColumn("n", F.monotonically_increasing_id())
    tail = _envelopes(spark, [("tail", "z", 0, 10**13, "command", "x", None), ("tail", "z", 1, 2 * 10**13, "command", "x", None)]).withColumn("n", F.lit(1 << 60) + F.col("seq"))
    stream = _replay(spark, df.unionByName(tail), tmp_path, "shuffled", "n", files=6)
    got = _drain(sessions.session_events(stream, 600_000_000, True, "100 hours"), "shuffled_out", tmp_path).where("source_key <> 'tail'")
    want = sessions.session_events_batch(df.drop("n"), 600_000_000, True)
    cols = ["source_key", "event", "session_uuid", "at_us", "reason"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_stamp_keeps_arrival_order(spark):
    rows = [("s", "A", 1, 1_000, "session_start", "", None), ("s", "x", 2, 5_000, "command", "ls", None), ("s", "B", 3, 5_000, "session_start", "", None),
            ("s", "y", 4, 5_000, "output", "o", None), ("s", "w", 0, 6_000, "http_request", "u", "p")]
    rows += [("s", "w", i, 6_000 + i, "http_request", "u", f"p{i}") for i in range(1, 400)]  # one source, few commands, many exchanges
    env = _envelopes(spark, rows).withColumnRenamed("source", "sender")
    got = {(r.seq, r.kind): r.session_uuid for r in sessions.stamp(env, 10**9, True, "sender").collect()}
    assert got[2, "command"] == "A" and got[4, "output"] == "B" and got[0, "http_request"] == "B" and len(got) == 402


def test_live_join_and_tally(spark, tmp_path):
    rows = [("a", "s", i, 1_000_000_000 + i * 1_000_000, "command", f"cmd {i} 10.0.0.{i}", None) for i in range(20)]
    rows += [("a", "s", i, 1_000_500_000 + i * 1_000_000, "output", "password=x", None) for i in range(0, 20, 2)]
    rows += [("a", "end", 0, 10**12, "command", "x", None), ("a", "end", 0, 10**12 + 1, "output", "x", None)]
    df = _envelopes(spark, rows)
    got = _drain(sessions.join_live(_replay(spark, df, tmp_path, "join"), "1 second", "5 seconds"), "join_out", tmp_path).where("session_uuid = 's'")
    want = sessions.join_live(df, "1 second", "5 seconds").where("session_uuid = 's'")
    assert got.count() == 20 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    counted = _drain(sessions.tally(_replay(spark, df, tmp_path, "tally")), "tally_out", tmp_path, "update")
    last = counted.orderBy(F.col("commands").desc(), F.col("outputs").desc()).first()
    assert (last.commands, last.outputs, last.redactions) == (21, 11, 30)


def test_late_output_corrects_its_command(spark, tmp_path):
    """Output before its command, within the wait, after it and after the key was given up: the table is that of the batch join."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(7)
    rows, second = [], 1_000_000
    for i in range(40):
        at = (1000 + 5 * i) * second
        rows.append(("a", "s", i, at, "command", f"cmd {i} 10.0.0.{i}", None))
        late = rng.choice([None, -2, 1, 30, 200, 900])  # seconds; wait is 20, hold 400
        if late is not None:
            rows.append(("a", "s", i, at + late * second, rng.choice(["output", "stdin_masked"]), f"out {i}", None))
        if rng.random() < 0.2:
            rows.append(("a", "s", i, at + 40 * second, "command", f"again {i}", None))
    rows.append(("a", "s", 99, 1100 * second, "output", "of no command", None))
    rows += [("tail", "end", k, (10**5 + 10**5 * k) * second, "output", "x", None) for k in range(3)]
    df = _envelopes(spark, rows)
    stream = _replay(spark, df, tmp_path, "late", files=12)
    told = _drain(sessions.command_revisions(stream, "1 second", "20 seconds", "400 seconds"), "late_out", tmp_path).where("session_uuid = 's'")
    got, want = sessions.commands_of(told), envelopes.join_command_output(df.where("session_uuid = 's'"))
    columns = ["ord", "cmd", "started_at_ms", "ended_at_ms", "exit_code", "output_line_count", "output_digest", "context_path"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and got.count() == 40
    counts = {r.ord: r.n for r in told.groupBy("ord").agg(F.count("*").alias("n")).collect()}
    assert max(counts.values()) >= 2 and told.where("command is null").count() >= 1  # corrections, also of keys given up


def test_web_dedupe_stream(spark, tmp_path):
    rows = [(f"s{i % 2}", f"p{i % 5}", f"http://{'in' if i % 2 else 'out'}.h/x", i) for i in range(40)]
    df = spark.createDataFrame(rows, "session_uuid string, pair_id string, url string, n bigint").withColumn("ts", F.timestamp_seconds("n"))
    got = _drain(envelopes.dedupe_web(_replay(spark, df, tmp_path, "web", "n"), ["in.h"]), "web_out", tmp_path)
    assert {(r.session_uuid, r.pair_id) for r in got.collect()} == {("s1", f"p{i}") for i in range(5)} and got.count() == 5
    assert envelopes.dedupe_web(df, ["in.h"]).count() == 5


def test_idle_gap_edge(spark):
    df = spark.createDataFrame([("k", 0), ("k", 600), ("k", 1201)], "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.events for r in sessions.idle_sessions(df, "k").collect()) == [1, 2]


def test_refresh_recomputes_touched_sessions(spark, tmp_path):
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "session_uuid string, n int")
    seen = {}
    run = live.refresh_touched(lambda: stored, lambda df: {"sums": df.groupBy("session_uuid").agg(F.sum("n").alias("n"))},
                               lambda name, table, number: seen.update({number: sorted(map(tuple, table.collect()))}))
    q = _replay(spark, stored.where("session_uuid = 'a'"), tmp_path, "touch", "n", 1).writeStream.foreachBatch(run).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert list(seen.values()) == [[("a", 3)]]
