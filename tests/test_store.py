import random
import re

import pytest
from pyspark.sql import functions as F

from runlens.schemas import ENVELOPE
from runlens.sources import envelopes, store

KINDS = ["command", "command", "output", "stdin_masked", "http_request", "http_response", "session_start"]


def rows(rng, n, sessions):
    """Envelopes in order of arrival: repeated keys, output and responses before and after what they belong to."""
    out = []
    for k in range(n):
        kind = rng.choice(KINDS)
        payload = {"cmd": f"run {k}", "exit_code": 0, "text": f"out {k}", "line_count": 1, "method": "GET", "url": f"http://h/{k}", "status": 200, "pair_id": f"p{rng.randrange(6)}"}
        out.append({"source": "a", "session_uuid": f"s{rng.randrange(sessions)}", "seq": rng.randrange(8), "ts_utc_us": rng.randrange(50), "kind": kind, "payload": payload, "provenance": {"context_path": "host"}})
    return out


def frame(spark, rows_):
    return spark.createDataFrame(rows_, ENVELOPE).coalesce(1)


def contents(tables):
    return {name: sorted(map(str, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


def buckets_read(df):
    return {(m[1], int(m[2]), int(m[3])) for f in df.inputFiles() if (m := re.search(r"/(batch|merged)/upto=(\d+)/bucket=(\d+)/", f))}


@pytest.fixture
def batches():
    rng = random.Random(9)
    return [rows(rng, 120, 12) for _ in range(4)]


def test_only_touched_buckets_are_opened(spark, tmp_path, batches):
    folder = str(tmp_path / "store")
    for n, batch in enumerate(batches):
        store.write_batch(frame(spark, batch), folder, n, 8)
    want = spark.createDataFrame([("s3",), ("s7",), ("nobody",)], "session_uuid string")
    place = {r.session_uuid: r.b for r in want.select("session_uuid", store.bucket_of(F.col("session_uuid"), 8).alias("b")).collect()}
    found = store.read_batches(spark, folder, want, 8)
    opened = buckets_read(found)
    assert {b for _k, _n, b in opened} <= set(place.values()) and {n for _k, n, _b in opened} == {0, 1, 2, 3}
    assert {r.session_uuid for r in found.select("session_uuid").distinct().collect()} == {"s3", "s7"}
    assert found.count() == sum(r["session_uuid"] in ("s3", "s7") for b in batches for r in b)
    assert store.read_batches(spark, folder, want.where("session_uuid = 'nobody'"), 8).count() == 0


def test_arrival_decides_not_time(spark, tmp_path):
    """Within a batch the first to arrive wins, also if it carries a later time."""
    base = rows(random.Random(1), 2, 1)
    first, second = ({**r, "kind": "command", "seq": 1, "ts_utc_us": ts, "payload": {**r["payload"], "cmd": cmd}} for r, ts, cmd in zip(base, (9, 3), ("came first", "came later")))
    store.write_batch(frame(spark, [first, second]), str(tmp_path), 0, 2)
    assert [r.raw_command for r in store.normalize(store.read_batches(spark, str(tmp_path), buckets=2))["commands"].collect()] == ["came first"]


def test_compaction_changes_no_table(spark, tmp_path, batches):
    folder = str(tmp_path)
    for n, batch in enumerate(batches[:3]):
        store.write_batch(frame(spark, batch), folder, n, 4)
    read = lambda: store.read_batches(spark, folder, buckets=4)
    before, raw = contents(store.normalize(read())), sorted(map(str, envelopes.raw_commands(read(), "first").drop("web").collect()))
    n = read().count()
    store.compact(spark, folder, 1, 4)
    assert contents(store.normalize(read())) == before and read().count() < n
    assert {(k, u) for k, u, _b in buckets_read(read())} == {("merged", 1), ("batch", 2)}
    store.compact(spark, folder, 2, 4)
    store.vacuum(spark, folder)
    assert contents(store.normalize(read())) == before and sorted(map(str, envelopes.raw_commands(read(), "first").drop("web").collect())) == raw
    assert sorted(p.name for p in (tmp_path / "merged").iterdir() if not p.name.startswith(".")) == ["upto=2"] and not list((tmp_path / "batch").glob("upto=*"))
    # The next batch stands beside the merged generation; written twice it counts once.
    for _ in range(2):
        store.write_batch(frame(spark, batches[3]), folder, 3, 4)
    assert {(k, u) for k, u, _b in buckets_read(read())} == {("merged", 2), ("batch", 3)}
    assert read().where("batch = 3").count() == len(batches[3])


def walked(batches):
    """The commands table as a row-by-row store would fill it: first wins, output marks the end of a known command."""
    commands = {}
    for batch in batches:
        for e in batch:  # all commands of a batch are known before its output, as the tables know by batch
            if e["kind"] == "command":
                commands.setdefault((e["session_uuid"], e["seq"]), [e["payload"]["cmd"], e["ts_utc_us"], None])
        for e in batch:
            if e["kind"] in ("output", "stdin_masked") and (e["session_uuid"], e["seq"]) in commands:
                commands[e["session_uuid"], e["seq"]][2] = e["ts_utc_us"]
    return commands


def test_commands_equal_a_walk(spark, tmp_path, batches):
    for n, batch in enumerate(batches):
        store.write_batch(frame(spark, batch), str(tmp_path), n, 4)
    store.compact(spark, str(tmp_path), 2, 4)
    got = {(r.session_uuid, r.seq): [r.raw_command, r.started_at, r.ended_at] for r in store.normalize(store.read_batches(spark, str(tmp_path), buckets=4))["commands"].collect()}
    assert got == walked(batches)
