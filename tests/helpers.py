"""Sequential definitions and small builders used by the tests."""

from runlens.schemas import EPISODE, FINDING

DEFAULTS = dict(
    session_uuid="s", seq=1, cmd="", binary="", started_at_ms=0, duration_ms=1000, gap_before_ms=0, exit_code=0, actor="human_active",
    output_digest=None, tactic="TA0007", technique="T1046", confidence=0.9, noise_weight=1.0, volume=1, context_path="host",
    alignment=None, loop_of_seq=None, ukc=None, cwe=None,
)


def episodes(spark, rows):
    names = [c.strip().split(" ")[0] for c in EPISODE.split(", ")]
    out = []
    for i, row in enumerate(rows):
        full = {**DEFAULTS, "seq": i + 1, "started_at_ms": i * 10_000, **row}
        if full["binary"] == "" and full["cmd"]:
            full["binary"] = full["cmd"].split()[0]
        out.append(tuple(full[n] for n in names))
    return spark.createDataFrame(out, EPISODE)


def findings(spark, rows):
    names = [c.strip().split(" ")[0] for c in FINDING.split(", ")]
    base = dict(session_uuid="s", id="x", kind="port", value="80/tcp", source_seq=1, tactic=None, proven=None, masked=False)
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], FINDING)


def board(spark, rows):
    base = dict(session_uuid="s", ordinal=0, objective="o", tactic="TA0007", satisfied_by=["nmap"], techniques=[], depends_on=[], user_satisfied_by_seq=None)
    schema = ("session_uuid string, ordinal int, objective string, tactic string, satisfied_by array<string>, techniques array<string>, "
              "depends_on array<string>, user_satisfied_by_seq bigint")
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple({**base, "ordinal": i, **r}[n] for n in names) for i, r in enumerate(rows)], schema)
