"""Contract checks: required, enum, range and pattern rules as boolean columns, violations as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.schemas import ENVELOPE_KINDS


def validate_report(tables: dict[str, DataFrame], keys: list[str], contract: dict[str, list] | None = None) -> DataFrame:
    """(part, keys, rule) over the tables of a report."""
    out = None
    for part, df in tables.items():
        found = validate(df, (contract or REPORT_CONTRACT)[part], keys).select(F.lit(part).alias("part"), *keys, "rule")
        out = found if out is None else out.unionByName(found)
    return out


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str
    value: object = None

    def broken(self) -> Column:
        c = F.col(self.column)
        if self.kind == "required":
            return c.isNull()
        if self.kind == "enum":
            return c.isNotNull() & ~c.isin(list(self.value))
        if self.kind == "pattern":
            return c.isNotNull() & ~c.rlike(self.value)
        if self.kind == "each":
            return F.exists(c, lambda x: ~x.rlike(self.value))
        low, high = self.value
        if self.kind == "each_range":
            return F.exists(c, lambda x: x < low)
        out = F.lit(False)
        if low is not None:
            out = out | (c < low)
        if high is not None:
            out = out | (c > high)
        return F.coalesce(out, F.lit(False))

    @property
    def name(self) -> str:
        return f"{self.column}:{self.kind}"


# fixed values: the telemetry and episode contracts
ENVELOPE_CONTRACT = [
    Rule("source", "required"), Rule("source", "enum", ("local_pty", "in_vm_daemon", "plugin")), Rule("session_uuid", "required"),
    Rule("ts_utc_us", "required"), Rule("ts_utc_us", "range", (0, None)), Rule("kind", "required"), Rule("kind", "enum", tuple(ENVELOPE_KINDS)),
    Rule("provenance.boundary_confidence", "range", (0, 1)),
]
TACTIC, TECHNIQUE, PERCENT, COUNT = r"^TA[0-9]{4}\z", r"^T[0-9]{4}(\.[0-9]{3})?\z", (0, 100), (0, None)


def _required(*names: str) -> list[Rule]:
    return [Rule(n, "required") for n in names]


def _within(bounds: tuple, *names: str) -> list[Rule]:
    return [Rule(n, "range", bounds) for n in names]


EPISODE_CONTRACT = [
    *_required("seq", "cmd", "binary", "duration_ms", "gap_before_ms", "actor", "tactic"),
    *_within(COUNT, "seq", "started_at_ms", "duration_ms", "gap_before_ms", "volume"), Rule("noise_weight", "range", (0, 10)),
    Rule("actor", "enum", ("machine_bound", "human_active", "think_pause", "idle")), Rule("tactic", "pattern", TACTIC),
    Rule("technique", "pattern", TECHNIQUE), Rule("confidence", "range", (0, 1)),
    Rule("alignment", "enum", ("match", "alternative", "detour", "skipped", "out_of_order")),
    Rule("ukc", "enum", (
        "reconnaissance", "exploitation", "execution", "persistence", "defense-evasion", "credential-access", "privilege-escalation",
        "lateral-movement", "command-and-control", "collection", "exfiltration", "objectives")),
    Rule("cwe", "each", r"^CWE-[0-9]+\z"),
]
#: The parts of a report, each a table of its own.
REPORT_CONTRACT = {
    "sessions": [
        *_required("session_uuid", "started_at", "ended_at", "target_scope", "shell", "source"),
        Rule("source", "enum", ("local_pty", "in_vm_daemon", "plugin")), Rule("target.difficulty_level", "range", (1, 5)), Rule("target.hue", "range", (0, 360)),
        Rule("target.platform", "enum", ("htb", "thm", "offsec", "immersive", "local", "breachyard")),
    ],
    "episodes": EPISODE_CONTRACT,
    "phases": [
        *_required("mitre_tactic", "label", "started_at", "ended_at", "efficiency_pct"), Rule("mitre_tactic", "pattern", TACTIC), *_within(PERCENT, "efficiency_pct")],
    "objectives": [
        *_required("objective", "tactic", "satisfied_by"), Rule("tactic", "pattern", TACTIC), Rule("status", "enum", ("untouched", "attempted", "reached", "proven"))],
    "metrics": [
        *_required("efficiency_pct", "stealth_score", "objective_coverage_pct", "technique_breadth", "productive_ms", "detour_ms", "stuck_ms", "loop_ms", "active_ms"),
        *_within(PERCENT, "efficiency_pct", "stealth_score", "objective_coverage_pct", "ukc_coverage_pct", "ukc_progression", "methodology_coverage_pct", "focus_discipline_pct"),
        *_within(COUNT, "productive_ms", "detour_ms", "stuck_ms", "loop_ms", "active_ms", "technique_breadth", "weakness_breadth", "recovery_median_ms",
                 "ghost_time_lost_ms", "ghost_human_wins"),
    ],
    "radar": [*_required("recon", "web", "exploit", "privesc", "opsec"), *_within(PERCENT, "recon", "web", "exploit", "privesc", "opsec")],
    "coaching": [*_required("action", "why", "category"), Rule("category", "enum", ("Recon", "Web", "Access", "PrivEsc", "OpSec", "Tactics", "Recap"))],
    "findings": [
        *_required("id", "kind", "value", "source_seq"), *_within(COUNT, "source_seq"), Rule("tactic", "pattern", TACTIC), Rule("confidence", "range", (0, 1)),
        Rule("kind", "enum", ("port", "service", "version", "cred", "url", "path", "host", "hash", "vuln", "flag")), Rule("used_by_seq", "each_range", COUNT),
    ],
    "hints": [
        *_required("tier", "at_ms", "phase"), Rule("tier", "enum", (1, 2, 3)), *_within(COUNT, "at_ms"), Rule("source", "enum", ("static", "ai:golden", "ai:knowledge"))],
    "ghost": [
        *_required("objective", "verdict"), Rule("verdict", "enum", ("on_time", "late_pivot", "skipped", "ahead", "off_path_win")), *_within(COUNT, "lag_ms")],
    "noise_baseline": [*_required("label", "noise", "total"), *_within(COUNT, "noise", "total")],
}


def validate(df: DataFrame, contract: list[Rule], keys: list[str]) -> DataFrame:
    """(keys, rule) for every broken rule; one pass, no joins. Rules on columns that the table doesn't have count as kept,
    unless the column is required."""
    def check(rule: Rule) -> Column:
        if rule.column.split(".")[0] in df.columns:
            return F.when(F.coalesce(rule.broken(), F.lit(False)), F.lit(rule.name))
        return F.lit(rule.name if rule.kind == "required" else None).cast("string")

    checks = F.array(*[check(rule) for rule in contract])
    return df.select(*keys, F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("rule"))
