"""Rounding, formatting and label functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import rules
from runlens.functions.text import on_target


def js_round(value: Column, places: int = 0) -> Column:
    """Half rounds up (towards plus infinity), also for negatives."""
    factor = float(10**places)
    return F.floor(value * factor + 0.5) / factor


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double")))


def letter(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    )


def minutes(ms: Column) -> Column:
    return F.floor(ms / 60000 + 0.5)


#: Thousandths whose double lies below the tie they are written as; they are rounded down to tenths, other ties up.
_BELOW_TIE = [ms for ms in range(50, 1000, 100) if Decimal(ms / 1000) < Decimal(ms) / 1000]


def format_duration(ms: Column) -> Column:
    total = F.floor(ms / 1000 + 0.5)
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return (
        F.when(ms < 1000, F.format_string("%.1fs", F.when(ms.isin(_BELOW_TIE), ms - 50).otherwise(ms) / 1000))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def format_minutes(ms: Column) -> Column:
    return F.concat(minutes(ms).cast("string"), F.lit(" min"))


def format_clock(ms: Column) -> Column:
    total = F.floor(ms / 1000)
    return F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))


def format_pct(value: Column) -> Column:
    return F.concat(F.floor(value + 0.5).cast("string"), F.lit("%"))


def label_of(table: dict, key: Column) -> Column:
    """Label from a fixed table of at most a few dozen entries, else the key itself."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def technique_name(technique: Column) -> Column:
    return label_of(rules.TECHNIQUE_NAMES, technique)


def technique_url(technique: Column) -> Column:
    parts = F.split(technique, r"\.")
    sub = F.get(parts, 1)
    return F.concat(
        F.lit("https://attack.mitre.org/techniques/"),
        F.get(parts, 0),
        F.when(sub.isNotNull() & (sub != ""), F.concat(F.lit("/"), sub)).otherwise(""),
        F.lit("/"),
    )


def cwe_label(cwe: Column) -> Column:
    pairs = [F.lit(x) for item in rules.CWE_NAMES.items() for x in item]
    name = F.try_element_at(F.create_map(*pairs), cwe)
    return F.when(name.isNotNull(), F.concat(cwe, F.lit(" · "), name)).otherwise(cwe)


def sentence_case(words: Column) -> Column:
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))


def ukc_label(phase: Column) -> Column:
    return sentence_case(F.replace(phase, F.lit("-"), F.lit(" ")))


def tactic_label(tactic: Column) -> Column:
    return label_of(rules.TACTIC_LABELS, tactic)


def short_tactic_label(tactic: Column) -> Column:
    return label_of(rules.SHORT_TACTIC_LABELS, tactic)


def platform_label(platform: Column) -> Column:
    return label_of(rules.PLATFORM_LABELS, platform)


def severity_label(severity: Column) -> Column:
    return F.when(severity == "unset", "unset (set severity)").otherwise(sentence_case(severity))


def objective_label(objective: Column) -> Column:
    pairs = [F.lit(x) for item in rules.OBJECTIVE_LABELS.items() for x in item]
    known = F.try_element_at(F.create_map(*pairs), objective)
    words = F.trim(F.replace(objective, F.lit("_"), F.lit(" ")))
    return F.coalesce(known, F.when(words != "", sentence_case(words)).otherwise(objective))


def capture_source(shell: Column, context: Column, source: Column) -> Column:
    """Struct (key, label) of where a session was recorded."""
    shell = F.lower(F.coalesce(shell, F.lit("")))
    context = F.lower(F.coalesce(context, F.lit("")))

    def pair(key: Column | str, label: str) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        return F.struct(key.alias("key"), F.lit(label).alias("label"))

    agent = (shell == "claude-code") | context.startswith("agent") | context.startswith("claude")
    return (
        F.when(agent, pair("claude-code", "Claude Code"))
        .when((shell == "http-proxy") | context.startswith("web:"), pair("http-proxy", "HTTP proxy"))
        .when((shell == "sysmon") | context.startswith("edr:"), pair("sysmon", "EDR / Sysmon"))
        .when(source == "local_pty", pair("local_pty", "Local terminal"))
        .when(source == "in_vm_daemon", pair("in_vm_daemon", "Pwnbox / VM"))
        .otherwise(pair(F.coalesce(source, F.lit("plugin")), "Plugin"))
    )


def is_live(recording: Column, ended_at: Column, started_at: Column, now: Column) -> Column:
    """Recording and a heartbeat younger than two minutes; no timestamp at all trusts the flag."""
    beat = F.coalesce(ended_at, started_at)
    fresh = F.when(beat.isNull(), True).otherwise(F.unix_millis(now) - F.unix_millis(beat) < 120_000)
    return F.coalesce(recording, F.lit(False)) & fresh


def lane(context: Column) -> Column:
    return F.when(on_target(context), "target").otherwise("host")
