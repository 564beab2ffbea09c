"""The evidence ledger: what outputs revealed, and which later commands used it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.operators import substring
from runlens.schemas import SESSION

# fixed values: detector patterns, in order, and texts one of which every match holds (any text of 32 bytes may hold a digest)
LONG = 32
HELD = {"port": ["/tcp", "/udp"], "url": ["http"], "hash": ["$"], "cred": [":", "="], "vuln": ["CVE-"], "flag": ["{"]}
DETECTORS = [
    ("port", r"(\d{1,5})/(tcp|udp)\s+open(?:\s+(\S+))?"),
    ("url", r"""https?://[^\s"'<>]+"""),
    ("hash", r"\b[a-f0-9]{32,}\b|\$[0-9a-z]\$[^\s:]+"),
    ("cred", r"(?i)(?:password|passwd|pwd|user(?:name)?)\s*[:=]\s*(\S+)"),
    ("vuln", r"CVE-\d{4}-\d{3,}"),
]
DETECTOR_TACTICS = {"port": "TA0007", "url": "TA0007", "cred": "TA0006", "vuln": "TA0001"}
FLAG_TOKEN = r"(?i)\b[a-f0-9]{32}\b|(?:HTB|THM|flag)\{[^}]*\}"
FLAG_SENTINEL = "[redacted-flag]"
SECRET_KINDS = ["cred", "hash", "flag"]


def _may_hold(kind: str, text: Column) -> Column:
    """Whether the pattern of this kind has to be tried at all."""
    may = F.octet_length(text) >= LONG if kind in ("hash", "flag") else F.lit(False)
    for part in HELD[kind]:
        may = may | text.contains(part)
    return may


def _row(kind: str, found: Column, pos: Column) -> Column:
    if kind == "port":
        pattern = r"^(\d{1,5})/(tcp|udp)"
        number, proto = F.regexp_extract(found, pattern, 1), F.regexp_extract(found, pattern, 2)
        ident, value = F.concat(F.lit("port:"), number, F.lit("-"), proto), F.concat(number, F.lit("/"), proto)
    elif kind == "vuln":
        ident, value = F.concat(F.lit("vuln:"), found), found
    else:
        ident, value = F.concat(F.lit(f"{kind}:"), t.hash8(found)), found
    return F.struct(
        ident.alias("id"), F.lit(kind).alias("kind"), value.alias("value"),
        F.lit(DETECTOR_TACTICS.get(kind)).cast("string").alias("tactic"), F.lit(None).cast("boolean").alias("proven"),
        pos.cast("int").alias("pos"),
    )


def _flag_row() -> Column:
    text = F.coalesce("output_digest", F.lit(""))
    name = F.when(
        F.col("cmd").contains(".") & F.col("cmd").rlike(r"(?i)(?:user|root|proof)\.txt"),
        F.when(F.col("cmd").rlike("(?i)root|proof"), "root").otherwise("user"),
    )
    token = F.when(_may_hold("flag", text), F.nullif(F.regexp_extract(text, t.rx(FLAG_TOKEN), 0), F.lit("")))
    sentinel = text.contains(FLAG_SENTINEL)
    shown = F.coalesce(token, F.lit(FLAG_SENTINEL))
    value = F.coalesce(token, F.when(sentinel, F.lit(FLAG_SENTINEL)), F.concat(name, F.lit(".txt")))
    row = F.struct(
        F.concat(F.lit("flag:"), F.coalesce(name, t.hash8(shown))).alias("id"), F.lit("flag").alias("kind"),
        value.alias("value"), F.lit(None).cast("string").alias("tactic"),
        (token.isNotNull() | sentinel).alias("proven"), F.lit(0).alias("pos"),
    )
    return F.when(name.isNotNull() | token.isNotNull() | sentinel, row)


def extract(episodes: DataFrame) -> DataFrame:
    """One row per distinct finding of a session; the first occurrence decides value and source."""
    text = F.coalesce("output_digest", F.lit(""))
    def rows(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(t.rx(pattern)), 0)
        held = F.when(_may_hold(kind, text), found).otherwise(F.array().cast("array<string>"))
        return F.transform(held, lambda m, i: _row(kind, m, i))

    parts = [rows(kind, pattern) for kind, pattern in DETECTORS]
    flag = F.filter(F.array(_flag_row()), lambda f: f.isNotNull())
    hits = episodes.select(SESSION, "seq", F.explode(F.concat(*parts, flag)).alias("f")).select(
        SESSION, "f.id", F.struct("seq", "f.pos", "f.kind", "f.value", "f.tactic", "f.proven").alias("at")
    )
    return hits.groupBy(SESSION, "id").agg(F.min("at").alias("at")).select(
        SESSION, "id", "at.kind", "at.value", F.col("at.seq").alias("source_seq"), "at.tactic", "at.proven",
        F.lit(False).alias("masked"),
    )


def link_uses(episodes: DataFrame, findings: DataFrame) -> DataFrame:
    """(session, id, used_seq) for every later command that refers to a finding.

    Ports meet commands on the exact number after a colon; other values go through the gram index.
    """
    commands = episodes.where(F.col("cmd") != "").select(SESSION, "seq", "cmd")
    ports = findings.where("kind = 'port'").select(
        SESSION, "id", "source_seq", F.get(F.split("value", "/"), 0).alias("port")
    )
    mentioned = commands.select(
        SESSION, "seq", F.explode(F.array_distinct(F.regexp_extract_all("cmd", F.lit(r":(\d+)"), 1))).alias("port")
    )
    by_port = mentioned.join(ports, [SESSION, "port"]).where(F.col("seq") > F.col("source_seq")).select(
        SESSION, "id", F.col("seq").alias("used_seq")
    )
    values = findings.where("kind <> 'port'").select(SESSION, "id", "value", "source_seq")
    found = substring.containing(commands, values.drop("source_seq"), [SESSION], "seq", "cmd", "id", "value")
    by_value = (
        found.select(SESSION, "id", "seq")
        .join(values.select(SESSION, "id", "source_seq"), [SESSION, "id"])
        .where(F.col("seq") > F.col("source_seq"))
        .select(SESSION, "id", F.col("seq").alias("used_seq"))
    )
    return by_port.unionByName(by_value)


def mask(findings: DataFrame, profile: str) -> DataFrame:
    """Hide credentials, hashes and flags for a shareable profile. Apply after linking."""
    if profile != "public_safe":
        return findings
    secret = F.col("kind").isin(SECRET_KINDS)
    return findings.withColumn("value", F.when(secret, t.mask_secret(F.col("value"))).otherwise(F.col("value"))).withColumn(
        "masked", secret
    )


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(SESSION, "source_seq", "id")


def by_kind(findings: DataFrame) -> DataFrame:
    """Kinds in order of first appearance, with the count of each; members stay in the ledger."""
    groups = findings.groupBy(SESSION, "kind").agg(
        F.min(F.struct("source_seq", "id")).alias("_first"), F.count("id").alias("findings")
    )
    order = F.row_number().over(Window.partitionBy(SESSION).orderBy("_first"))
    return groups.withColumn("position", order).select(
        SESSION, "kind", "findings", "position", F.col("_first.source_seq").alias("first_seq")
    )
