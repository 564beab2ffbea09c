"""Tactic, technique, weakness, noise and platform classification from rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import rules
from runlens.functions import net
from runlens.functions import text as t
from runlens.session import table_of


def prior_table(spark: SparkSession) -> DataFrame:
    rows, seen = [], set()
    for binaries, tactic, technique, confidence in rules.BINARY_PRIORS:
        for binary in binaries:
            if binary not in seen:
                seen.add(binary)
                rows.append((binary, tactic, technique, confidence))
    return table_of(spark, rows, "binary string, tactic string, technique string, confidence double")


def noise_table(spark: SparkSession) -> DataFrame:
    rows = [(b, float(w)) for b, w in rules.NOISE_WEIGHTS.items()]
    return table_of(spark, rows, "binary string, noise_weight double")


def cwe_table(spark: SparkSession) -> DataFrame:
    return table_of(spark, list(rules.BINARY_CWE.items()), "binary string, cwe array<string>")


def ukc_table(spark: SparkSession) -> DataFrame:
    rows = [(tactic, phase, rules.UKC_ORDER.index(phase)) for tactic, phase in rules.TACTIC_UKC.items()]
    return table_of(spark, rows, "tactic string, ukc string, ukc_rank int")


def _lookup(df: DataFrame, table: DataFrame, key: Column, names: dict[str, str], on: str) -> DataFrame:
    """Left join of a rule table by a computed key; ``names`` maps table columns to output columns."""
    side = table.select(F.col(on).alias("_key"), *[F.col(c).alias(n) for c, n in names.items()])
    return df.withColumn("_probe", key).join(side, F.col("_probe") == F.col("_key"), "left").drop("_probe", "_key")


def _prior(tactic: str, technique: str, confidence: float) -> Column:
    return F.struct(
        F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"), F.lit(float(confidence)).alias("confidence"),
        F.lit(None).cast("string").alias("cwe"),
    )


def _prior_of(prefix: str) -> Column:
    return F.struct(
        F.col(f"{prefix}_tactic").alias("tactic"), F.col(f"{prefix}_technique").alias("technique"),
        F.col(f"{prefix}_confidence").alias("confidence"), F.lit(None).cast("string").alias("cwe"),
    )


def classify_binary(df: DataFrame, binary: str = "binary", priors: DataFrame | None = None) -> DataFrame:
    """Add tactic, technique and confidence of a binary, with the low-confidence fallback."""
    priors = priors if priors is not None else prior_table(df.sparkSession)
    names = {"tactic": "_b_tactic", "technique": "_b_technique", "confidence": "_b_confidence"}
    out = _lookup(df, priors, F.lower(F.col(binary)), names, "binary")
    tactic, technique, confidence = rules.FALLBACK_PRIOR
    return (
        out.withColumn("tactic", F.coalesce("_b_tactic", F.lit(tactic)))
        .withColumn("technique", F.coalesce("_b_technique", F.lit(technique)))
        .withColumn("confidence", F.coalesce("_b_confidence", F.lit(confidence)))
        .drop("_b_tactic", "_b_technique", "_b_confidence")
    )


def on_target_prior(cmd: Column, binary: Column) -> Column:
    """Reclassification of a command that ran on the target; null where the local meaning stands."""
    lowered, name = F.lower(cmd), F.lower(binary)
    store = t.rx(r"/etc/(shadow|passwd)\b|ntds\.dit|\bsam\b|\.kdbx\b|id_rsa\b")
    chain = None
    for binaries, *prior in rules.ON_TARGET_PRIORS:
        chain = (F if chain is None else chain).when(name.isin(binaries), _prior(*prior))
    chain = chain.when(lowered.rlike(store), _prior(*rules.CREDENTIAL_STORE_PRIOR))
    for binaries, *prior in rules.ON_TARGET_LATE_PRIORS:
        chain = chain.when(name.isin(binaries), _prior(*prior))
    return chain


def is_file_staging(cmd: Column) -> Column:
    lowered = F.lower(cmd)
    return lowered.contains("http.server") | lowered.contains("updog") | lowered.contains("simplehttpserver")


def is_shell_upgrade(cmd: Column) -> Column:
    lowered = F.lower(cmd)
    may = (lowered.contains("sh") & lowered.contains("-i")) | lowered.contains("/dev/tcp/") | lowered.contains("mkfifo") | (
        lowered.contains("nc") & lowered.contains("-e")
    )
    return may & lowered.rlike(t.rx(r"\b(bash|sh)\s+-i|/dev/tcp/|rm\s+/tmp/f;.*mkfifo|nc.*-e"))


def web_prior(web: Column) -> Column:
    """Prior of an http exchange: injection, traversal, script probe, auth post, else browsing."""
    url = F.coalesce(web["url"], F.lit(""))
    mark = F.instr(url, "?")
    query = F.when(mark > 0, F.substr(url, mark + 1)).otherwise("")
    body = F.coalesce(web["req_body"], F.lit(""))
    resp = F.coalesce(web["resp_body"], F.lit(""))
    sqli, traversal, xss = t.rx(rules.SQLI_PROBE), t.rx(rules.TRAVERSAL), t.rx(rules.XSS_PROBE)

    def prior(tactic: str, technique: str, cwe: str | None, confidence: Column | float) -> Column:
        confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.struct(
            F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"), confidence.alias("confidence"),
            F.lit(cwe).cast("string").alias("cwe"),
        )

    confirmed = F.when(resp.rlike(t.rx(rules.SQL_ERROR)), F.lit(0.9)).otherwise(F.lit(0.7))
    return (
        F.when(query.rlike(sqli) | body.rlike(sqli), prior("TA0001", "T1190", "CWE-89", confirmed))
        .when(query.rlike(traversal) | body.rlike(traversal), prior("TA0001", "T1190", "CWE-22", 0.8))
        .when(query.rlike(xss) | (body.rlike(xss) & resp.rlike(xss)), prior("TA0001", "T1190", "CWE-79", 0.7))
        .when((web["method"] == "POST") & url.rlike(t.rx(rules.AUTH_URL)), prior("TA0001", "T1110", None, 0.6))
        .otherwise(prior("TA0007", "T1595", None, 0.4))
    )


def classify_commands(raw: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Add ``binary``, ``prior`` (before the staging override) and ``may_stage``.

    The staging override depends on the previous row and is applied by the segmentation scan.
    """
    spark = raw.sparkSession
    priors = priors if priors is not None else prior_table(spark)
    df = raw.withColumn("binary", t.extract_binary(F.col("cmd")))
    inner = t.extract_binary(F.regexp_replace("cmd", r"(?i)^\s*(?:sudo|doas)\s+", ""))
    df = _lookup(df, priors, F.lower("binary"),
                 {"tactic": "_o_tactic", "technique": "_o_technique", "confidence": "_o_confidence"}, "binary")
    wrapped = F.col("binary").isin("sudo", "doas")
    df = _lookup(df, priors, F.when(wrapped & (inner != "") & (inner != F.col("binary")), F.lower(inner)),
                 {"tactic": "_i_tactic", "technique": "_i_technique", "confidence": "_i_confidence"}, "binary")
    elevated = wrapped & (F.col("_i_tactic") == "TA0007") & (F.col("_i_confidence") >= 0.5)
    landed = F.when(t.on_target(F.col("context_path")), on_target_prior(F.col("cmd"), F.col("binary")))
    local = (
        F.when(is_shell_upgrade(F.col("cmd")), _prior(*rules.SHELL_PRIOR))
        .when(elevated, _prior_of("_i"))
        .when(F.col("_o_tactic").isNotNull(), _prior_of("_o"))
        .otherwise(_prior(*rules.FALLBACK_PRIOR))
    )
    web = F.when(F.col("web").isNotNull(), web_prior(F.col("web")))
    return (
        df.withColumn("_landed", landed)
        .withColumn("prior", F.coalesce(web, F.col("_landed"), local))
        .withColumn(
            "may_stage", F.col("web").isNull() & F.col("_landed").isNull() & is_file_staging(F.col("cmd"))
        )
        .drop("_landed", "_o_tactic", "_o_technique", "_o_confidence", "_i_tactic", "_i_technique", "_i_confidence")
    )


def with_noise_weight(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    table = table if table is not None else noise_table(df.sparkSession)
    out = _lookup(df, table, F.lower("binary"), {"noise_weight": "_w"}, "binary")
    return out.withColumn("noise_weight", F.coalesce("_w", F.lit(1.0))).drop("_w")


def with_frameworks(episodes: DataFrame, ukc: DataFrame | None = None, cwe: DataFrame | None = None) -> DataFrame:
    """Add ``ukc`` from the tactic and ``cwe`` from the binary; a weakness set upstream wins."""
    spark = episodes.sparkSession
    ukc = ukc if ukc is not None else ukc_table(spark)
    cwe = cwe if cwe is not None else cwe_table(spark)
    if "cwe" not in episodes.columns:
        episodes = episodes.withColumn("cwe", F.lit(None).cast("array<string>"))
    base = episodes.drop("ukc")
    out = _lookup(base, ukc, F.col("tactic"), {"ukc": "ukc"}, "tactic")
    out = _lookup(out, cwe, F.lower("binary"), {"cwe": "_cwe"}, "binary")
    return out.withColumn("cwe", F.coalesce("cwe", "_cwe")).drop("_cwe")


def with_binary_cwe(episodes: DataFrame, name: str = "binary_cwe", table: DataFrame | None = None) -> DataFrame:
    """The weakness classes implied by the tool alone (empty array for none)."""
    table = table if table is not None else cwe_table(episodes.sparkSession)
    out = _lookup(episodes, table, F.lower("binary"), {"cwe": "_bc"}, "binary")
    return out.withColumn(name, F.coalesce("_bc", F.array().cast("array<string>"))).drop("_bc")


def platform_scores(scope: Column, context: Column, hint: Column, rule_rows: list | None = None) -> list[tuple]:
    ips = net.ips_in(F.coalesce(scope, F.lit("")))
    out = []
    for order, pid, _kind, context_re, scope_re, ranges in rule_rows or rules.PLATFORM_RULES:
        if context_re is None:
            score = F.lit(0.1)
        else:
            score = (
                F.when(F.coalesce(hint == pid, F.lit(False)), 1.0)
                .when(F.coalesce(context.rlike(t.rx(context_re)), F.lit(False)), 0.9)
                .when(F.coalesce(scope.rlike(scope_re), F.lit(False)), 0.8)
                .when(net.any_ip_in(ips, ranges), 0.6)
                .otherwise(0.0)
            )
        out.append((order, pid, score))
    return out


def resolve_platform(scope: Column, context: Column, hint: Column, rule_rows: list | None = None) -> Column:
    """Best-scoring platform; the earliest rule wins a tie."""
    ranked = [
        F.struct(score.alias("score"), F.lit(-order).alias("rank"), F.lit(pid).alias("platform"))
        for order, pid, score in platform_scores(scope, context, hint, rule_rows)
    ]
    return F.greatest(*ranked)["platform"]


def identify_target(
    sessions: DataFrame, scope: str = "target_scope", context: str = "context_path", hint: str | None = None,
    platforms: list | DataFrame | None = None, levels: dict | None = None,
) -> DataFrame:
    """Add ``target`` (platform, kind, name, slug, difficulty, hue, url) parsed from the scope text.

    ``platforms`` replaces the rule rows (order, id, kind, context pattern, scope pattern, ranges); a table of them is small.

    Optional columns ``machine_name``, ``machine_slug`` and ``machine_difficulty`` override the parse.
    """
    none = F.lit(None).cast("string")
    columns = sessions.columns
    machine = F.col("machine_name") if "machine_name" in columns else none
    machine_slug = F.col("machine_slug") if "machine_slug" in columns else none
    machine_level = F.col("machine_difficulty") if "machine_difficulty" in columns else none
    hint_col = F.col(hint) if hint else F.when(machine.isNotNull(), "htb")
    text = F.col(scope)
    rows = [tuple(r) for r in platforms.collect()] if isinstance(platforms, DataFrame) else platforms or rules.PLATFORM_RULES
    df = sessions.withColumn("_p", resolve_platform(text, F.col(context), hint_col, rows))
    p = F.col("_p")
    default = F.when(p == "htb", "session").when(p == "thm", "room").when(p == "local", "session").otherwise("lab")
    ts = F.coalesce(text, default)
    after = F.when(ts.contains("::"), F.get(F.split(ts, "::"), 1)).otherwise(ts)
    head = F.get(F.split(after, r"\("), 0)
    dashed = F.get(F.split(head, "—"), 0)
    scoped = t.trim(F.when(p == "htb", dashed).otherwise(head))
    bare = t.trim(F.regexp_replace(ts, r"\s*\(.*\)\s*", ""))
    local_name = F.when(bare != "", bare).otherwise("Local capture")
    name = F.coalesce(machine, F.when(p == "local", local_name).when(scoped != "", scoped).otherwise(ts))
    word = (
        F.when(text.rlike(t.rx(r"(?i)\beasy\b")), "Easy")
        .when(text.rlike(t.rx(r"(?i)\bmedium\b")), "Medium")
        .when(text.rlike(t.rx(r"(?i)\bhard\b")), "Hard")
        .when(text.rlike(t.rx(r"(?i)\binsane\b")), "Insane")
    )
    label = F.coalesce(machine_level, F.when(p == "htb", word))
    level = F.lit(None).cast("int")
    for platform, levels in (levels or rules.DIFFICULTY_LEVELS).items():
        for key, value in levels.items():
            level = F.when((p == platform) & (label == key), value).otherwise(level)
    made = F.regexp_replace(F.lower("_name"), "[^a-z0-9]", "")
    slug = F.when(p == "htb", F.coalesce(machine_slug, made)).when(p == "thm", made)
    kinds = {r[1]: r[2] for r in rows}
    kind = F.lit(None).cast("string")
    for platform, noun in kinds.items():
        kind = F.when(p == platform, noun).otherwise(kind)
    url = F.when(p == "htb", F.concat(F.lit("https://app.hackthebox.com/machines/"), slug)).when(
        p == "thm", F.concat(F.lit("https://tryhackme.com/room/"), slug)
    )
    return (
        df.withColumn("_name", name)
        .withColumn(
            "target",
            F.struct(
                p.alias("platform"), kind.alias("kind"), F.col("_name").alias("name"), slug.alias("slug"),
                level.alias("difficulty_level"), F.when(level.isNotNull(), label).alias("difficulty_label"),
                t.hue(F.col("_name")).alias("hue"), url.alias("url"),
            ),
        )
        .drop("_p", "_name")
    )
