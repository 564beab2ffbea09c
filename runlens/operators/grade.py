"""Grade rubric, hint penalties, minimized bundles and the attestation chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import rules
from runlens.functions import display as d
from runlens.functions import text as t
from runlens.operators import ordered
from runlens.schemas import SESSION


def hint_summary(pulls: DataFrame) -> DataFrame:
    """Pull count, penalty, model-written pulls and the next tier. ``pulls(session_uuid, tier, at_ms, source)``."""
    pairs = [F.lit(x) for item in rules.HINT_PENALTIES.items() for x in item]
    cost = F.try_element_at(F.create_map(*pairs), F.col("tier").cast("int"))
    return pulls.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("hint_pulls"), F.sum(cost).alias("hint_penalty"),
        F.count(F.when(F.col("source").isin("ai:golden", "ai:knowledge"), 1)).alias("ai_pulls"),
        F.least(F.lit(3), F.max("tier") + 1).cast("int").alias("next_tier"),
    )


def merge_pulls(saved: DataFrame, local: DataFrame) -> DataFrame:
    """Saved pulls plus the local ones newer than the last saved pull of the session."""
    last = saved.groupBy(SESSION).agg(F.max("at_ms").alias("_last"))
    newer = local.join(last, SESSION, "left").where(F.col("at_ms") > F.coalesce("_last", F.lit(0))).drop("_last")
    return saved.unionByName(newer, allowMissingColumns=True)


def grade(metrics: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Weighted rubric per session.

    A methodology value selects the second rubric, its absence the first; independence counts only when it
    was measured or hints were pulled, and the other weights are scaled up when it was not.
    """
    df = metrics
    for c, kind in (("independence_score", "double"), ("methodology_coverage_pct", "double"),
                    ("focus_discipline_pct", "double"), ("ukc_progression", "double")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    if hints is not None:
        df = df.join(hints.select(SESSION, "hint_pulls", "hint_penalty", "ai_pulls"), SESSION, "left")
    else:
        for c in ("hint_pulls", "hint_penalty", "ai_pulls"):
            df = df.withColumn(c, F.lit(None).cast("bigint"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    pulls, penalty, ai = zero(F.col("hint_pulls")), zero(F.col("hint_penalty")), zero(F.col("ai_pulls"))
    second = F.col("methodology_coverage_pct").isNotNull()
    signalled = F.col("independence_score").isNotNull()
    measured = signalled | (pulls > 0)
    raws = {
        "coverage": d.clamp(F.col("objective_coverage_pct")),
        "breadth": d.clamp(F.col("technique_breadth") / rules.BREADTH_TARGET * 100),
        "efficiency": d.clamp(F.col("efficiency_pct")),
        "progression": d.clamp(F.coalesce("ukc_progression", F.lit(100.0))),
        "discipline": d.clamp(F.col("stealth_score")),
        "independence": F.when(measured, d.clamp(F.coalesce("independence_score", F.lit(100.0)) - penalty)).otherwise(0.0),
        "methodology": d.clamp(F.coalesce("methodology_coverage_pct", F.lit(0.0))),
        "focus": d.clamp(F.coalesce("focus_discipline_pct", F.lit(100.0))),
    }

    def components(rubric: list) -> Column:
        every, without = sum(w for _k, w in rubric), sum(w for k, w in rubric if k != "independence")
        rows = []
        for name, w in rubric:
            scaled = 0.0 if name == "independence" else w / without
            weight = F.when(measured, w / every).otherwise(scaled)
            rows.append(F.struct(F.lit(name).alias("name"), raws[name].alias("raw"), weight.alias("weight")))
        return F.array(*rows)

    df = df.withColumn("_components", F.when(second, components(rules.RUBRIC_V2)).otherwise(components(rules.RUBRIC_V1)))
    score = F.aggregate("_components", F.lit(0.0), lambda acc, c: acc + c["raw"] * c["weight"])
    flagged = signalled & (d.clamp(F.col("independence_score")) < rules.INDEPENDENCE_GATE)
    number = lambda v: F.regexp_replace(d.js_round(v, 1).cast("string"), r"\.0\z", "")
    low = lambda key: F.when(raws[key] < 50, F.concat(F.lit(f"Low {key} ("), number(raws[key]), F.lit(").")))
    said = [
        F.when(flagged, F.concat(
            F.lit("Independence "), number(raws["independence"]),
            F.lit(f" is under the gate ({rules.INDEPENDENCE_GATE}); a person has to review the run."))),
        *[low(k) for k in ("coverage", "efficiency", "progression", "discipline")],
        *[F.when(second, low(k)) for k in ("methodology", "focus")],
        F.when(pulls > 0, F.concat(
            F.lit("Used "), pulls.cast("string"), F.when(pulls == 1, " hint").otherwise(" hints"),
            F.when(ai > 0, F.concat(F.lit(" ("), ai.cast("string"), F.lit(" AI)"))).otherwise(""),
            F.lit(" (independence −"), penalty.cast("string"), F.lit(")."))),
    ]
    rationale = F.filter(F.array(*said), lambda s: s.isNotNull())
    calm = F.array(F.lit("All parts of the rubric are met and the integrity gate is passed."))
    rounded = F.transform("_components", lambda c: F.struct(
        c["name"].alias("name"), d.js_round(c["raw"], 1).alias("raw"), c["weight"].alias("weight"),
        d.js_round(c["raw"] * c["weight"], 1).alias("weighted")))
    return df.select(
        SESSION, d.js_round(score, 1).alias("score"), d.letter(d.js_round(score, 1)).alias("letter"),
        F.when(second, 2).otherwise(1).alias("version"), rounded.alias("components"),
        d.js_round(raws["independence"], 1).alias("independence"), flagged.alias("flagged"), measured.alias("measured"),
        F.when(flagged, "integrity_queue").otherwise("grade").alias("routed_to"),
        F.when(F.size(rationale) == 0, calm).otherwise(rationale).alias("rationale"),
    )


def sorted_fields(value: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct in alphabetical order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        made = F.struct(*[sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNull(), F.lit(None)).otherwise(made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: sorted_fields(v, kind.elementType))
    return value


def canonical_json(df: DataFrame, column: str) -> Column:
    """Key-sorted JSON with nulls kept."""
    return F.to_json(sorted_fields(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})


def link_text(content_json: Column, prev_hash: Column) -> Column:
    previous = F.coalesce(F.concat(F.lit('"'), prev_hash, F.lit('"')), F.lit("null"))
    return F.concat(F.lit('{"content":'), content_json, F.lit(',"prev_hash":'), previous, F.lit("}"))


def attestation_hash(content_json: Column, prev_hash: Column) -> Column:
    return F.sha2(link_text(content_json, prev_hash), 256)


def build_chain(contents: DataFrame, key: str, position: str = "position", content: str = "content") -> DataFrame:
    """Hash chains, one per key: every hash covers its content and the hash before it.

    A hash chain is sequential by definition, so a key is walked in order, but batch by batch: the only thing
    kept between batches is the last hash of the current key.
    """
    ordered_rows = contents.select(key, position, content).repartition(key).sortWithinPartitions(key, position)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            previous, hashes = [], []
            for name, body in zip(batch[key], batch[content]):
                if name != current:
                    current, last = name, None
                before = "null" if last is None else f'"{last}"'
                previous.append(last)
                last = hashlib.sha256(f'{{"content":{body},"prev_hash":{before}}}'.encode()).hexdigest()
                hashes.append(last)
            yield batch.assign(prev_hash=previous, hash=hashes)

    schema = T.StructType(ordered_rows.schema.fields + [T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    return ordered_rows.mapInPandas(walk, schema)


def verify_chain(attestations: DataFrame, key: str, position: str = "position", content: str = "content") -> DataFrame:
    """Whether each chain holds, and the position of its first broken link.

    A link holds when its hash covers its content and stored predecessor, and the predecessor is the hash before it.
    """
    df = ordered.with_slices(attestations, [key], position)
    df = ordered.scan(df, [key], [position], {"_before": ordered.previous(F.col("hash"))})
    good = (attestation_hash(F.col(content), F.col("prev_hash")) == F.col("hash")) & F.col("prev_hash").eqNullSafe(F.col("_before.hash"))
    out = df.groupBy(key).agg(
        F.min(F.when(~F.coalesce(good, F.lit(False)), F.col(position))).alias("broken_at"), F.count(F.lit(1)).alias("links")
    )
    return out.withColumn("ok", F.col("broken_at").isNull())


def bundle(sessions: DataFrame, metrics: DataFrame, grades: DataFrame, objectives_board: DataFrame) -> DataFrame:
    """Scores and objective digests only: no commands, no output, scope redacted."""
    digests = objectives_board.groupBy(SESSION).agg(
        F.sort_array(F.collect_list(F.struct(
            "ordinal", "objective", "tactic", F.col("user_satisfied_by_seq").isNotNull().alias("satisfied"),
            F.col("user_satisfied_by_seq").alias("by_seq")))).alias("_d")
    ).select(SESSION, F.transform("_d", lambda x: x.dropFields("ordinal")).alias("evidence_digests"))
    independence = F.coalesce("independence_score", F.lit(0.0)) if "independence_score" in metrics.columns else F.lit(0.0)
    scores = metrics.select(SESSION, F.struct(
        "objective_coverage_pct", "technique_breadth", "efficiency_pct", "stealth_score", independence.alias("independence")
    ).alias("metrics_summary"))
    graded = grades.select(SESSION, F.struct(
        "score", "letter", "routed_to", F.col("flagged").alias("integrity_flag"), "components").alias("grade"))
    who = sessions.select(SESSION, F.struct(
        F.col(SESSION).alias("uuid"), t.redact_text(F.col("target_scope")).alias("target_scope"), "started_at", "ended_at"
    ).alias("session"))
    df = who.join(scores, SESSION).join(graded, SESSION).join(digests, SESSION, "left")
    return df.select(SESSION, F.struct(
        F.lit("1.0").alias("schema_version"), "session", "grade", "metrics_summary", "evidence_digests",
        F.lit("manager").alias("redaction_profile")).alias("content"))
