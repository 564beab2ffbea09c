"""Intended paths: ladders, depth and lineage, and paths read from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens import rules
from runlens.functions import text as t
from runlens.operators import ordered
from runlens.schemas import GOLDEN, SESSION
from runlens.session import table_of


def ladders(spark: SparkSession) -> DataFrame:
    """The two fallback paths, ``host`` and ``web``, in the golden table layout."""
    rows = []
    for golden_id, ladder in (("host", rules.HOST_LADDER), ("web", rules.WEB_LADDER)):
        for ordinal, (objective, tactic, satisfied_by, techniques, depends_on) in enumerate(ladder):
            rows.append((golden_id, ordinal, objective, tactic, satisfied_by, techniques, depends_on))
    return table_of(spark, rows, GOLDEN)


def is_web_run(episodes: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session, golden_id): the web ladder for web sessions or a majority of web episodes, else the host ladder."""
    web = F.coalesce(F.lower("context_path").startswith("web"), F.lit(False)).cast("int")
    df = episodes.groupBy(SESSION).agg(F.avg(web).alias("_share"))
    said = F.lit(False)
    if sessions is not None:
        df = df.join(sessions.select(SESSION, F.lower("context_path").startswith("web").alias("_said")), SESSION, "left")
        said = F.coalesce("_said", F.lit(False))
    return df.select(SESSION, F.when(said | (F.col("_share") > 0.5), "web").otherwise("host").alias("golden_id"))


def with_lineage(golden: DataFrame, key: str = "golden_id") -> DataFrame:
    """Add ``depth`` (longest dependency chain) and ``lineage_tactics`` (own and ancestors' tactics).

    Works on the objectives of one path as an array, a few dozen at most, relaxed as many times as there
    are objectives, so the authored order does not matter.
    """
    node = F.struct("ordinal", "objective", "tactic", F.coalesce("depends_on", F.array().cast("array<string>")).alias("deps"))
    packed = golden.groupBy(key).agg(F.sort_array(F.collect_list(node)).alias("_nodes"))
    start = F.transform("_nodes", lambda n: F.struct(n["objective"].alias("objective"), F.lit(0).alias("depth"), F.array(n["tactic"]).alias("tactics")))

    def relax(state: Column, _round: Column) -> Column:
        def step(n: Column) -> Column:
            parents = F.filter(state, lambda s: F.array_contains(n["deps"], s["objective"]))
            depth = F.coalesce(F.array_max(F.transform(parents, lambda s: s["depth"])) + 1, F.lit(0))
            tactics = F.array_distinct(
                F.concat(F.array(n["tactic"]), F.flatten(F.transform(parents, lambda s: s["tactics"])))
            )
            return F.struct(n["objective"].alias("objective"), depth.alias("depth"), tactics.alias("tactics"))

        return F.transform(F.col("_nodes"), step)

    rounds = F.sequence(F.lit(1), F.size("_nodes"))
    solved = packed.select(key, F.explode(F.arrays_zip(
        F.transform("_nodes", lambda n: n["ordinal"]).alias("o"), F.aggregate(rounds, start, relax).alias("s")
    )).alias("z"))
    side = solved.select(
        key, F.col("z.o").alias("ordinal"), F.col("z.s.depth").alias("depth"), F.col("z.s.tactics").alias("lineage_tactics")
    )
    return golden.join(side, [key, "ordinal"])


def check_order(golden: DataFrame) -> DataFrame:
    """Dependencies that do not name an earlier objective of the same path."""
    edges = golden.select("golden_id", "ordinal", "objective", F.explode("depends_on").alias("depends_on"))
    nodes = golden.select("golden_id", F.col("objective").alias("depends_on"), F.col("ordinal").alias("_at"))
    earlier = nodes.groupBy("golden_id", "depends_on").agg(F.min("_at").alias("_at"))
    return edges.join(earlier, ["golden_id", "depends_on"], "left").where(
        F.col("_at").isNull() | (F.col("_at") >= F.col("ordinal"))
    ).select("golden_id", "objective", "depends_on")


def from_writeups(writeups: DataFrame, key: str, text: str, detectors: list | None = None, most: int | None = None) -> DataFrame:
    """Objectives named in a write-up, in order of first mention, each depending on the one before.

    One hit is not a path; confidence grows with the number of hits up to one half. ``most`` keeps the first so many.
    """
    rows = detectors or rules.WRITEUP_DETECTORS
    hits = F.filter(
        F.array(*[
            F.struct(
                F.regexp_instr(F.col(text), F.lit(t.rx(pattern))).alias("at"), F.lit(order).alias("order"),
                F.lit(objective).alias("objective"), F.lit(tactic).alias("tactic"), F.lit(method).alias("method"),
            )
            for order, pattern, objective, tactic, method in rows
        ]),
        lambda h: h["at"] > 0,
    )
    found = F.sort_array(hits) if most is None else F.slice(F.sort_array(hits), 1, most)
    confidence = F.least(F.lit(0.5), 0.25 + F.size("_f") * 0.05)
    df = writeups.select(key, found.alias("_f")).where(F.size("_f") >= 2)
    return df.select(key, confidence.alias("confidence"), "_f", F.posexplode("_f").alias("ordinal", "h")).select(
        F.col(key).alias("golden_id"), "ordinal", "h.objective", "h.tactic", F.array("h.method").alias("satisfied_by"),
        F.array().cast("array<string>").alias("techniques"),
        F.when(F.col("ordinal") > 0, F.array(F.get("_f", F.col("ordinal") - 1)["objective"]))
        .otherwise(F.array().cast("array<string>")).alias("depends_on"),
        "confidence",
    )


TASK_HEADER = r"(?i)^\s*Task\s+\d+\b[.:]?\s*(.*)\z"


def from_task_lists(texts: DataFrame, key: str, text: str, most_chars: int | None = None) -> DataFrame:
    """Objectives from pasted task lists: one per ``Task N`` section, tactic by keyword, linear dependencies.

    ``most_chars`` shortens names; whole titles are kept otherwise, so two long ones stay apart.
    """
    pattern = t.rx(TASK_HEADER)
    lines = texts.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("_head", F.col("line").rlike(pattern))
    lines = ordered.with_slices(lines, [key], "line_no")
    lines = ordered.scan(lines, [key], ["line_no"], {"task_no": ordered.running_sum(F.col("_head").cast("int"))})
    title = F.when(F.col("_head"), t.trim(F.regexp_extract("line", pattern, 1)))
    body = F.when(~F.col("_head"), F.concat(F.lit(" "), t.trim_ends(F.col("line"))))
    # The tactic looks at title and body together; a keyword never spans lines, so testing each line alone is enough.
    spoken = F.coalesce(title, body)
    tests = [F.max(F.col("_said").rlike(t.rx(p)).cast("int")).alias(f"_k{i}") for i, (p, _t, _m) in enumerate(rules.TASK_TACTICS)]
    tasks = lines.where("task_no > 0").withColumn("_said", spoken).groupBy(key, "task_no").agg(
        F.max(title).alias("title"), *tests
    )
    tactic, method = F.lit("TA0002"), F.lit("manual")
    for i, (_p, tac, tool) in reversed(list(enumerate(rules.TASK_TACTICS))):
        tactic = F.when(F.col(f"_k{i}") == 1, tac).otherwise(tactic)
        method = F.when(F.col(f"_k{i}") == 1, tool).otherwise(method)
    fallback = F.concat(F.lit("task_"), F.col("task_no").cast("string"))
    base = F.when(F.col("title") != "", F.col("title")).otherwise(fallback)
    name = F.regexp_replace(F.regexp_replace(F.lower(base), r"\s+", "_"), "[^a-z0-9_]", "")
    name = name if most_chars is None else F.substr(name, F.lit(1), F.lit(most_chars))
    objective = F.when(name != "", name).otherwise(fallback)
    named = tasks.select(
        F.col(key).alias("golden_id"), F.col("task_no"), (F.col("task_no") - 1).cast("int").alias("ordinal"),
        objective.alias("objective"), tactic.alias("tactic"), F.array(method).alias("satisfied_by"),
        F.array().cast("array<string>").alias("techniques"),
    )
    many = named.groupBy("golden_id").agg(F.max("task_no").alias("_n")).where("_n >= 2").select("golden_id")
    before = named.select("golden_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("objective").alias("_before"))
    return named.join(many, "golden_id").join(before, ["golden_id", "ordinal"], "left").select(
        "golden_id", "ordinal", "objective", "tactic", "satisfied_by", "techniques",
        F.when(F.col("_before").isNotNull(), F.array("_before")).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )


def clean_objectives(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Normalize proposed objectives: slug ids, first of each id, known tactics, dangling deps dropped.

    Input: golden_id, position, objective, tactic, satisfied_by, depends_on. ``most`` keeps the first so many of a path.
    """
    methods = F.filter(F.transform("satisfied_by", t.trim), lambda m: m != "")
    df = rows.select(
        "golden_id", "position", t.slug(F.col("objective")).alias("objective"),
        F.when(F.upper(t.trim(F.col("tactic"))).isin(rules.KNOWN_TACTICS), F.upper(t.trim(F.col("tactic")))).otherwise("TA0002").alias("tactic"),
        methods.alias("satisfied_by"), F.transform(F.coalesce("depends_on", F.array().cast("array<string>")), t.slug).alias("depends_on"),
    ).where((F.col("objective") != "") & (F.size("satisfied_by") > 0))
    first = df.groupBy("golden_id", "objective").agg(
        F.min(F.struct("position", "tactic", "satisfied_by", "depends_on")).alias("r")
    ).select("golden_id", "objective", "r.*")
    rank = F.row_number().over(Window.partitionBy("golden_id").orderBy("position"))
    kept = first.withColumn("ordinal", rank - 1)
    kept = kept if most is None else kept.where(F.col("ordinal") < most)
    ids = kept.groupBy("golden_id").agg(F.collect_set("objective").alias("_ids"))
    return kept.join(ids, "golden_id").select(
        "golden_id", "ordinal", "objective", "tactic", "satisfied_by",
        F.array().cast("array<string>").alias("techniques"),
        F.filter("depends_on", lambda dep: F.array_contains(F.col("_ids"), dep)).alias("depends_on"),
    )


def reusable(sessions: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached paths to apply: session not live, no path of its own, a named source, not empty.

    ``sessions(session_uuid, live, has_path)``, ``cached(session_uuid, golden_id, source, objectives)``.
    """
    return sessions.join(cached, SESSION).where(
        ~F.col("live") & ~F.col("has_path") & (F.col("source") != "none") & (F.col("objectives") > 0)
    ).select(SESSION, "golden_id", "source")
