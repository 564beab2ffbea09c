"""Alignment of sessions to a graph of intended objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.operators import ordered
from runlens.operators.metrics import is_running
from runlens.rules import LOW_YIELD
from runlens.schemas import SESSION


def low_yield() -> Column:
    said = F.coalesce(F.col("output_digest").rlike(t.rx(LOW_YIELD)), F.lit(False))
    return F.coalesce(F.col("exit_code") != 0, F.lit(False)) | said


def methods(satisfied_by: Column) -> Column:
    """Parsed methods: position, tool name, and the flags a command must carry."""
    def parse(method: Column, i: Column) -> Column:
        words = t.tokens(F.lower(method))
        return F.struct(
            i.cast("int").alias("idx"),
            t.strip_path(F.get(words, 0)).alias("tool"),
            F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: w.startswith("-")).alias("flags"),
        )

    return F.filter(F.transform(satisfied_by, parse), lambda m: m["tool"].isNotNull())


def session_objectives(session_golden: DataFrame, golden: DataFrame) -> DataFrame:
    """Objectives of every session: ``session_golden(session_uuid, golden_id)`` joined to the ladder table."""
    return session_golden.select(SESSION, "golden_id").join(golden, "golden_id").drop("golden_id")


#: Distinct objectives of all ladders up to which they are broadcast; more are met through an index of their tokens.
MOST_BROADCAST = 10_000
_DEFINITION = ["tactic", "satisfied_by", "techniques"]


def candidates(episodes: DataFrame, objectives: DataFrame, ladders: DataFrame | None = None, most: int = MOST_BROADCAST) -> DataFrame:
    """Episodes that could satisfy each objective, with the position of the matching method.

    A listed technique counts as position 0. Commands meet the distinct objectives of all ladders (``ladders``; without it
    those of ``objectives``) first, where they are: the ladders are counted and broadcast, or, if there are more than
    ``most``, joined on (tactic, token) through the tools and techniques that they name. Only the pairs that fit go on to
    the sessions' own objectives.
    """
    known = (objectives if ladders is None else ladders).select(*_DEFINITION).distinct()
    steps = known.select(
        F.struct(*_DEFINITION).alias("_of"), "tactic", methods(F.col("satisfied_by")).alias("_methods"),
        F.transform(F.coalesce("techniques", F.array().cast("array<string>")), F.upper).alias("_techniques"),
    )
    words = t.tokens(F.lower("cmd"))
    commands = episodes.where(is_running() | (F.col("cmd") != "")).select(
        SESSION, "seq", "tactic", F.upper(F.coalesce("technique", F.lit(""))).alias("_technique"), words.alias("_words"),
        F.array_append(F.transform(words, t.strip_path), F.lower("binary")).alias("_names"),
    )
    if known.limit(most + 1).count() <= most:
        joined = commands.join(F.broadcast(steps), "tactic")
    else:
        marked = lambda mark, names: F.transform(names, lambda x: F.concat(F.lit(mark), x))
        index = steps.select("*", F.explode(F.array_distinct(F.concat(marked("m", F.col("_methods.tool")), marked("t", F.col("_techniques"))))).alias("_token"))
        tokens = F.array_distinct(F.filter(F.concat(marked("m", F.col("_names")), F.array(F.concat(F.lit("t"), "_technique"))), lambda x: x.isNotNull()))
        joined = commands.withColumn("_token", F.explode(tokens)).join(index, ["tactic", "_token"])
    by_technique = (F.col("_technique") != "") & F.array_contains(F.col("_techniques"), F.col("_technique"))
    fitting = F.filter(
        "_methods",
        lambda m: F.array_contains(F.col("_names"), m["tool"]) & (F.size(F.array_except(m["flags"], F.col("_words"))) == 0),
    )
    idx = F.when(by_technique, 0).otherwise(F.array_min(F.transform(fitting, lambda m: m["idx"])))
    fits = t.once(joined, "method_idx", idx).where("method_idx is not null").select(F.col(SESSION).alias("_session"), "seq", "_of", "method_idx").distinct()
    own = objectives.select(SESSION, "ordinal", "objective", *_DEFINITION)
    same = F.col(SESSION) == F.col("_session")
    for name in _DEFINITION:
        same = same & F.col(name).eqNullSafe(F.col(f"_of.{name}"))
    return fits.join(own, same).select(SESSION, "ordinal", "objective", "seq", "method_idx")


def claims(episodes: DataFrame, objectives: DataFrame, ladders: DataFrame | None = None) -> DataFrame:
    """Greedy claims: objectives in order each take their earliest episode that is still free.

    At most ``ordinal`` episodes are taken before an objective, so its first ``ordinal + 1`` candidates
    suffice. That bounds what is folded per session by the size of the ladder, not of the session.
    """
    rank = F.row_number().over(Window.partitionBy(SESSION, "ordinal").orderBy("seq"))
    near = (
        candidates(episodes, objectives, ladders)
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("ordinal") + 1)
    )
    packed = near.groupBy(SESSION).agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "seq", "method_idx", "objective"))).alias("_c")
    )
    empty = F.expr("cast(array() as array<struct<ordinal:int,seq:bigint,method_idx:int,objective:string>>)")
    fold = F.aggregate(
        "_c",
        empty,
        lambda taken, c: F.when(
            F.exists(taken, lambda x: (x["ordinal"] == c["ordinal"]) | (x["seq"] == c["seq"])), taken
        ).otherwise(F.array_append(taken, c)),
    )
    return packed.select(SESSION, F.explode(fold).alias("c")).select(
        SESSION, "c.ordinal", "c.objective", "c.seq", "c.method_idx"
    )


def board(objectives: DataFrame, claimed: DataFrame) -> DataFrame:
    """Objectives with the sequence number that satisfied them, null where none did."""
    taken = claimed.select(SESSION, "ordinal", F.col("seq").alias("user_satisfied_by_seq"), "method_idx")
    return objectives.join(taken, [SESSION, "ordinal"], "left")


def early_satisfiers(objectives_board: DataFrame) -> DataFrame:
    """(session, seq) of satisfiers that came before the satisfier of something they depend on."""
    own = objectives_board.where(F.col("user_satisfied_by_seq").isNotNull())
    edges = own.select(SESSION, F.col("user_satisfied_by_seq").alias("seq"), F.explode("depends_on").alias("objective"))
    needed = own.select(SESSION, "objective", F.col("user_satisfied_by_seq").alias("_dep"))
    return edges.join(needed, [SESSION, "objective"]).where(F.col("seq") < F.col("_dep")).select(SESSION, "seq").distinct()


def mark(episodes: DataFrame, objectives_board: DataFrame) -> DataFrame:
    """Episodes with ``alignment`` and ``loop_of_seq``, given the board of their claims."""
    claimed = objectives_board.where("user_satisfied_by_seq is not null").select(
        SESSION, F.col("user_satisfied_by_seq").alias("seq"), "method_idx"
    )
    early = early_satisfiers(objectives_board).withColumn("_early", F.lit(True))
    marks = claimed.join(early, [SESSION, "seq"], "left")
    df = ordered.with_slices(episodes, [SESSION], "seq").join(marks, [SESSION, "seq"], "left")
    return _fill_alignment(df)


def align(episodes: DataFrame, objectives: DataFrame, ladders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Aligned episodes and the objective board."""
    objectives_board = board(objectives, claims(episodes, objectives, ladders))
    return mark(episodes, objectives_board), objectives_board


def align_without_path(episodes: DataFrame) -> DataFrame:
    """Loop, detour and alternative marks for sessions that have no intended path."""
    df = ordered.with_slices(episodes, [SESSION], "seq")
    return _fill_alignment(
        df.withColumn("method_idx", F.lit(None).cast("int")).withColumn("_early", F.lit(None).cast("boolean"))
    )


def _fill_alignment(df: DataFrame) -> DataFrame:
    running = is_running()
    df = df.withColumn("_claimed", F.col("method_idx").isNotNull()).withColumn("_failed", low_yield())
    look = F.when(running, F.struct("seq", "binary", "_claimed", "_failed"))
    df = ordered.scan(df, [SESSION], ["seq"], {
        "_prev": ordered.last_seen(look, inclusive=False), "_next": ordered.next_seen(look, inclusive=False),
    })
    open_row = running & ~F.col("_claimed")
    retried = open_row & F.col("_failed") & F.coalesce(F.col("_next.binary") == F.col("binary"), F.lit(False))
    # The previous row of the same tool is itself a loop unless it was claimed or had worked.
    prev_free = F.col("_prev._claimed") | ~F.col("_prev._failed")
    repeats = open_row & F.col("_failed") & F.coalesce((F.col("_prev.binary") == F.col("binary")) & prev_free, F.lit(False))
    loop = F.when(retried, F.col("_next.seq")).when(repeats, F.col("_prev.seq"))
    alignment = (
        F.when(F.col("_claimed") & F.coalesce("_early", F.lit(False)), "out_of_order")
        .when(F.col("_claimed") & (F.col("method_idx") == 0), "match")
        .when(F.col("_claimed"), "alternative")
        .when(~running | loop.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_failed"), "detour")
        .otherwise("alternative")
    )
    return df.withColumn("loop_of_seq", loop).withColumn("alignment", alignment).drop(
        "method_idx", "_early", "_claimed", "_failed", "_prev", "_next"
    )


ROOT_PROOF = r"\buid=0\b|\beuid=0\b|(^|\n)\s*root\s*(\r?\z|\n)"


def finding_links(findings: DataFrame, uses: DataFrame) -> DataFrame:
    """(session, seq, id) for the step that produced a finding and every step that used it."""
    made = findings.select(SESSION, F.col("source_seq").alias("seq"), "id")
    used = uses.select(SESSION, F.col("used_seq").alias("seq"), "id")
    return made.unionByName(used).distinct()


def objective_status(episodes: DataFrame, objectives_board: DataFrame, findings: DataFrame, uses: DataFrame) -> DataFrame:
    """Status, finding references and proof of every objective."""
    facts = findings.select(SESSION, "id", "kind", "source_seq", F.coalesce("proven", F.lit(False)).alias("proven"))
    wanted = objectives_board.where("user_satisfied_by_seq is not null").select(SESSION, F.col("user_satisfied_by_seq").alias("seq"))
    links = finding_links(findings, uses).join(wanted, [SESSION, "seq"], "left_semi").join(facts, [SESSION, "id"])
    flagged = F.when((F.col("kind") == "flag") & F.col("proven"), F.struct("source_seq", "id"))
    at_seq = links.groupBy(SESSION, F.col("seq").alias("user_satisfied_by_seq")).agg(
        F.sort_array(F.collect_list(F.struct("source_seq", "id"))).alias("_refs"), F.min(flagged).alias("_flag")
    )
    tried = episodes.groupBy(SESSION, "tactic").agg(
        F.bool_or((F.coalesce(F.col("alignment") == "detour", F.lit(False))) | F.col("loop_of_seq").isNotNull()).alias("_tried")
    )
    rooted = episodes.where(F.coalesce(F.col("output_digest").rlike(t.rx(ROOT_PROOF)), F.lit(False))).select(
        SESSION, F.col("seq").alias("_root_seq")
    )
    wants_root = (F.col("tactic") == "TA0004") & F.col("objective").rlike("(?i)root|admin|system")
    proofs = (
        objectives_board.where(wants_root & F.col("user_satisfied_by_seq").isNotNull())
        .select(SESSION, "ordinal", "user_satisfied_by_seq")
        .join(rooted, SESSION)
        .where(F.col("_root_seq") >= F.col("user_satisfied_by_seq"))
        .groupBy(SESSION, "ordinal")
        .agg(F.min("_root_seq").alias("_proof"))
    )
    df = (
        objectives_board.join(at_seq, [SESSION, "user_satisfied_by_seq"], "left")
        .join(tried, [SESSION, "tactic"], "left")
        .join(proofs, [SESSION, "ordinal"], "left")
    )
    proven = F.coalesce(F.col("_flag.source_seq"), F.col("_proof"))
    met = F.col("user_satisfied_by_seq").isNotNull()
    status = (
        F.when(met & proven.isNotNull(), "proven").when(met, "reached")
        .when(F.coalesce("_tried", F.lit(False)), "attempted").otherwise("untouched")
    )
    refs = F.coalesce(F.transform("_refs", lambda r: r["id"]), F.array().cast("array<string>"))
    return (
        df.withColumn("status", status)
        .withColumn("finding_refs", refs)
        .withColumn("proven_by_seq", F.when(met, proven))
        .drop("_refs", "_flag", "_tried", "_proof")
    )


def coverage(objectives_board: DataFrame) -> DataFrame:
    return objectives_board.groupBy(SESSION).agg(
        (F.count("user_satisfied_by_seq") / F.count(F.lit(1)) * 100).alias("objective_coverage_pct")
    )


def route_steps(objectives_board: DataFrame, episodes: DataFrame) -> DataFrame:
    used = episodes.select(SESSION, F.col("seq").alias("user_satisfied_by_seq"), "alignment", "binary")
    df = objectives_board.join(used, [SESSION, "user_satisfied_by_seq"], "left")
    status = (
        F.when(F.col("user_satisfied_by_seq").isNull(), "skipped")
        .when(F.col("alignment").isin("alternative", "out_of_order"), F.col("alignment"))
        .otherwise("match")
    )
    return df.select(
        SESSION, "ordinal", "objective", status.alias("status"), F.col("user_satisfied_by_seq").alias("seq"),
        F.get("satisfied_by", 0).alias("suggestion"), "binary",
    )


def route_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy(SESSION).agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("match", "alternative", "out_of_order", "skipped")]
    )
