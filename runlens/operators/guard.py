"""Screening of proposed hint texts: shape, leaked artifacts, unrevealed objectives, unseen tools."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import rules
from runlens.functions import text as t
from runlens.schemas import SESSION

# fixed values: characters that render as nothing
INVISIBLE = (
    "[­͏؀-؅؜۝܏࢐࢑࣢ᅟᅠ឴឵᠋-᠏​-‏‪-‮"
    "⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ￹-￻\U000110bd\U000110cd\U00013430-\U0001343f"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f\U000e0100-\U000e01ef]"
)


@F.pandas_udf(T.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    """Compatibility-normalized text; there is no SQL function for it. Plain ASCII stays as it is."""
    wide = texts.str.contains(r"[^\x00-\x7f]", na=False)
    return texts.mask(wide, texts[wide].str.normalize("NFKC")) if wide.any() else texts


def _escaped(term: Column) -> Column:
    return F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def contains_word(lowered: Column, term: Column) -> Column:
    """The term or its plural, not inside another word."""
    return F.regexp_like(lowered, F.concat(F.lit("(?<![a-z0-9])"), _escaped(term), F.lit("(?:e?s)?(?![a-z0-9])")))


def _mixed_token(text: Column) -> Column:
    def classes(word: Column) -> Column:
        core = F.regexp_replace(word, r"^[^\w]+|[^\w]+\z", "")
        kinds = [core.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", r"\d", "[^A-Za-z0-9]")]
        return (F.length(core) >= 8) & (kinds[0] + kinds[1] + kinds[2] + kinds[3] >= 3)

    return F.exists(t.tokens(text), classes)


def screen_hints(
    hints: DataFrame, objectives_board: DataFrame, episodes: DataFrame, tools_of: list[str] = rules.HINT_TOOLS,
    stopwords: list[str] = rules.HINT_STOPWORDS, artifacts: list[tuple[str, str]] = rules.HINT_ARTIFACTS,
) -> DataFrame:
    """Add ``ok``, the folded ``text`` and the first failing ``reason``. The word lists and patterns can be replaced.

    ``hints(hint_id, session_uuid, hint, kind, tier)``. Per session only the terms that could matter are kept of
    what was seen, so the lookup stays as small as the term lists.
    """
    words = F.concat(F.split("objective", "_"), "satisfied_by", F.coalesce("techniques", F.array().cast("array<string>")))
    usable = F.filter(
        F.transform(words, F.lower), lambda w: (F.length(w) >= 4) & ~w.isin(list(stopwords))
    )
    open_goals = objectives_board.where("user_satisfied_by_seq is null").select(SESSION, "ordinal", F.posexplode(usable).alias("at", "term"))
    golden_tools = objectives_board.select(
        SESSION, (F.col("ordinal") + 1).alias("ordinal"), F.posexplode(F.transform("satisfied_by", F.lower)).alias("at", "term")
    )
    sessions = hints.select(SESSION).distinct()
    listed = F.array(*[F.struct(F.lit(0).alias("ordinal"), F.lit(i).alias("at"), F.lit(x).alias("term")) for i, x in enumerate(tools_of)])
    known_tools = sessions.select(SESSION, F.explode(listed).alias("k")).select(SESSION, "k.*")
    tools = known_tools.unionByName(golden_tools.join(sessions, SESSION, "left_semi"))
    goals = open_goals.join(sessions, SESSION, "left_semi")
    wanted = goals.select(SESSION, "term").unionByName(tools.select(SESSION, "term")).distinct()
    said = episodes.join(sessions, SESSION, "left_semi").select(
        SESSION, F.explode(t.seen_terms(F.concat_ws(" ", F.coalesce("cmd", F.lit("")), F.coalesce("output_digest", F.lit(""))))).alias("term")
    ).distinct()
    seen = wanted.join(said, [SESSION, "term"], "left_semi")
    fresh = lambda df, name: df.join(seen, [SESSION, "term"], "left_anti").groupBy(SESSION).agg(
        F.transform(F.sort_array(F.collect_set(F.struct("ordinal", "at", "term"))), lambda x: x["term"]).alias(name)
    )
    df = hints.join(fresh(goals, "_goals"), SESSION, "left").join(fresh(tools, "_tools"), SESSION, "left")
    df = df.withColumn("text", t.trim(F.regexp_replace(fold_text(F.col("hint")), INVISIBLE, "")))
    text, kind, tier = F.col("text"), F.col("kind"), F.col("tier")
    lowered = F.lower(text)
    first_word = lambda terms: F.get(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda w: contains_word(lowered, w)), 0)
    shape = (
        F.when(text.isNull() | (text == ""), "shape: missing or empty hint")
        .when(kind.isNull() | ~kind.isin("process", "area", "technique"), "shape: bad kind")
        .when(F.length(text) > rules.HINT_MAX_CHARS, "shape: too long")
        .when(F.size(t.tokens(text)) > rules.HINT_MAX_WORDS, "shape: too many words")
        .when(text.rlike(r"(?![A-Za-z])\p{L}|\p{M}"), "shape: non-ascii letter")
        .when((tier == 1) & (kind != "process"), "shape: tier 1 requires process")
        .when((tier == 2) & (kind == "technique"), "shape: tier 2 forbids technique")
    )
    leak = None
    for name, pattern in artifacts:
        leak = (F if leak is None else leak).when(text.rlike(t.rx(pattern)), f"artifacts: {name}")
    leak = leak.when(_mixed_token(text), "artifacts: secret-like token")
    goal, tool = first_word(F.col("_goals")), first_word(F.col("_tools"))
    reason = F.coalesce(
        shape, leak, F.when(goal.isNotNull(), F.concat(F.lit("golden: "), goal)),
        F.when((tier == 1) & tool.isNotNull(), F.concat(F.lit("tierOneTools: "), tool)),
    )
    return df.withColumn("reason", reason).select("hint_id", SESSION, "text", "kind", "tier", F.col("reason").isNull().alias("ok"), "reason")
