"""Mixing sources to target weights by hash-random order and prefix sums.

Each row gets a random key from a hash of its id. The key's top bits cut a source into fixed ranges; sizes are summed per
range, then along the ranges of a source, then within a range, so the largest source is as spread as any. Cutting the
running sum at the source's budget takes whole epochs first and then exactly the rest.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm import common

RANGES = 1024  # of the random key within a source
WEIGHTS = (5, 2, 1)
_WORD = re.compile(f"[^{common.SEPARATORS}]+")


def sized(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and size: how many words the text has (null: 0)."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches):
        for batch in batches:
            n = common.word_counts(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "size"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(count, f"{kinds}, size long")


def targets(rows: DataFrame, source: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target. Sources by code point, null last, take the weights in turn.

    All targets together are `share` of all sizes. A target stops at `most` times its source's size; the excess goes to
    the others by weight until none is above. A level says how much one unit of weight gets; each round two sums (of
    the stopped targets and of the weights still open) give the next level, until no further source stops.
    """
    sizes = rows.groupBy(source).agg(F.sum("size").alias("source_size"))
    # One row per source name. The names are ranked by their UTF-8 bytes, which sort as code points do.
    place = F.row_number().over(Window.orderBy(F.col(source).isNull(), F.col(source))) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sizes = common.saved(sizes.withColumn("weight", F.get(turn, F.pmod(place, F.lit(len(weights))))), "sources")
    total = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    limit, level, stopped = F.col("source_size") * most, 0.0, -1
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        held, open_weight, n = sizes.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == stopped or not open_weight:
            break
        level, stopped = (total - (held or 0.0)) / open_weight, n
    return sizes.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")) if open_weight else limit)


def mix(rows: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """Adds source_size, target and taken (words that the mix takes of the row, repeats counted) to rows with a size.

    Give it a written table; it is read twice. taken adds up to the whole words of the target in each source. Null ids
    and null sources are ordinary values; repeated rows are rows of their own and interchangeable; a source without words
    takes nothing; an empty table gives an empty result. Same rows, same result, in any order and partitioning.
    """
    goals = targets(rows, source, **options).select(F.col(source).alias("_source"), "source_size", "target")
    random = F.xxhash64(F.lit("mix"), F.col(key).cast("string"))
    rows = rows.withColumn("_key", random).withColumn("_range", F.shiftrightunsigned("_key", 64 - RANGES.bit_length() + 1).cast("int"))
    others = [c for c in rows.columns if c not in ("_key", "_range", "size", key, source)]
    order = ["_key", F.col(key), "size", *([F.xxhash64(*others)] if others else [])]
    placed = common.add_prefix(rows, [source], "_range", order, F.col("size"), "_start").drop("_key", "_range")
    placed = placed.join(goals, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return placed.withColumn("taken", (epochs * F.col("size") + part).cast("long")).drop("_start")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Key, source, size, source_size, target and taken of every document; see `mix`."""
    return mix(common.saved(sized(docs, [key, source], text), "sizes"), key, source, **options)


@F.pandas_udf(T.StringType())
def head(texts: pd.Series, n: pd.Series) -> pd.Series:
    """The text up to the end of its n-th word."""
    def cut(text, k):
        at = next(islice(_WORD.finditer(text), k - 1, None), None) if text and k > 0 else None
        return text[: at.end()] if at else ""

    return pd.Series([cut(t, k) for t, k in zip(texts, n)], dtype=object)


def repeated(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents as the mix takes them: whole copies, then the first words of the text for a part; all columns.

    Rows with equal text and source that are repeated share evenly what they take, whole words each.
    """
    identity = F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))])
    own, same, size, taken, copy = common.free_names(docs, "own", "same", "size", "taken", "copy")
    rows = docs.withColumn(own, identity)
    decided = mixed(rows, own, source, text, **options)
    takes = decided.groupBy(F.col(own).alias(same)).agg(F.max("size").alias(size), F.expr("sum(taken) div count(*)").alias(taken)).where(F.col(taken) > 0)
    rows = rows.join(takes, F.col(own) == F.col(same))
    copies, part = F.floor(F.col(taken) / F.col(size)).cast("int"), (F.col(taken) % F.col(size)).cast("int")
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), copies + F.when(part > 0, 1).otherwise(0))))
    return rows.withColumn(text, F.when(F.col(copy) > copies, head(F.col(text), part)).otherwise(F.col(text))).select(*docs.columns)
