"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word separators of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one gets its own; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="run-"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that the table doesn't have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while f"_{name}" in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def words(text: Column) -> Column:
    """Maximal runs of characters that are no separators, in order; null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SEPARATORS[1:], " " * (len(SEPARATORS) - 1))
    return F.array_remove(F.split(plain, " "), "")


_is_word_byte = np.ones(256, dtype=bool)
_is_word_byte[[ord(c) for c in SEPARATORS]] = False


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts and ends in it. Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; a word never crosses the end of its text."""
    inside = _is_word_byte[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(raw), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(raw), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending byte positions fall into each text."""
    return np.diff(np.searchsorted(marks, offsets))


def word_counts(texts: pa.Array) -> np.ndarray:
    raw, offsets = bytes_of(texts)
    return per_text(word_bounds(raw, offsets)[0], offsets)


def add_prefix(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier rows of the group, rows ordered by bucket and then by `order`.

    Buckets are cut by a uniform hash, so no group is ever sorted in one task: totals per (group, bucket) are summed
    first (at most one row per bucket and group), then rows are summed within their bucket. Rows that tie in the whole
    order are interchangeable.
    """
    rows = df.withColumn("_value", value)
    totals = rows.groupBy(*group, bucket).agg(F.sum("_value").alias("_total"))
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    match = (F.col(bucket) == F.col("_b"))
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    drop = ["_value", "_inner", "_before", "_b", *[f"_g{i}" for i in range(len(group))]]
    return rows.join(totals, match, "left").withColumn(name, F.col("_inner") + F.col("_before")).drop(*drop)
