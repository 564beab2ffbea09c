"""Session-level helpers shared by all modules."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_ROWS_CONF = "spark.runlens.sliceRows"
DEFAULT_SLICE_ROWS = 1_000_000


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the engine relies on; a cluster may set them in its own defaults instead."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )


def slice_rows(spark: SparkSession) -> int:
    """Rows of one session above which its timeline is cut into slices."""
    return int(spark.conf.get(SLICE_ROWS_CONF, str(DEFAULT_SLICE_ROWS)))


def table_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small rule table as a local relation, so its size is known and the optimizer can broadcast it."""
    struct = T._parse_datatype_string(schema)
    names = [f.name for f in struct.fields]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)
    table = pa.table(
        {n: pa.array(list(c), type=arrow.field(n).type) for n, c in zip(names, columns)}, schema=arrow
    )
    return spark.createDataFrame(table, schema=struct)


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a local session without one gets a folder of its own; a cluster
    has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="run-")
    return _local_folders[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several operators read, and go on from the files.

    The files keep columns apart, so every reader prunes to what it needs, and a lost executor recomputes from
    them instead of from the source.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/staged/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
