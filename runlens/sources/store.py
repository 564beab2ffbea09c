"""The normalized store: Parquet tables written from envelopes, and envelopes rebuilt from them.

Live envelopes are kept in generations: each micro-batch is one, and ``compact`` merges the older ones. A generation is laid
out by bucket of the session, and a manifest tells for each generation which buckets it has and in which folder. A reader
that wants some sessions opens the files of their buckets alone, however many batches there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.schemas import ENVELOPE, SESSION
from runlens.sources.envelopes import _at, _pick

TABLES = ["sessions", "commands", "output_blocks", "http_exchanges"]


def normalize(envelopes: DataFrame) -> dict[str, DataFrame]:
    """Store tables with first-wins keys; output is kept only for known commands, a response only for a known request.

    With a ``batch`` column (see ``read_batches``) known means by that batch: output or a response that came in an earlier
    batch than its command or request is dropped, and a response of a later batch completes the exchange.
    """
    if "batch" not in envelopes.columns:
        envelopes = envelopes.withColumn("batch", F.lit(0))
    place = F.struct(F.col(_at(envelopes)[0]), F.col("ts_utc_us"))
    sessions = envelopes.groupBy(SESSION).agg(
        F.min_by(F.struct(F.col("ts_utc_us").alias("started_at"), "source", F.col("provenance.platform").alias("platform")), place).alias("s")
    ).select(SESSION, "s.*")
    body = F.struct("ts_utc_us", "payload", "provenance", "batch")
    keys = [SESSION, "seq"]
    first = _pick(envelopes.where("kind = 'command'"), keys, "first", body)
    outputs = envelopes.where("kind in ('output', 'stdin_masked')")
    text = F.coalesce("payload.text", F.lit(""))
    known = first.select(*keys, F.col("r.batch").alias("_known"))
    outputs = outputs.join(known, keys).where(F.col("batch") >= F.col("_known"))
    blocks = outputs.select(
        *keys, F.col("ts_utc_us").alias("started_at"), text.alias("content"), F.col("payload.line_count").alias("line_count"),
        F.octet_length(text).alias("byte_count"), F.when(F.col("kind") == "stdin_masked", "masked").otherwise("clean").alias("fidelity"),
        *([c for c in ("line_at",) if c in envelopes.columns]),
    )
    ended = outputs.groupBy(*keys).agg(F.max_by("ts_utc_us", place).alias("ended_at"))
    cmd = F.coalesce("r.payload.cmd", F.lit(""))
    commands = first.join(ended, keys, "left").select(
        *keys, cmd.alias("raw_command"), F.get(F.split(F.trim(cmd), r"\s+"), 0).alias("binary"), F.col("r.ts_utc_us").alias("started_at"),
        "ended_at", F.col("r.payload.exit_code").alias("exit_code"), F.col("r.provenance.boundary_confidence").alias("boundary_confidence"),
        F.col("r.provenance.context_path").alias("context_path"),
    )
    paired = envelopes.withColumn("pair_id", F.col("payload.pair_id"))
    pkeys = [SESSION, "pair_id"]
    asked = _pick(paired.where("kind = 'http_request'"), pkeys, "first", body).withColumnRenamed("r", "q")
    answered = _pick(paired.where("kind = 'http_response'"), pkeys, "last", body).withColumnRenamed("r", "a")
    in_time = F.when(F.col("a.batch") >= F.col("q.batch"), F.col("a"))
    exchanges = asked.join(answered, pkeys, "left").withColumn("a", in_time).select(
        *pkeys, "q.payload.method", "q.payload.url", "q.payload.req_headers", "q.payload.req_body", "a.payload.status",
        "a.payload.resp_headers", "a.payload.resp_body", "a.payload.mime", F.col("q.ts_utc_us").alias("started_at"),
        F.col("a.ts_utc_us").alias("ended_at"), "q.provenance.context_path",
    )
    return {"sessions": sessions, "commands": commands, "output_blocks": blocks.drop("line_at"), "http_exchanges": exchanges}


def write_store(envelopes: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write the tables, partitioned by the day a session started and clustered by session."""
    tables = normalize(envelopes)
    days = tables["sessions"].select(SESSION, F.to_date(F.timestamp_micros("started_at")).alias("session_date"))
    for name in TABLES:
        dated = tables[name].join(days, SESSION)
        clustered = dated.repartitionByRange("session_date", SESSION, *[c for c in ("seq", "pair_id") if c in dated.columns])
        clustered.write.mode(mode).partitionBy("session_date").parquet(f"{folder}/{name}")


BUCKETS = 64  # of sessions, a file each in a batch; all generations of a store have the same number
_MANIFEST = "bucket int, rows bigint, first_us bigint, last_us bigint, kind string, upto bigint"


def _schema(*more: str) -> T.StructType:
    """An envelope, its batch and its order of arrival within the batch."""
    return T._parse_datatype_string(", ".join([ENVELOPE, "batch bigint", "row bigint", *more]))


def _kept() -> list[str]:
    return _schema().fieldNames()[:-2]


def bucket_of(session: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def _write_generation(rows: DataFrame, folder: str, kind: str, upto: int, buckets: int) -> None:
    """The rows by bucket, then their entry in the manifest: without it nobody reads them."""
    place = f"{folder}/{kind}/upto={upto}"
    rows = rows.withColumn("bucket", bucket_of(F.col(SESSION), buckets)).repartition("bucket").sortWithinPartitions("bucket", SESSION, "batch", "row")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(place)
    written = rows.sparkSession.read.schema(_schema("bucket int")).parquet(place)
    facts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("ts_utc_us").alias("first_us"), F.max("ts_utc_us").alias("last_us"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/kind={kind}/upto={upto}")


def write_batch(envelopes: DataFrame, folder: str, number: int, buckets: int = BUCKETS) -> None:
    """Keeps the envelopes of one micro-batch, numbered as they arrived. A batch that is replayed overwrites itself, and no
    earlier one is touched."""
    numbered = envelopes.select(*_kept(), F.lit(number).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("row"))
    _write_generation(numbered, folder, "batch", number, buckets)


def read_batch(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The envelopes of one batch as it was written."""
    return spark.read.schema(_schema()).parquet(f"{folder}/batch/upto={number}")


def batch_writer(folder: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that fills the store."""
    return lambda batch, number: write_batch(batch, folder, number, buckets)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The generations in force, a row for each of their buckets: the latest merged one and the batches after it."""
    found = spark.read.schema(_MANIFEST).option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest")
    merged = found.where("kind = 'merged'").agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("_upto"))
    return found.join(F.broadcast(merged)).where("case kind when 'merged' then upto = _upto else upto > _upto end").drop("_upto")


def read_batches(spark: SparkSession, folder: str, sessions: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The envelopes kept so far, with the batch they came in and their place of arrival; with ``sessions`` only theirs, and
    only files of their buckets are opened."""
    parts = manifest(spark, folder).select("kind", "upto", "bucket")
    if sessions is not None:
        touched = sessions.select(bucket_of(F.col(SESSION), buckets).alias("bucket")).distinct()
        parts = parts.join(touched, "bucket", "left_semi")
    # At most a row for each bucket of the merged generation and of each batch after it.
    paths = sorted(f"{folder}/{r['kind']}/upto={r['upto']}/bucket={r['bucket']}" for r in parts.collect())
    rows = spark.read.schema(_schema()).parquet(*paths) if paths else spark.createDataFrame([], _schema())
    rows = rows.withColumn("line_at", F.struct("batch", "row"))
    return rows if sessions is None else rows.join(sessions.select(SESSION).distinct(), SESSION, "left_semi")


def compact(spark: SparkSession, folder: str, upto: int, buckets: int = BUCKETS) -> None:
    """Merges everything up to batch ``upto`` into one generation, bucket by bucket.

    Repeats that no reader can see any more are left out: a command or request after the first of its key, and a response
    that is neither the first nor the last of its pair. Rows keep their batch and place of arrival, so tables made from
    the store stay the same. Files of earlier generations stay until ``vacuum``.
    """
    rows = read_batches(spark, folder, None, buckets).where(F.col("batch") <= upto)
    key = F.when(F.col("kind") == "command", F.col("seq").cast("string")).when(F.col("kind").isin("http_request", "http_response"), F.coalesce("payload.pair_id", F.lit("")))
    single = F.col("kind").isin("command", "http_request", "http_response")
    bounds = rows.where(single).groupBy(F.col(SESSION).alias("_s"), F.col("kind").alias("_kind"), key.alias("_key")).agg(F.min("line_at").alias("_first"), F.max("line_at").alias("_last"))
    marked = rows.where(single).withColumn("_key", key).join(bounds.withColumnRenamed("_key", "_k"), (F.col(SESSION) == F.col("_s")) & (F.col("kind") == F.col("_kind")) & (F.col("_key") == F.col("_k")))
    kept = marked.where((F.col("line_at") == F.col("_first")) | ((F.col("kind") == "http_response") & (F.col("line_at") == F.col("_last"))))
    out = kept.select(*_kept(), "batch", "row").unionByName(rows.where(~single).select(*_kept(), "batch", "row"))
    _write_generation(out, folder, "merged", upto, buckets)


def vacuum(spark: SparkSession, folder: str) -> None:
    """Removes the generations that a merged one has replaced, and their entries in the manifest. Run it when no reader
    that started before ``compact`` is left."""
    every = spark.read.schema(_MANIFEST).option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest").select("kind", "upto").distinct()
    current = manifest(spark, folder).select("kind", "upto").distinct()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in every.join(current, ["kind", "upto"], "left_anti").collect():  # a row for each generation
        for place in (f"{folder}/manifest/kind={row['kind']}/upto={row['upto']}", f"{folder}/{row['kind']}/upto={row['upto']}"):
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(conf).delete(path, True)


def read_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def export_envelopes(store: dict[str, DataFrame], session: str | None = None, every: bool = False) -> DataFrame:
    """Envelopes rebuilt in (time, seq, kind, pair) order for one session, by default the one that started last."""
    sessions = store["sessions"]
    if session is not None:
        chosen = sessions.where(F.col(SESSION) == session)
    elif every:
        chosen = sessions
    else:
        latest = sessions.agg(F.max_by(SESSION, F.struct("started_at", SESSION)).alias(SESSION))
        chosen = sessions.join(latest, SESSION, "left_semi")
    chosen = chosen.select(SESSION, F.coalesce("source", F.lit("local_pty")).alias("_source"), F.coalesce("platform", F.lit("local")).alias("_platform"))

    def envelope(df: DataFrame, kind, source, ts, seq, payload: dict, confidence, context) -> DataFrame:
        fields = [f.split(":")[0] for f in "cmd exit_code stream text line_count method url status req_headers req_body resp_headers resp_body mime pair_id".split()]
        types = {"exit_code": "bigint", "line_count": "bigint", "status": "bigint"}
        body = F.struct(*[payload.get(f, F.lit(None)).cast(types.get(f, "string")).alias(f) for f in fields])
        origin = F.struct(
            confidence.cast("double").alias("boundary_confidence"), F.lit(None).cast("string").alias("redaction_method"),
            context.cast("string").alias("context_path"), F.col("_platform").alias("platform"),
        )
        return df.select(source.alias("source"), SESSION, seq.cast("bigint").alias("seq"), ts.cast("bigint").alias("ts_utc_us"),
                         kind.alias("kind"), body.alias("payload"), origin.alias("provenance"))

    none = F.lit(None)
    commands = store["commands"].join(chosen, SESSION)
    out = envelope(commands, F.lit("command"), F.col("_source"), F.col("started_at"), F.col("seq"),
                   {"cmd": F.col("raw_command"), "exit_code": F.col("exit_code")}, F.col("boundary_confidence"), F.col("context_path"))
    blocks = store["output_blocks"].join(chosen, SESSION)
    kind = F.when(F.col("fidelity") == "masked", "stdin_masked").otherwise("output")
    out = out.unionByName(envelope(blocks, kind, F.col("_source"), F.col("started_at"), F.col("seq"),
                                   {"text": F.col("content"), "line_count": F.col("line_count")}, none, none))
    web = store["http_exchanges"].join(chosen, SESSION)
    request = {c: F.col(c) for c in ("pair_id", "method", "url", "req_headers", "req_body")}
    response = {c: F.col(c) for c in ("pair_id", "status", "resp_headers", "resp_body", "mime")}
    out = out.unionByName(envelope(web, F.lit("http_request"), F.lit("plugin"), F.coalesce("started_at", F.lit(0)), F.lit(0), request, F.lit(1.0), F.col("context_path")))
    out = out.unionByName(envelope(web, F.lit("http_response"), F.lit("plugin"), F.coalesce("ended_at", "started_at", F.lit(0)), F.lit(0), response, F.lit(1.0), F.col("context_path")))
    return out.orderBy("ts_utc_us", "seq", "kind", "payload.pair_id")


def store_summary(store: dict[str, DataFrame]) -> DataFrame:
    """Sessions with their commands, in listing order."""
    return store["sessions"].join(store["commands"].drop("started_at"), SESSION, "left").select(
        SESSION, "source", "started_at", "seq", "binary", F.coalesce(F.col("exit_code").cast("string"), F.lit("-")).alias("exit"), "raw_command"
    ).orderBy("started_at", SESSION, "seq")
