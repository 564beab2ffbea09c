"""Report sinks: schema-versioned JSON per session, in bounded parts or as one document written line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import ordered
from runlens.schemas import SESSION

SCHEMA_VERSION = "1.4"
PART_ROWS = 1000


def report_parts(sections: dict[str, tuple[DataFrame, str]], sessions: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(session_uuid, section, part, rows): JSON arrays of at most ``part_rows`` rows.

    ``sections`` maps a name to (table, ordering number column). The header section is the session row itself. No
    session is ever gathered into one value: reading the parts of a section in order yields the whole section.
    """
    header = sessions.select(
        SESSION, F.lit("session").alias("section"), F.lit(0).cast("bigint").alias("part"),
        F.to_json(F.array(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *[F.col(c) for c in sessions.columns]))).alias("rows"),
    )
    out = header
    for name, (table, order) in sections.items():
        fields = [c for c in table.columns if c not in (SESSION, "slice")]
        part = F.floor(F.col(order) / part_rows).cast("bigint")
        packed = table.groupBy(SESSION, part.alias("part")).agg(
            F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.to_json(F.struct(*fields)).alias("_j")))).alias("_r")
        )
        text = F.concat(F.lit("["), F.array_join(F.transform("_r", lambda x: x["_j"]), ","), F.lit("]"))
        out = out.unionByName(packed.select(SESSION, F.lit(name).alias("section"), "part", text.alias("rows")))
    return out


def write_reports(parts: DataFrame, folder: str) -> None:
    parts.repartitionByRange(SESSION, "section", "part").sortWithinPartitions(SESSION, "section", "part").write.mode("overwrite").json(folder)


def report_documents(sections: dict[str, tuple[DataFrame, str]], sessions: DataFrame) -> DataFrame:
    """(session_uuid, section, at, line): the lines of one JSON document per session, in the order of these columns.

    ``sections`` maps a name to (table, ordering number column); rows that tie in it follow their JSON text. Every line is a
    row of its own: brackets are lines, and a comma stands before each element that has one before it in its section,
    which a sliced scan tells. A section without rows is an empty array. No session is gathered, however long it is.
    """
    last = F.lit(len(sections) + 1)
    at = lambda n: F.lit(n).cast("bigint").alias("at")
    session = F.to_json(F.struct(*[F.col(c) for c in sessions.columns]), {"ignoreNullFields": "false"})
    opening = F.concat(F.lit(f'{{"schema_version":"{SCHEMA_VERSION}","session":'), session)
    out = sessions.select(SESSION, F.lit(0).alias("section"), at(0), opening.alias("line")).unionByName(
        sessions.select(SESSION, last.alias("section"), at(0), F.lit("}").alias("line")))
    low, high = -(1 << 63), (1 << 63) - 1
    elements = None
    for number, (name, (table, order)) in enumerate(sections.items(), 1):
        fields = [c for c in table.columns if c not in (SESSION, ordered.SLICE)]
        line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        rows = table.select(SESSION, F.lit(number).alias("section"), F.col(order).cast("bigint").alias("at"), line.alias("line"))
        elements = rows if elements is None else elements.unionByName(rows)
        edges = F.explode(F.array(F.struct(at(low), F.lit(f',"{name}":[').alias("line")), F.struct(at(high), F.lit("]").alias("line")))).alias("e")
        out = out.unionByName(sessions.select(SESSION, F.lit(number).alias("section"), edges).select(SESSION, "section", "e.*"))
    if elements is None:
        return out
    keys = [SESSION, "section"]
    told = ordered.scan(ordered.with_slices(elements, keys, "at"), keys, ["at", "line"], {"_before": ordered.previous(F.col("at"))})
    line = F.when(F.col("_before").isNull(), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line")))
    return out.unionByName(told.select(SESSION, "section", "at", line.alias("line")))


def write_documents(lines: DataFrame, folder: str) -> None:
    """Text files that hold the documents one after the other: read the files in order of their names. Lines are ranged by
    session and place, so a long document spreads over files. A document begins at the line that opens its object."""
    place = [SESSION, "section", "at", F.ltrim(F.col("line"), F.lit(","))]
    ranged = lines.repartitionByRange(*place).sortWithinPartitions(*place)
    ranged.select(F.col("line").alias("value")).write.mode("overwrite").text(folder)
