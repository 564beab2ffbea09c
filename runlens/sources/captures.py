"""Foreign capture formats: HTTP archives, process-create events and agent transcripts.

Captures are read by line: a line is addressed by its file and a number that rises along the file, so a file of many blocks
is read by many tasks. Only a file that is one JSON document over several lines is put together again, and only such a file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.operators import ordered
from runlens.schemas import RAW_COLUMNS, SESSION, WEB
from runlens.session import stage

HAR = (
    "struct<log:struct<entries:array<struct<startedDateTime:string,time:double,"
    "request:struct<method:string,url:string,postData:struct<text:string>>,"
    "response:struct<status:bigint,content:struct<text:string,mimeType:string,encoding:string>>>>>>"
)


#: Characters of a file that is one document. One value holds it, so a larger one fails with a message that names it.
MOST_DOCUMENT = 1 << 30
#: Characters from which a file is put together only after all its lines were looked at. A matter of speed, not of results.
LARGE_DOCUMENT = 1 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, body), each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line). A block's lines are counted from where the block starts in its file, so ``ord`` rises along the
    file whichever tasks read its blocks: a block has fewer lines than bytes."""
    counted = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + counted).alias("ord"), F.col("value").alias("line"))


def lines_of(files: DataFrame) -> DataFrame:
    """(file, ord, line) of files that are at hand as (file, body)."""
    lines = files.select("file", F.posexplode(F.split("body", "\n")).alias("ord", "line"))
    return lines.withColumn("ord", F.col("ord").cast("bigint"))


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _may_hold(text: Column, pattern: str) -> Column:
    """Whether JSON may hold the names or values of a pattern: as they are, or with letters written as code points. Parsing
    a text costs far more than a look for what a format can't be without, above all a text that is no JSON."""
    return text.rlike(rf"{pattern}|\\u")


# fixed values: what a file's first line tells: one record of many, or a document; the begin of a document; neither
WHOLE, OPEN, NO_DOCUMENT = 1, 2, 0
# fixed values: signs that don't follow each other in any JSON text; 0 is a string, a number or a literal
NEVER_NEXT = r"(?<=[0\]}])(?=[0\[{])|(?<=[,:])(?=[,:\]}])|(?<=\[)(?=[,:}])|(?<=\{)(?=[,:\[{\]])"


def _shape(line: Column) -> Column:
    """What a line is in a JSON text of many lines: its signs up to where such a text can't go on, whether they are all
    (``broken`` if not), how far they change the depth of brackets, and the least depth on the way (null without brackets).

    No string, number or literal goes on in the next line, so signs are told line by line. Escapes, digits and kinds of
    brackets are not looked at: what is broken is no JSON, but not all that is no JSON is broken.
    """
    plain = F.regexp_replace(t.trim(line), r"(?s)\\.", "_")
    plain = F.regexp_replace(F.regexp_replace(plain, r"-?[0-9][0-9.eE+-]*|true|false|null", "0"), '"[^"]*"', "0")
    plain = F.regexp_replace(plain, r"\s", "")
    signs = F.get(F.split(plain, rf"[^\[\]{{}}:,0]|{NEVER_NEXT}", 2), F.lit(0))
    brackets = F.filter(F.split(F.regexp_replace(signs, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    none = F.struct(F.lit(0).cast("bigint").alias("net"), F.lit(None).cast("bigint").alias("low"))

    def step(acc: Column, c: Column) -> Column:
        net = acc["net"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(net.alias("net"), F.least(acc["low"], net).alias("low"))

    return F.struct(signs.alias("signs"), (F.length(signs) < F.length(plain)).alias("broken"), F.aggregate(brackets, none, step).alias("depth"))


def _documents_by_lines(lines: DataFrame) -> DataFrame:
    """(file, document): whether the lines (file, ord, line) of a file reach the end of a JSON document before anything that
    can't be in one. Lines are looked at where they are, and long files in slices; no file is put together."""
    rows = t.once(lines, "s", _shape(F.col("line"))).select(
        "file", "ord", "line", F.col("s.broken").alias("broken"), F.col("s.depth.net").alias("net"), F.col("s.depth.low").alias("low"),
        F.substring("s.signs", 1, 1).alias("first"), F.nullif(F.substring("s.signs", -1, 1), F.lit("")).alias("last"))
    rows = ordered.scan(ordered.with_slices(rows, ["file"], "ord", like=rows), ["file"], ["ord", "line"], {
        "depth": ordered.running_sum(F.col("net"), inclusive=False), "before": ordered.last_seen(F.col("last"), inclusive=False)})
    apart = F.coalesce(F.concat("before", "first").rlike(NEVER_NEXT), F.lit(False))
    ends = ~apart & (F.coalesce("depth", F.lit(0)) + F.col("low") <= 0)
    found = rows.groupBy("file").agg(F.min(F.when(ends, F.col("ord"))).alias("end"), F.min(F.when(apart | F.col("broken"), F.col("ord"))).alias("bad"))
    return found.select("file", (F.col("end").isNotNull() & F.coalesce(F.col("end") <= F.col("bad"), F.lit(True))).alias("document"))


@dataclass
class Capture:
    """Files as the formats want them. ``lines`` (file, ord, line) has every line of every file; ``documents`` (file, body)
    the files that are one JSON value; ``records`` (file, ord, doc) JSON objects one by one: the elements of a document
    that is an array, a document that is an object, and the lines of all other files."""

    lines: DataFrame
    documents: DataFrame

    @property
    def records(self) -> DataFrame:
        body = t.trim(F.col("body"))
        items = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.array(body))
        inside = self.documents.select("file", F.posexplode(items).alias("ord", "doc")).withColumn("ord", F.col("ord").cast("bigint"))
        by_line = self.lines.where(F.trim("line") != "").join(self.documents.select("file"), "file", "left_anti")
        return inside.unionByName(by_line.select("file", "ord", F.col("line").alias("doc")))


def from_lines(lines: DataFrame) -> Capture:
    """A capture out of (file, ord, line).

    A first line that is complete by itself, with more lines after it, means one record per line: no JSON document goes on
    after its end. A first line that no document has means the same. Files of one line, and files whose first line can go
    on, may be documents and are put together, large ones only if all their lines can be one; those that do not parse are
    files of lines with a broken first line.
    """
    filled = lines.where(F.trim("line") != "")
    line = F.col("line")
    shape = _shape(line)
    broken = shape["broken"] & F.coalesce(shape["depth"]["low"] > 0, F.lit(True))
    # Numbers, not structs: their aggregate needs no sort.
    first = F.when(~line.rlike(rf"^{t.WS}*[\[{{]"), NO_DOCUMENT).when(line.rlike(r"[\]}]") & _is_json(line), WHOLE).when(broken, NO_DOCUMENT).otherwise(OPEN)
    facts = filled.groupBy("file").agg(F.min_by(first, "ord").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.length("line") + 1).alias("size"))
    maybe = facts.where((F.col("first") == OPEN) | (F.col("first") == WHOLE) & (F.col("n") == 1))
    # Few files are large: at most one for each LARGE_DOCUMENT characters of input.
    large = maybe.where((F.col("first") == OPEN) & (F.col("n") > 1) & (F.col("size") > LARGE_DOCUMENT)).select("file")
    checked = _documents_by_lines(lines.join(F.broadcast(large), "file"))
    maybe = maybe.join(F.broadcast(checked), "file", "left").withColumn("document", F.coalesce("document", F.lit(True)))
    held = F.when(F.col("document") & (F.col("size") > MOST_DOCUMENT), F.raise_error(F.concat(F.lit("one JSON document is too long for a value: "), F.col("file"))))
    maybe = maybe.where(held.otherwise(F.col("document"))).select("file")
    bodies = lines.join(maybe, "file").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("all"))
    bodies = bodies.select("file", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("body"))
    return Capture(lines, bodies.where(_is_json(t.trim(F.col("body")))))


def from_files(files: DataFrame) -> Capture:
    """A capture out of (file, body)."""
    body = t.trim(F.col("body"))
    lines = F.filter(F.split(body, "\n"), lambda ln: F.trim(ln) != "")
    per_line = (F.size(lines) > 1) & _is_json(F.get(lines, 0))
    return Capture(lines_of(files), files.where((body.startswith("[") | body.startswith("{")) & ~per_line & _is_json(body)).select("file", "body"))


def file_session(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]+)?\z", 1)


def iso_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def _shortened(text: Column, most: int | None) -> Column:
    return text if most is None else F.substr(text, F.lit(1), F.lit(most))


def _web(df: DataFrame, **values: Column) -> DataFrame:
    out = {
        SESSION: file_session(F.col("file")), "exit_code": F.lit(None).cast("int"), "output_line_count": F.lit(0).cast("bigint"),
        "output_digest": F.lit(None).cast("string"), "volume": F.lit(None).cast("bigint"), "web": F.lit(None).cast(WEB), **values,
    }
    return df.select("file", *[out[c].alias(c) for c in RAW_COLUMNS])


def parse_har(files: DataFrame, max_body: int | None = None, context: str = "web:har") -> DataFrame:
    """Entries of HTTP archives as web commands; entries without a url or a readable date are skipped. ``max_body``
    shortens response bodies."""
    files = files.where(_may_hold(F.col("body"), "entries"))
    entries = files.select("file", F.posexplode(F.from_json("body", HAR)["log"]["entries"]).alias("ord", "e"))
    e = F.col("e")
    content = e["response"]["content"]
    decoded = F.decode(F.expr("try_to_binary(e.response.content.text, 'base64')"), "UTF-8")
    body = F.when(content["encoding"] == "base64", F.coalesce(decoded, F.lit("[binary body]"))).otherwise(content["text"])
    started = iso_ms(e["startedDateTime"])
    took = F.when(e["time"] > 0, F.floor(e["time"] + 0.5)).otherwise(0).cast("bigint")
    method = F.coalesce(e["request"]["method"], F.lit("GET"))
    url = t.redact_text(e["request"]["url"])
    return _web(
        entries.where(e["request"]["url"].isNotNull() & started.isNotNull()),
        ord=F.col("ord").cast("bigint"), cmd=F.concat(method, F.lit(" "), t.url_path(url)), started_at_ms=started,
        ended_at_ms=started + took, context_path=F.lit(context),
        web=F.struct(
            method.alias("method"), url.alias("url"), t.redact_text(e["request"]["postData"]["text"]).alias("req_body"),
            e["response"]["status"].alias("status"), _shortened(t.redact_text(body), max_body).alias("resp_body"),
            content["mimeType"].alias("mime"),
        ),
    )


def _pick(fields: Column, *names: str) -> Column:
    out = F.lit("")
    for name in reversed(names):
        value = fields[name]
        out = F.when(value.isNotNull() & (value != ""), value).otherwise(out)
    return out


def parse_process_events(files: DataFrame, context: str = "edr:sysmon") -> DataFrame:
    """Process-create records of (file, body): an array, one object, or one object per line."""
    return parse_event_records(from_files(files).records, context)


def parse_event_records(records: DataFrame, context: str = "edr:sysmon") -> DataFrame:
    """Process-create records, flat or nested, one JSON object per row of (file, ord, doc); other rows are passed over."""
    rows = records.where(_may_hold(F.col("doc"), "Event ?ID|Id|event_id"))
    nested = "struct<Event:struct<System:map<string,string>,EventData:struct<Data:array<struct<`@Name`:string,`#text`:string>>>>>"
    rows = t.once(rows, "_n", F.when(_may_hold(F.col("doc"), "Event[\"']"), F.from_json("doc", nested)["Event"]))
    pairs = F.transform(
        F.filter(F.col("_n.EventData.Data"), lambda x: x["@Name"].isNotNull()),
        lambda x: F.struct(x["@Name"].alias("key"), F.coalesce(x["#text"], F.lit("")).alias("value")),
    )
    # Later records of the same name win, and data fields win over system fields.
    empty = F.create_map().cast("map<string,string>")
    last = F.aggregate(
        F.coalesce(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)")),
        F.coalesce(F.col("_n.System"), empty),
        lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _v: k != x["key"]), F.create_map(x["key"], x["value"])),
    )
    fields = F.when(F.col("_n").isNotNull(), last).otherwise(F.from_json("doc", "map<string,string>"))
    rows = t.once(rows, "f", fields)
    f = F.col("f")
    event_id = F.regexp_extract(F.coalesce(f["EventID"], f["Event ID"], f["Id"], f["event_id"]), r"^\s*([+-]?\d+)", 1)
    stamp = F.coalesce(f["UtcTime"], f["SystemTime"], f["TimeCreated"], F.lit(""))
    zoned = stamp.rlike(r"Z|[+-]\d\d:?\d\d\z")
    started = iso_ms(F.when(zoned, stamp).otherwise(F.concat(F.regexp_replace(F.trim(stamp), " ", "T"), F.lit("Z"))))
    user, parent = _pick(f, "User"), _pick(f, "ParentImage", "ParentCommandLine")
    note = F.array_join(
        F.filter(
            F.array(
                F.when(user != "", F.concat(F.lit("user "), user)), F.when(parent != "", F.concat(F.lit("parent "), parent))
            ),
            lambda x: x.isNotNull(),
        ),
        " · ",
    )
    line = _pick(f, "CommandLine", "Image")
    return _web(
        rows.where(f.isNotNull() & (event_id == "1") & (line != "") & started.isNotNull()),
        ord=F.col("ord").cast("bigint"), cmd=t.redact_text(line), started_at_ms=started, ended_at_ms=started,
        output_digest=F.when(note != "", t.redact_text(note)), context_path=F.lit(context),
    )


RECORD = "struct<timestamp:string,message:struct<content:array<string>>>"
PART = (
    "struct<type:string,name:string,id:string,input:struct<command:string>,tool_use_id:string,is_error:boolean,content:string>"
)


def parse_agent_transcript(files: DataFrame, max_digest: int | None = None, tool: str = "Bash", redact_cmd: bool = True) -> DataFrame:
    """Shell calls of agent transcripts that are at hand as (file, body); see ``parse_transcript_lines``."""
    return parse_transcript_lines(lines_of(files), max_digest, tool, redact_cmd)


def parse_transcript_lines(lines: DataFrame, max_digest: int | None = None, tool: str = "Bash", redact_cmd: bool = True) -> DataFrame:
    """Shell calls of agent transcripts, one message per line of (file, ord, line), paired with the first result that follows
    them; unpaired calls are dropped.

    A result answers the call of its id right before it: calls and results of an id are one sequence, in which a forward
    scan tells each result what stands before it. A call that is repeated replaces the one before, a second result finds
    a result before it and answers nothing.
    """
    lines = lines.select("file", "ord", "line").where(_may_hold(F.col("line"), "content"))
    records = t.once(lines, "r", F.from_json(t.trim(F.col("line")), RECORD)).where("r.message.content is not null")
    parts = t.once(records.select(
        "file", "ord", iso_ms(F.col("r.timestamp")).alias("at_ms"), F.posexplode("r.message.content").alias("part_no", "doc")
    ), "p", F.from_json("doc", PART))
    command = t.trim(F.coalesce("p.input.command", F.lit("")))
    is_call = F.coalesce((F.col("p.type") == "tool_use") & (F.col("p.name") == tool) & F.col("p.id").isNotNull() & (command != "") & F.col("at_ms").isNotNull(), F.lit(False))
    is_result = F.coalesce((F.col("p.type") == "tool_result") & F.col("p.tool_use_id").isNotNull(), F.lit(False))
    events = parts.where(is_call | is_result).select(
        "file", F.when(is_call, F.col("p.id")).otherwise(F.col("p.tool_use_id")).alias("tool_id"),
        (F.col("ord") * (1 << 20) + F.col("part_no")).alias("place"), is_call.alias("is_call"), "at_ms",
        F.when(is_call, command).alias("cmd"), F.coalesce("p.is_error", F.lit(False)).alias("failed"), F.when(is_result, F.col("p.content")).alias("content"))
    keys = ["file", "tool_id"]
    events = ordered.scan(ordered.with_slices(events, keys, "place"), keys, ["place"], {"before": ordered.previous(*[F.col(c) for c in ("is_call", "place", "cmd", "at_ms")])})
    pieces = F.from_json("content", "array<struct<text:string>>")
    text = F.when(F.col("content").startswith("["), F.coalesce(
        F.array_join(F.transform(pieces, lambda x: F.coalesce(x["text"], F.lit(""))), ""), F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    answered = events.where(~F.col("is_call") & F.coalesce("before.is_call", F.lit(False))).select(
        "file", F.col("before.place").alias("place"), F.col("before.cmd").alias("cmd"), F.col("before.at_ms").alias("started"),
        F.col("at_ms").alias("ended"), "failed", text.alias("text"))
    cleaned = t.normalize_typography(t.redact_text(F.col("text")))
    return _web(
        answered, ord=F.col("place"), cmd=t.redact_text(F.col("cmd")) if redact_cmd else F.col("cmd"),
        started_at_ms=F.col("started"), ended_at_ms=F.coalesce("ended", "started"), exit_code=F.col("failed").cast("int"),
        output_line_count=F.when(F.col("text") != "", F.size(F.split("text", "\n"))).otherwise(0).cast("bigint"),
        output_digest=_shortened(cleaned, max_digest), context_path=F.lit("host"),
    )


def _archives(capture: Capture) -> DataFrame:
    return parse_har(capture.documents)


def _events(capture: Capture) -> DataFrame:
    return parse_event_records(capture.records)


def _transcripts(capture: Capture) -> DataFrame:
    return parse_transcript_lines(capture.lines)


# fixed values: adapters in routing order: (name, parser, context of the session, scope when nothing better is known)
_ADAPTERS: dict[str, tuple[Callable[[Capture], DataFrame], str, str]] = {
    "http-proxy": (_archives, "web", "HTTP proxy capture"),
    "sysmon": (_events, "host", "Sysmon capture"),
    "claude-code": (_transcripts, "host", "Claude Code session"),
}


def register_adapter(name: str, parse: Callable[[Capture], DataFrame], context: str = "host", scope: str | None = None) -> None:
    """Add a format: a function from a ``Capture`` to (file, raw command columns). Later formats are tried later."""
    _ADAPTERS[name] = (parse, context, scope or name)


def forget_adapter(name: str) -> None:
    """Take a format out again."""
    _ADAPTERS.pop(name, None)


def route(capture: Capture) -> tuple[DataFrame, DataFrame]:
    """Raw commands with their format, and the files no format recognized.

    The first format that finds commands in a file owns it; each later one sees only the commands of files that are still
    free. Formats look at their own shape of data: documents, records or lines. What a format finds is written once.
    """
    # Put together once: archives are read from the documents, records from them and from the files that are none.
    capture = Capture(capture.lines, stage(capture.documents, "documents"))
    chosen, owned = None, None
    for name, (parse, _context, _scope) in _ADAPTERS.items():
        found = stage(parse(capture).withColumn("capture_kind", F.lit(name)), "commands")
        if chosen is not None:
            found = found.join(owned, "file", "left_anti")
        chosen = found if chosen is None else chosen.unionByName(found)
        owned = chosen.select("file").distinct()
    return chosen, capture.lines.select("file").distinct().join(owned, "file", "left_anti")


def route_captures(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``route`` for files that are at hand as (file, body)."""
    return route(from_files(files))


def read_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``route`` for a folder of captures, read by line."""
    return route(from_lines(read_lines(spark, path)))


def derive_sessions(raw: DataFrame) -> DataFrame:
    """Session rows of imported captures: from the first start to the end of the command that started last."""
    place = F.struct("started_at_ms", "ord")
    out = raw.groupBy(SESSION, "capture_kind").agg(
        F.min("started_at_ms").alias("_start"), F.max_by("ended_at_ms", place).alias("_end"),
        F.min_by(F.col("web.url"), place).alias("_url"), F.min("file").alias("file"),
    )
    host = F.regexp_extract("_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)
    base = F.regexp_replace(F.regexp_extract("file", r"([^/]+)\z", 1), r"\.[^.]+\z", "")
    kind = F.col("capture_kind")
    scope, context = kind, F.lit("host")
    for name, (_parse, ctx, label) in _ADAPTERS.items():
        scope = F.when(kind == name, label).otherwise(scope)
        context = F.when(kind == name, ctx).otherwise(context)
    scope = (
        F.when((kind == "http-proxy") & (host != ""), F.concat(F.lit("HTTP proxy :: "), host))
        .when((kind == "claude-code") & (base != ""), F.concat(F.lit("Claude Code :: "), base))
        .otherwise(scope)
    )
    return out.select(
        SESSION, F.timestamp_millis("_start").alias("started_at"), F.timestamp_millis("_end").alias("ended_at"),
        scope.alias("target_scope"), context.alias("context_path"), kind.alias("shell"), F.lit("plugin").alias("source"),
        F.when(kind == "http-proxy", "web").otherwise("host").alias("golden_id"),
    )
