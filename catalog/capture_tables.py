"""Sources, store, taps and live sessions on telemetry derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.bindings import CMD, CONFIG, OUTPUT, SQL_EPISODES, SQL_RAW, Run, raw_commands, table
from catalog.kit import ALIGNED, CLAIMS, FINDINGS, NOISE, WASTE, WEB_CLAIMS, registry
from catalog.session_metrics import HOLES, RADAR
from catalog.text_tables import SQL_REDACT
from catalog.timeline import FOLD, LABELS
from runlens.functions import text as t
from runlens.operators import golden, grade, ordered, progress, segment
from runlens.plans import debrief
from runlens.schemas import SESSION
from runlens.session import shared_folder, stage, table_of
from runlens.sources import captures, contracts, envelopes, sinks, store, taps
from runlens.streaming import live, sessions

QUERIES, query = registry()

KIND = """case when event_type = 'click' then 'command' when event_type = 'view' then 'output' when event_type = 'error' then 'stdin_masked'
 when event_type = 'purchase' then 'http_request' else 'http_response' end"""
URL = "concat('http://10.10.10.5/p', k, '?q=', event_id % 7)"


def json_lines(spark, sf, broken=False):
    """Each event as one telemetry line; on request every tenth line is cut short, to be rejected by the parser."""
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", r'"k": (\d+)', 1).cast("int"))
    payload = F.struct(
        F.expr(CMD).alias("cmd"), F.expr(f"coalesce({OUTPUT}, '')").alias("text"), (F.col("k") * 2).alias("line_count"), F.lit("GET").alias("method"),
        F.expr(URL).alias("url"), F.lit(200).alias("status"), (F.col("event_id") % 40).cast("string").alias("pair_id"))
    body = F.struct(
        F.concat(F.lit("host"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("user_id").cast("string").alias(SESSION),
        (F.col("event_id") % 40).alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_utc_us"), F.expr(KIND).alias("kind"),
        payload.alias("payload"))
    line = F.to_json(body)
    return e.select(F.when(F.lit(broken) & (F.col("event_id") % 10 == 0), F.substr(line, F.lit(1), F.lit(60))).otherwise(line).alias("value"))


def telemetry(spark, sf):
    return envelopes.parse_lines(json_lines(spark, sf))


SQL_ENV = f"""
ev as (select *, regexp_extract(props, '"k": ([0-9]+)', 1)::int k from events),
env as (select 'host' || (user_id % 3) source, user_id::varchar session_uuid, event_id % 40 seq, epoch_us(ts) ts_utc_us, {KIND} kind, {CMD} cmd, coalesce({OUTPUT}, '') as "text", k * 2 line_count,
  {URL} url, (event_id % 40)::varchar pair_id from ev)"""


@query("parsed_envelopes", f"with {SQL_ENV.replace('k from events)', 'k from events where event_id % 10 <> 0)')} select source, session_uuid, seq, ts_utc_us, kind, cmd from env")
def parsed_envelopes(spark, sf):
    return envelopes.parse_lines(json_lines(spark, sf, broken=True)).select("source", SESSION, "seq", "ts_utc_us", "kind", F.col("payload.cmd").alias("cmd"))


@query("handshakes_in_force", f"""with {SQL_ENV}, ln as (select event_id, event_id % 5 f, case when event_id % 50 = 0 then event_id end h from ev),
fo as (select event_id, max(h) over (partition by f order by event_id) h from ln), e as (select event_id, user_id::varchar session_uuid, epoch_us(ts) ts_utc_us from ev)
select session_uuid, ts_utc_us, event_id seq, 'p' || (h % 7) platform, 'ctx' || (h % 3) context_path, case when h is null then null when h % 100 = 0 then 1.0 else 0.7 end::double boundary_confidence
from e join fo using (event_id)""")
def handshakes_in_force(spark, sf):
    """Five files of telemetry lines; before every tenth line of a file its sender may shake hands anew."""
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(F.lit("a").alias("source"), F.col("user_id").cast("string").alias(SESSION), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_utc_us"), F.lit("command").alias("kind")))
    hello = F.to_json(F.struct(F.lit("1").alias("x_handshake"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("plugin"), F.concat(F.lit("ctx"), (F.col("event_id") % 3).cast("string")).alias("context_template"),
                               F.struct(F.when(F.col("event_id") % 100 == 0, "exact").otherwise("heuristic").alias("boundary_confidence")).alias("capabilities")))
    both = e.select(F.concat(F.lit("/c/"), (F.col("event_id") % 5).cast("string")).alias("file"), "event_id", F.posexplode(F.when(F.col("event_id") % 50 == 0, F.array(hello, line)).otherwise(F.array(line))).alias("n", "line"))
    filled = envelopes.with_handshakes(both.select("file", (F.col("event_id") * 2 + F.col("n")).cast("bigint").alias("ord"), "line"))
    return filled.select(SESSION, "ts_utc_us", "seq", "provenance.platform", "provenance.context_path", "provenance.boundary_confidence")


LAST = """
c as (select session_uuid, seq, max(ts_utc_us) ts, arg_max(cmd, ts_utc_us) cmd from env where kind = 'command' group by 1, 2),
o as (select session_uuid, seq, max(ts_utc_us) ts, arg_max("text", ts_utc_us) as "text", arg_max(line_count, ts_utc_us) n from env where kind in ('output', 'stdin_masked') group by 1, 2)"""


@query("joined_commands", f"""with {SQL_ENV}, {LAST} select c.session_uuid, c.seq ord, {SQL_REDACT.replace('X', 'c.cmd')} cmd, c.ts // 1000 started_at_ms, greatest(c.ts // 1000, coalesce(o.ts // 1000, c.ts // 1000)) ended_at_ms,
  coalesce(n, 0) output_line_count, {SQL_REDACT.replace('X', 'o."text"')} output_digest from c left join o using (session_uuid, seq)""")
def joined_commands(spark, sf):
    df = envelopes.join_command_output(telemetry(spark, sf))
    return df.select(SESSION, "ord", "cmd", "started_at_ms", "ended_at_ms", "output_line_count", "output_digest")


WEB_LAST = """
q as (select session_uuid, pair_id, max(ts_utc_us) ts, arg_max(url, ts_utc_us) url from env where kind = 'http_request' group by 1, 2),
a as (select session_uuid, pair_id, max(ts_utc_us) ts from env where kind = 'http_response' group by 1, 2)"""


@query("joined_exchanges", f"""with {SQL_ENV}, {WEB_LAST} select q.session_uuid, 'GET ' || regexp_extract(q.url, '//[^/]+(.*)$', 1) cmd, q.ts // 1000 started_at_ms, greatest(q.ts // 1000, coalesce(a.ts // 1000, q.ts // 1000)) ended_at_ms,
  'web:burp' context_path, replace(q.url, '10.10.10.5', 'x.x.x.x') url, case when a.ts is not null then 200 end status from q left join a using (session_uuid, pair_id)""")
def joined_exchanges(spark, sf):
    df = envelopes.join_http_pairs(telemetry(spark, sf))
    return df.select(SESSION, "cmd", "started_at_ms", "ended_at_ms", "context_path", F.col("web.url").alias("url"), F.col("web.status").alias("status"))


@query("merged_streams", f"""with {SQL_ENV}, {LAST}, {WEB_LAST}, u as (select session_uuid, ts // 1000 at_ms, 0 r, ts, cmd from c union all select session_uuid, ts // 1000, 1, ts, 'GET ' || regexp_extract(url, '//[^/]+(.*)$', 1) from q)
select session_uuid, row_number() over (partition by session_uuid order by at_ms, r, ts) as "position", {SQL_REDACT.replace('X', 'cmd')} cmd from u""")
def merged_streams(spark, sf):
    env = stage(telemetry(spark, sf), "envelopes")
    df = envelopes.merge_raw(envelopes.join_command_output(env), envelopes.join_http_pairs(env))
    df = ordered.scan(ordered.with_slices(df, [SESSION], "started_at_ms"), [SESSION], ["started_at_ms", "ord"], {"position": ordered.position()})
    return df.select(SESSION, "position", "cmd")


@query("filled_provenance", f"""with {SQL_ENV} select session_uuid, seq, ts_utc_us, case source when 'host0' then 'host' when 'host1' then 'web:x' end context_path, case source when 'host0' then 1.0 when 'host1' then 0.7 end::double confidence,
  case source when 'host0' then 'shell' when 'host1' then 'proxy' end platform from env""")
def filled_provenance(spark, sf):
    rows = [("host0", "shell", "host", "exact"), ("host1", "proxy", "web:x", "inferred")]
    hs = table_of(spark, rows, "source string, plugin string, context_template string, b string").withColumn(
        "capabilities", F.struct(F.col("b").alias("boundary_confidence")))
    df = envelopes.apply_handshake(telemetry(spark, sf), hs)
    p = F.col("provenance")
    return df.select(SESSION, "seq", "ts_utc_us", p["context_path"].alias("context_path"), p["boundary_confidence"].alias("confidence"), p["platform"].alias("platform"))


@query("redacted_envelopes", f"""with {SQL_ENV} select source, kind, count(*) filter ({SQL_REDACT.replace('X', 'cmd')} <> cmd or {SQL_REDACT.replace('X', '"text"')} <> "text" or (kind like 'http%' and contains(url, '10.10'))) redacted, count(*) n from env group by 1, 2""")
def redacted_envelopes(spark, sf):
    return sessions.redact_envelopes(telemetry(spark, sf)).groupBy("source", "kind").agg(F.count(F.when(F.col("redacted"), 1)).alias("redacted"), F.count(F.lit(1)).alias("n"))


@query("envelope_tally", f"""with {SQL_ENV} select source source_key, count(*) filter (kind = 'command') commands, count(*) filter (kind <> 'command') outputs,
  count(*) filter ({SQL_REDACT.replace('X', 'cmd')} <> cmd or {SQL_REDACT.replace('X', '"text"')} <> "text" or (kind like 'http%' and contains(url, '10.10'))) redactions from env group by 1""")
def envelope_tally(spark, sf):
    return sessions.tally(telemetry(spark, sf))


@query("stored_commands", f"""with {SQL_ENV}, f as (select session_uuid, seq, arg_min(cmd, ts_utc_us) raw_command, min(ts_utc_us) started_at from env where kind = 'command' group by 1, 2),
e as (select session_uuid, seq, max(ts_utc_us) ended_at from env where kind in ('output', 'stdin_masked') group by 1, 2)
select session_uuid, seq, raw_command, split_part(raw_command, ' ', 1) "binary", started_at, ended_at from f left join e using (session_uuid, seq)""")
def stored_commands(spark, sf):
    return store.normalize(stage(telemetry(spark, sf), "envelopes"))["commands"].select(SESSION, "seq", "raw_command", "binary", "started_at", "ended_at")


@query("stored_blocks", f"""with {SQL_ENV} select session_uuid, seq, ts_utc_us started_at, "text" as "content", strlen("text") byte_count, case kind when 'stdin_masked' then 'masked' else 'clean' end fidelity from env e
where kind in ('output', 'stdin_masked') and exists (select 1 from env x where x.session_uuid = e.session_uuid and x.seq = e.seq and x.kind = 'command')""")
def stored_blocks(spark, sf):
    df = store.normalize(stage(telemetry(spark, sf), "envelopes"))["output_blocks"]
    return df.select(SESSION, "seq", "started_at", "content", F.col("byte_count").cast("bigint").alias("byte_count"), "fidelity")


@query("exported_envelopes", f"""with {SQL_ENV}, s as (select arg_max(session_uuid, (t, session_uuid)) u from (select session_uuid, min(ts_utc_us) t from env group by 1)),
w as (select session_uuid, pair_id, min(ts_utc_us) ts from env where kind = 'http_request' group by 1, 2), a as (select session_uuid, pair_id, max(ts_utc_us) ts from env where kind = 'http_response' group by 1, 2),
x as (select session_uuid, seq, min(ts_utc_us) ts_utc_us, 'command' kind from env where kind = 'command' group by 1, 2
  union all select session_uuid, seq, ts_utc_us, case kind when 'stdin_masked' then kind else 'output' end from env e where kind in ('output', 'stdin_masked') and exists (select 1 from env y where y.session_uuid = e.session_uuid and y.seq = e.seq and y.kind = 'command')
  union all select session_uuid, 0, ts, 'http_request' from w union all select w.session_uuid, 0, coalesce(a.ts, w.ts), 'http_response' from w left join a using (session_uuid, pair_id))
select x.* from x join s on s.u = x.session_uuid""")
def exported_envelopes(spark, sf):
    return store.export_envelopes(store.normalize(stage(telemetry(spark, sf), "envelopes"))).select(SESSION, "seq", "ts_utc_us", "kind")


@query("store_listing", f"""with {SQL_ENV}, f as (select session_uuid, seq, arg_min(cmd, ts_utc_us) raw_command from env where kind = 'command' group by 1, 2), s as (select distinct session_uuid, source from env)
select s.session_uuid, s.source, f.seq, split_part(raw_command, ' ', 1) "binary", case when raw_command is not null then '-' else '-' end "exit" from s left join f using (session_uuid)""")
def store_listing(spark, sf):
    return store.store_summary(store.normalize(stage(telemetry(spark, sf), "envelopes"))).select(SESSION, "source", "seq", "binary", "exit")


BROKEN = """select 'source:enum' rule, seq from env where seq % 5 <> 0 union all select 'source:required', seq from env where seq % 7 = 0 and false
union all select 'ts_utc_us:range', seq from env where seq % 11 = 0 union all select 'ts_utc_us:required', seq from env where seq % 13 = 0 and seq % 11 <> 0
union all select 'kind:enum', seq from env where seq % 17 = 0 union all select 'provenance.boundary_confidence:range', seq from env where seq % 19 = 0"""


@query("contract_violations", f"""with {SQL_ENV} select rule, count(*) n from ({BROKEN}) group by 1""")
def contract_violations(spark, sf):
    """Telemetry with broken rows of each kind."""
    every = lambda n: F.col("seq") % n == 0
    bad = telemetry(spark, sf).withColumn("source", F.when(every(5), "plugin").otherwise(F.col("source")))
    bad = bad.withColumn("ts_utc_us", F.when(every(11), -1).when(~every(13), F.col("ts_utc_us"))).withColumn("kind", F.when(every(17), "other").otherwise(F.col("kind")))
    bad = bad.withColumn("provenance", F.struct(F.when(every(19), 1.5).otherwise(0.5).alias("boundary_confidence")))
    return contracts.validate(bad, contracts.ENVELOPE_CONTRACT, [SESSION, "seq"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("episode_contract", f"""with {SQL_EPISODES} select 'seq:range' "rule", count(*) filter (seq % 10 = 3) n from ep union all select 'actor:enum', count(*) filter (seq % 10 = 4) from ep
union all select 'tactic:pattern', count(*) filter (seq % 10 = 5) from ep union all select 'technique:pattern', count(*) filter (seq % 10 = 6) from ep
union all select 'confidence:range', count(*) filter (seq % 10 = 7) from ep union all select 'cmd:required', count(*) filter (seq % 10 = 8) from ep
union all select 'cwe:each', count(*) filter (seq % 10 = 9) from ep union all select 'ukc:enum', count(*) filter (seq % 10 = 0) from ep""")
def episode_contract(spark, sf):
    """Segmented episodes, eight kinds of rows broken on purpose; the others break nothing."""
    at = lambda n: F.col("_n") == n
    ep = Run(spark, sf).segmented.withColumn("_n", F.col("seq") % 10)
    put = lambda df, c, n, v: df.withColumn(c, F.when(at(n), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    for column, n, value in (("seq", 3, -1), ("actor", 4, "nobody"), ("tactic", 5, "TA7"), ("technique", 6, "T10"), ("confidence", 7, 2.0), ("cmd", 8, None)):
        ep = put(ep, column, n, value)
    ep = ep.withColumn("cwe", F.when(at(9), F.array(F.lit("CWE-1"), F.lit("cwe 2")))).withColumn("ukc", F.when(at(0), "nowhere"))
    return contracts.validate(ep, contracts.EPISODE_CONTRACT, [SESSION]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


REPORT_PARTS = """select 'findings' part, 'kind:enum' "rule", count(*) filter (o_orderkey % 11 = 10) n from orders union all select 'findings', 'source_seq:range', count(*) filter (o_orderkey % 7 = 0) from orders
union all select 'findings', 'tactic:pattern', count(*) filter (o_orderkey % 20 >= 10) from orders union all select 'findings', 'used_by_seq:each_range', count(*) filter (o_orderkey % 3 = 0) from orders
union all select 'phases', 'efficiency_pct:range', count(*) filter (o_totalprice > 100000) from orders union all select 'phases', 'label:required', count(*) filter (o_orderkey % 4 = 0) from orders
union all select 'objectives', 'status:enum', count(*) filter (o_orderstatus = 'P') from orders union all select 'objectives', 'satisfied_by:required', count(*) filter (o_orderkey % 9 = 0) from orders
union all select 'hints', 'tier:enum', count(*) filter (o_orderkey % 5 in (0, 4)) from orders union all select 'ghost', 'verdict:enum', count(*) filter (o_orderkey % 6 = 5) from orders
union all select 'metrics', 'stealth_score:range', count(*) filter (o_totalprice > 200000) from orders union all select 'metrics', 'loop_ms:required', count(*) filter (o_orderkey % 8 = 0) from orders
union all select 'coaching', 'category:enum', count(*) filter (o_orderpriority = '5-LOW') from orders"""


@query("report_contract", f"select * from ({REPORT_PARTS}) where n > 0")
def report_contract(spark, sf):
    """Parts of reports made from orders, each with rows that break its contract."""
    o = table(spark, sf, "orders").withColumn(SESSION, F.col("o_orderkey").cast("string"))
    k, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    kinds = ["port", "service", "version", "cred", "url", "path", "host", "hash", "vuln", "flag", "other"]
    parts = {
        "findings": o.select(SESSION, text("o_orderkey").alias("id"), pick(kinds, 11).alias("kind"), text("o_comment" if "o_comment" in o.columns else "o_orderstatus").alias("value"),
                             (k % 7 - 1).alias("source_seq"), F.concat(F.lit("TA000"), (k % 20).cast("string")).alias("tactic"), F.lit(0.5).alias("confidence"),
                             F.array(F.lit(3), F.when(k % 3 == 0, -1).otherwise(1)).alias("used_by_seq")),
        "phases": o.select(SESSION, F.lit("TA0001").alias("mitre_tactic"), F.when(k % 4 != 0, "x").alias("label"), F.col("o_orderdate").alias("started_at"),
                           F.col("o_orderdate").alias("ended_at"), (F.col("o_totalprice") / 1000).alias("efficiency_pct")),
        "objectives": o.select(SESSION, F.lit("o").alias("objective"), F.lit("TA0001").alias("tactic"), F.when(k % 9 != 0, F.array(F.lit("nmap"))).alias("satisfied_by"),
                               F.when(F.col("o_orderstatus") == "P", "partly").otherwise("reached").alias("status")),
        "hints": o.select(SESSION, (k % 5).cast("int").alias("tier"), F.lit(0).alias("at_ms"), F.lit("x").alias("phase")),
        "ghost": o.select(SESSION, F.lit("o").alias("objective"), pick(["on_time", "late_pivot", "skipped", "ahead", "off_path_win", "never"], 6).alias("verdict"), F.lit(0).alias("lag_ms")),
        "metrics": o.select(SESSION, (F.col("o_totalprice") / 2000).alias("stealth_score"), F.when(k % 8 != 0, F.lit(1)).alias("loop_ms"), F.lit(50.0).alias("efficiency_pct"),
                            F.lit(1.0).alias("objective_coverage_pct"), *[F.lit(1).alias(c) for c in ("technique_breadth", "productive_ms", "detour_ms", "stuck_ms", "active_ms")]),
        "coaching": o.select(SESSION, F.lit("a").alias("action"), F.lit("w").alias("why"), F.when(F.col("o_orderpriority") == "5-LOW", "Low").otherwise("Recon").alias("category")),
    }
    return contracts.validate_report(parts, [SESSION]).groupBy("part", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("bracketed_streams", f"""with {SQL_ENV} select session_uuid, 'session_start' kind, min(ts_utc_us) ts_utc_us from env group by 1 union all select session_uuid, 'session_end', max(ts_utc_us) from env group by 1
union all select session_uuid, 'session_flag', min(ts_utc_us) from env where kind in ('output', 'stdin_masked') and regexp_matches("text", '(^|[^0-9a-fA-F])[0-9a-fA-F]{{32}}([^0-9a-fA-F]|$)') group by 1""")
def bracketed_streams(spark, sf):
    return sessions.bracket(telemetry(spark, sf), "run").where("kind like 'session%'").select(SESSION, "kind", "ts_utc_us")


# --- other formats ----------------------------------------------------------------------------------


def _har(spark, sf):
    entry = F.struct(
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(".250Z")).alias("startedDateTime"),
        (F.col("page_id") * 1.5).alias("time"), F.struct(F.lit("GET").alias("method"), F.col("url")).alias("request"),
        F.struct(F.lit(200).alias("status"), F.struct(F.base64(F.encode("html", "UTF-8")).alias("text"), F.lit("text/html").alias("mimeType"), F.lit("base64").alias("encoding")).alias("content")).alias("response"))
    return table(spark, sf, "pages").select(F.concat(F.lit("/c/page-"), F.col("page_id").cast("string"), F.lit(".har")).alias("file"),
                                           F.to_json(F.struct(F.struct(F.array(entry).alias("entries")).alias("log"))).alias("body"))


@query("http_archives", f"""select 'page-' || page_id session_uuid, 1704067200250 + (page_id % 60) * 1000 started_at_ms, 1704067200250 + (page_id % 60) * 1000 + floor(page_id * 1.5 + 0.5)::bigint ended_at_ms,
  md5({SQL_REDACT.replace('X', 'html')}) body from pages""")
def http_archives(spark, sf):
    df = captures.parse_har(_har(spark, sf))
    return df.select(SESSION, "started_at_ms", "ended_at_ms", F.md5(F.col("web.resp_body")).alias("body"))


def _process_events(spark, sf):
    """(file, ord, line) of process-create records: a file of one flat object, an array over several lines, and files of
    one record per line that many orders share, with broken lines between."""
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    flat = F.to_json(F.struct(F.when(key % 5 == 0, 3).otherwise(1).alias("EventID"), at.alias("UtcTime"),
                              F.concat(F.lit("run.exe --order "), text).alias("CommandLine"), F.col("o_orderpriority").alias("User")))
    pair = lambda name, value: F.struct(F.lit(name).alias("@Name"), value.cast("string").alias("#text"))
    nested = F.to_json(F.struct(F.struct(
        F.struct(F.lit("1").alias("EventID")).alias("System"),
        F.struct(F.array(pair("UtcTime", at), pair("Image", F.concat(F.lit("run.exe --order "), text)), pair("ParentImage", F.col("o_orderstatus"))).alias("Data")).alias("EventData")).alias("Event")))
    line = F.when(key % 4 == 0, F.array(flat)).when(key % 4 == 1, F.array(F.lit("["), nested, F.lit("]"))).when(key % 4 == 2, F.array(flat, F.lit("{cut"))).otherwise(F.array(F.lit("{cut"), nested))
    name = F.when(key % 4 < 2, F.concat(F.lit("/c/log-"), text, F.lit(".json"))).otherwise(F.concat(F.lit("/c/batch-"), (F.col("o_custkey") % 16).cast("string"), F.lit(".ndjson")))
    rows = table(spark, sf, "orders").select(name.alias("file"), key.alias("_key"), F.posexplode(line).alias("_at", "line"))
    return rows.select("file", (F.col("_key") * 4 + F.col("_at")).cast("bigint").alias("ord"), "line")


SQL_EVENTS = """ev as (select case when o_orderkey % 4 < 2 then 'log-' || o_orderkey else 'batch-' || (o_custkey % 16) end session_uuid, 'run.exe --order ' || o_orderkey cmd,
  epoch_us(o_orderdate) // 1000 started_at_ms, case when o_orderkey % 2 = 0 then 'user ' || o_orderpriority else 'parent ' || o_orderstatus end output_digest,
  o_orderkey % 2 = 0 and o_orderkey % 5 = 0 other from orders)"""


@query("process_events", f"with {SQL_EVENTS} select * exclude (other) from ev where not other")
def process_events(spark, sf):
    records = captures.from_lines(_process_events(spark, sf)).records
    return captures.parse_event_records(records).select(SESSION, "cmd", "started_at_ms", "output_digest")


def _transcripts(spark, sf):
    """(file, ord, line): user turns as shell calls, assistant turns as results, all other turns as plain messages."""
    slot = F.concat(F.lit("t"), F.floor(F.col("turn") / 2).cast("string"))
    at = F.concat(F.lit("2024-01-01T00:00:0"), (F.col("turn") % 10).cast("string"), F.lit("Z")).alias("timestamp")
    message = lambda content: F.to_json(F.struct(F.struct(content.alias("content")).alias("message"), at))
    call = message(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), slot.alias("id"), F.struct(F.concat(F.lit("run "), F.col("turn").cast("string")).alias("command")).alias("input"))))
    result = message(F.array(F.struct(F.lit("tool_result").alias("type"), slot.alias("tool_use_id"), (F.col("turn") % 4 == 3).alias("is_error"), F.col("text").alias("content"))))
    line = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(message(F.col("text")))
    return table(spark, sf, "conversations").select(F.concat(F.lit("/c/talk-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("turn").cast("bigint").alias("ord"), line.alias("line"))


SQL_CALLS = f"""call as (select conv_id, turn, "text", role, lag(role) over w before, lag(turn) over w asked from conversations where role in ('user', 'assistant')
  window w as (partition by conv_id, turn // 2 order by turn)),
tr as (select 'talk-' || conv_id session_uuid, 'run ' || asked cmd, 1704067200000 + (asked % 10) * 1000 started_at_ms, 1704067200000 + (turn % 10) * 1000 ended_at_ms, (turn % 4 = 3)::int exit_code,
  len(string_split("text", chr(10))) output_line_count, md5({SQL_REDACT.replace('X', '"text"')}) digest from call where role = 'assistant' and before = 'user')"""


@query("agent_transcripts", f"with {SQL_CALLS} select * from tr")
def agent_transcripts(spark, sf):
    df = captures.parse_transcript_lines(_transcripts(spark, sf))
    return df.select(SESSION, "cmd", "started_at_ms", "ended_at_ms", "exit_code", "output_line_count", F.md5("output_digest").alias("digest"))


def _mixed(spark, sf):
    """Files of every format by line; the archives are documents over three lines."""
    har = _har(spark, sf).select("file", F.posexplode(F.array(F.lit("{"), F.expr("substr(body, 2, length(body) - 2)"), F.lit("}"))).alias("ord", "line"))
    return har.withColumn("ord", F.col("ord").cast("bigint")).unionByName(_process_events(spark, sf)).unionByName(_transcripts(spark, sf))


@query("routed_captures", f"""with {SQL_EVENTS}, {SQL_CALLS}, every as (select 'page-' || page_id f from pages union select session_uuid from ev union select 'talk-' || conv_id from conversations),
chosen as (select 'http-proxy' capture_kind, 'page-' || page_id f from pages union all select 'sysmon', session_uuid from ev where not other union all select 'claude-code', session_uuid from tr)
select capture_kind, count(*) commands, count(distinct f) files from chosen group by 1
union all select 'rejected', 0, count(*) from every where f not in (select f from chosen)""")
def routed_captures(spark, sf):
    chosen, rejected = captures.route(captures.from_lines(_mixed(spark, sf)))
    counts = chosen.groupBy("capture_kind").agg(F.count(F.lit(1)).alias("commands"), F.countDistinct("file").alias("files"))
    return counts.unionByName(rejected.agg(F.count(F.lit(1)).alias("files")).select(F.lit("rejected").alias("capture_kind"), F.lit(0).cast("bigint").alias("commands"), "files"))


@query("imported_sessions", rf"""with {SQL_EVENTS}, {SQL_CALLS}
select 'page-' || page_id session_uuid, 'HTTP proxy :: ' || regexp_extract(url, '://([^/?#]+)', 1) target_scope, 'web' golden_id, 'web' context_path, 'http-proxy' shell, 'plugin' "source",
  1704067200250 + (page_id % 60) * 1000 start_ms, 1704067200250 + (page_id % 60) * 1000 + floor(page_id * 1.5 + 0.5)::bigint end_ms from pages
union all select session_uuid, 'Sysmon capture', 'host', 'host', 'sysmon', 'plugin', min(started_at_ms), max(started_at_ms) from ev where not other group by 1
union all select session_uuid, 'Claude Code :: ' || session_uuid, 'host', 'host', 'claude-code', 'plugin', min(started_at_ms), arg_max(ended_at_ms, started_at_ms) from tr group by 1""")
def imported_sessions(spark, sf):
    chosen, _r = captures.route(captures.from_lines(_mixed(spark, sf)))
    out = captures.derive_sessions(chosen)
    return out.select(SESSION, "target_scope", "golden_id", "context_path", "shell", "source", F.unix_millis("started_at").alias("start_ms"), F.unix_millis("ended_at").alias("end_ms"))


@query("unseen_exchanges", r"""select distinct (page_id % 10)::varchar session_uuid, regexp_extract(url, '://([^/:?#]+)', 1) pair_id from pages where regexp_extract(url, '://([^/:?#]+)', 1) like '%.com'""")
def unseen_exchanges(spark, sf):
    host = F.regexp_extract("url", r"://([^/:?#]+)", 1)
    pages = table(spark, sf, "pages")
    web = pages.select((F.col("page_id") % 10).cast("string").alias(SESSION), host.alias("pair_id"), "url", F.timestamp_seconds("page_id").alias("ts"))
    scope = pages.select(host.alias("host")).where("host like '%.com'").distinct()
    return envelopes.dedupe_web(web, scope).select(SESSION, "pair_id")


@query("scripted_steps", """select l_orderkey::varchar session_uuid, l_linenumber::bigint ord, (1000 + sum(l_quantity::bigint + 5) over w - 5)::bigint started_at_ms, (1000 + sum(l_quantity::bigint + 5) over w)::bigint ended_at_ms
from (select l_orderkey, l_linenumber, sum(l_quantity::bigint)::bigint l_quantity from lineitem group by 1, 2) window w as (partition by l_orderkey order by l_linenumber)""")
def scripted_steps(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("gap"))
    steps = li.select(F.col("l_orderkey").cast("string").alias(SESSION), F.col("l_linenumber").cast("bigint").alias("ord"), F.lit("run").alias("cmd"), "gap",
                      F.lit(5).cast("bigint").alias("dur"), F.lit("").alias("out"), F.lit(1).alias("lines"), F.lit(1).alias("volume"))
    starts = steps.select(SESSION).distinct().withColumn("start_ms", F.lit(1000).cast("bigint"))
    return envelopes.expand_steps(steps, starts).select(SESSION, "ord", "started_at_ms", "ended_at_ms")


@query("attached_sidecars", """select o_orderkey::varchar session_uuid, case when o_orderkey % 3 = 0 then null else 1 end::int pulls from orders""")
def attached_sidecars(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias(SESSION), "o_orderkey")
    body = F.when(F.col("o_orderkey") % 3 == 0, "{broken").otherwise('[{"tier":1,"atMs":5,"phase":"x"}]')
    out = envelopes.attach_sidecars(o.select(SESSION), o.select(SESSION, body.alias("body")))
    return out.select(SESSION, F.when(F.col("hints").isNotNull(), F.size("hints")).alias("pulls"))


@query("report_parts", f"""with {SQL_RAW} select session_uuid, 'commands' section, count(*) n, count(distinct ord // 100) parts from raw group by 1 union all select session_uuid, 'session', 1, 1 from raw group by 1""")
def report_parts(spark, sf):
    raw = raw_commands(spark, sf)
    parts = sinks.report_parts({"commands": (raw, "ord")}, raw.select(SESSION).distinct(), part_rows=100)
    return parts.groupBy(SESSION, "section").agg(F.sum(F.expr("json_array_length(rows)")).cast("bigint").alias("n"), F.count(F.lit(1)).alias("parts"))


DOCUMENTS = f"""with {SQL_EPISODES} {FINDINGS}, cl as (select session_uuid, seq as pos, '{{"seq":' || seq || ',"cmd":"' || cmd || '","binary":"' || "binary" || '","exit_code":' || coalesce(exit_code::varchar, 'null') || ',"tactic":"' || tactic || '"}}' j from ep),
fl as (select session_uuid, source_seq as pos, '{{"id":"' || id || '","kind":"' || kind || '","source_seq":' || source_seq || '}}' j from found),
c as (select session_uuid, string_agg(j, ',' order by pos, j) j from cl group by 1), f as (select session_uuid, string_agg(j, ',' order by pos, j) j from fl group by 1),
d as (select session_uuid, '{{"schema_version":"1.4","session":{{"session_uuid":"' || session_uuid || '","target_name":"Box ' || session_uuid || '","difficulty":null}},"commands":[' || c.j || '],"findings":[' || coalesce(f.j, '') || '],"hints":[]}}' body
  from c left join f using (session_uuid))"""


@query("report_documents", f"{DOCUMENTS} select session_uuid, md5(body) digest, length(body) chars from d")
def report_documents(spark, sf):
    """Whole documents, put together here only to be compared; a session's lines lie in many slices and files."""
    run = Run(spark, sf)
    sessions_ = run.sessions.select(SESSION, F.concat(F.lit("Box "), SESSION).alias("target_name"), F.lit(None).cast("string").alias("difficulty"))
    sections = {"commands": (run.staged.select(SESSION, "seq", "cmd", "binary", "exit_code", "tactic"), "seq"),
                "findings": (run.findings.select(SESSION, "id", "kind", "source_seq"), "source_seq"), "hints": (run.findings.where("false").select(SESSION, "source_seq"), "source_seq")}
    lines = sinks.report_documents(sections, sessions_)
    order = F.struct("section", "at", F.ltrim(F.col("line"), F.lit(",")).alias("text"), "line")
    whole = lines.groupBy(SESSION).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]), "").alias("body"))
    return whole.select(SESSION, F.md5("body").alias("digest"), F.length("body").cast("bigint").alias("chars"))


# --- taps -------------------------------------------------------------------------------------------


@query("replayed_keystrokes", r"""select doc_id::varchar session_uuid, cmd from (select doc_id, regexp_replace(regexp_replace(unnest(string_split_regex(text, '\r\n|\r|\n')), '\t', ' ', 'g'), '^\s+|\s+$', '', 'g') cmd from documents) where cmd <> ''""")
def replayed_keystrokes(spark, sf):
    typed = F.regexp_replace(F.regexp_replace("text", "e", "q\x7fe"), "a", "\x1b[31ma")
    logs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias(SESSION), typed.alias("input_log"))
    return taps.parse_keystrokes(logs).select(SESSION, "cmd")


@query("echoed_commands", r"""with l as (select doc_id, text, regexp_replace(regexp_replace(unnest(string_split_regex(text, '\r\n|\r|\n')), '\t', ' ', 'g'), '^\s+|\s+$', '', 'g') cmd from documents)
select doc_id::varchar session_uuid, cmd from l where cmd <> '' and (length(cmd) < 3 or contains(left(text, (length(text) // 2)::int), cmd))""")
def echoed_commands(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias(SESSION), F.col("text").alias("input_log"),
                                                F.left("text", F.floor(F.length("text") / 2).cast("int")).alias("output_log"))
    return taps.scrub_unechoed(taps.parse_keystrokes(docs), docs.select(SESSION, "output_log")).select(SESSION, "cmd")


@query("tapped_commands", r"""select doc_id::varchar session_uuid, row_number() over (partition by doc_id order by n) - 1 ord, (row_number() over (partition by doc_id order by n) - 1) * 1000 + doc_id started_at_ms, 'host->ssh:' || source context_path
from (select doc_id, source, regexp_replace(regexp_replace(unnest(ls), '\t', ' ', 'g'), '^\s+|\s+$', '', 'g') cmd, generate_subscripts(ls, 1) n from (select doc_id, source, string_split_regex(text, '\r\n|\r|\n') ls from documents)) where cmd <> ''""")
def tapped_commands(spark, sf):
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias(SESSION), F.col("text").alias("input_log"), none.alias("output_log"), none.alias("timing_log"),
        F.col("source").alias("target"), F.col("doc_id").alias("started_at_ms"))
    return taps.tap_to_raw(rows).select(SESSION, "ord", "started_at_ms", "context_path")


@query("ssh_targets", f"""with {SQL_RAW} select session_uuid, ord, nullif(regexp_extract(cmd, '^ssh \\S+@(\\S+)$', 1), '') target from raw""")
def ssh_targets(spark, sf):
    return raw_commands(spark, sf).select(SESSION, "ord", t.ssh_target(F.col("cmd")).alias("target"))


# --- paths ------------------------------------------------------------------------------------------


@query("path_order_breaks", """with p as (select p_brand g, p_partkey, p_name, row_number() over (partition by p_brand order by p_partkey) - 1 o from part), d as (select g, o, p_partkey, case when o % 5 = 4 then o + 1 else o - 1 end dep from p where o > 0)
select d.g golden_id, d.p_partkey::varchar objective from d left join p on p.g = d.g and p.o = d.dep where p.o is null or p.o >= d.o""")
def path_order_breaks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    o = (F.row_number().over(w) - 1).cast("int")
    df = table(spark, sf, "part").select(F.col("p_brand").alias("golden_id"), o.alias("ordinal"), F.col("p_partkey").cast("string").alias("objective"),
                                         F.lag("p_partkey").over(w).cast("string").alias("_b"), F.lead("p_partkey").over(w).cast("string").alias("_n"))
    dep = F.when(F.col("ordinal") == 0, F.array().cast("array<string>")).when(F.col("ordinal") % 5 == 4, F.array(F.coalesce("_n", F.lit("none")))).otherwise(F.array("_b"))
    return golden.check_order(df.withColumn("depends_on", dep)).select("golden_id", "objective")


@query("run_kinds", f"""with {SQL_RAW} select session_uuid, case when avg((ord % 3 <> 0 and session_uuid::int % 2 = 0)::int) > 0.5 then 'web' else 'host' end golden_id from raw group by 1""")
def run_kinds(spark, sf):
    odd = (F.col("ord") % 3 != 0) & (F.col(SESSION).cast("int") % 2 == 0)
    return golden.is_web_run(raw_commands(spark, sf).withColumn("context_path", F.when(odd, "web:har").otherwise("host")))


@query("reusable_paths", """select o_orderkey::varchar session_uuid from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 > 0""")
def reusable_paths(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias(SESSION), F.col("o_orderkey").alias("n"))
    own = o.select(SESSION, (F.col("n") % 2 == 1).alias("live"), (F.col("n") % 3 == 0).alias("has_path"))
    cached = o.select(SESSION, F.lit("g").alias("golden_id"), F.when(F.col("n") % 5 == 0, "none").otherwise("ai").alias("source"), (F.col("n") % 7).alias("objectives"))
    return golden.reusable(own, cached).select(SESSION)


# --- live sessions ----------------------------------------------------------------------------------

IDLE_US = 7_200_000_000
LIVE_KIND = """case when event_type = 'click' then 'command' when event_type = 'view' then 'output' when event_type = 'error' then 'stdin_masked' when event_type = 'purchase' and k % 4 = 0 then 'session_start'
 when event_type = 'purchase' then 'command' when k % 3 = 0 then 'session_end' else 'http_request' end"""


def live_envelopes(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", r'"k": (\d+)', 1).cast("int"))
    flag = F.when(F.col("k") % 11 == 0, "deadbeefdeadbeefdeadbeefdeadbeef").otherwise("x")
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias(SESSION),
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_utc_us"), F.expr(LIVE_KIND).alias("kind"),
        F.struct(F.lit("ls").alias("cmd"), flag.alias("text")).alias("payload"), F.struct(F.lit("host").alias("context_path"), F.lit("p").alias("platform")).alias("provenance"))


CONTROLLER = f"""
le as (select 's' || (user_id % 10) source_key, 'u' || event_id session_uuid, event_id, epoch_us(ts) at_us, {LIVE_KIND} kind, k % 11 = 0 fl from (select *, regexp_extract(props, '"k": ([0-9]+)', 1)::int k from events)),
dr as (select *, row_number() over (partition by source_key order by at_us, event_id) n from le where kind <> 'http_request'),
st as (with recursive w(source_key, n, at_us, kind, before, uuid, started, was_uuid, was_last, flagged, flag_now, idle_end) as (
  select source_key, n, at_us, kind, null::varchar, case when kind = 'session_start' then session_uuid when kind = 'command' then source_key || '-' || at_us end, case when kind in ('session_start', 'command') then at_us end,
    null::varchar, null::bigint, false, false, null::bigint from dr where n = 1
  union all select r.source_key, r.n, r.at_us, r.kind, w.uuid,
    case when r.kind = 'session_start' then r.session_uuid when r.kind = 'session_end' then null
      when w.uuid is not null and r.at_us - w.at_us <= {IDLE_US} then w.uuid when r.kind = 'command' then r.source_key || '-' || r.at_us end,
    case when r.kind = 'session_start' then r.at_us when r.kind = 'session_end' then null when w.uuid is not null and r.at_us - w.at_us <= {IDLE_US} then w.started when r.kind = 'command' then r.at_us end,
    w.uuid, w.at_us,
    case when r.kind in ('session_start', 'session_end') then false when w.uuid is not null and r.at_us - w.at_us <= {IDLE_US} then w.flagged or (r.kind <> 'command' and r.fl) when r.kind = 'command' then false else false end,
    r.kind in ('output', 'stdin_masked') and r.fl and w.uuid is not null and r.at_us - w.at_us <= {IDLE_US} and not w.flagged,
    case when w.uuid is not null and r.kind not in ('session_start', 'session_end') and r.at_us - w.at_us > {IDLE_US} then w.at_us + {IDLE_US} end
  from w join dr r on r.source_key = w.source_key and r.n = w.n + 1)
  select * from w)"""


@query("live_session_events", f"""with {CONTROLLER}
select source_key, 'start' as "event", uuid session_uuid, at_us, null reason from st where uuid is not null and uuid is distinct from before
union all select source_key, 'end', before, case when kind in ('session_start', 'session_end') then at_us else idle_end end, case when kind in ('session_start', 'session_end') then 'manual' else 'idle' end from st
  where before is not null and (kind in ('session_start', 'session_end') or idle_end is not null)
union all select source_key, 'flag', uuid, at_us, null from st where flag_now
union all select source_key, 'end', uuid, at_us + {IDLE_US}, 'idle' from (select *, row_number() over (partition by source_key order by n desc) z from st) where z = 1 and uuid is not null""")
def live_session_events(spark, sf):
    return sessions.session_events_batch(live_envelopes(spark, sf), IDLE_US, True).select("source_key", "event", SESSION, "at_us", "reason")


@query("stamped_envelopes", f"""with {CONTROLLER} select 'u' || event_id original, uuid session_uuid from (
  select le.*, last_value(case when st.n is not null then coalesce(st.uuid, '') end ignore nulls) over (partition by le.source_key order by le.at_us, le.event_id) uuid
  from le left join (select dr.event_id, st.n, st.uuid from dr join st using (source_key, n)) st using (event_id)) where kind not in ('session_start', 'session_end') and uuid <> ''""")
def stamped_envelopes(spark, sf):
    env = live_envelopes(spark, sf).withColumn("original", F.col(SESSION))
    return sessions.stamp(env, IDLE_US, True).select("original", SESSION)


@query("live_event_tally", f"""with {CONTROLLER} select source_key, count(*) filter (uuid is not null and uuid is distinct from before) sessions, count(*) filter (flag_now) nudges from st group by 1""")
def live_event_tally(spark, sf):
    return sessions.tally_events(sessions.session_events_batch(live_envelopes(spark, sf), IDLE_US, True))


@query("idle_sessions", """with g as (select user_id, epoch_us(ts) t, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) > 36000000000 b from events),
i as (select *, sum(coalesce(b, true)::int) over (partition by user_id order by t) s from g)
select user_id, min(t) started_us, max(t) + 36000000000 closes_us, count(*) events from i group by user_id, s""")
def idle_sessions(spark, sf):
    df = sessions.idle_sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", gap="10 hours")
    return df.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("closes_at").alias("closes_us"), "events")


@query("joined_live_commands", f"""with {SQL_ENV} select c.session_uuid, c.seq ord, c.ts_utc_us // 1000 started_at_ms, greatest(c.ts_utc_us // 1000, coalesce(o.ts_utc_us // 1000, c.ts_utc_us // 1000)) ended_at_ms, coalesce(o.line_count, 0) output_line_count
from (select * from env where kind = 'command') c left join (select * from env where kind in ('output', 'stdin_masked')) o on o.session_uuid = c.session_uuid and o.seq = c.seq and abs(o.ts_utc_us - c.ts_utc_us) <= 864000000000""")
def joined_live_commands(spark, sf):
    return sessions.join_live(telemetry(spark, sf), wait="10 days").select(SESSION, "ord", "started_at_ms", "ended_at_ms", "output_line_count")


@query("live_status", f"""with {ALIGNED} {FINDINGS}, {HOLES},
lst as (select session_uuid, max(seq) seq, arg_max(tactic, seq) tactic, arg_max(started_at_ms, seq) last_ms, count(*) commands from al group by 1),
usd as (select distinct session_uuid, id, true u from used), src as (select session_uuid, seq source_seq, started_at_ms from ep),
fc as (select session_uuid, count(*) findings, count(*) filter (kind = 'port') ports_found, count(*) filter (kind = 'port' and u) ports_engaged, count(*) filter (kind = 'cred' and u is null) creds,
  count(*) filter (kind in ('url', 'path') and u is null) paths, max(coalesce(started_at_ms, 0)) found_ms from found left join usd using (session_uuid, id) left join src using (session_uuid, source_seq) group by 1),
hl as (select session_uuid, max(end_seq) end_seq, arg_max("binary", (end_seq, "binary")) b from holes group by 1), nz as (select session_uuid, sum({NOISE}) total from ep group by 1),
st as (select *, case when coalesce(found_ms, 0) <> 0 and last_ms <> 0 then greatest(0, last_ms - found_ms) end since from lst join nz using (session_uuid) left join fc using (session_uuid) left join hl using (session_uuid))
select session_uuid, case tactic {LABELS} else tactic end phase, 2592000000 elapsed_ms, floor(greatest(0, 100 - least(100, total / 400 * 100)) + 0.5) stealth, coalesce(ports_found, 0) ports_found,
  coalesce(ports_engaged, 0) ports_engaged, coalesce(findings, 0) findings, concat_ws(' ', case when creds = 1 then 'An unused credential is sitting in your loot.' when creds > 1 then creds || ' unused credentials are sitting in your loot.' end,
    case when paths = 1 then 'A path you found was never revisited.' when paths > 1 then paths || ' paths you found were never revisited.' end) threads,
  case when end_seq = seq then 'Long run on ' || b || ' with little to show. Step back and re-enumerate?' when since > 600000 then 'Nothing new in ' || floor(since / 60000 + 0.5)::bigint || 'm. Widen the search?' end nudge,
  commands, since since_last_find_ms from st""")
def live_status(spark, sf):
    from runlens.operators import metrics, timeline

    run = Run(spark, sf)
    who = run.sessions.select(SESSION, SESSION, F.concat(F.lit("Box "), SESSION).alias("target_name"), F.lit("2024-01-01").cast("timestamp").alias("started_at"),
                              F.lit("2024-01-31").cast("timestamp").alias("ended_at"), F.lit(False).alias("recording")).toDF(SESSION, "_x", "target_name", "started_at", "ended_at", "recording").drop("_x")
    out = live.live_status(who, run.aligned, stage(timeline.phases(run.aligned), "phases"), run.findings, run.uses, metrics.stealth(run.aligned), F.lit("2024-02-01").cast("timestamp"))
    return out.select(SESSION, "phase", "elapsed_ms", "stealth", "ports_found", "ports_engaged", "findings", F.array_join("threads", " ").alias("threads"), "nudge", "commands", "since_last_find_ms")


@query("masked_keystrokes", """select 'd' || doc_id session_uuid, case when doc_id % 3 > 0 then text else substr(text, 6) end kept from documents""")
def masked_keystrokes(spark, sf):
    """The first five keys of every third document are typed inside a full-screen program; every third has no timing."""
    d = table(spark, sf, "documents")
    rest = F.greatest(F.length("text") - 5, F.lit(0)).cast("string")
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit("\x1b[?1049h")).otherwise(F.lit("screen..")), F.when(F.col("doc_id") % 3 == 0, F.lit("\x1b[?1049l")).otherwise(F.lit("screen.."))
    rows = d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias(SESSION), F.col("text").alias("input_log"),
        F.concat(mark[0], mark[1]).alias("output_log"), F.when(F.col("doc_id") % 3 != 2, F.concat(F.lit("O 0.1 8\nI 0.2 5\nO 0.3 8\nI 0.4 "), rest, F.lit("\n"))).alias("timing_log"))
    return taps.strip_alt_screen(rows).select(SESSION, F.col("input_log").alias("kept"))


@query("paired_taps", """select 'd' || doc_id session_uuid, 'host' || doc_id % 5 target, doc_id * 1000 started_at_ms, md5(text) input, case when doc_id % 2 = 0 then 'out' end as "output" from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def paired_taps(spark, sf):
    """Up to four files per tap: every document is the typed log of one, every second tap has an output log."""
    d = table(spark, sf, "documents")
    name = lambda part: F.concat(F.lit("/taps/d"), F.col("doc_id").cast("string"), F.lit(f".{part}"))
    meta = F.to_json(F.struct(F.concat(F.lit("host"), (F.col("doc_id") % 5).cast("string")).alias("target"), (F.col("doc_id") * 1000).alias("startedAtMs")))
    files = d.select(name("in").alias("file"), F.col("text").alias("body")).unionByName(d.select(name("meta").alias("file"), meta.alias("body")))
    files = files.unionByName(d.where("doc_id % 2 = 0").select(name("out").alias("file"), F.lit("out").alias("body")))
    return taps.pair_tap_files(files).select(SESSION, "target", "started_at_ms", F.md5("input_log").alias("input"), F.col("output_log").alias("output"))


# --- store in batches and refresh -------------------------------------------------------------------


def _in_batches(spark, sf, use):
    """Hands the telemetry to use(batch, number) in three batches, as a stream would."""
    rows = stage(telemetry(spark, sf), "envelopes").withColumn("_b", (F.col("payload.line_count") / 2).cast("int") % 3)
    for number in range(3):
        use(rows.where(F.col("_b") == number).drop("_b").orderBy("ts_utc_us"), number)


@query("stored_in_batches", f"""with {SQL_ENV}, b as (select *, line_count // 2 % 3 n from env),
f as (select session_uuid, seq, arg_min(cmd, (n, ts_utc_us)) raw_command, arg_min(ts_utc_us, (n, ts_utc_us)) started_at, min(n) first_n from b where kind = 'command' group by 1, 2),
o as (select session_uuid, seq, arg_max(ts_utc_us, (n, ts_utc_us)) ended_at, count(*) blocks from b join f using (session_uuid, seq) where kind in ('output', 'stdin_masked') and n >= first_n group by 1, 2)
select session_uuid, seq, raw_command, started_at, ended_at, coalesce(blocks, 0) blocks from f left join o using (session_uuid, seq)""")
def stored_in_batches(spark, sf):
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    _in_batches(spark, sf, store.batch_writer(folder, 4))
    tables = store.normalize(store.read_batches(spark, folder, buckets=4))
    blocks = tables["output_blocks"].groupBy(SESSION, "seq").agg(F.count(F.lit(1)).alias("blocks"))
    return tables["commands"].join(blocks, [SESSION, "seq"], "left").select(
        SESSION, "seq", "raw_command", "started_at", "ended_at", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query("stored_exchanges_in_batches", f"""with {SQL_ENV}, b as (select *, line_count // 2 % 3 n from env),
q as (select session_uuid, pair_id, arg_min(url, (n, ts_utc_us)) url, arg_min(n, (n, ts_utc_us)) n from b where kind = 'http_request' group by 1, 2),
a as (select session_uuid, pair_id, arg_max(ts_utc_us, (n, ts_utc_us)) ended_at, max(n) n from b where kind = 'http_response' group by 1, 2)
select session_uuid, pair_id, url, case when a.n >= q.n then ended_at end ended_at from q left join a using (session_uuid, pair_id)""")
def stored_exchanges_in_batches(spark, sf):
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    _in_batches(spark, sf, store.batch_writer(folder, 4))
    store.compact(spark, folder, 1, 4)  # the first two batches as one generation, the third as it came
    return store.normalize(store.read_batches(spark, folder, buckets=4))["http_exchanges"].select(SESSION, "pair_id", "url", "ended_at")


#: Segmentation and alignment without a path, of commands and exchanges out of telemetry instead of events.
REFRESHED = f"""{SQL_ENV}, fc as (select session_uuid, seq, min(ts_utc_us) ts, arg_min(cmd, ts_utc_us) cmd from env where kind = 'command' group by 1, 2),
fo as (select session_uuid, seq, min(ts_utc_us) ts, arg_min("text", ts_utc_us) as "text", arg_min(line_count, ts_utc_us) n from env where kind in ('output', 'stdin_masked') group by 1, 2),
fq as (select session_uuid, pair_id, min(ts_utc_us) ts, arg_min(url, ts_utc_us) url from env where kind = 'http_request' group by 1, 2),
fa as (select session_uuid, pair_id, min(ts_utc_us) ts from env where kind = 'http_response' group by 1, 2),
raw as (select session_uuid, seq ord, {SQL_REDACT.replace('X', 'cmd')} cmd, c.ts // 1000 started_at_ms, greatest(c.ts // 1000, coalesce(o.ts // 1000, c.ts // 1000)) ended_at_ms, 0 exit_code, coalesce(n, 0) output_line_count,
    {SQL_REDACT.replace('X', '"text"')} output_digest, 'host' context_path, 1 volume, false web from fc c left join fo o using (session_uuid, seq)
  union all select session_uuid, 1099511627776 + q.ts % 1000, 'GET ' || regexp_extract(url, '(/p.*)', 1), q.ts // 1000, greatest(q.ts // 1000, coalesce(a.ts // 1000, q.ts // 1000)), 0, 0, null, 'web', 1, true
  from fq q left join fa a using (session_uuid, pair_id)){SQL_EPISODES[len(SQL_RAW):].replace("case" + chr(10) + "   when regexp_matches(lc, '", "case when web then 'TA0007|T1595|0.4'" + chr(10) + "   when regexp_matches(lc, '")},
claims as (select session_uuid, seq, 0 method_idx from ep where false), board as (select session_uuid, [''] depends_on, '' objective, seq user_satisfied_by_seq from ep where false){ALIGNED[len(CLAIMS):]}, {WASTE}"""


@query("refreshed_sessions", f"""with {REFRESHED}, m as (select session_uuid, {FOLD} from w group by 1), s as (select session_uuid, case tactic {RADAR} else 'exploit' end k from ep),
r as (select session_uuid, {', '.join(f"least(100, 25 * count(*) filter (k = '{k}'))::bigint {k}" for k in ('recon', 'web', 'exploit', 'privesc', 'opsec'))} from s group by 1),
c as (select session_uuid, count(*) episodes, count(*) filter (alignment = 'detour') detours, count(*) filter (alignment = 'alternative') alternatives, count(loop_of_seq) loops, count(distinct tactic) phases,
  count(distinct technique) filter (technique <> '') technique_breadth from al group by 1)
select session_uuid, session_uuid::int % 2 batch, c.* exclude (session_uuid), m.* exclude (session_uuid), r.* exclude (session_uuid),
  'Recording: ' || episodes || ' commands so far, techniques: ' || technique_breadth || '.' recap from c join m using (session_uuid) join r using (session_uuid)""")
def refreshed_sessions(spark, sf):
    """Batch 0 holds even sessions, batch 1 odd ones; what a batch writes holds the sessions that it touched only."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    refresh = debrief.live_refresh(spark, folder, lambda name, df, number: df.write.mode("overwrite").parquet(f"{folder}/{name}/{number}"), config=CONFIG, buckets=4)
    rows = stage(telemetry(spark, sf), "envelopes")
    for number in range(2):
        refresh(rows.where(F.col(SESSION).cast("int") % 2 == number).orderBy("ts_utc_us"), number)

    def written(number):
        read = lambda name: spark.read.parquet(f"{folder}/{name}/{number}")
        count = lambda what: F.count(F.when(what, 1))
        steps = read("episodes").groupBy(SESSION).agg(
            F.count(F.lit(1)).alias("episodes"), count(F.col("alignment") == "detour").alias("detours"), count(F.col("alignment") == "alternative").alias("alternatives"), F.count("loop_of_seq").alias("loops"))
        phases = read("phases").groupBy(SESSION).agg(F.count(F.lit(1)).alias("phases"))
        row = read("metrics").select(SESSION, "technique_breadth", "productive_ms", "detour_ms", "stuck_ms", "loop_ms", "active_ms", F.round("efficiency_pct", 6).alias("efficiency_pct"))
        out = steps.withColumn("batch", F.lit(number))
        for part in (phases, row, read("radar"), read("recap").select(SESSION, F.col("action").alias("recap"))):
            out = out.join(part, SESSION, "left")
        return out

    return written(0).unionByName(written(1))


@query("appended_episodes", f"""with {SQL_EPISODES}, m as (select session_uuid, max(seq) n from ep group by 1)
select session_uuid, seq, cmd from ep union all select ep.session_uuid, ep.seq + m.n, cmd from ep join m using (session_uuid) where ep.seq <= 3""")
def appended_episodes(spark, sf):
    run = Run(spark, sf)
    return segment.append_episodes(run.staged, run.staged.where("seq <= 3")).select(SESSION, "seq", "cmd")


@query("canonical_contents", """select o_orderkey, '{"a":' || o_orderkey || ',"inner":{"b":null,"y":"' || o_orderstatus || '"},"list":[{"k":1,"z":"' || o_orderpriority || '"}],"n":null,"z":"' || o_orderstatus || '"}' body from orders""")
def canonical_contents(spark, sf):
    null = F.lit(None).cast("string")
    body = F.struct(
        F.col("o_orderstatus").alias("z"), F.array(F.struct(F.col("o_orderpriority").alias("z"), F.lit(1).alias("k"))).alias("list"),
        F.struct(F.col("o_orderstatus").alias("y"), null.alias("b")).alias("inner"), null.alias("n"), F.col("o_orderkey").alias("a"))
    df = table(spark, sf, "orders").select("o_orderkey", body.alias("content"))
    return df.select("o_orderkey", grade.canonical_json(df, "content").alias("body"))


CARD_ROWS = """select c_custkey::varchar session_uuid, timestamp '2024-01-01' + to_days((c_custkey * 7 % 100)::int) started_at,
  timestamp '2024-01-01' + to_days((c_custkey * 7 % 100)::int) + to_hours((c_custkey % 5)::int) ended_at, false recording, c_nationkey % 3 = 0 rooted, c_acctbal coverage from customer"""


@query("session_cards", f"""with s as ({CARD_ROWS}) select session_uuid, coverage, coverage / 2 efficiency, session_uuid::int % 9 breadth, coverage / 3 methodology, coverage / 4 grade, 'B' letter, rooted,
  1 + session_uuid::int % 2 episodes, session_uuid = (select arg_max(session_uuid, (ended_at, session_uuid)) from s) is_latest from s""")
def session_cards(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string").alias(SESSION)
    began = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") * 7 % 100).cast("int")).cast("timestamp")
    who = c.select(key, began.alias("started_at"), F.timestamp_seconds(F.unix_seconds(began) + F.col("c_custkey") % 5 * 3600).alias("ended_at"), F.lit(False).alias("recording"))
    rows = c.select(key, F.col("c_acctbal").alias("objective_coverage_pct"), (F.col("c_acctbal") / 2).alias("efficiency_pct"),
                    (F.col("c_custkey") % 9).cast("int").alias("technique_breadth"), (F.col("c_acctbal") / 3).alias("methodology_coverage_pct"))
    grades = c.select(key, (F.col("c_acctbal") / 4).alias("score"), F.lit("B").alias("letter"))
    board = c.select(key, F.lit("escalate_to_root").alias("objective"), F.when(F.col("c_nationkey") % 3 == 0, F.lit(1).cast("bigint")).alias("user_satisfied_by_seq"))
    steps = c.select(key, F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 2).cast("int"))).alias("seq"))
    out = progress.session_cards(who, rows, grades, board, steps, F.lit("2024-12-01").cast("timestamp"))
    return out.select(SESSION, "coverage", "efficiency", "breadth", "methodology", "grade", "letter", "rooted", "episodes", "is_latest")


@query("defense_cards", """select s_suppkey::varchar session_uuid, 'case-' || s_suppkey case_id, s_acctbal grade, floor(case when s_suppkey % 7 > 0 then (s_suppkey % 3) / (s_suppkey % 7)::double * 100 else 0 end + 0.5) coverage,
  s_suppkey % 7 episodes, false rooted, 'defense' mode from supplier""")
def defense_cards(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    reports = s.select(key.alias("run_session"), F.concat(F.lit("case-"), key).alias("case_id"), F.col("s_acctbal").alias("score"), F.lit("A").alias("letter"),
                       (F.col("s_suppkey") % 7).alias("artifacts"), (F.col("s_suppkey") % 3).alias("found"))
    out = progress.defense_cards(s.select(key.alias(SESSION)), reports.select("case_id"), reports)
    return out.select(SESSION, "case_id", "grade", "coverage", "episodes", "rooted", "mode")


@query("realigned_coverage", f"""with {WEB_CLAIMS} select session_uuid, count(*) objectives, count(seq)::double / count(*) * 100 coverage_pct from wboard group by 1""")
def realigned_coverage(spark, sf):
    """All sessions under the web ladder instead of their own."""
    run = Run(spark, sf)
    web = run.sessions.select(SESSION, F.lit("web").alias("golden_id"))
    _aligned, board, _row = debrief.realign(run.staged, web, run.golden, run.findings, run.uses)
    return board.groupBy(SESSION).agg(F.count(F.lit(1)).alias("objectives"), (F.count("user_satisfied_by_seq") / F.count(F.lit(1)) * 100).alias("coverage_pct"))
