"""Text, url and label functions on documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bindings import SQL_EPISODES, Run, table
from catalog.kit import CWE, UKC, registry
from runlens import rules
from runlens.functions import display as d
from runlens.functions import net
from runlens.functions import text as t
from runlens.operators import classify, golden, guard
from runlens.schemas import SESSION

QUERIES, query = registry()

SQL_REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(X,
  '\b(?:\d{1,3}\.){3}\d{1,3}\b', 'x.x.x.x', 'g'), '\b[0-9a-f]{32}\b', '[redacted-flag]', 'gi'),
  '\b(password|passwd|pass|secret|token|api[_-]?key)\b\s*[:=]\s*[^\s&]+', '\1=[redacted]', 'gi'),
  '\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'gi'), '\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b', '[redacted-jwt]', 'g'),
  '\b(?:sk|pk|ghp|xox[baprs])[_-][A-Za-z0-9_-]{10,}\b', '[redacted-key]', 'g')"""


@query("redacted_documents", f"select doc_id, md5({SQL_REDACT.replace('X', 'text')}) digest from documents")
def redacted_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.redact_text(F.col("text"))).alias("digest"))


@query("redaction_audit", f"select source, count(*) filter ({SQL_REDACT.replace('X', 'text')} <> text) redacted, count(*) documents from documents group by 1")
def redaction_audit(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.when(t.was_redacted(F.col("text")), 1)).alias("redacted"), F.count(F.lit(1)).alias("documents"))


@query("masked_ips", r"select doc_id, md5(regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', 'x.x.x.x', 'g')) digest from documents")
def masked_ips(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.mask_ips(F.col("text"))).alias("digest"))


@query("public_profile", f"select doc_id, md5(case when doc_id % 2 = 0 then {SQL_REDACT.replace('X', 'text')} else text end) digest from documents")
def public_profile(spark, sf):
    profile = F.when(F.col("doc_id") % 2 == 0, "public_safe").otherwise("full")
    return table(spark, sf, "documents").select("doc_id", F.md5(t.apply_profile(F.col("text"), profile)).alias("digest"))


@query("leading_binaries", r"""select doc_id, regexp_replace(coalesce(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '' and not regexp_matches(w, '^[A-Z_][A-Z0-9_]*='))[1], ''), '^.*[/\\]', '') "binary" from documents""")
def leading_binaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.extract_binary(F.col("text")).alias("binary"))


@query("plain_typography", r"""select doc_id, md5(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{2012}-\x{2015}]', '-', 'g'),
  '[\x{2018}-\x{201b}]', '''', 'g'), '[\x{201c}-\x{201f}]', '"', 'g'), chr(8230), '...'), '[\x{00a0}\x{2007}\x{2009}\x{202f}]', ' ', 'g'), '[\x{200b}-\x{200d}\x{feff}]', '', 'g')) digest from documents""")
def plain_typography(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.normalize_typography(F.col("text"))).alias("digest"))


@query("masked_secrets", "select doc_id, '••••' || right(source, 2) masked from documents")
def masked_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.mask_secret(F.col("source")).alias("masked"))


@query("redacted_headers", r"""select page_id, 'Host: ' || regexp_extract(url, '://([^/]+)', 1) || chr(10) || 'Cookie: [redacted]' || chr(10) || 'X-Api-Key: [redacted]' headers from pages""")
def redacted_headers(spark, sf):
    host = F.regexp_extract("url", "://([^/]+)", 1)
    raw = F.concat(F.lit("Host: "), host, F.lit("\r\nCookie: a="), F.col("page_id").cast("string"), F.lit("\r\nX-Api-Key: "), host)
    return table(spark, sf, "pages").select("page_id", t.redact_headers(raw).alias("headers"))


HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split(url, ''), lambda c: unicode(c)::bigint)), lambda a, b: (a * 31 + b) & 4294967295)"


@query("url_hashes", f"select page_id, format('{{:08x}}', {HASH}) hash8, ({HASH} % 360)::int hue from pages")
def url_hashes(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.hash8(F.col("url")).alias("hash8"), t.hue(F.col("url")).alias("hue"))


@query("flag_tokens", "select doc_id, regexp_matches(text, '(^|[^0-9a-fA-F])[0-9a-fA-F]{32}([^0-9a-fA-F]|$)') has_flag from documents")
def flag_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.contains_flag(F.col("text")).alias("has_flag"))


PATH = r"""(select page_id, url, regexp_replace(regexp_replace(url, '^[a-z][a-z0-9+.-]*://[^/?#]+', ''), '#.*$', '') r from pages)"""


@query("url_parts", f"""select page_id, 'POST' as "method", case when r like '/%' then r else '/' || r end path from {PATH}""")
def url_parts(spark, sf):
    cmd = F.concat(F.lit("post "), t.url_path(F.col("url")))
    return table(spark, sf, "pages").select("page_id", t.http_method(cmd).alias("method"), t.http_path(cmd).alias("path"))


@query("web_exchange_priors", r"""with q as (select page_id, url, case when contains(url, '?') then substr(url, strpos(url, '?') + 1) else '' end q,
  case when page_id % 7 = 0 then 'id=1'' OR 1=1' when page_id % 7 = 1 then 'f=../../x' when page_id % 7 = 2 then '<script>' else '' end b,
  case when page_id % 2 = 0 then 'SQL syntax error <script>' else html end r, case when page_id % 3 = 0 then 'POST' else 'GET' end m from pages)
select page_id, case when regexp_matches(q, s) or regexp_matches(b, s) then 'T1190' when regexp_matches(q, tr) or regexp_matches(b, tr) then 'T1190'
    when regexp_matches(q, x) or (regexp_matches(b, x) and regexp_matches(r, x)) then 'T1190' when m = 'POST' and regexp_matches(url, '(?i)\b(login|signin|auth|token|session)\b') then 'T1110' else 'T1595' end technique,
  case when regexp_matches(q, s) or regexp_matches(b, s) then 'CWE-89' when regexp_matches(q, tr) or regexp_matches(b, tr) then 'CWE-22' when regexp_matches(q, x) or (regexp_matches(b, x) and regexp_matches(r, x)) then 'CWE-79' end cwe,
  case when regexp_matches(q, s) or regexp_matches(b, s) then case when regexp_matches(r, '(?i)sql syntax|mysql_fetch|ORA-\d|unclosed quotation|pg_query|sqlite_') then 0.9 else 0.7 end
    when regexp_matches(q, tr) or regexp_matches(b, tr) then 0.8 when regexp_matches(q, x) or (regexp_matches(b, x) and regexp_matches(r, x)) then 0.7
    when m = 'POST' and regexp_matches(url, '(?i)\b(login|signin|auth|token|session)\b') then 0.6 else 0.4 end::double confidence
from q, (select '(?i)(''|%27|\bUNION\b|\bOR\b\s+1=1|--\s|%20OR%20)' s, '(?i)(\.\./|\.\.%2f|%2e%2e/|/etc/passwd)' tr, '(?i)<script|onerror=|javascript:' x)""")
def web_priors(spark, sf):
    pid = F.col("page_id")
    body = F.when(pid % 7 == 0, "id=1' OR 1=1").when(pid % 7 == 1, "f=../../x").when(pid % 7 == 2, "<script>").otherwise("")
    web = F.struct(
        F.when(pid % 3 == 0, "POST").otherwise("GET").alias("method"), F.col("url").alias("url"), body.alias("req_body"),
        F.when(pid % 2 == 0, "SQL syntax error <script>").otherwise(F.col("html")).alias("resp_body"))
    df = table(spark, sf, "pages").select("page_id", classify.web_prior(web).alias("p"))
    return df.select("page_id", "p.technique", "p.cwe", "p.confidence")


@query("addresses", r"""with i as (select doc_id, regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b') ips from documents)
select doc_id, len(ips) addresses, coalesce(list_bool_or(list_transform(ips, lambda x: (split_part(x, '.', 1)::bigint & 255) = 10)), false) in_ten from i""".replace("list_bool_or", "list_max"))
def addresses(spark, sf):
    ips = net.ips_in(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(ips).cast("bigint").alias("addresses"), net.any_ip_in(ips, ["10.0.0.0/8"]).alias("in_ten"))


@query("version_ranges", """select p_partkey, (a, b, c) >= (5, 8, 0) and (a, b, c) < (5, 16, 11) in_range from (
  select p_partkey, p_partkey % 7 a, p_size % 20 b, p_partkey % 15 c from part)""")
def version_ranges(spark, sf):
    text = F.concat((F.col("p_partkey") % 7).cast("string"), F.lit("."), (F.col("p_size") % 20).cast("string"), F.lit("."),
                    (F.col("p_partkey") % 15).cast("string"), F.lit("-generic"))
    return table(spark, sf, "part").select("p_partkey", net.version_in(net.parse_version(text), (5, 8, 0), (5, 16, 11)).alias("in_range"))


@query("normalized_binaries", """select p_partkey, case p_size % 3 when 0 then 'python3' when 1 then 'perl' else 'vim' end "binary" from part""")
def normalized_binaries(spark, sf):
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/usr/bin/python3."), F.col("p_size").cast("string"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("/opt/perl5."), F.col("p_size").cast("string"))).otherwise("/usr/bin/vim.basic")
    return table(spark, sf, "part").select("p_partkey", net.normalize_binary(path).alias("binary"))


@query("coaching_categories", r"""select doc_id, case when regexp_matches(text, '(?i)sudo|privesc|kernel|suid|cron|capabilit|gtfo|escalat|\broot\b') then 'PrivEsc'
  when regexp_matches(text, '(?i)noise|loud|stealth|opsec|rate.?limit|detour|quiet') then 'OpSec' when regexp_matches(text, '(?i)credential|hydra|brute|password|login|default cred|\bssh\b|reuse|lateral') then 'Access'
  when regexp_matches(text, '(?i)nmap|gobuster|ffuf|enumerat|recon|\bscan\b') then 'Recon' when regexp_matches(text, '(?i)upload|web ?shell|http|payload|\.ph') then 'Web' else 'Tactics' end category from documents""")
def coaching_categories(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.coaching_category(F.col("text")).alias("category"))


@query("leads", r"""with x as (select conv_id, turn, text, strpos(text, '. ') p from conversations)
select conv_id, turn, case when p > 1 and p < 91 then trim(substr(text, 1, p)) else regexp_replace(text, '^\s+|\s+$', '', 'g') end as "action",
  case when p > 1 and p < 91 then regexp_replace(substr(text, p + 2), '^\s+|\s+$', '', 'g') else '' end why from x""")
def leads(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", t.split_lead(F.col("text")).alias("l"))
    return df.select("conv_id", "turn", "l.action", "l.why")


@query("seen_terms", r"""select distinct item_id, term from (select item_id, regexp_replace(unnest(string_split_regex(lower(text), '[^\w.-]+')), '^[.-]+|[.-]+$', '', 'g') term from benchmark) where length(term) >= 3""")
def seen_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(t.seen_terms(F.col("text"))).alias("term"))


@query("slugs", r"select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') slug from part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.slug(F.col("p_name")).alias("slug"))


@query("prose_lists", "select p_partkey, p_brand || ', ' || p_type || ' and ' || p_size items from part")
def prose_lists(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.list_join(F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("items"))


@query("formatted_times", r"""with v as (select event_id, floor(value * 1000)::bigint ms from events), s as (select *, floor(ms / 1000.0 + 0.5)::bigint t from v)
select event_id, case when ms in (250, 750) then printf('%.1fs', (ms + 50) / 1000.0) when ms < 1000 then printf('%.1fs', ms / 1000.0) when t >= 3600 then (t // 3600) || 'h ' || (t % 3600 // 60) || 'm' when t >= 60 then (t // 60) || 'm ' || (t % 60) || 's' else t || 's' end as "duration",
  floor(ms / 60000.0 + 0.5)::bigint || ' min' "minutes", (ms // 60000) || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') clock from s""")
def formatted_times(spark, sf):
    ms = F.floor(F.col("value") * 1000).cast("bigint")
    df = table(spark, sf, "events").select("event_id", ms.alias("ms"))
    return df.select("event_id", d.format_duration(F.col("ms")).alias("duration"), d.format_minutes(F.col("ms")).alias("minutes"),
                     d.format_clock(F.col("ms")).alias("clock"))


@query("letters", """select o_orderkey, floor(s * 10 + 0.5) / 10 rounded, case when s >= 90 then 'A' when s >= 80 then 'B' when s >= 70 then 'C' when s >= 60 then 'D' else 'F' end letter,
  greatest(0, least(100, s))::double clamped, floor(s + 0.5)::bigint || '%' pct from (select o_orderkey, o_totalprice / 4000 - 5 s from orders)""")
def letters(spark, sf):
    s = F.col("o_totalprice") / 4000 - 5
    return table(spark, sf, "orders").select(
        "o_orderkey", d.js_round(s, 1).alias("rounded"), d.letter(s).alias("letter"), d.clamp(s).alias("clamped"), d.format_pct(s).alias("pct"))


def _case(table_: dict, column: str) -> str:
    quoted = " ".join(f"when '{k}' then '{v}'" for k, v in table_.items())
    return f"case {column} {quoted} else {column} end"


@query("display_labels", f"""with {SQL_EPISODES}, {UKC}, {CWE} select distinct tactic, technique, {_case(rules.TACTIC_LABELS, 'tactic')} "label", {_case(rules.SHORT_TACTIC_LABELS, 'tactic')} short,
  {_case(rules.TECHNIQUE_NAMES, 'technique')} name, 'https://attack.mitre.org/techniques/' || replace(technique, '.', '/') || '/' url, upper(ukc[1]) || replace(ukc[2:], '-', ' ') phase,
  case when cwe is not null then cwe || ' · ' || {_case(rules.CWE_NAMES, 'cwe')} end weakness from ep join ukc using (tactic) left join weak on weak.b = lower("binary") where technique is not null""")
def display_labels(spark, sf):
    df = classify.with_frameworks(Run(spark, sf).segmented).where("technique is not null")
    cwe = F.get("cwe", 0)
    return df.select(
        "tactic", "technique", d.tactic_label(F.col("tactic")).alias("label"), d.short_tactic_label(F.col("tactic")).alias("short"),
        d.technique_name(F.col("technique")).alias("name"), d.technique_url(F.col("technique")).alias("url"), d.ukc_label(F.col("ukc")).alias("phase"),
        d.cwe_label(cwe).alias("weakness")).distinct()


@query("capture_sources", """select c_custkey, case c_custkey % 5 when 0 then 'claude-code' when 1 then 'http-proxy' when 2 then 'sysmon' when 3 then 'local_pty' else 'plugin' end key from customer""")
def capture_sources(spark, sf):
    k = F.col("c_custkey") % 5
    shell = F.when(k == 0, "Claude-Code").otherwise("bash")
    context = F.when(k == 1, "web:har").when(k == 2, "EDR:sysmon").otherwise("host")
    source = F.when(k == 3, "local_pty").otherwise("plugin")
    return table(spark, sf, "customer").select("c_custkey", d.capture_source(shell, context, source)["key"].alias("key"))


@query("live_recordings", """select o_orderkey, o_orderstatus = 'O' and epoch_ms(timestamp '1997-06-01') - epoch_ms(o_orderdate) < 120000 live from orders""")
def live_recordings(spark, sf):
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        "o_orderkey", d.is_live(F.col("o_orderstatus") == "O", at, at, F.lit("1997-06-01").cast("timestamp")).alias("live"))


@query("target_identity", """with s as (select c_custkey, c_custkey % 6 k, replace(c_name, '#', '') n from customer)
select c_custkey, case k when 0 then 'htb' when 1 then 'thm' when 2 then 'offsec' when 3 then 'htb' when 4 then 'thm' else 'local' end platform,
  case k when 0 then n when 3 then 'box 10.129.4.' || (c_custkey % 250) when 4 then '10.10.7.' || (c_custkey % 250) || ' room' else n end name,
  case k when 0 then 2 end::int difficulty_level,
  case k when 0 then 'https://app.hackthebox.com/machines/' || regexp_replace(lower(n), '[^a-z0-9]', '', 'g') when 1 then 'https://tryhackme.com/room/' || regexp_replace(lower(n), '[^a-z0-9]', '', 'g')
    when 3 then 'https://app.hackthebox.com/machines/box101294' || (c_custkey % 250) when 4 then 'https://tryhackme.com/room/10107' || (c_custkey % 250) || 'room' end url from s""")
def target_identity(spark, sf):
    k, n = F.col("c_custkey") % 6, F.replace("c_name", F.lit("#"), F.lit(""))
    scope = (
        F.when(k == 0, F.concat(F.lit("HTB:: "), n, F.lit(" (Medium) — x"))).when(k == 1, F.concat(F.lit("thm::"), n, F.lit(" (b)")))
        .when(k == 2, F.concat(F.lit("OffSec::"), n)).when(k == 3, F.concat(F.lit("box 10.129.4."), (F.col("c_custkey") % 250).cast("string")))
        .when(k == 4, F.concat(F.lit("10.10.7."), (F.col("c_custkey") % 250).cast("string"), F.lit(" room"))).otherwise(F.concat(n, F.lit(" (x)"))))
    df = table(spark, sf, "customer").select("c_custkey", scope.alias("target_scope"), F.lit("host").alias("context_path"))
    out = classify.identify_target(df)
    return out.select("c_custkey", "target.platform", "target.name", "target.difficulty_level", "target.url")


KEYWORDS = [
    (1, r"(?i)\b(the|les)\b", "scan", "TA0007", "nmap"), (2, r"(?i)\band\b", "enter", "TA0001", "sqlmap"),
    (3, r"(?i)\bthat\b", "run", "TA0002", "bash"), (4, r"(?i)\b(with|avec)\b", "escalate", "TA0004", "sudo"),
]
KEY_ROWS = ", ".join(f"({i}, '{p}', '{o}', '{tac}')" for i, p, o, tac, _m in KEYWORDS)


@query("writeup_paths", f"""with k(i, p, objective, tactic) as (values {KEY_ROWS}), x as (select doc_id, objective, tactic, i, case
    when i = 1 then least(coalesce(nullif(strpos(regexp_replace(text, '(?i)\\b(the|les)\\b', chr(1)), chr(1)), 0), 9999999), 9999999)
    when i = 2 then coalesce(nullif(strpos(regexp_replace(text, '(?i)\\band\\b', chr(1)), chr(1)), 0), 9999999)
    when i = 3 then coalesce(nullif(strpos(regexp_replace(text, '(?i)\\bthat\\b', chr(1)), chr(1)), 0), 9999999)
    else coalesce(nullif(strpos(regexp_replace(text, '(?i)\\b(with|avec)\\b', chr(1)), chr(1)), 0), 9999999) end spot from documents, k),
f as (select *, row_number() over (partition by doc_id order by spot, i) - 1 o, count(*) over (partition by doc_id) n, lag(objective) over (partition by doc_id order by spot, i) before from x where spot < 9999999)
select doc_id golden_id, o::int ordinal, objective, tactic, before depends_on, round(least(0.5, 0.25 + n * 0.05), 6)::double confidence from f where n >= 2""")
def writeup_paths(spark, sf):
    df = golden.from_writeups(table(spark, sf, "documents"), "doc_id", "text", KEYWORDS)
    return df.select("golden_id", "ordinal", "objective", "tactic", F.get("depends_on", 0).alias("depends_on"), F.round("confidence", 6).alias("confidence"))


@query("task_list_paths", r"""with d as (select doc_id, string_split_regex('Task 1: ' || replace(text, '. ', chr(10) || 'Task 2. '), '\r?\n') ls from documents),
l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) n from d),
h as (select *, regexp_matches(line, '(?i)^\s*Task\s+\d+\b') hd, sum(regexp_matches(line, '(?i)^\s*Task\s+\d+\b')::int) over (partition by doc_id order by n) s from l),
tk as (select doc_id, s, max(case when hd then regexp_replace(regexp_extract(line, '(?i)^\s*Task\s+\d+\b[.:]?\s*(.*)$', 1), '^\s+|\s+$', '', 'g') end) title,
  max(regexp_matches(line, '(?i)\b(nmap|scan|enumerat|recon|port)\b')::int) a, max(regexp_matches(line, '(?i)\b(exploit|shell|access|foothold|smb|upload|rce)\b')::int) b,
  max(regexp_matches(line, '(?i)\b(cred|password|hash|brute)\b')::int) c, max(regexp_matches(line, '(?i)\b(privilege|privesc|escalat|root|system|suid|sudo)\b')::int) e from h where s > 0 group by 1, 2),
o as (select *, regexp_replace(regexp_replace(lower(coalesce(nullif(title, ''), 'task_' || s)), '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') nm, max(s) over (partition by doc_id) n from tk)
select doc_id golden_id, (s - 1)::int ordinal, coalesce(nullif(nm, ''), 'task_' || s) objective, case when a = 1 then 'TA0007' when b = 1 then 'TA0002' when c = 1 then 'TA0006' when e = 1 then 'TA0004' else 'TA0002' end tactic from o where n >= 2""")
def task_list_paths(spark, sf):
    text = F.concat(F.lit("Task 1: "), F.replace("text", F.lit(". "), F.lit("\nTask 2. ")))
    df = golden.from_task_lists(table(spark, sf, "documents").select("doc_id", text.alias("tasks")), "doc_id", "tasks")
    return df.select("golden_id", "ordinal", "objective", "tactic")


@query("cleaned_objectives", r"""with p as (select p_brand g, p_partkey pos, regexp_replace(regexp_replace(lower(trim(p_type)), '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') o, case when p_size % 2 = 0 then 'TA0007' else 'TA0002' end tac from part where p_partkey % 5 <> 0),
f as (select g, o, min(pos) pos, arg_min(tac, pos) tac from p where o <> '' group by 1, 2), r as (select *, row_number() over (partition by g order by pos) - 1 n from f)
select g golden_id, n::int ordinal, o objective, tac tactic from r""")
def cleaned_objectives(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("golden_id"), F.col("p_partkey").alias("position"), F.col("p_type").alias("objective"),
        F.when(F.col("p_size") % 2 == 0, " ta0007").otherwise("none").alias("tactic"),
        F.array(F.when(F.col("p_partkey") % 5 == 0, " ").otherwise("nmap")).alias("satisfied_by"), F.array("p_name").alias("depends_on"))
    return golden.clean_objectives(rows).select("golden_id", "ordinal", "objective", "tactic")


GUARD_TERMS = ["that", "onen"]


@query("screened_hints", r"""with h as (select conv_id || '-' || turn hint_id, text, lower(text) l, case turn % 3 when 0 then 'process' when 1 then 'area' else 'technique' end kind, (conv_id % 3 + 1) tier,
  regexp_replace(text, '^\s+|\s+$', '', 'g') x from conversations)
select hint_id, case when x = '' then 'shape: missing or empty hint' when length(x) > 300 then 'shape: too long' when len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) > 30 then 'shape: too many words'
  when regexp_matches(regexp_replace(x, '[A-Za-z]', '', 'g'), '\p{L}|\p{M}') then 'shape: non-ascii letter' when tier = 1 and kind <> 'process' then 'shape: tier 1 requires process' when tier = 2 and kind = 'technique' then 'shape: tier 2 forbids technique'
  when regexp_matches(x, '(?i)\b[a-z][a-z0-9+.-]*://|\bwww\.') then 'artifacts: url' when regexp_matches(x, '\b\d{1,3}(?:\.\d{1,3}){3}\b') then 'artifacts: ipv4'
  when regexp_matches(x, '(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b') then 'artifacts: hostname' when regexp_matches(x, '(?i)\bcve-\d{4}-\d{3,}\b') then 'artifacts: cve'
  when regexp_matches(x, '(?i)(?:^|[^\w])(?:~|\.{1,2})?/[\w.-]+/|\b[\w.-]+/[\w.-]+/[\w.-]+|[a-z]:\\|\\[\w.-]+\\') then 'artifacts: path' when regexp_matches(x, '\b\w{2,16}\{[^}]*\}') then 'artifacts: flag'
  when regexp_matches(x, '(?i)\b(?:0x)?[0-9a-f]{16,}\b') then 'artifacts: hex' when regexp_matches(x, '(?i)\b(?:password|passwd|passphrase|pwd|secret|token|api[ _-]?key)\s*(?:is|was|=|:)') then 'artifacts: credential'
  when regexp_matches(x, '(?i)(?:^|\s)--?[a-z][\w-]*|\||(?:^|\s)\d?[<>]{1,2}|\$\(|\$\{|`|&&') then 'artifacts: command'
  when len(list_filter(string_split_regex(x, '\s+'), lambda w: length(regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g')) >= 8 and regexp_matches(regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g'), '[a-z]')::int + regexp_matches(regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g'), '[A-Z]')::int
    + regexp_matches(regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g'), '\d')::int + regexp_matches(regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g'), '[^A-Za-z0-9]')::int >= 3)) > 0 then 'artifacts: secret-like token'
  when regexp_matches(lower(x), '(^|[^a-z0-9])that(e?s)?([^a-z0-9]|$)') then 'golden: that' when regexp_matches(lower(x), '(^|[^a-z0-9])onen(e?s)?([^a-z0-9]|$)') then 'golden: onen' end reason from h""")
def screened_hints(spark, sf):
    talk = table(spark, sf, "conversations")
    hints = talk.select(
        F.concat_ws("-", "conv_id", "turn").alias("hint_id"), F.col("conv_id").cast("string").alias(SESSION), F.col("text").alias("hint"),
        F.when(F.col("turn") % 3 == 0, "process").when(F.col("turn") % 3 == 1, "area").otherwise("technique").alias("kind"),
        (F.col("conv_id") % 3 + 1).alias("tier"))
    board = talk.select(F.col("conv_id").cast("string").alias(SESSION)).distinct().select(
        SESSION, F.lit(0).alias("ordinal"), F.lit("go_up").alias("objective"), F.array(*[F.lit(w) for w in GUARD_TERMS]).alias("satisfied_by"),
        F.array().cast("array<string>").alias("techniques"), F.lit(None).cast("bigint").alias("user_satisfied_by_seq"))
    steps = talk.select(F.col("conv_id").cast("string").alias(SESSION), F.lit("ls").alias("cmd"), F.lit("none").alias("output_digest"))
    return guard.screen_hints(hints, board, steps).select("hint_id", "reason")
