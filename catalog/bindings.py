"""The given tables read as session telemetry.

``events`` becomes raw commands: one session per user, the command line, output and exit code derived from the
event type and the ``k`` property. The derivation is written once and used by both engines; everything after it
is computed independently by each.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import rules
from runlens.operators import align, findings, ghost, golden, privesc, segment
from runlens.schemas import SESSION
from runlens.session import stage

THINK_MS, IDLE_MS = 43_200_000, 172_800_000
CONFIG = segment.SegmentConfig(idle_gap_ms=IDLE_MS, think_pause_ms=THINK_MS)

CMD = """
case
 when event_type = 'click' and k % 3 = 0 then 'nmap -sV 10.10.10.5'
 when event_type = 'click' and k % 3 = 1 then concat('gobuster dir -u http://10.10.10.5:', 8000 + k % 5, '/ -w list', k)
 when event_type = 'click' then concat('curl -u svc:pw http://10.10.10.5:', 8000 + k % 5, '/p', k)
 when event_type = 'view' and k % 3 = 0 then concat('cat /srv/data/hunter', k % 20, '.txt')
 when event_type = 'view' and k % 3 = 1 then 'id'
 when event_type = 'view' then concat('python3 -m http.server ', 9000 + k)
 when event_type = 'signup' and k % 4 = 0 then 'sudo -l'
 when event_type = 'signup' and k % 4 = 1 then 'sudo nmap -sn 10.10.10.0/24'
 when event_type = 'signup' and k % 4 = 2 then concat('ssh svc@10.10.10.', k)
 when event_type = 'signup' then 'cat /home/svc/user.txt'
 when event_type = 'purchase' and k % 4 = 0 then 'hydra -l admin ssh://10.10.10.5'
 when event_type = 'purchase' and k % 4 = 1 then concat('python3 exploit.py --run password=hunter', k % 20)
 when event_type = 'purchase' and k % 4 = 2 then 'bash -i'
 when event_type = 'purchase' then 'cat /root/root.txt'
 when k % 3 = 0 then 'smbclient -L //10.10.10.5 -N'
 when k % 3 = 1 then concat('sqlmap -u http://10.10.10.5/?id=', k)
 else concat('hydra -l root ssh://10.10.10.', k)
end"""
OUTPUT = """
case
 when event_type = 'click' and k % 3 = 0 then concat(8000 + k % 5, '/tcp open http')
 when event_type = 'click' and k % 3 = 1 then concat('found http://10.10.10.5:', 8000 + k % 5, '/p', k)
 when event_type = 'view' and k % 3 = 0 then concat('password=hunter', k % 20)
 when event_type = 'view' and k % 3 = 1 then 'uid=1000(svc) gid=1000(svc) groups=1000(svc),999(docker)'
 when event_type = 'signup' and k % 4 = 0 then '(root) NOPASSWD: /usr/bin/find'
 when event_type = 'signup' and k % 4 = 3 then 'deadbeefdeadbeefdeadbeefdeadbeef'
 when event_type = 'purchase' and k % 4 = 2 then 'uid=0(root) gid=0(root)'
 when event_type = 'purchase' and k % 4 = 3 then '[redacted-flag]'
 when event_type = 'purchase' and k % 4 = 1 and k % 5 = 0 then 'CVE-2021-3156 applies'
 when event_type = 'purchase' and k % 4 = 1 then 'done'
 when event_type = 'error' and k % 3 = 1 then 'connection rejected'
 when event_type = 'error' and k % 3 = 2 then 'login denied'
end"""
EXIT = "case when event_type = 'error' and k % 3 <> 0 then 1 else 0 end"
CONTEXT = "case when k >= 85 then 'host->ssh:10.10.10.5' else 'host' end"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_commands(spark: SparkSession, sf: str) -> DataFrame:
    started = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    base = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias(SESSION), F.col("event_id").alias("ord"), "event_type",
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("k"), started.alias("started_at_ms"), "value",
    )
    return base.select(
        SESSION, "ord", F.expr(CMD).alias("cmd"), "started_at_ms",
        (F.col("started_at_ms") + F.floor(F.col("value") * 1000)).cast("bigint").alias("ended_at_ms"),
        F.expr(EXIT).cast("int").alias("exit_code"), (F.col("k") * 10).cast("bigint").alias("output_line_count"),
        F.expr(OUTPUT).alias("output_digest"), F.expr(CONTEXT).alias("context_path"),
        F.floor("value").cast("bigint").alias("volume"),
        F.lit(None).cast("struct<method:string,url:string,req_body:string,status:bigint,resp_body:string,mime:string>").alias("web"),
    )


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return segment.segment_episodes(raw_commands(spark, sf), CONFIG)


class Run:
    """The telemetry of one scale. Tables that several operators of a query read are staged once."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def segmented(self) -> DataFrame:
        """Episodes as a lazy plan, for queries that read them once."""
        return episodes(self.spark, self.sf)

    @cached_property
    def staged(self) -> DataFrame:
        return stage(self.segmented, "episodes")

    @cached_property
    def golden(self) -> DataFrame:
        return golden.with_lineage(golden.ladders(self.spark))

    @cached_property
    def sessions(self) -> DataFrame:
        """One row per session, straight from the key column."""
        return table(self.spark, self.sf, "events").select(F.col("user_id").cast("string").alias(SESSION)).distinct()

    @cached_property
    def objectives(self) -> DataFrame:
        """Objectives of the ladder that fits each session's own commands."""
        pick = golden.is_web_run(raw_commands(self.spark, self.sf).select(SESSION, "context_path"))
        return align.session_objectives(pick, self.golden)

    @cached_property
    def board(self) -> DataFrame:
        claimed = align.claims(self.staged, self.objectives, self.golden)
        return stage(align.board(self.objectives, claimed), "board")

    @cached_property
    def aligned(self) -> DataFrame:
        return stage(align.mark(self.staged, self.board), "aligned")

    @cached_property
    def findings(self) -> DataFrame:
        return stage(findings.extract(self.staged), "findings")

    @cached_property
    def uses(self) -> DataFrame:
        return stage(findings.link_uses(self.staged, self.findings), "uses")

    @cached_property
    def facts(self) -> DataFrame:
        return stage(privesc.host_facts(self.staged, self.findings), "facts")

    @cached_property
    def paths(self) -> DataFrame:
        return stage(privesc.escalation_paths(self.staged, self.findings, self.facts), "paths")

    @cached_property
    def escalation(self) -> DataFrame:
        return stage(privesc.escalation_summary(self.aligned, self.paths, self.facts), "escalation")

    @cached_property
    def ghost(self) -> DataFrame:
        return stage(ghost.ghost_items(self.aligned, self.board, self.findings, self.escalation), "ghost")


# --- the same reading in SQL ------------------------------------------------------------------------

PRIOR_ROWS = ", ".join(
    f"('{b}', '{tac}', '{tech}', {conf})"
    for bins, tac, tech, conf in rules.BINARY_PRIORS
    for b in bins
)
NOISE_ROWS = ", ".join(f"('{b}', {w})" for b, w in rules.NOISE_WEIGHTS.items())
SCAN_LIST = ", ".join(f"'{b}'" for b in rules.SCANNING_BINARIES)

SQL_RAW = f"""
ev as (select user_id::varchar session_uuid, event_id ord, event_type, value,
  regexp_extract(props, '"k": ([0-9]+)', 1)::int k, (epoch_us(ts) // 1000)::bigint started_at_ms from events),
raw as (select session_uuid, ord, {CMD} cmd, started_at_ms, started_at_ms + floor(value * 1000)::bigint ended_at_ms,
  {EXIT} exit_code, k * 10 output_line_count, {OUTPUT} output_digest, {CONTEXT} context_path,
  floor(value)::bigint volume from ev)"""

SQL_CLASSIFIED = SQL_RAW + f""",
priors(b, tactic, technique, confidence) as (values {PRIOR_ROWS}),
bin as (select *, regexp_extract(cmd, '^([^ ]+)', 1) binary_name, lower(cmd) lc,
  regexp_matches(context_path, 'ssh:') target,
  row_number() over (partition by session_uuid order by started_at_ms, ord) pos from raw),
pri as (select bin.*,
  case
   when target and binary_name in ('ssh','scp','sshpass','rsync') then 'TA0008|T1021|0.8'
   when target and binary_name in ('wget','curl','certutil','tftp') then 'TA0011|T1105|0.75'
   when target and regexp_matches(lc, '/etc/(shadow|passwd)\\b|ntds\\.dit|\\bsam\\b|\\.kdbx\\b|id_rsa\\b') then 'TA0006|T1003|0.75'
   when target and binary_name in ('whoami','id','groups') then 'TA0007|T1033|0.75'
   when target and binary_name in ('uname','hostname','lsb_release','systeminfo') then 'TA0007|T1082|0.7'
  end landed,
  case
   when regexp_matches(lc, '\\b(bash|sh)\\s+-i|/dev/tcp/|nc.*-e') then 'TA0002|T1059|0.85'
   when binary_name = 'sudo' and i.tactic = 'TA0007' and i.confidence >= 0.5 then i.tactic || '|' || i.technique || '|' || i.confidence
   when o.tactic is not null then o.tactic || '|' || o.technique || '|' || o.confidence
   else 'TA0007|T1059|0.2' end located,
  from bin left join priors o on o.b = bin.binary_name
  left join priors i on bin.binary_name = 'sudo' and i.b = regexp_extract(bin.cmd, '^sudo ([^ ]+)', 1)),
base as (select *, coalesce(landed, located) prior, landed is null and regexp_matches(lc, 'http\\.server|updog|simplehttpserver') stages from pri),
walk as (
  with recursive w(session_uuid, pos, prior) as (
    select session_uuid, pos, prior from base where pos = 1
    union all
    select b.session_uuid, b.pos,
      case when b.stages and split_part(w.prior, '|', 1) in ('TA0004', 'TA0008') then 'TA0011|T1105|0.7' else b.prior end
    from w join base b on b.session_uuid = w.session_uuid and b.pos = w.pos + 1)
  select * from w),
cls as (select b.* exclude (prior), split_part(w.prior, '|', 1) tactic, split_part(w.prior, '|', 2) technique,
  split_part(w.prior, '|', 3)::double confidence from base b join walk w using (session_uuid, pos))"""

SQL_EPISODES = SQL_CLASSIFIED + f""",
noise(b, w) as (values {NOISE_ROWS}),
gapped as (select cls.*, coalesce(noise.w, 1)::double noise_weight,
  coalesce(greatest(0, started_at_ms - lag(ended_at_ms) over (partition by session_uuid, target order by started_at_ms, ord)), 0) gap
  from cls left join noise on noise.b = binary_name),
halves as (
  select session_uuid, started_at_ms, ord, 1 half, cmd, binary_name as "binary", ended_at_ms - started_at_ms duration_ms,
    case when gap >= {THINK_MS} then 0 else gap end gap_before_ms, exit_code,
    case when ended_at_ms - started_at_ms >= 20000 and (lower(binary_name) in ({SCAN_LIST}) or output_line_count >= 500)
      then 'machine_bound' else 'human_active' end actor,
    output_digest, tactic, technique, confidence, noise_weight, volume, context_path from gapped
  union all
  select session_uuid, started_at_ms, ord, 0, '', '', 0, gap, null, case when gap >= {IDLE_MS} then 'idle' else 'think_pause' end,
    case when gap >= {IDLE_MS} then 'walked away' else 'long pause - reasoning or stuck' end, tactic, null, 0, 0, 0, context_path
  from gapped where gap >= {THINK_MS}),
ep as (select session_uuid, row_number() over (partition by session_uuid order by started_at_ms, ord, half) seq,
  cmd, "binary", started_at_ms, duration_ms::bigint duration_ms, gap_before_ms::bigint gap_before_ms, exit_code, actor,
  output_digest, tactic, technique, confidence::double confidence, noise_weight::double noise_weight, volume::bigint volume,
  context_path from halves)"""
