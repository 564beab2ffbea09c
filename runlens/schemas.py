"""Explicit schemas. A missing optional field is null, never a default."""

SESSION = "session_uuid"
SEQ = "seq"

PAYLOAD = (
    "struct<cmd:string,exit_code:bigint,stream:string,text:string,line_count:bigint,method:string,url:string,"
    "status:bigint,req_headers:string,req_body:string,resp_headers:string,resp_body:string,mime:string,pair_id:string>"
)
PROVENANCE = "struct<boundary_confidence:double,redaction_method:string,context_path:string,platform:string>"
ENVELOPE = (
    f"source string, session_uuid string, seq bigint, ts_utc_us bigint, kind string, payload {PAYLOAD}, "
    f"provenance {PROVENANCE}"
)
HANDSHAKE = (
    "plugin string, class string, capabilities struct<has_exit_codes:boolean,has_stdin:boolean,"
    "boundary_confidence:string,redaction:string>, context_template string"
)
ENVELOPE_KINDS = [
    "command", "output", "stdin_masked", "input", "session_start", "session_end", "session_flag", "http_request",
    "http_response",
]
WEB = "struct<method:string,url:string,req_body:string,status:bigint,resp_body:string,mime:string>"
RAW_COMMAND = (
    "session_uuid string, ord bigint, cmd string, started_at_ms bigint, ended_at_ms bigint, exit_code int, "
    f"output_line_count bigint, output_digest string, context_path string, volume bigint, web {WEB}"
)
RAW_COLUMNS = [part.split()[0] for part in RAW_COMMAND.split(f", web {WEB}")[0].split(", ")] + ["web"]
EPISODE = (
    "session_uuid string, seq bigint, cmd string, binary string, started_at_ms bigint, duration_ms bigint, "
    "gap_before_ms bigint, exit_code int, actor string, output_digest string, tactic string, technique string, "
    "confidence double, noise_weight double, volume bigint, context_path string, alignment string, loop_of_seq bigint, "
    "ukc string, cwe array<string>"
)
GOLDEN = (
    "golden_id string, ordinal int, objective string, tactic string, satisfied_by array<string>, "
    "techniques array<string>, depends_on array<string>"
)
FINDING = (
    "session_uuid string, id string, kind string, value string, source_seq bigint, tactic string, proven boolean, "
    "masked boolean"
)
