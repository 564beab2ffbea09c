from pyspark.sql import functions as F

from runlens.functions import display as d
from runlens.functions import net as n
from runlens.functions import text as t


def _apply(spark, fn, *values):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)],
                               "i int, " + ", ".join(f"c{j} string" for j in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    cols = [F.col(c) for c in df.columns if c != "i"]
    return [r.x for r in df.select("i", fn(*cols).alias("x")).orderBy("i").collect()]


def test_binary(spark):
    got = _apply(spark, t.extract_binary, "  FOO=1 BAR=2 /usr/bin/nmap -sV", "./lp.sh", "", "sudo -l", "A=1", "C:\\x\\y.exe a")
    assert got == ["nmap", "lp.sh", "", "sudo", "", "y.exe"]


def test_redaction_order_and_boundaries(spark):
    got = _apply(
        spark, t.redact_text,
        "ssh 10.0.0.1 and 1.2.3.4567",
        "flag deadbeefdeadbeefdeadbeefdeadbeef end",
        "x Password : hunter2&y=1",
        "Authorization: Bearer abc.def-1",
        "jwt eyJab.cd.ef- tail",
        "key sk-abcdefghijkl and xoxb_0123456789a",
        "épassword=abc passwords=1",
        "token=1.2.3.4",
    )
    assert got == [
        "ssh x.x.x.x and 1.2.3.4567",
        "flag [redacted-flag] end",
        "x Password=[redacted]&y=1",
        "Authorization: Bearer [redacted]",
        "jwt [redacted-jwt]- tail",
        "key [redacted-key] and [redacted-key]",
        "épassword=[redacted] passwords=1",
        "token=[redacted]",
    ]


def test_headers(spark):
    got = _apply(spark, t.redact_headers, "Host: a\r\nCookie: x=1\r\nX-Custom-API-Key: 1\nno colon")
    assert got == ["Host: a\nCookie: [redacted]\nX-Custom-API-Key: [redacted]\nno colon"]


def test_hash_matches_utf16_definition(spark):
    def want(s):
        h = 0
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i:i + 2], "big")) & 0xFFFFFFFF
        return f"{h:08x}"

    samples = ("http://a/b", "", "é😀x", "password=hunter2")
    assert _apply(spark, t.hash8, *samples) == [want(s) for s in samples]


def test_flag_run(spark):
    h = "0123456789abcdef" * 2
    assert _apply(spark, t.contains_flag, h, h + "0", "x" + h + "z", "", None) == [True, False, True, False, False]


def test_http_and_paths(spark):
    assert _apply(spark, t.http_method, "post /a", "GETX /", "/x") == ["POST", "GET", "GET"]
    assert _apply(spark, t.http_path, "POST  /a b", "/x") == ["/a b", "/x"]
    assert _apply(spark, t.url_path, "http://h:80/a?b=1#f", "https://h", "word", "http://h?q=1") == ["/a?b=1", "/", "word", "/?q=1"]
    assert _apply(spark, t.ssh_target, "ssh -i k bob@10.0.0.5", "sshpass -px ssh root@box.htb ", "ls", "ssh host") == [
        "10.0.0.5", "box.htb", None, "host"]


def test_token_contains(spark):
    got = _apply(spark, t.token_contains, ("run /tmp/Evil.sh now", "evil.sh"), ("xevil evil", "evil"), ("a-evil-", "evil"), ("b", "c"))
    assert got == [True, False, True, False]


def test_labels_and_formats(spark):
    assert _apply(spark, lambda c: d.format_duration(c.cast("double")), "300", "59999", "61000", "3700000") == [
        "0.3s", "1m 0s", "1m 1s", "1h 1m"]
    assert _apply(spark, lambda c: d.format_clock(c.cast("bigint")), "61000", "5000") == ["1:01", "0:05"]
    assert _apply(spark, lambda c: d.js_round(c.cast("double")), "-2.5", "2.5", "2.4") == [-2.0, 3.0, 2.0]
    assert _apply(spark, d.technique_url, "T1595.003", "T1046") == [
        "https://attack.mitre.org/techniques/T1595/003/", "https://attack.mitre.org/techniques/T1046/"]
    assert _apply(spark, d.objective_label, "escalate_to_root", "my_new_goal") == ["Escalate to root", "My new goal"]
    assert _apply(spark, lambda c: t.list_join(F.split(c, ",")), "a,b,c", "a", "a,b") == ["a, b and c", "a", "a and b"]
    assert _apply(spark, t.coaching_category, "try sudo", "quiet", "hydra", "nmap", "http", "x") == [
        "PrivEsc", "OpSec", "Access", "Recon", "Web", "Tactics"]
    got = _apply(spark, t.split_lead, "**Do** it. Now", "First one. Then", "nothing")
    assert [(r.action, r.why) for r in got] == [("Do", "it. Now"), ("First one.", "Then"), ("nothing", "")]


def test_net(spark):
    assert _apply(spark, lambda c: n.any_ip_in(n.ips_in(c), ["10.10.0.0/16"]), "x 10.10.3.4", "10.11.0.1", "") == [True, False, False]
    assert _apply(spark, lambda c: n.version_in(n.parse_version(c), (5, 8, 0), (5, 16, 11)), "5.16.10-x", "5.16.11", "5.8", "z") == [
        True, False, True, None]
    assert _apply(spark, n.normalize_binary, "/usr/bin/python3.11", "/x/perl5.30", "/bin/vim.basic", "/a/b/") == ["python3", "perl", "vim", "b"]
