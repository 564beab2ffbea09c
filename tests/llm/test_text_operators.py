"""Token counts, packing, personal data, quality rules, licences and extraction against plain definitions."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import licences, mixing, packing, pii, quality, tokens, wrapper

VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY[0]))


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "中文", "–", "'s", "don't", "12", "<|endoftext|>", " A", "😀", "\r\n", "!!", "\x01", "ǆ", "İ", "\u0085", "a's"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", "\n", " \n ", "foo\n", "\nfoo", "x" * 5000]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("batch_bytes", [200, tokens.BATCH_BYTES])
def test_ids_are_the_librarys(library, monkeypatch, batch_bytes):
    monkeypatch.setattr(tokens, "BATCH_BYTES", batch_bytes)
    texts = odd_texts(3000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    column = pa.array([*texts, None], pa.string())
    assert list(tokens.counts_of(column, *VOCABULARY)) == [*map(len, want), 0]
    got = {row: list(ids) for row, ids in tokens.ids_of(column, *VOCABULARY)}
    assert [got.get(i, []) for i in range(len(texts))] == want


def test_token_counts_rows(spark, library):
    docs = table(spark, [(1, "Hello world", "a"), (None, None, None), (2, "", "a"), (2, "", "a"), (3, "word " * 2000, "a")]).withColumn("n_tokens", F.lit(-1))
    rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect()}
    long = len(library.encode("word " * 2000).ids)
    assert rows == {(1, 11, 2, False), (None, 0, 0, False), (2, 0, 0, False), (3, 10000, long, True)}
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_plan_fills_and_uses_every_piece():
    rng = random.Random(5)
    for _ in range(60):
        counts = {length: rng.randint(1, 40) for length in rng.sample(range(1, 65), rng.randint(1, 50))}
        used, sequences = {}, {}
        for length, rank, n, first, offset in packing.plan(counts, 64):
            used.setdefault(length, []).extend(range(rank, rank + n))
            for i in range(n):
                sequences.setdefault(first + i, []).append((offset, length))
        assert {k: sorted(v) for k, v in used.items()} == {k: list(range(n)) for k, n in counts.items()}
        for parts in sequences.values():
            parts.sort()
            assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 64
        room = []  # of first-fit decreasing
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                room.append(64 - length)
            else:
                room[at] -= length
        assert len(sequences) <= 1.02 * len(room) + 1


def test_plan_finds_exact_triples():
    assert max(first + n for _, _, n, first, _ in packing.plan({600: 5, 300: 5, 100: 5, 24: 5}, 1024)) == 5  # a gap of 424 is 300 + 100 + 24


def test_packing_round_trip(spark, library):
    texts = [t for t in odd_texts(150, 3)] + ["many words here " * 900, None, "same", "same"]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("length", F.lit(0))
    rows = sorted(packing.packed(docs, 64).collect(), key=lambda r: (r.doc_id, r.piece))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = [r for r in rows if r.doc_id == i]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)]))[:-1] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:]) and all(zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in own)
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 64
    assert packing.packed(docs.limit(0)).count() == 0


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = ["a", "@", "b.", "1", ".", "12", "255", "256", "+", "-", " ", "(", ")", "é", "é@", "4111111111111111", "0", "00", "x@y.z", "1.2.3.4", "..", "\n"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        assert [tuple(s[:3]) for s in pii.spans_of(text) if s.kind in pii.BASE] == plain_spans(text), text
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "+1" + " " * 200_000):  # no pattern takes quadratic time
        pii.spans_of(long)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    kinds = [s.kind for s in pii.spans_of("IBAN GB82 WEST 1234 5698 7654 32, card 378282246310005, call 212-555-1234")]
    assert kinds == ["iban", "short_card", "local_phone"]
    assert pii.spans_of("a 378282246310005 b 212-555-1234 c 123-45-6789") == []  # nothing nearby says what they are


def test_ibans_before_other_words():
    for account in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for after in ("", " BIC COBADEFFXXX", " 2024 A", " B", ", then", " DE89370400440532013000 X"):
            text = f"IBAN {account}{after}"
            spans = [(s.start, s.end) for s in pii.spans_of(text) if s.kind == "iban"]
            assert spans[0] == (5, 5 + len(account)) and len(spans) == 1 + after.startswith(" DE"), text
    text = "IBAN DE89 3704 0044 0532 0130 00 BIC X"
    assert pii.redacted_text(text, pii.spans_of(text)) == "IBAN <IBAN> BIC X"
    text = "AB12 DE89 3704 0044 0532 0130 00"
    assert [text[s.start : s.end] for s in pii.spans_of(text) if s.kind == "iban"] == ["DE89 3704 0044 0532 0130 00"]
    for text in ("DE89 3704 0044 0532 0130 00x", "DE88 3704 0044 0532 0130 00 BIC", "XDE89370400440532013000"):
        assert not [s for s in pii.spans_of(text) if s.kind == "iban"]
    pii.spans_of("AB12 " * 60_000), pii.spans_of("DE89 " + "A" * 300_000)


def test_spans_and_redaction_rows(spark):
    docs = table(spark, [(1, "mail me: a.b@c.de!", "s"), (2, None, "s"), (None, "", None), (3, "none", "s"), (3, "none", "s")]).withColumn("spans", F.lit("x"))
    rows = pii.spans(docs, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in rows) == [(0, []), (1, [("email", 9, 17)]), (2, []), (3, []), (3, [])]
    assert {r.text for r in pii.redacted(docs).collect()} == {"mail me: <EMAIL>!", None, "", "none"}
    listed = pii.spans(docs, ["doc_id"]).where("doc_id = 1").select(F.sha2(pii.listed(F.col("spans")), 256)).first()[0]
    assert listed == hashlib.sha256(b"email:9:17").hexdigest()


def repeated(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_many_spans_in_proportional_time():
    """A text of 5 MB with 100,000 spans; and the same spans as by comparing each with all before it."""
    rng = random.Random(3)
    kinds = ["mail a.b@example.com now", "phone 555-0134 or call 555-867-5309", "ip 10.1.2.3", "card 4111 1111 1111 1111", "ssn 078-05-1120", "+1 (706) 555-3138", "IBAN DE89 3704 0044 0532 0130 00"]
    small = " ".join(rng.choice(kinds) for _ in range(300))
    kept = []
    for kind, start, end in pii._proposals(small):
        near = pii._context[kind].search(small[max(0, start - pii.NEAR) : start]) or pii._context[kind].search(small[end : end + pii.NEAR])
        score = min(1.0, pii.START[kind] + (pii.BONUS if near else 0.0))
        if kind in pii.BASE or score >= pii.KEEP and not any(s[1] < end and start < s[2] for s in kept):
            kept.append((kind, start, end))
    assert [tuple(s)[:3] for s in pii.spans_of(small)] == kept and len({k for k, _, _ in kept}) >= 5
    text = ("word " * 5 + rng.choice(kinds) + " ") * 100_000
    start = time.time()
    found = pii.spans_of(text)
    out = pii.redacted_text(text, found)
    assert len(found) >= 100_000 and len(out) < len(text) and time.time() - start < 30


def test_quality_features(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b", "cc ", " ", "\n", "a b c ", "#", "é\t", "same line\n", "<|"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "\n\n"]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("words", F.lit(1)).withColumn("line", F.lit(1))
    rows = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words, filled, r = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)], rows[i]
        n = repeated(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(filled) - len(set(filled)), n), t
        assert r.base_failed == (len(words) < 50 or 100 * n > 50 * len(words))


def test_line_frequency(spark):
    name = lambda k: chr(97 + k // 26 % 26) + chr(97 + k % 26)  # noqa: E731  letters only: digits count as equal
    body = lambda i, n: " ".join(f"w{name(i)}x{name(k)}y" for k in range(n))
    common_line = "This Site uses 12 cookies and asks you to accept all of them " * 2
    rows = [(i, f"{body(i, 60)}\n{common_line}", "a") for i in range(40)]
    rows += [(100 + i, f"{common_line}\n" * 2 + body(100 + i, 22), "a") for i in range(2)]  # depleted
    rows += [(200, f"{common_line}\n{body(200, 60)}", "b"), (300, body(300, 60), None), (300, body(300, 60), None), (None, body(7, 60), "a")]
    docs = table(spark, rows)
    got = quality.judged(docs).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} == {100, 101}
    assert {r.removed_words for r in got if r.doc_id == 5} == {26} and {r.removed_words for r in got if r.doc_id in (200, 300)} == {0}
    left = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert left[5] == body(5, 60) and common_line in left[200] and 100 not in left
    assert quality.judged(docs.limit(0)).count() == 0


def test_copies_are_one_vote(spark):
    name = lambda k: chr(97 + k // 26 % 26) + chr(97 + k % 26)
    body = lambda i, n: "\n".join(" ".join(f"w{name(i)}x{name(k)}y{name(j)}" for j in range(10)) for k in range(n))
    footer = "The same footer stands below every page of this site"
    rows = [(i, f"{body(700, 8)}\nCopy {i % 3} of 12", "a") for i in range(300)] + [(1000 + i, f"{body(i, 8)}\n{footer}", "a") for i in range(30)]
    docs = table(spark, rows)
    left = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert len(left) == len(rows) and left[0] == rows[0][1] and left[1005] == body(5, 8)  # one vote of the copies, 30 of the others
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_rules(spark, docs, ""), "").collect()
    assert sum(body(700, 8) in r.text for r in kept) == 1
    assert not any(r.kept for r in quality.judged(docs).collect() if r.doc_id < 300)  # by ids, as the query's SQL counts


def test_lines_of_a_large_host(spark):
    name = lambda k: chr(97 + k // 676) + chr(97 + k // 26 % 26) + chr(97 + k % 26)
    body = lambda i, n: "\n".join(" ".join(f"w{name(i)}x{name(k)}y{name(j)}" for j in range(10)) for k in range(n))
    footer = "The same footer stands below every page of this site"
    rows = [(i, body(i, 6) + (f"\n{footer}" if i < 25 else ""), "a") for i in range(2800)]  # 25 is below 1 % of the host
    rows += [(5000 + i, f"{body(4000, 6)}\n{body(4001 + i, 1)}", "a") for i in range(25)]  # near copies
    docs = table(spark, rows)
    left = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert len(left) == len(rows) and left[5] == body(5, 6) and left[5003] == rows[2803][1]
    assert {r.removed_words for r in quality.judged(docs).collect()} == {0}  # with the share, as the query's SQL has it


def test_licences(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    filler = "plain words of a file " * 20
    files = spark.createDataFrame([
        (1, "p/LICENSE", f"{apache}\n{filler}"), (2, "p/src/deep/a.txt", filler), (3, "p/src/deep/b.txt", f"{filler}\n{mit}\nend"), (4, "p/src/sub/COPYING.md", mit),
        (5, "p/src/sub/c.txt", ""), (6, "q/d.txt", filler), (7, None, mit), (8, "p/src/subway/e.txt", None), (8, "p/src/subway/e.txt", None), (9, "p/x.txt", "license to run " + filler),
    ], "id long, path string, text string").withColumn("licence", F.lit("x"))
    rows = {r.id: (r.own_licence, r.licence, r.from_directory) for r in licences.scanned(files, "id").collect()}
    assert rows == {
        1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "Apache-2.0", "p"), 3: ("MIT", "MIT", None), 4: ("MIT", "MIT", None), 5: (None, "MIT", "p/src/sub"),
        6: (None, None, None), 7: ("MIT", "MIT", None), 8: (None, "Apache-2.0", "p"), 9: (None, "Apache-2.0", "p")}
    assert licences.scanned(files, "id").count() == 10 and licences.scanned(files.limit(0), "id").count() == 0


def test_licence_headers_and_files(spark):
    full = {f.stem: f.read_text() for f in Path(licences.__file__).with_name("licence_texts").glob("*.txt")}
    code = "\n\nint main() { return compute(3); }\n" * 40
    gpl = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    boxed = lambda text, mark: "\n".join(f"{mark} {x}" for x in text.split("\n"))
    texts = [
        ("MIT", "// SPDX-License-Identifier: MIT" + code), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception" + code), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code),
        ("GPL-2.0", "/*\n" + boxed(gpl, " *") + "\n */" + code), ("GPL-2.0", boxed(gpl.replace("\n", " "), "#") + code), ("MPL-2.0", boxed(mpl, "//") + code),
        ("GPL-3.0", full["GPL-3.0"][:1500]), ("Apache-2.0", full["Apache-2.0"][:2000]), ("MIT", full["MIT"].split("\n\n")[1] + code), ("ISC", full["ISC"].split("\n\n")[1]),
        ("MIT", "# Tool\n\nSome words on it.\n\nThis project is licensed under the MIT License." + code),
        ("BSD-3-Clause", "Copyright (c) 2019, The Authors\nAll rights reserved.\n\n" + full["BSD-3-Clause"].split("\n\n", 1)[1].replace("COPYRIGHT HOLDERS", "REGENTS")),
        (None, "The driver showed the licence to the officer and drove on to the next town." + code), (None, code),
    ] + [(k, "Copyright 2021 Someone\n\n" + v) for k, v in full.items()]
    files = spark.createDataFrame([(i, f"d{i}/{'LICENSE' if i > 13 else 'a.c'}", t) for i, (_, t) in enumerate(texts)] + [(99, "d20/sub/b.c", code)], "id long, path string, text string")
    rows = {r.id: r for r in licences.scanned(files, "id").collect()}
    assert [rows[i].own_licence for i in range(len(texts))] == [k for k, _ in texts]
    assert rows[99].licence == texts[20][0] and rows[99].from_directory == "d20"


def test_tree_matching_is_largest():
    def size(a, b, na, nb, ka, kb):
        if na[a][1:] != nb[b][1:]:
            return 0
        x, y = ka[a], kb[b]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(x[i], y[j], na, nb, ka, kb))
        return 1 + m[-1][-1]

    rng = random.Random(4)
    for _ in range(60):
        pages = ["".join(rng.choice(["<div>", "</div>", "<p>x", "<ul><li>a", "</ul>", "<b>", "</b>"]) for _ in range(14)) for _ in range(2)]
        a, b = map(wrapper.parse, pages)
        ka, kb = wrapper._elements(a)[0], wrapper._elements(b)[0]
        match = wrapper.align(wrapper.Tree(a), wrapper.Tree(b))
        assert sum(j >= 0 for j in match) == size(0, 0, a, b, ka, kb)
        used = [j for j in match if j >= 0]
        assert len(used) == len(set(used)) and all(a[i][1] == b[j][1] for i, j in enumerate(match) if j >= 0)


def test_main_text():
    page = ("<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=x>Menu</a></nav><header>Top</header>"
            "<div class='ad'>Buy</div><article><header><h1>Title &amp; more</h1></header><p><b>First<br>line</b> of\n text<p>Second &lt;p&gt; &#233;<ul><li>one<li>two</ul>"
            "<form>Mail <input></form><section id=comments><p>Nice!</section></article><aside>Side</aside><footer>&copy; x</footer>")
    assert wrapper.main_text(wrapper.parse(page)) == "Title & more First line of text Second <p> é one two"
    assert wrapper.main_text(wrapper.parse("")) == "" and wrapper.main_text(wrapper.parse("just text")) == "just text"
    assert wrapper.main_text(wrapper.parse("<p>a<b>b</b>c</p>d<p title=\"x>y\">e")) == "abc d e"
    assert wrapper.main_text(wrapper.parse("<div>" * 5000 + "deep")) == "deep"


def test_deep_pages():
    text = lambda page: wrapper.main_text(wrapper.parse(page))
    assert text("<div><article>" + "<div>" * 250 + "<p>inner</p>" + "</div>" * 250 + "<p>tail</p></article></div><p>after</p>") == "inner tail"
    assert text("<article>" + "<div>" * 300 + "<nav><p>menu</p></nav><p>body</p>") == "body"
    deep = "<div>" * 500 + "<p>x" + "</div>" * 500
    tree = wrapper.Tree(wrapper.parse(deep))
    assert sum(j >= 0 for j in wrapper.align(tree, tree)) == len(tree.kids) - 1  # all but the piece of text
    for page in ("<div>" * 100_000 + "</section>" * 100_000, "<p><div>" + "<b>" * 100_000 + "<hr>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000):
        wrapper.parse(page)  # no step walks down the stack


def test_names_do_not_remove_the_article():
    text = lambda page: wrapper.main_text(wrapper.parse(page))
    story = "<article><div class='article-header'><h1>Title</h1></div><p>First part of the story.</p><div class='related-work'><p>Earlier results.</p></div><p class='form-factor'>Shape.</p></article>"
    want = "Title First part of the story. Earlier results. Shape."
    for wrap in ("layout no-sidebar", "has-sidebar", "sidebar-right", "with-menu", "menu", "content ad-free", "widget"):
        assert text(f"<body class='{wrap}'><div class='{wrap}'><div id='{wrap}'>{story}</div></div></body>") == want
        assert text(f"<div class='{wrap}'>{story.replace('article>', 'main>').replace('<article', '<main')}</div>") == want
    # Sure names go, nested ones too; beside the article everything with another role goes.
    inner = story.replace("<p>First", "<div class='box'><div class='share-buttons'><span>Share</span></div><div class='ad'>Buy</div></div><div class='sidebar'><p>Side</p></div><p>First")
    assert text(f"<div class='has-sidebar'><div class='related'><article class='card'><p>Other story</p></article></div>{inner}<div class='site-footer'>Imprint</div><div id='comments'>{'<p>Nice!</p>' * 40}</div></div>") == want
    # Without an article: what holds most of the text stays whatever it is called, the rest goes by its name.
    assert text("<div class='sidebar-layout'><p>" + "Body text. " * 9 + "</p><div class='sidebar'>Side</div></div><div class='page-footer'>Imprint</div>") == ("Body text. " * 9).strip()
    assert text("<article><div class='notice'>" + "The whole story is in here. " * 5 + "</div><p>End.</p></article>").startswith("The whole story")


def plain_extraction(rows):
    """Template and slots by dictionaries: what half of a group's different pages have in one place of the reference goes."""
    groups, out = {}, {}
    for i, host, page in rows:
        nodes = wrapper.parse(page)
        groups.setdefault((host, wrapper.layout(nodes)), []).append((i, page, nodes))
    for (host, _layout), members in groups.items():
        votes = {}
        for _i, page, nodes in members:
            own = (sum(n[1] != "#" for n in nodes), page)
            votes[wrapper.vote(nodes)] = min(votes.get(wrapper.vote(nodes), own), own)
        template = set()
        if len(votes) >= wrapper.LEAST_PAGES:
            least = min(n for n, _p in votes.values())
            (reference,) = {p for n, p in votes.values() if n == least}  # the fixtures have one smallest page
            place = lambda nodes: [(k, j, wrapper.Tree(nodes).texts[k]) for k, j in enumerate(wrapper.align(wrapper.Tree(nodes), wrapper.Tree(wrapper.parse(reference)))) if j >= 0]
            seen = {}
            for _i, _page, nodes in members:
                for k, j, text in place(nodes):
                    if text and k in wrapper._main(nodes)[1]:
                        seen.setdefault((j, text), set()).add(wrapper.vote(nodes))
            template = {slot for slot, by in seen.items() if len(by) >= max(wrapper.LEAST_PAGES, wrapper.SHARE * len(votes))}
        for i, _page, nodes in members:
            skip = {k for k, j, text in place(nodes) if (j, text) in template} if template else set()
            out[i] = wrapper.main_text(nodes, frozenset(skip))
    return out


def test_extraction_equals_dictionaries(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(50)) for _ in range(n))
    rows = []
    for host, shell in (("a", "<main>{}</main>"), ("b", "<div class='no-sidebar'>{}</div>"), ("c", "<article>{}</article>")):
        for k in range(14):
            parts = ["<p>Constant line of the site</p>" if rng.random() < 0.7 else f"<p>{words(3)}</p>", f"<h2>{words(4)}</h2>"]
            parts += [f"<p>{words(rng.randint(5, 20))}</p>" for _ in range(rng.randint(1, 4))] + ["<ul>" + "".join(f"<li>{words(2)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>"]
            rows.append((len(rows), host, f"<html><body><div class='top'><p>Welcome {host}</p></div>" + shell.format("".join(parts) + "<p>Written for you</p>" * (k % 3 > 0)) + "</body></html>"))
        rows.append((len(rows), host, f"<html><body><div class='top'><p>Welcome {host}</p></div>" + shell.format(f"<h2>{words(2)}</h2>") + "</body></html>"))  # the smallest
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame([(i, f"http://{h}/x", p) for i, h, p in rows], "page_id long, url string, html string")).collect()}
    want = plain_extraction(rows)
    assert got == want and any("Constant line" not in t for t in want.values()) and any("Written" not in t for t in want.values())


@pytest.mark.parametrize("most_bytes", [0, 300, wrapper.MOST_BYTES])  # none, some and all references broadcast
def test_template_is_learned(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(wrapper, "MOST_BYTES", most_bytes)
    rows = []
    for i in range(12):
        body = f"<html><body><div><p>Welcome to our site</p></div><div><h2>News {i}</h2><p>Story number {i} tells {'x' * i}</p></div><div><p>All rights reserved</p></div></body></html>"
        rows.append((i, f"http://h.example.com/{i}", body))
    rows += [(50, "http://other.example.com/1", rows[0][2]), (51, None, None), (52, "", ""), (53, "http://h.example.com/53", rows[3][2])]
    rows += [(100 + i, "http://copies.example.com/", "<html><body><p>Same text</p></body></html>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("nodes", F.lit(1))
    got = {r.page_id: r for r in wrapper.extracted(pages).collect()}
    assert len(got) == len(rows) and got[3].text == got[53].text == "News 3 Story number 3 tells xxx" and got[3].n_chars == 31
    assert got[50].text.startswith("Welcome to our site News 0") and got[51].text == got[52].text == "" and got[104].text == "Same text"
    assert wrapper.extracted(pages.limit(0)).count() == 0


def test_near_copies_keep_their_article(spark):
    body = [f"Paragraph {k} of the one article that many pages of the host repeat, {'word ' * (20 + ord(k) - 97)}" for k in "abcdef"]
    page = lambda parts: "<html><body><article><h1>Head</h1>" + "".join(f"<p>{p}</p>" for p in parts) + "<p>Read more at our site</p></article></body></html>"
    rows = [(i, "http://h.example.com/", page([f"Seen by {'xyz'[i % 3] * (1 + i)} readers", *body])) for i in range(12)]  # a changing paragraph
    rows += [(50 + i, "http://h.example.com/", page([f"Story {'abcdefgh'[i] * 40} text {k} of page {i} alone" for k in "uvwxyz"])) for i in range(8)]
    long = lambda i: "changes " * 60 + "z" * i
    rows += [(100 + i, "http://long.example.com/", page([long(i), *body])) for i in range(12)]  # the longest block changes, most of the text doesn't
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    squeezed = " ".join(" ".join(body).split())
    assert all(squeezed in got[i] for i in [*range(12), *range(100, 112)])
    assert "Read more at our site" not in got[53] and got[53].count("Story") == 6  # what different pages share is template


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", "a", "a", "ü", None])) for i in range(600)] + [(600, None, "z"), (601, "", "z"), (7, "w w w", "a"), (7, "w w w", "a")]
    docs = table(spark, rows).withColumn("target", F.lit(0))
    got = mixing.mixed(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, total = {}, 1.5 * sum(sizes.values())
    open_ = set(order)
    while True:  # the rule of the contract, step by step
        level = (total - sum(goal.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            break
        goal |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    goal |= {s: level * weight[s] for s in open_}
    assert len(got) == len(rows)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - goal[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size for r in own)
        assert sum(r.taken for r in own) == int(goal[s] + 1e-9)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mixed(docs.limit(0)).count() == 0
    taken = {i: 0 for i, _, _ in rows}
    for r in mixing.repeated(table(spark, rows[:600])).collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    direct = {r.doc_id: r.taken for r in mixing.mixed(table(spark, rows[:600])).collect()}
    assert sum(taken.values()) == sum(direct.values())
