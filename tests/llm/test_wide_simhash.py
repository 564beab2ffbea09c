"""Fingerprints of 512 bits against a plain version; links against all pairs; recall at a similarity of 0.8."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from runlens.llm import graph, simhash, simhash_wide

MASK = (1 << 64) - 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    plain = lower(text)
    for c in "\t\n\x0b\x0c\r":
        plain = plain.replace(c, " ")
    return [w for w in plain.split(" ") if w]


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_fingerprint(text, width=5):
    words, hashes = words_of(text), []
    for i in range(max(len(words) - width + 1, min(len(words), 1))):
        h = 0
        for k in range(width):
            word = xxhash.xxh64_intdigest(words[i + k].encode(), 42) if i + k < len(words) else k
            h = mixed((h * 0x9E3779B97F4A7C15 + word) & MASK)
        hashes.append(h)
    out = []
    for i in range(8):
        z = [mixed((h + (i + 1) * 0x9E3779B97F4A7C15) & MASK) for h in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in z) > len(z)))
    return out


def groups_of(pairs, nodes):
    label = {n: n for n in nodes}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_wide_fingerprints(monkeypatch, block):
    rng = random.Random(4)
    texts = ["", None, "One", "a b", "a b c d e", "\t a\x0bB ", "ÄÖ é word ÄÖ é word", "same " * 700]
    texts += [" ".join(rng.choices("the Of a tree House İ ß 東京 x1".split(), k=rng.randrange(1, 60))) for _ in range(20)]
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = simhash_wide.wide_fingerprints_of(pa.array(texts, pa.string()))
    assert [[int(x) for x in row] for row in got] == [plain_fingerprint(t) for t in texts]
    assert simhash_wide.wide_fingerprints_of(pa.array([], pa.string())).shape == (0, 8)


@pytest.mark.parametrize("rows, block", [(8, 11), (4096, 1 << 19)])
def test_wide_links_against_all_pairs(spark, monkeypatch, rows, block):
    """Groups are those of all pairs that agree in a part of 16 bits and differ in at most MOST bits."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    fps = [np.zeros(8, np.uint64)]
    for b in base:
        for flips in [0, 1, 20, 31, 40, 60, 80, 87, 88, 89, 100] + [12] * 12:
            bits = np.zeros(512, np.uint64)
            bits[rng.choice(512, flips, replace=False)] = 1
            fps.append(b ^ (bits.reshape(8, 64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
    fps = np.unique(np.array(fps), axis=0)
    parts = np.ascontiguousarray(fps).view(np.uint16)
    pairs = [
        (i, j) for i in range(len(fps)) for j in range(i)
        if np.bitwise_count(fps[i] ^ fps[j]).sum() <= simhash_wide.MOST and (parts[i] == parts[j]).any()
    ]
    monkeypatch.setattr(simhash_wide, "ANCHOR_ROWS", rows)  # with few rows: many classes for each anchor
    monkeypatch.setattr(simhash_wide, "LEADERS", 1 if rows == 8 else 4)
    monkeypatch.setattr(simhash, "BLOCK", block)
    nodes = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(fps)], ["id", *(f"f{i}" for i in range(8))])
    found = [(r.a, r.b) for r in simhash_wide.wide_links(nodes).collect()]
    everything = groups_of(pairs, range(len(fps)))
    assert groups_of(found, range(len(fps))) == everything
    assert all(everything[a] == everything[b] for a, b in found) and len(set(everything.values())) < len(fps)
    if rows > 8:  # pairs of a tight group never leave a task
        assert len(found) < 40 * len(fps)


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(4000)]


def shingles(text):
    words = words_of(text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_recall_at_similarity(spark):
    """Of planted copies with a similarity from 0.8, at least 0.9 are linked to their original; other documents stay alone."""
    rng = random.Random(7)
    rows, planted = [], []
    for i in range(250):
        words = rng.choices(VOCABULARY, k=rng.randrange(60, 400))
        copy = edited(rng, words, 0.021)
        a, b = " ".join(words), " ".join(copy)
        rows += [(2 * i, a), (2 * i + 1, b)]
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        planted.append((2 * i, j))
    rows += [(10_000 + i, " ".join(rng.choices(VOCABULARY, k=200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash_wide.similar_documents(docs).collect()}
    near = [n for n, j in planted if j >= 0.8]
    assert len(near) > 80 and min(j for n, j in planted if j >= 0.8) < 0.82
    assert sum(got[n + 1] == n for n in near) >= 0.9 * len(near)
    assert all(got[n] == n for n in got if n >= 10_000)
    size = collections.Counter(got.values())
    assert max(size.values()) == 2


def test_similar_documents_edge_cases(spark):
    schema = "doc_id long, text string, _key string, f0 string, id int, root int, key string"
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(5, None), (3, ""), (9, " \t"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A B\nC D E F"), (7, "other words stand in this one"),
            (None, "a b c d e f"), (None, "quite alone"), (8, long), (6, long + " end")]
    docs = spark.createDataFrame([(*r, "k", "f", 1, 2, "x") for r in rows], schema)
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash_wide.similar_documents(docs).collect())
    assert got == collections.Counter([(5, 3), (3, 3), (9, 3), (4, 2), (4, 2), (2, 2), (None, 2), (7, 7), (None, None), (8, 6), (6, 6)])
    assert simhash_wide.similar_documents(docs.limit(0)).count() == 0


def test_large_group_is_one_component(spark):
    rng = random.Random(3)
    base = rng.choices(VOCABULARY, k=300)
    rows = [(i, " ".join(edited(rng, base, 0.005))) for i in range(400)] + [(1000 + i, " ".join(rng.choices(VOCABULARY, k=100))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in simhash_wide.similar_documents(docs).collect()}
    assert got == {**dict.fromkeys(range(400), 0), **{i: i for i in range(1000, 1050)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
