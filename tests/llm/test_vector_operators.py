"""SimHash, embeddings, language model, components and the pipeline against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import graph, lm, simhash, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    parts = ["the", "of", "é", "THE", " ", " ", " ", "\n", "  ", "\t", "x" * 40, "longerword", "b" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", None, " "]
    for block in (64, 1 << 19):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [int(x) for x in simhash.fingerprints_of(pa.array(texts, pa.string()))] == [plain_fingerprint(t) for t in texts]


def near_prints(rng, n):
    base = [rng.getrandbits(64) for _ in range(n)]
    return base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for x in base]


def test_anchors_miss_nothing():
    fp = np.array(near_prints(random.Random(1), 300), dtype=np.uint64)
    key, home, which = simhash.anchors(fp)
    met = collections.defaultdict(lambda: ([], []))
    for k, h, w in zip(key, home, which):
        met[k][0 if h else 1].append(w)
    found = {(min(x, y), max(x, y)) for homes, copies in met.values() for x in homes for y in homes + copies if x != y}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4}
    assert want and want <= found


def test_links_of_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", 20)  # many blocks for each anchor
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | set(near_prints(rng, 50)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = graph.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    root = {r.node: r.root for r in found}
    got = [root.get(x, x) for x in signed]
    assert len({(a, b) for a, b in zip(want, got)}) == len(set(want)) == len(set(got))


def test_near_duplicate_rows(spark):
    rng = random.Random(7)
    vocabulary = [f"word{k}" for k in range(500)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(100, 300))) for _ in range(40)]
    texts += [t.replace("word7", "other", 1) for t in texts[:20]] + [texts[0].upper(), None, "", " ", "one", "one"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[5], "en", "s", 0), (3, texts[3], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    fp = [plain_fingerprint(r[1]) for r in rows]
    label = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = {}
    for r, g in zip(rows, label):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted((r[0] is None, r[0] or 0, f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fp, label))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    links += [(5, 5), (None, 3), (7, 6), (7, 6)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None]
    label = groups(2500, real)
    nodes = {x for link in real for x in link}
    assert set(got) == nodes and len({(label[n], got[n]) for n in nodes}) == len({label[n] for n in nodes}) == len(set(got.values()))
    a, b = graph.forest(np.array([x for x, _ in real]), np.array([y for _, y in real]))
    assert groups(2500, list(zip(a, b))) == label and len(a) < len(nodes)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 40)
    monkeypatch.setattr(vectors, "STRIP", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 32))
    x = np.concatenate([centres + rng.normal(scale=s, size=centres.shape) for s in (0.1, 0.3, 0.35, 0.5)] + [rng.normal(size=(150, 32))]).astype(np.float32)
    x = np.concatenate([x, x[:10], 3 * x[10:15], np.repeat(x[20:21], 90, axis=0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [None] + [1.0] * 31), (904, [float("inf")] * 32), (905, []), (None, rows[0][1]), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("vector", F.lit(1))
    got = vectors.near_duplicates(frame).collect()
    full = np.zeros((len(rows), 32))
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v):
            full[i, : len(v)] = np.array(v, np.float32)
    size = np.linalg.norm(full, axis=1, keepdims=True)
    unit = full / np.where(size > 0, size, 1)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = groups(len(rows), list(zip(*np.nonzero(link))))
    least = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((-1 if i is None else i, int(link[k].sum()), least.get(label[k]), i is not None and i == least.get(label[k])) for k, (i, _) in enumerate(rows))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_in_clusters(spark, monkeypatch):
    """Five times the clusters: a vector goes to about as many tiles, and no link is lost."""
    monkeypatch.setattr(vectors, "TILE", 50)
    rng = np.random.default_rng(9)
    per_vector = []
    for clusters in (20, 100):
        centres = rng.normal(size=(clusters, 8)) @ np.eye(8, 64)
        x = (np.repeat(centres, 50, axis=0) + rng.normal(scale=0.02, size=(clusters * 50, 64))).astype(np.float32)
        frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        link = unit @ unit.T >= 0.99
        np.fill_diagonal(link, False)
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame, least=0.99).collect()}
        assert got == dict(enumerate(link.sum(axis=1)))
        rows = frame.selectExpr("vec_id as node", "1L as copies", "embedding as vector")
        axes, _ = vectors.principal_axes(rows, 64)
        per_vector.append(vectors.paired(rows, len(x), axes, 0.99).count() / len(x))
        if clusters == 20:  # few cells, each of many tiles
            monkeypatch.setattr(vectors, "MOST_CELLS", 3)
            assert {r.vec_id: r.n_links for r in vectors.near_duplicates(frame, least=0.99).collect()} == got
            monkeypatch.setattr(vectors, "MOST_CELLS", 1 << 15)
    assert per_vector[1] < 1.5 * per_vector[0] and per_vector[1] < 6, per_vector


def test_language_model(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["the", "of", "é", "There", "thing", "x", "日本"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "unseen zzz", "The  the\n"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    held = {i for i in range(len(rows)) if i % 5 == 1}
    words = {i: WORD.findall(lower(t)) for i, t, *_ in rows}
    count = collections.Counter(w for i in words if i not in held for w in [*words[i], "\n"])
    total, distinct = sum(count.values()), len(count)
    tree = collections.defaultdict(lambda: [0, 0])
    data = {i: b"\n" * 5 + " ".join(w).encode() + b"\n" for i, w in words.items()}
    bits = lambda byte: [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]
    for i, d in data.items():
        for q in range(5, len(d) if i not in held else 0):
            for so_far, bit in bits(d[q]):
                for depth in range(6):
                    tree[d[q - depth : q], so_far][bit] += 1
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    below, weighted = collections.defaultdict(float), {}
    for (context, so_far), (a, b) in sorted(tree.items(), key=lambda x: -len(x[0][0])):
        w = own(a, b) if len(context) == 5 else np.logaddexp(math.log(0.5) + own(a, b), math.log(0.5) + below[context, so_far])
        weighted[context, so_far] = w
        below[context[1:], so_far] += w if context else 0

    def score(d):
        out = 0.0
        for q in range(5, len(d)):
            for so_far, bit in bits(d[q]):
                p, mixed, left = 0.5, 0.0, 1.0
                for depth in range(6):
                    node = d[q - depth : q], so_far
                    if node not in tree:
                        break
                    a, b = tree[node]
                    one = (b + 0.5) / (a + b + 1)
                    p = mixed + left * one
                    share = 1 if depth == 5 else math.exp(math.log(0.5) + own(a, b) - weighted[node])
                    mixed, left = mixed + left * share * one, left * (1 - share)
                out += math.log10(p if bit else 1 - p)
        return out

    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("key", F.lit(1))
    for bound in (4, lm.MOST_WORDS):  # with nearly all entries joined, and with all looked up
        monkeypatch.setattr(lm, "MOST_WORDS", bound)
        monkeypatch.setattr(lm, "MOST_SEQUENCES", bound)
        for r in lm.scored(docs, F.col("doc_id") % 5 == 1).collect():
            tokens = [*words[r.doc_id], "\n"]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(tokens), sum(count[w] > 0 for w in tokens), total)
            assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens), rel_tol=1e-9)
            assert math.isclose(r.score, score(data[r.doc_id]), rel_tol=1e-9)
    assert lm.scored(docs.limit(0), F.lit(False)).count() == 0
    untrained = lm.scored(docs.limit(3), F.lit(True)).collect()
    assert len(untrained) == 3 and all(r.n_known == 0 and math.isclose(r.bits_per_byte, 8.0) for r in untrained)


def test_model_probabilities_add_up():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 400)
    key = sum(data[5 - k : len(data) - k].astype(np.int64) << (8 * (k if k == 0 else 6 - k)) for k in range(6))
    key, n = np.unique(key, return_counts=True)
    local = lm.local_levels(key, n)
    levels = lm.top_levels(*local[0].shorter()) + local
    for context in (key[0] >> 8, key[5] >> 8, 0x6161_7A7A_7A):
        every = (np.int64(context) << 8) | np.arange(256, dtype=np.int64)
        assert math.isclose(float((10.0 ** lm.log_probability(every, levels)).sum()), 1.0, rel_tol=1e-9)


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 200))) for _ in range(60)]
    texts += [texts[0], texts[1] + " extra", "too short", None, texts[2] + " write to a.b@c.de now", ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["quality rules"]} == set(range(62)) | {64}
    fp = {r.doc_id: plain_fingerprint(r.text) for r in kept["quality rules"]}
    ids = sorted(fp)
    label = groups(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 4])
    assert sorted(r.doc_id for r in kept["SimHash near-duplicates"]) == sorted({ids[g] for g in label})
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in kept["personal data"])
    total = sum(len(WORD.findall(r.text)) for r in kept["personal data"])
    assert 1.5 * total - 2 <= sum(len(WORD.findall(r.text)) for r in kept["source mix"]) <= 1.5 * total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).count() > 0
    # Repeated rows go, rows of one id with different texts stay, and an empty table passes through.
    twice = spark.createDataFrame([rows[0], rows[0], (0, *rows[5][1:])], SCHEMA)
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, twice, "").collect()) == sorted([rows[0][1], rows[5][1]])
    odd = spark.createDataFrame(rows[:20], SCHEMA)
    for name in ("_own", "_same", "removed", "identity", "size", "taken", "fp", "spans", "_n", "lines", "component_id"):
        odd = odd.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept_rows = stage(spark, odd, "").collect()
        assert len(kept_rows) >= 20 and all(r[n] == n for r in kept_rows for n in odd.columns[5:])
    empty = docs.limit(0)
    assert all(stage(spark, empty, "").count() == 0 for _, stage in corpus_pipeline.STAGES)
