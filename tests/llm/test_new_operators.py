"""Positive-unlabelled classifier, Merkle manifest and periodic runs against brute force, and their odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import merkle, periods, positive, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- periodic runs ----------------------------------------------------------------------------------------------------------


def plain_runs(words, least=24):
    """All runs as (start, length, smallest period)."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def nested(rng):
    """Repeats within repeats, cut anywhere."""
    letters = rng.choice([1, 2, 2, 3, 5, 50])

    def piece(depth):
        if not depth or rng.random() < 0.3:
            return [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, 40))]
        p = piece(depth - 1) + (piece(depth - 1) if rng.random() < 0.4 else [])
        return (p * rng.choice([1, 2, 3, 4, 6, 9]) + p[: rng.randrange(len(p))])[:700]

    return [w for _ in range(rng.randint(0, 4)) for w in piece(rng.randint(0, 3))][:1000]


def runs_by_text(texts):
    words = periods.Words(pa.array(texts, pa.string()))
    a, b, q = periods.runs_in(words.text, words.first, words.n)
    out = [[] for _ in texts]
    for start, end, period, k in zip(a, b, q, np.searchsorted(words.first, a, side="right") - 1):
        out[k].append((int(start - words.first[k]), int(end - start), int(period)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_nested_repeats(seed):
    rng = random.Random(seed)
    lists = [nested(rng) for _ in range(60)]
    want = [plain_runs(w) for w in lists]
    assert runs_by_text([" ".join(w) for w in lists]) == want
    assert any(q >= 64 for runs in want for _, _, q in runs)


def test_runs_at_their_bounds():
    rng = random.Random(5)
    for q in [*range(1, 20), 31, 32, 33, 47, 48, 63, 64, 65, 100, 127, 128, 200]:
        root = [f"r{k}" for k in range(q)]
        for length in (max(24, 3 * q) - 1, max(24, 3 * q), max(24, 3 * q) + 1):
            words = [f"a{k}" for k in range(rng.randint(0, 9))] + (root * (length // q + 1))[:length] + ["end"]
            assert runs_by_text([" ".join(words)]) == [plain_runs(words)]
    # A root that is nearly periodic itself: its long repeats hide it from windows that lie inside them.
    for inner in (1, 2, 5, 30):
        words = ([f"x{k % inner}" for k in range(90)] + ["odd"]) * 4
        assert runs_by_text([" ".join(words)]) == [plain_runs(words)]


def test_long_text_of_runs():
    rng = random.Random(8)
    words = [f"w{rng.randrange(400)}" for _ in range(400_000)]
    for at in range(0, 400_000, 1000):
        words[at + 50 : at + 500] = (words[at + 50 : at + 50 + 90 + at // 10_000] * 5)[:450]
    got = runs_by_text([" ".join(words)])[0]
    periods_found = [q for _, _, q in got]
    assert len(got) == 400 and sorted(set(periods_found)) == list(range(90, 130))


def test_run_rows(spark):
    again = ["stay", *["a", "b", "c"] * 9, "tail"]
    rows = [(1, "  " + "\t".join(again) + "\n"), (2, None), (3, ""), (4, " \n "), (None, " ".join(["é"] * 30)), (1, " ".join(again)), (5, "no run here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    got = sorted((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in periods.found_runs(docs).collect())
    run = [(1, 27, 3)]
    assert got == sorted([(1, run, "stay a b c tail")] * 2 + [(2, [], ""), (3, [], ""), (4, [], ""), (-1, [(0, 30, 1)], "é"), (5, [], "no run here")])
    assert periods.found_runs(docs.limit(0)).count() == 0


def test_run_query(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(nested(rng)) for _ in range(60)] + [None, "", "one"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        n, g = len(words), zlib.crc32(str(i).encode()) // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        runs = plain_runs(words)
        gone = {k for a, length, q in runs for k in range(a + q, a + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert len(got) == len(texts)


# -- Merkle manifest --------------------------------------------------------------------------------------------------------


def test_addresses():
    for levels in range(1, 6):
        all_ = np.concatenate([merkle.address(levels, d, np.arange(16**d)) for d in range(levels)])
        assert sorted(all_) == list(range(merkle.size(levels)))
    # Four levels: a node of depth 2 and its children stand together.
    assert merkle.address(4, 3, np.arange(16)).tolist() == list(range(merkle.address(4, 2, np.array([0]))[0] + 1, 34))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_proof(levels, i):
    for nodes in levels[:-1]:
        a = i // 16 * 16
        yield nodes[a:i], nodes[i + 1 : a + 16]
        i //= 16


@pytest.mark.parametrize("sizes", [[1], [3, 1, 17], [700, 256, 257, 16, 1], [5000] + [2] * 40])
def test_manifest(spark, sizes):
    rows = [(i * 10_000 + k, None if i == 1 else f"s{'é' if i == 2 else i}") for i, n in enumerate(sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, host string").withColumns({"tree": F.lit("x"), "_row": F.lit(1), "position": F.lit(1)})
    frame = frame.withColumn("leaf", merkle.leaf([F.col("id"), F.col("host")])).withColumn("other", F.when(F.col("id") % 3 == 0, F.unhex(F.sha2(F.lit("changed"), 256))).otherwise(F.col("leaf")))
    found = merkle.manifest(frame, "id", "host", "leaf", "other")
    got = {r.key: r for r in merkle.audited(found).collect()}
    hosts = sorted({h for _, h in rows}, key=lambda h: (h is not None, (h or "").encode()))
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {h: plain_tree([sha(text(i) + text(h)) for i, g in sorted(rows, key=lambda r: r[0]) if g == h]) for h in hosts}
    top = plain_tree([trees[h][-1][0] for h in hosts])
    assert found.root.hex() == top[-1][0] and len(got) == len(rows)
    for k, h in enumerate(hosts):
        for place, i in enumerate(sorted(i for i, g in rows if g == h)):
            proof, r = [*plain_proof(trees[h], place), *plain_proof(top, k)], got[i]
            end = sha("changed") if i % 3 == 0 else trees[h][0][place]
            for before, after in proof:
                end = sha("".join(before) + end + "".join(after))
            assert [x.siblings.hex() for x in r.proof] == ["".join(a + b) for a, b in proof]
            assert (r.leaf.hex(), r.subroot.hex(), r.folded_root.hex()) == (trees[h][0][place], trees[h][-1][0], end)
            assert (r.folded_root == found.root) == (i % 3 != 0)


def test_manifest_of_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "a")]
    frame = spark.createDataFrame(rows, "id long, host string").withColumn("leaf", merkle.leaf([F.col("id")]))
    found = merkle.manifest(frame, "id", "host")
    got = merkle.audited(found).collect()
    a = sha("".join([sha("-"), sha("1:1"), sha("1:1"), sha("1:2")]))
    assert found.root.hex() == sha(sha("-") + a) and len(got) == 5 and all(r.folded_root == found.root for r in got)
    empty = merkle.manifest(frame.limit(0), "id", "host")
    assert empty.root is None and merkle.audited(empty).count() == 0


# -- positive-unlabelled classifier -----------------------------------------------------------------------------------------


def corpus(rng, n, share):
    vocabulary = [f"{rng.choice(['an', 'the', 'or'])}{'abcdefghijkl'[k % 12]}{k % 37}" for k in range(300)]
    out = []
    for i in range(n):
        good = rng.random() < share
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if not good:
            words = [w + "###" for w in words] if i % 2 else [w for w in words[:8] for _ in range(6)]
        out.append((i, " ".join(words) + ".", good))
    return out


def test_classifier(spark):
    rows = corpus(random.Random(2), 1500, 0.7)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], SCHEMA).withColumns({"x": F.lit(1), "held_out": F.lit("y"), "id": F.lit(2), "k": F.lit(3)})
    labels = spark.createDataFrame([(i, int(good)) for i, _, good in rows if i % 3], "doc_id long, quality int").withColumn("positive", F.lit(0))
    held_out = F.col("doc_id") % 4 == 2
    got = {r.doc_id: r for r in positive.scored(docs, labels, held_out).collect()}
    assert all(r.held_out == (i % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    right = [(got[i].predicted == 1) == good for i, _, good in rows if i % 4 == 2]
    assert np.mean(right) > 0.95
    # Labels of held-out rows and labels 0 change nothing.
    less = labels.where(~(F.col("doc_id") % 4 == 2) & (F.col("quality") == 1))
    again = {r.doc_id: r.score for r in positive.scored(docs, less, held_out).collect()}
    assert max(abs(again[i] - got[i].score) for i in again) < 1e-9


def test_prior_and_risk(spark):
    rows = corpus(random.Random(4), 3000, 0.6)
    x = positive.measured(pa.array([t for _, t, _ in rows]))
    table = spark.createDataFrame([(good and i % 2 == 0, [float(v) for v in x[i]]) for i, _, good in rows], "positive boolean, x array<double>")
    shift, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    w = positive.fit(table, shift, scale, None, np.zeros(x.shape[1] + 1))
    assert abs(positive.estimated_prior(table, shift, scale, w) - np.mean([g for _, _, g in rows])) < 0.05
    # Sums over partitions are those of all rows, and the gradient is that of the risk.
    z = np.concatenate([np.ones((len(x), 1)), (x - shift) / scale], axis=1)
    own = np.array([g and i % 2 == 0 for i, _, g in rows])
    v = np.random.default_rng(1).normal(size=z.shape[1]) / 5
    pos, all_ = positive.sums(table, shift, scale, v)
    soft = lambda m: np.logaddexp(0, m).mean()

    def risk(w):
        ridge = positive.RIDGE * (w[1:] ** 2).sum() / 2
        return 0.6 * soft(-(z[own] @ w)) + max(0.0, soft(z @ w) - 0.6 * soft(z[own] @ w)) + ridge

    value, slope, _ = positive._risk(pos, all_, v, 0.6)
    assert abs(value - risk(v)) < 1e-9
    step = 1e-6 * np.eye(len(v))
    assert np.allclose([(risk(v + s) - risk(v - s)) / 2e-6 for s in step], slope, atol=1e-5)


def test_measures_stand_alone():
    rng = random.Random(9)
    texts = [t for _, t, _ in corpus(rng, 40, 0.5)] + ["", None, " \n", "é", "a\nb\n\nc", "x" * 100_000, "go " * 50_000]
    whole = positive.measured(pa.array(texts, pa.string()))
    assert np.isfinite(whole).all() and not whole[40].any() and not whole[41].any()
    for k, text in enumerate(texts):
        assert np.allclose(positive.measured(pa.array([text], pa.string()))[0], whole[k])


def test_classifier_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 0), (1, "a b", "en", "s", 0), (None, None, "en", "s", 0), (2, "", "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    got = positive.scored(docs, labels, F.lit(False)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}  # the only key with a label has both
    got = positive.scored(docs, labels.where("quality = 1"), F.lit(False)).collect()
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert positive.scored(docs.limit(0), labels, F.lit(False)).count() == 0
    assert positive.scored(docs, labels.limit(0), F.col("doc_id") == 2).count() == 4
