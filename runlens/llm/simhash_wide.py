"""SimHash near-duplicates at a similarity of word shingles: fingerprints of 512 bits, found through 32 anchor spaces.

Texts of a Jaccard similarity J have shingle sets at an angle of arccos(2J / (1 + J)), and each bit differs with that angle
over pi: 0.15 at 0.8. At 64 bits that is too coarse to decide and too far to cover by few anchors, so a fingerprint has eight
words of 64 bits. Every word is cut into four parts of 16 bits. The anchors of a part are all its values, a code of radius
zero, and the threshold of a part is zero: a fingerprint has one copy at one anchor of each of the 32 parts. What meets at an
anchor is compared in all 512 bits, so no link is false. Two fingerprints that differ in at most 31 bits agree in some part
for certain; at a similarity of 0.8 (78 bits on average) they do with a probability of 0.91, at 0.9 (53 bits) of 0.997.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common, graph, simhash

WORDS, PART_BITS = 8, 16
#: Differing bits of 512 that link: 78 are the mean at a similarity of 0.8, with a deviation of 8.
MOST = 88
#: Copies at one anchor above which they are dealt to classes, and each pair of classes is compared by itself.
ANCHOR_ROWS = 4096
LEADERS = 4
_NAMES = [f"f{i}" for i in range(WORDS)]
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ONES = np.uint64(0x0101010101010101)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def wide_fingerprints_of(texts: pa.Array, width: int = 5) -> np.ndarray:
    """One row of eight unsigned words for each text; nulls and texts without words have zeros.

    A shingle's hash is made from the hashes of its words in their order, and eight more from that. A-Z are lower-cased.
    """
    raw, offsets = common.bytes_of(texts)
    starts, ends = common.word_bounds(raw, offsets)
    n_words = common.per_text(starts, offsets)
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    first_word, shingle = np.cumsum(n_words) - n_words, np.cumsum(n_shingles) - n_shingles
    word = np.append(simhash.hashes(simhash._lower[raw], starts, ends), np.zeros(width, np.uint64))
    votes = np.zeros((len(n_words), 64 * WORDS), dtype=np.int64)
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    with np.errstate(over="ignore"):
        for lo in range(0, len(owner), simhash.BLOCK):
            own = owner[lo : lo + simhash.BLOCK]
            at = first_word[own] + np.arange(lo, lo + len(own)) - shingle[own]
            upto = first_word[own] + n_words[own]
            h = np.zeros(len(own), np.uint64)
            for k in range(width):
                h = _mixed(h * _ODD[0] + np.where(at + k < upto, word[at + k], np.uint64(k)))
            # Eight bits of eight hashes bytes at a time: sums of at most 255 hashes of one text fit into a byte.
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            parts = -(-np.diff(begin, append=len(own)) // 255)
            cut = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            text_of_cut = np.repeat(own[begin], parts)
            change = np.flatnonzero(np.diff(text_of_cut, prepend=-1))
            for i in range(WORDS):
                z = _mixed(h + np.uint64(i + 1) * _ODD[0])
                for k in range(8):
                    sums = np.add.reduceat((z >> np.uint64(k)) & _ONES, cut).view(np.uint8).reshape(-1, 8)
                    votes[text_of_cut[change], 64 * i + k : 64 * (i + 1) : 8] += np.add.reduceat(sums.astype(np.int64), change, axis=0)
    bits = (votes * 2 > n_shingles[:, None]).reshape(-1, WORDS, 64)
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def wide_fingerprints(docs: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """Key and f0 to f7 of every row. Whole texts; a null text is one without words. No shuffle."""
    types = f"_key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in _NAMES)

    def compute(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("")
            size = np.cumsum(np.diff(common.bytes_of(texts)[1]))
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + simhash.BATCH_BYTES, side="right")))
                fp = wide_fingerprints_of(texts.slice(start, stop - start), width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), *(pa.array(fp[:, i].copy()) for i in range(WORDS))], names=["_key", *_NAMES])
                start = stop

    return docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(compute, types)


def wide_links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: links between ids of distinct fingerprints (id, f0 to f7) that meet at an anchor and differ in at most `most` bits.

    Each task reduces what it finds to a forest, and rows that are near the same of a block's first few rows are not compared
    with each other. A crowded anchor is split into classes by a hash and every pair of classes is a block, so blocks stay
    small, but the copies of one anchor's rows grow with the square of their number, divided by ANCHOR_ROWS / 2.
    """
    parts = 64 // PART_BITS

    def replicate(batches):
        for batch in batches:
            for i in range(WORDS):
                fp = batch.column(1 + i).to_numpy().view(np.uint64)
                for p in range(parts):
                    key = ((fp >> np.uint64(PART_BITS * p)) & np.uint64((1 << PART_BITS) - 1)).astype(np.int64)
                    key |= (i * parts + p) << PART_BITS
                    yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", "id", *_NAMES])

    types = "key long, id long, " + ", ".join(f"{n} long" for n in _NAMES)
    spread = nodes.select("id", *_NAMES).mapInArrow(replicate, types)
    crowded = spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > ANCHOR_ROWS)
    crowded = crowded.select("key", F.ceil(F.col("n") * 2 / ANCHOR_ROWS).cast("int").alias("classes"))
    own = F.pmod(F.xxhash64("id"), F.col("classes")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("classes") - 1), lambda c: F.xxhash64("key", F.least(c, own), F.greatest(c, own)))
    blocks = F.when(F.col("classes").isNull(), F.array(F.xxhash64("key", F.lit(0), F.lit(0)))).otherwise(pairs)
    spread = spread.join(crowded, "key", "left").select(F.explode(blocks).alias("block"), "id", *_NAMES)
    spread = spread.repartition("block").sortWithinPartitions("block")
    return spread.mapInArrow(lambda batches: _compared(batches, most), "a long, b long")


def _compared(batches, most: int):
    held = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        if not len(block):
            continue
        whole = int(np.searchsorted(block, block[-1]))  # the last block may go on in the next batch
        if whole:
            yield from _forest(pa.Table.from_batches([*held, batch.slice(0, whole)]), most)
            held = []
        held.append(batch.slice(whole))
    if held:
        yield from _forest(pa.Table.from_batches(held), most)


def _near(fp: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs of rows differ in at most `most` bits; half of the words exclude nearly all others."""
    half = WORDS // 2
    count = lambda x, y, words: np.bitwise_count(fp[x, words] ^ fp[y, words]).sum(axis=1, dtype=np.int64)
    bits = count(x, y, slice(0, half))
    near = np.flatnonzero(bits <= most)
    near = near[bits[near] + count(x[near], y[near], slice(half, WORDS)) <= most]
    return near


def _forest(rows: pa.Table, most: int):
    block = rows.column(0).to_numpy()
    ids = rows.column(1).to_numpy()
    fp = np.column_stack([rows.column(2 + i).to_numpy() for i in range(WORDS)]).view(np.uint64)
    n = len(block)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    size = np.diff(np.append(first, n))
    label = np.full(n, -1, np.int64)
    found_a, found_b = [], []
    in_block = np.repeat(np.arange(len(first)), size)
    for _ in range(LEADERS):
        left = np.flatnonzero(label < 0)
        if not len(left):
            break
        has, where = np.unique(in_block[left], return_index=True)
        leader = np.full(len(first), -1, np.int64)
        leader[has] = left[where]
        x = np.flatnonzero(leader[in_block] >= 0)
        y = leader[in_block[x]]
        for lo in range(0, len(x), simhash.BLOCK):
            at, to = x[lo : lo + simhash.BLOCK], y[lo : lo + simhash.BLOCK]
            near = _near(fp, at, to, most)
            at, to = at[near], to[near]
            a, b = graph.forest(ids[at[at != to]], ids[to[at != to]])
            found_a.append(a), found_b.append(b)
            new = label[at] < 0
            label[at[new]] = to[new]
    alone = label < 0
    label[alone] = np.flatnonzero(alone)
    # A row is compared with the rows of its block whose label comes after its own, each pair once.
    order = np.lexsort((label, in_block))
    label, in_block = label[order], in_block[order]
    last = np.flatnonzero(np.append((label[1:] != label[:-1]) | (in_block[1:] != in_block[:-1]), True)) if n else np.zeros(0, np.int64)
    after = last[np.searchsorted(last, np.arange(n))] + 1
    m = (first + size)[in_block] - after
    upto = np.cumsum(m)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + simhash.BLOCK, side="right")))
        k = m[start:stop]
        x = np.repeat(np.arange(start, stop), k)
        y = np.repeat(after[start:stop] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        x, y = order[x], order[y]
        near = _near(fp, x, y, most)
        a, b = graph.forest(ids[x[near]], ids[y[near]])
        found_a.append(a), found_b.append(b)
        start = stop
    a, b = graph.forest(np.concatenate([np.zeros(0, np.int64), *found_a]), np.concatenate([np.zeros(0, np.int64), *found_b]))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, most: int = MOST) -> DataFrame:
    """Key and component_id (smallest key reachable by links) of every row; links are fingerprints within `most` of 512 bits.

    Equal texts have equal fingerprints and take part once. Null and empty texts have the fingerprint zero and are linked
    with each other. A null key never names a component unless all keys in it are null. Repeated rows are kept; other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    rows = common.saved(wide_fingerprints(docs, key, text, width), "fingerprints")
    distinct = rows.groupBy(*_NAMES).agg(F.min("_key").alias("_least"))
    nodes = common.saved(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")  # written once: ids stay
    root = graph.components(wide_links(nodes, most)).select(F.col("node").alias("id"), "root")
    nodes = nodes.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = nodes.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = nodes.join(smallest, "root").select(*_NAMES, "component_id")
    return rows.join(named, _NAMES, "left").select(F.col("_key").alias(key), "component_id")
