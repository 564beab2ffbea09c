"""SimHash near-duplicates: fingerprints, and all links within a distance by anchor-point covering.

A fingerprint's 64 bits are cut into three parts of 23, 23 and 18 bits. Two fingerprints that differ in at most 4 bits
agree up to one bit in one of the first two parts, or wholly in the third (2 + 2 + 1 = 5 > 4 differing bits otherwise).
The anchors of a part are a covering code. In the first two, the Hamming code covers 15 bits with radius 1 and the other
8 bits are free (every value is an anchor, radius 0); in the third all 18 bits are free. A fingerprint is at home at the
anchor that covers it, and is copied to every anchor within the radius plus the part's threshold: if x and y agree up to
the threshold, y has a copy at the home of x. Homes and copies of an anchor are compared bit by bit, so no link is missed
and none is false.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common, graph

SEED = 42
#: Fixed values of the hash function XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
LONG = 256  # bytes from which a shingle is hashed by itself
BLOCK = 1 << 19  # shingles and pairs that are handled at once
BATCH_BYTES = 8 << 20
#: Homes or copies of one anchor above which the anchor is split into blocks of homes times blocks of copies.
ANCHOR_ROWS = 4096

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_lower[[ord(c) for c in common.SEPARATORS]] = 32


def _rotated(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc, value):
    return _rotated(acc + value * P2, 31) * P1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each byte range; ranges of equal length are hashed together."""
    out = np.empty(len(starts), dtype=np.uint64)
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(raw) + 1, dtype="<u8", buffer=data, strides=(1,))
    half = np.ndarray(len(raw) + 1, dtype="<u4", buffer=data, strides=(1,))
    length = np.minimum(ends - starts, LONG).astype(np.uint16)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1).astype(bool))
    seed = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = order[lo:hi]
            s, n = starts[at], int(length[at[0]])
            if n == LONG:
                out[at] = [xxhash.xxh64_intdigest(raw[a:b].tobytes(), SEED) for a, b in zip(s, ends[at])]
                continue
            done = 0
            if n >= 32:
                acc = [np.full(len(s), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
                while done + 32 <= n:
                    acc = [_lane(acc[i], wide[s + (done + 8 * i)]) for i in range(4)]
                    done += 32
                h = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
                for a in acc:
                    h = (h ^ _lane(np.uint64(0), a)) * P1 + P4
            else:
                h = np.full(len(s), seed + P5, np.uint64)
            h += np.uint64(n)
            while done + 8 <= n:
                h = _rotated(h ^ _lane(np.uint64(0), wide[s + done]), 27) * P1 + P4
                done += 8
            if done + 4 <= n:
                h = _rotated(h ^ (half[s + done].astype(np.uint64) * P1), 23) * P2 + P3
                done += 4
            while done < n:
                h = _rotated(h ^ (raw[s + done].astype(np.uint64) * P5), 11) * P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[at] = h ^ (h >> np.uint64(32))
    return out


def fingerprints_of(texts: pa.Array, width: int = 4) -> np.ndarray:
    """Unsigned fingerprint of each text; nulls and texts without words have zero."""
    raw, offsets = common.bytes_of(texts)
    starts, ends = common.word_bounds(raw, offsets)
    n_words = common.per_text(starts, offsets)
    raw = _lower[raw]
    if len(starts) and (np.diff(np.append(starts, starts[-1])) - (ends - starts) != 1)[:-1].any():
        # Words stand further apart somewhere (at least where a text ends): join all by one space.
        length = ends - starts
        new = np.cumsum(length + 1) - (length + 1)
        joined = np.full(int(new[-1] + length[-1]), 32, np.uint8)
        index = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
        joined[np.repeat(new - (np.cumsum(length) - length), length) + np.arange(length.sum())] = raw[index]
        raw, starts, ends = joined, new, new + length
    first_word = np.cumsum(n_words) - n_words
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    shingle = np.cumsum(n_shingles) - n_shingles
    total = int(n_shingles.sum())
    # The word a shingle starts with, and the one it ends with.
    from_word = np.repeat(first_word - shingle, n_shingles) + np.arange(total)
    to_word = np.minimum(from_word + width, np.repeat(first_word + n_words, n_shingles)) - 1
    votes = np.zeros((len(n_words), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    ones = np.uint64(0x0101010101010101)
    for lo in range(0, total, BLOCK):
        part = slice(lo, min(total, lo + BLOCK))
        h = hashes(raw, starts[from_word[part]], ends[to_word[part]])
        # Eight bits of eight hashes bytes at a time: sums of at most 255 hashes of one text fit into a byte.
        own = owner[part]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        runs = np.diff(begin, append=len(own))
        n_parts = -(-runs // 255)
        cut = np.repeat(begin, n_parts) + 255 * (np.arange(n_parts.sum()) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts))
        text_of_cut = np.repeat(own[begin], n_parts)
        change = np.flatnonzero(np.diff(text_of_cut, prepend=-1))
        for k in range(8):
            sums = np.add.reduceat((h >> np.uint64(k)) & ones, cut).view(np.uint8).reshape(-1, 8)
            votes[text_of_cut[change], k::8] += np.add.reduceat(sums.astype(np.int64), change, axis=0)
    bits = votes * 2 > n_shingles[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fp (64 bits, as a signed long) of every row. Whole texts; a null text is one without words. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def compute(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("")
            size = np.cumsum(np.diff(common.bytes_of(texts)[1]))
            start, parts = 0, []
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH_BYTES, side="right")))
                parts.append(fingerprints_of(texts.slice(start, stop - start)))
                start = stop
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(compute, f"`{key}` {kind}, fp long")


#: First bit, width and threshold of each part; the low CODED bits of parts with a threshold are covered by the Hamming code.
PARTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
CODED = 15
_position = np.arange(1 << CODED, dtype=np.int64)
_syndrome = np.zeros(1 << CODED, dtype=np.int64)
for _i in range(CODED):
    _syndrome ^= np.where(_position >> _i & 1, _i + 1, 0)
#: Pairs of bits to flip for each syndrome s: positions i < j with i ^ j = s.
_pairs = np.zeros((16, 7), dtype=np.int64)
for _s in range(1, 16):
    _pairs[_s] = [(1 << (i - 1)) | (1 << (j - 1)) for i in range(1, 16) if (j := i ^ _s) > i]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: anchor (part in the high bits), whether it is the home, and which fingerprint it is of."""
    keys, homes, which = [], [], []

    def add(part, key, home, index):
        keys.append(key | (part << 40)), homes.append(np.full(len(key), home)), which.append(index)

    index = np.arange(len(fp))
    for part, (first, width, threshold) in enumerate(PARTS):
        x = ((fp >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        if not threshold:
            add(part, x, True, index)
            continue
        s = _syndrome[x & ((1 << CODED) - 1)]
        home = np.where(s > 0, x ^ (1 << np.maximum(s - 1, 0)), x)
        add(part, home, True, index)
        for bit in range(CODED, width):  # a free bit differs: nothing is left of the threshold
            add(part, home ^ (1 << bit), False, index)
        off = np.flatnonzero(s > 0)
        for k in range(7):  # other code words at distance 2
            add(part, x[off] ^ _pairs[s[off], k], False, off)
    return np.concatenate(keys), np.concatenate(homes), np.concatenate(which)


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """a, b: links that join the same distinct fingerprints (column fp, without repeats) as all pairs within `most` bits do.

    Each task reduces the links it finds to a forest, at most one link per fingerprint and block, so large groups of near
    copies give few rows.
    """
    assert sum(t + 1 for _, _, t in PARTS) > most, "parts must cover the distance"

    def replicate(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            key, home, which = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fp[which].view(np.int64))], names=["key", "home", "fp"])

    spread = fps.select("fp").mapInArrow(replicate, "key long, home boolean, fp long")
    crowded = spread.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    crowded = crowded.where(F.col("n") > ANCHOR_ROWS).where("homes > 0").select("key", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("blocks"))
    spread = spread.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # Homes stand in one row of blocks, copies in one column; a home is compared as a copy too.
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_copy = F.transform(all_blocks, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("left")))
    as_home = F.transform(all_blocks, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("left")))
    spread = spread.select("key", "fp", F.explode(F.when(F.col("home"), F.concat(as_copy, as_home)).otherwise(as_copy)).alias("p"))
    spread = spread.select(F.xxhash64("key", "p.i", "p.j").alias("block"), "p.left", "fp").repartition("block").sortWithinPartitions("block")
    return spread.mapInArrow(lambda batches: _compared(batches, most), "a long, b long")


def _compared(batches, most: int):
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(p) for p in zip(held, now)]
        last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0  # the last block may go on in the next batch
        held = [c[last:] for c in now]
        yield from _within(*(c[:last] for c in now), most)
    if held is not None:
        yield from _within(*held, most)


def _within(block: np.ndarray, left: np.ndarray, fp: np.ndarray, most: int):
    """Forest of the links between homes and copies of the same block; rows are sorted by block."""
    found_a, found_b = [], []
    homes, copies = np.flatnonzero(left), np.flatnonzero(~left)
    lo = np.searchsorted(block[copies], block[homes], side="left")
    n = np.searchsorted(block[copies], block[homes], side="right") - lo
    upto = np.cumsum(n)
    start = 0
    while start < len(homes):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + (BLOCK << 2), side="right")))
        m = n[start:stop]
        x = fp[np.repeat(homes[start:stop], m)]
        y = fp[copies[np.repeat(lo[start:stop] - (np.cumsum(m) - m), m) + np.arange(m.sum())]]
        near = (np.bitwise_count((x ^ y).view(np.uint64)) <= most) & (x != y)
        a, b = graph.forest(x[near], y[near])
        found_a.append(a), found_b.append(b)
        start = stop
    if found_a:
        a, b = graph.forest(np.concatenate(found_a), np.concatenate(found_b))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """Key, fingerprint (16 hexadecimal digits) and component_id (smallest key reachable by links) of every row.

    Documents link if their fingerprints differ in at most `most` bits; equal texts have equal fingerprints and take part
    once. Null and empty texts have fingerprint zero and link like others. A null key never names a component unless all
    keys in it are null. Repeated rows are kept. An empty table gives an empty result.
    """
    rows = common.saved(fingerprints(docs, key, text), "fingerprints")
    nodes = common.saved(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    root = graph.components(links(nodes, most)).withColumnRenamed("node", "_fp")
    nodes = nodes.join(root, F.col("fp") == F.col("_fp"), "left").select("fp", "least", "root")
    smallest = nodes.where("root is not null").groupBy("root").agg(F.min("least").alias("_least")).withColumnRenamed("root", "_root")
    named = nodes.join(smallest, F.col("root") == F.col("_root"), "left").select(F.col("fp").alias("_fp"), F.coalesce("_least", "least").alias("component_id"))
    out = rows.join(named, F.col("fp") == F.col("_fp"), "left")
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
