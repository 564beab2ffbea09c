"""Packing of token pieces into sequences of fixed length by exact-complement hashing, then best fit.

A plan needs only how many pieces there are of each length, so at most `capacity` numbers reach the driver, whatever the
input. Counts by length are the index: a gap is looked up as one length, as a pair and as a triple that sums to it. Where
there is none, the longest piece that goes in is taken (best fit) and the rest of the gap is looked up again. Lengths are
taken from the longest on, so that no long piece finds the short ones used up. Each combination is taken as often as its
scarcest length allows, so steps use up lengths and the plan has few entries. Pieces then get their place from their rank
within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common, tokens

BUCKETS = 1024  # of pieces of one length; each is ranked on its own


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text",
           vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of at most `capacity` tokens: key, piece, start, length, ids_crc32.

    A document is its ids and then `end_id`; null and empty texts hold `end_id` alone. Only longer documents are cut, the
    first piece takes what the full ones leave. Null keys and repeated rows are kept; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []

            def emit(row, ids):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                count = -(-len(ids) // capacity)
                first = len(ids) - capacity * (count - 1)
                for i in range(count):
                    start = 0 if i == 0 else first + capacity * (i - 1)
                    stop = first + capacity * i
                    rows.append(row), numbers.append(i), starts.append(start), lengths.append(stop - start)
                    sums.append(zlib.crc32(ids[start:stop]))

            seen = 0
            for row, ids in tokens.ids_of(batch.column(1), vocabulary, ranks):
                emit(row, ids)
                seen += 1
            if seen < batch.num_rows:  # texts without any id are not reported
                for row in np.setdiff1d(np.arange(batch.num_rows), np.array(rows, dtype=np.int64)):
                    emit(int(row), np.zeros(0, np.uint32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Stock:
    """Pieces left of each length. Two bit sets, by length and by capacity - length, say which lengths are left; shifting one
    against the other gives all pairs with a sum at once."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.up, self.down = capacity, [0] * (capacity + 1), 0, 0
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        self.left[length] += n
        bit, mirrored = 1 << length, 1 << (self.capacity - length)
        if self.left[length]:
            self.up, self.down = self.up | bit, self.down | mirrored
        else:
            self.up, self.down = self.up & ~bit, self.down & ~mirrored

    def longest(self, most: int) -> int:
        """The longest length up to `most`, 0 if there is none."""
        return max(0, (self.up & ((2 << most) - 1)).bit_length() - 1)

    def pair(self, total: int, least: int) -> tuple[int, int] | None:
        """Two lengths from `least` on with this sum, the longer one as long as can be."""
        found = self.up & (self.down >> (self.capacity - total)) & ((2 << (total // 2)) - 1) >> least << least
        while found:
            short = (found & -found).bit_length() - 1
            if 2 * short < total or self.left[short] > 1:
                return total - short, short
            found &= found - 1
        return None

    def exactly(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to the gap."""
        if self.left[gap]:
            return (gap,)
        if two := self.pair(gap, 1):
            return two
        thirds = self.up & ((2 << (gap // 3)) - 1)
        while thirds:
            third = (thirds & -thirds).bit_length() - 1
            self.add(third, -1)
            two = self.pair(gap - third, third)
            self.add(third, 1)
            if two:
                return (*two, third)
            thirds &= thirds - 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first rank, how many, first sequence, offset): piece rank + i goes to sequence first + i."""
    stock = Stock(counts, capacity)
    taken = [0] * (capacity + 1)
    groups: list[tuple[tuple[int, ...], int]] = []
    while length := stock.longest(capacity):
        stock.add(length, -1)
        combination, gap = [length], capacity - length
        while gap:
            found = stock.exactly(gap) or (stock.longest(gap),)  # else best fit, and the rest of the gap again
            if not found[0]:
                break
            for piece in found:
                stock.add(piece, -1)
            combination += found
            gap -= sum(found)
        need = Counter(combination)
        # As often as the scarcest length allows, this once included.
        times = 1 + min(stock.left[piece] // n for piece, n in need.items())
        for piece, n in need.items():
            stock.add(piece, -n * (times - 1))
        groups.append((tuple(combination), times))
    out, sequence = [], 0
    for combination, times in groups:
        offset = 0
        for length in combination:
            out.append((length, taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = 1024, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a table of `pieces`; it is read twice, so hand in a written one.

    Every sequence is filled from 0 without gaps. Equal rows are interchangeable; an empty table gives an empty result.
    """
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    entries = sorted(plan(counts, capacity))
    stride = max([1, *(c for c in counts.values())]) + 1
    at = np.array([e[0] * stride + e[1] for e in entries], dtype=np.int64)
    sequence, offset = (np.array([e[i] for e in entries], dtype=np.int64) for i in (3, 4))
    rank_at = np.array([e[1] for e in entries], dtype=np.int64)
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    ranked = common.add_prefix(parts, ["length"], "_bucket", [F.col(key), "piece", "ids_crc32", "start"], F.lit(1), "_rank").drop("_bucket")

    def place(batches):
        for batch in batches:
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            e = np.searchsorted(at, length * stride + rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(sequence[e] + rank - rank_at[e]), pa.array(offset[e])],
                names=[*names, "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    ranked = ranked.withColumn("_rank", F.col("_rank").cast("long"))
    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """Cuts and packs documents; see `pieces` and `pack`. The pieces are written to the shared folder in between."""
    return pack(common.saved(pieces(docs, capacity, **options), "pieces"), capacity, options.get("key", "doc_id"))
