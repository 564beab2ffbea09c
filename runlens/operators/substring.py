"""Which texts of a group contain which values, without pairing everything in the group.

Texts and values are compared through short grams of their bytes. A value of at least GRAM + WINDOW - 1 bytes is found by
winnowing: of the grams in every window of WINDOW places the one with the least hash is kept, on both sides by the same
rule, so all kept grams of a value are kept in a text that contains it. Shorter values are represented by all their grams of
GRAM bytes, or by themselves. A bitmap of bounded size, made from the values' grams, is looked at where a text is cut: only
grams that a value of the same group may have leave the task. They are written once; each value then takes the gram that
the fewest texts have (a value with a gram that no text has is in none), both meet in an equi-join on (group, gram), and
those few candidates are checked. The result is exact.

Where a value must not cut through words (`containing_tokens`), every maximal run of [a-z0-9] in it is such a run of the text
too. Runs, or windows of two or four of them with what stands between, then take the place of grams: a text has a few for each
word instead of several for each byte, however full the filter is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as t
from runlens.session import stage

GRAM, WINDOW = 8, 8  # bytes of a gram (as many as a 64-bit number holds); places of which one gram is kept
FILTER_BITS, MOST_FILTER_BITS = 1 << 25, 1 << 28  # of a filter for few and for many values; eight for each gram between
CODE_BITS = 42  # of a gram, so that a count of texts and a gram fit into one number
BATCH_BYTES = 4 << 20
_PAGE = 1 << 15  # bits of one row of the filter
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
#: Ways to cut: by length for values shorter than a gram, every gram, and winnowed grams.
EVERY, WINNOWED = GRAM, GRAM + 1
#: Ways to cut at words: by how many of them stand in a window; none for values without a word.
WORDLESS, WINDOWS = 0, (1, 2, 4)
_CODES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_BASE, _INVERSE = (np.uint64(x) for x in (_ODD[0], pow(int(_ODD[0]), -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for odd in _ODD:
            x = x * odd
            x ^= x >> np.uint64(32)
    return x


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a gram of zeros after them, and where each text starts and ends. Nulls are empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return np.concatenate([raw, np.zeros(GRAM, np.uint8)]), bounds - bounds[0]


def cut(texts: pa.Array, ways: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each way the rows and codes of the texts' grams; a code may come several times for a row."""
    data, bounds = _bytes(texts)
    size = len(data) - GRAM
    wide = np.ndarray(size, "<u8", buffer=data, strides=(1,))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    left = bounds[1:][owner] - np.arange(size)  # bytes from here to the end of the text
    for way in ways:
        length = min(way, GRAM)
        part = wide if length == GRAM else wide & np.uint64((1 << 8 * length) - 1)
        with np.errstate(over="ignore"):
            code = _mixed(part + np.uint64(way) * _ODD[0])
        if way != WINNOWED:
            at = np.flatnonzero(left >= length)
            yield owner[at], code[at]
            continue
        step = 1
        while step < WINDOW:
            code[:-step] = np.minimum(code[:-step], code[step:])
            step *= 2
        at = np.flatnonzero(left >= GRAM + WINDOW - 1)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (code[at[1:]] != code[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            at = at[new]
        yield owner[at], code[at]


def _word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each maximal run of [a-z0-9] starts and ends, and the row of its text."""
    word = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    apart = np.ones(len(data) + 1, bool)  # whether a run cannot go on from the byte before
    apart[1:-1] = ~(word[1:] & word[:-1])
    apart[bounds] = True
    start, end = np.flatnonzero(word & apart[:-1]), np.flatnonzero(word & apart[1:]) + 1
    return start, end, np.searchsorted(bounds[1:], start, side="right")


def cut_words(texts: pa.Array, ways: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each way the rows and codes of the texts' windows of words."""
    data, bounds = _bytes(texts)
    data = data[:-GRAM]
    start, end, owner = _word_bounds(data, bounds)
    with np.errstate(over="ignore"):
        power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(data) - 1, 0), x)])) for x in (_BASE, _INVERSE))
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * power[: len(data)], out=upto[1:])
        for way in ways:
            last = max(len(start) - way + 1, 0) if way else 0
            first, stop = start[:last], end[way - 1 :][:last]
            own = owner[:last] == owner[way - 1 :][:last]
            code = _mixed((upto[stop] - upto[first]) * back[first] + np.uint64(way) * _ODD[1])
            yield owner[:last][own], code[own]


def _word_ways(texts: pa.Array) -> np.ndarray:
    data, bounds = _bytes(texts)
    words = np.bincount(_word_bounds(data[:-GRAM], bounds)[2], minlength=len(texts))
    return np.array([WORDLESS, *WINDOWS])[np.searchsorted(WINDOWS, words, side="right")]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BATCH_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _in_group(batch: pa.RecordBatch, column: int, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
    group = batch.column(column).to_numpy().view(np.uint64)
    return _mixed(code ^ group[rows]) & np.uint64((1 << CODE_BITS) - 1)


def _distinct(rows: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((code, rows))
    rows, code = rows[order], code[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (code[1:] != code[:-1])
    return rows[new], code[new]


def _way(size: np.ndarray) -> np.ndarray:
    return np.where(size >= GRAM + WINDOW - 1, WINNOWED, np.minimum(size, GRAM))


class Cutter(NamedTuple):
    """How values and texts are cut: the way for each value, and the grams of texts for some ways."""

    ways: Callable[[pa.Array], np.ndarray]
    cut: Callable[[pa.Array, Sequence[int]], Iterator[tuple[np.ndarray, np.ndarray]]]


BYTES = Cutter(lambda texts: _way(pc.binary_length(texts).to_numpy()), cut)
WORDS = Cutter(_word_ways, cut_words)


def value_grams(values: DataFrame, kept: list[str], value: str, by: Cutter = BYTES) -> DataFrame:
    """The columns `kept`, way and gram: every gram of each value, cut in the way that it asks for; of a value without words
    one row without a gram."""
    types = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in kept)

    def grams(batches):
        for batch in batches:
            ways = by.ways(batch.column(1))
            for way in np.unique(ways):
                own = batch.filter(pa.array(ways == way))
                if way == WORDLESS:
                    rows, code = np.arange(own.num_rows), np.zeros(own.num_rows, np.uint64)
                else:
                    rows, code = next(by.cut(own.column(1), [int(way)]))
                    rows, code = _distinct(rows, _in_group(own, 0, rows, code))
                told = own.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*told.columns[2:], pa.array(np.full(len(rows), way, np.int32)), pa.array(code.view(np.int64))], names=[*kept, "way", "gram"])

    return values.select("_g", value, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)]).mapInArrow(grams, f"{types}, way int, gram long")


def text_grams(
    texts: DataFrame, kept: list[str], text: str, ways: list[int], filter_: np.ndarray, by: Cutter = BYTES
) -> DataFrame:
    """The columns `kept` and gram: the grams of each text that the filter lets through, each once."""
    types = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept)
    shared = texts.sparkSession.sparkContext.broadcast(filter_)

    def grams(batches):
        bits = shared.value
        for batch in batches:
            for part in _parts(batch, 1):
                found = []
                for rows, code in by.cut(part.column(1), ways):
                    code = _in_group(part, 0, rows, code)
                    at = code & np.uint64(8 * len(bits) - 1)
                    hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    found.append(_distinct(rows[hit], code[hit]))
                rows, code = (np.concatenate(x) for x in zip(*found))
                told = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*told.columns[2:], pa.array(code.view(np.int64))], names=[*kept, "gram"])

    return texts.select("_g", text, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)]).mapInArrow(grams, f"{types}, gram long")


def _filter(options: DataFrame) -> np.ndarray:
    """A bit for each gram; at most MOST_FILTER_BITS / 8 bytes come to the driver, whatever the number of values."""
    size = min(max(FILTER_BITS, 1 << (8 * options.count()).bit_length()), MOST_FILTER_BITS)
    at = F.col("gram").bitwiseAND(F.lit(size - 1))
    pages = options.groupBy((at / _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(at % _PAGE).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in pages.collect():
        out[row["page"] * _PAGE // 8 : (row["page"] + 1) * _PAGE // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _near(
    texts: DataFrame, options: DataFrame, ways: list[int], own: list[str], keys: list[str], ref: str, text: str, by: Cutter
) -> DataFrame:
    """Texts beside the values whose rarest gram they have."""
    group = F.xxhash64(*keys).alias("_g")
    grams = text_grams(texts.select(*keys, ref, text, group), [*keys, ref], text, ways, _filter(options), by)
    indexed = stage(grams, "text_grams")
    # Count and gram in one number: the least of it is kept in a hash table, where a struct would have to be sorted.
    frequency = indexed.groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    one = F.lit(1 << CODE_BITS)
    rank = F.least(F.coalesce("_df", F.lit(0)), F.lit((1 << 62 - CODE_BITS) - 1)) * one + F.col("gram")
    rare = options.join(frequency, "gram", "left").groupBy(*own).agg(F.min(rank).alias("_rank")).where(F.col("_rank") >= one)
    rare = rare.select(*own, F.col("_rank").bitwiseAND(one - 1).alias("gram"))
    return indexed.join(rare, [*keys, "gram"]).drop("gram").join(texts, [*keys, ref])


def containing(
    texts: DataFrame, values: DataFrame, keys: Sequence[str], ref: str, text: str, value_id: str, value: str
) -> DataFrame:
    """Rows (keys, value_id, value, ref, text) where the text contains the value. Values must not be empty."""
    keys = list(keys)
    group = F.xxhash64(*keys).alias("_g")
    own = list(dict.fromkeys([*keys, value_id, value]))
    wanted = values.where(F.length(value) > 0).select(*own, group)
    options = stage(value_grams(wanted, own, value), "value_grams")
    ways = [r["way"] for r in options.select("way").distinct().collect()]  # at most GRAM + 1
    if not ways:
        return values.select(*own).limit(0).join(texts.select(*keys, ref, text).limit(0), keys)
    near = _near(texts, options, sorted(ways), own, keys, ref, text, BYTES)
    return near.where(F.col(text).contains(F.col(value)))


def containing_tokens(
    texts: DataFrame, values: DataFrame, keys: Sequence[str], ref: str, text: str, value_id: str, value: str
) -> DataFrame:
    """As `containing`, of texts and values in lower case, where the first occurrence of the value cuts through no word
    (`text.token_contains`). Values without a word go through the grams of bytes."""
    keys = list(keys)
    own = list(dict.fromkeys([*keys, value_id, value]))
    wanted = values.where(F.length(value) > 0).select(*own, F.xxhash64(*keys).alias("_g"))
    options = stage(value_grams(wanted, own, value, WORDS), "value_words")
    ways = {r["way"] for r in options.select("way").distinct().collect()}  # at most WORDLESS and WINDOWS
    worded = options.where(F.col("way") != WORDLESS)
    wordless = options.where(F.col("way") == WORDLESS).select(*own)
    if ways <= {WORDLESS}:
        near = containing(texts, wordless, keys, ref, text, value_id, value)
    else:
        near = _near(texts, worded, sorted(ways - {WORDLESS}), own, keys, ref, text, WORDS)
        if WORDLESS in ways:
            near = near.unionByName(containing(texts, wordless, keys, ref, text, value_id, value))
    return near.where(t.token_contains(F.col(text), F.col(value), lowered=True))
