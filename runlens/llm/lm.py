"""Language-model scoring by context-tree weighting over bytes, beside a word base.

A byte is eight binary decisions; each decision in each context of 0 to 5 preceding bytes has counts of zeros and ones and
a Krichevsky-Trofimov estimate. A context's weighted probability is half its own estimate and half the product of those of
its longer contexts, which fixes how much weight each depth gets; a decision is coded with the mixture over all depths that
training has seen. Counts of six-byte sequences hold all of this.

Work is split by the last three bytes of the context: of one such group there are at most 2^24 sequences, and depths 3 to 5
are worked out inside it. Depth 2 (at most 2^16 contexts of 255 decisions) is a table, each group is joined with the at most
255 decisions that lead to it. Only depths 0 and 1 (at most 2^8 contexts, about 2 MB) pass the driver. A first pass over the texts counts sequences and words, a second adds up their scores. Frequent
entries (bounded numbers of them) are looked up where the text is; every other occurrence is joined to its entry.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import common, simhash

DEPTH, LOCAL = 5, 3  # bytes of context; the depth from which a group of contexts is worked out in one task
#: Bytes of text that are handled at once: when counting (larger batches give fewer rows) and when scoring (beside the tables).
COUNT_BYTES, SCORE_BYTES = 3 << 20, 1 << 20
#: Entries that tasks look up directly; all others are joined. They bound what is broadcast, not what is counted.
MOST_WORDS, MOST_SEQUENCES = 1 << 19, 1 << 21
WORD, SEQUENCE, DOCUMENT = 0, 1, 2
_HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive x: shifted by 8, then Stirling's series."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the probability that the estimator gives to a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


class Level:
    """The decisions of one depth: sorted codes (context and bits so far), the estimate of a one, and the depth's share."""

    def __init__(self, code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None):
        own = estimate(zeros, ones)
        self.code, self.zeros, self.ones = code, zeros, ones
        self.weighted = own if below is None else np.logaddexp(_HALF + own, _HALF + below)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)
        self.share = np.ones(len(code)) if below is None else np.exp(_HALF + own - self.weighted)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.code):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return at, self.code[at] == code

    def shorter(self) -> tuple[np.ndarray, ...]:
        """Codes of contexts one byte shorter, with sums of the counts and of the weighted probabilities."""
        code = (self.code >> 16 << 8) | (self.code & 255)
        code, at = np.unique(code, return_inverse=True)
        return code, *(np.bincount(at, x, len(code)) for x in (self.zeros, self.ones, self.weighted))


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits so far (with a leading one) and the next bit, eight for each byte."""
    k = np.arange(8)
    return (1 << k) | (byte[:, None] >> (8 - k)), (byte[:, None] >> (7 - k)) & 1


def local_levels(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """Depths LOCAL to DEPTH of whole groups of sequences that training has seen."""
    seen = n > 0
    key, n = key[seen], n[seen].astype(float)
    before, bit = decisions(key & 255)
    code, at = np.unique(((key >> 8 << 8)[:, None] | before).ravel(), return_inverse=True)
    weight, bit = np.repeat(n, 8), bit.ravel()
    levels = [Level(code, np.bincount(at, weight * (1 - bit), len(code)), np.bincount(at, weight * bit, len(code)), None)]
    for _ in range(DEPTH - LOCAL):
        levels.append(Level(*levels[-1].shorter()))
    return levels[::-1]


def top_levels(code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depths: int = LOCAL) -> list[Level]:
    """Depths 0 to `depths` - 1 from the sums of the deepest of them."""
    order = np.argsort(code)
    levels = [Level(code[order], zeros[order], ones[order], below[order])]
    while len(levels) < depths:
        levels.append(Level(*levels[-1].shorter()))
    return levels[::-1]


class Joined:
    """Decisions of depth LOCAL - 1 as they stand beside each group of sequences: sorted codes (the group's bytes and bits so
    far), with the estimate of a one and the depth's share."""

    def __init__(self, code: np.ndarray, one: np.ndarray, share: np.ndarray):
        self.code, self.one, self.share = code, one, share

    find = Level.find


def log_probability(key: np.ndarray, levels: list[Level | Joined]) -> np.ndarray:
    """log10 of each sequence's last byte after the others. A context that training never met ends the mixture above it."""
    before, bit = decisions(key & 255)
    before, bit = before.ravel(), bit.ravel()
    context = np.repeat(key >> 8, 8)
    p, mixed, left = np.full(len(bit), 0.5), np.zeros(len(bit)), np.ones(len(bit))
    for depth, level in enumerate(levels):
        held = LOCAL if isinstance(level, Joined) else depth
        at, seen = level.find((context >> (8 * (DEPTH - held)) << 8) | before)
        if not len(level.code):
            continue
        one = level.one[at]
        p = np.where(seen, mixed + left * one, p)
        share = np.where(seen, level.share[at], 0.0)
        mixed, left = mixed + left * share * one, left * (1 - share)
    return np.log10(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)


class Lines:
    """Texts as tokens and as bytes: words in lower case (A-Z) joined by a space, then the end (a line feed). Line feeds
    stand before each text, so that its first bytes have a context."""

    def __init__(self, texts: pa.Array):
        raw, offsets = common.bytes_of(texts)
        starts, ends = common.word_bounds(raw, offsets)
        length = ends - starts
        self.n_words = common.per_text(starts, offsets)
        upto = np.concatenate([[0], np.cumsum(length + 1)])
        first = np.concatenate([[0], np.cumsum(self.n_words)])
        size = DEPTH + np.maximum(upto[first[1:]] - upto[first[:-1]], 1)
        self.begin = np.cumsum(size) - size
        self.end = self.begin + size
        self.starts = np.repeat(self.begin + DEPTH - upto[first[:-1]], self.n_words) + upto[:-1]
        self.ends = self.starts + length
        self.data = np.full(int(size.sum()), 10, np.uint8)
        inner = np.ones(len(length), bool)
        inner[first[1:][self.n_words > 0] - 1] = False
        self.data[self.ends[inner]] = 32
        in_word = np.ones(len(self.data), bool)
        for k in range(DEPTH):
            in_word[self.begin + k] = False
        in_word[self.end - 1] = False
        in_word[self.ends] = False
        self.data[in_word] = simhash._lower[raw[common._is_word_byte[raw]]]

    def words(self) -> np.ndarray:
        return simhash.hashes(self.data, self.starts, self.ends).view(np.int64)

    def sequences(self) -> np.ndarray:
        """One for each byte of the texts and their ends: the five bytes before, nearest in the high bits, then the byte."""
        b = self.data.astype(np.int64)
        key = b[DEPTH:].copy()
        for k in range(1, DEPTH + 1):
            key |= b[DEPTH - k : len(b) - k] << (8 * (DEPTH + 1 - k))
        own = np.ones(len(b), bool)
        for k in range(DEPTH):
            own[self.begin + k] = False
        return key[own[DEPTH:]]

    def sizes(self) -> np.ndarray:
        return self.end - self.begin - DEPTH


class Lookup:
    """Hash table from 64-bit keys to values, with linear probing, for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = keys, values
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, the last one stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(11400714819323198485)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._slot(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != keys[open_])]
        return out


def _parts(texts: pa.Array, size: int):
    """First row and texts of about `size` bytes each."""
    texts = texts.fill_null("") if texts.null_count else texts
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def counts(rows: DataFrame) -> DataFrame:
    """kind, key, n: how often training rows hold each word and each six-byte sequence. Sequences of other rows are listed
    too, with 0 if training has none. `rows` has training (boolean) and text."""
    def count(batches):
        for batch in batches:
            training = batch.column(0).to_numpy(zero_copy_only=False)
            for start, texts in _parts(batch.column(1), COUNT_BYTES):
                lines = Lines(texts)
                own = training[start : start + len(texts)]
                found = [(WORD, lines.words()[np.repeat(own, lines.n_words)], 1)]
                in_training = np.repeat(own, lines.sizes())
                key = lines.sequences()
                found += [(SEQUENCE, key[in_training], 1), (SEQUENCE, key[~in_training], 0)]
                for kind, keys, one in found:
                    unique = pc.value_counts(pa.array(keys))
                    n = unique.field(1).to_numpy() * one
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), unique.field(0), pa.array(n, pa.int64())], names=["kind", "key", "n"])

    return rows.select("training", "text").mapInArrow(count, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


_GROUP = 8 * (DEPTH + 1 - LOCAL)  # bits of a sequence behind those that name its group


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of the same group (the last three bytes of context) together, sorted by the other columns too."""
    return rows.repartition("group").sortWithinPartitions(*rows.columns[:3])


def _whole_groups(batches):
    """The columns of a batch, cut only between groups."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[last:] for x in now]
        if last:
            yield [x[:last] for x in now]
    if held is not None:
        yield held


def joined_depth(sequences: DataFrame) -> DataFrame:
    """code, zeros, ones, weighted, one, share of every decision of depth LOCAL - 1."""
    def upward(batches):
        for _, key, n in _whole_groups(batches):
            code, zeros, ones, below = local_levels(key, n)[0].shorter()
            yield pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(x, pa.float64()) for x in (zeros, ones, below))], names=["code", "zeros", "ones", "below"])

    def weigh(batches):
        for batch in batches:
            level = Level(*(c.to_numpy() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level.code, level.zeros, level.ones, level.weighted, level.one, level.share)], names=["code", "zeros", "ones", "weighted", "one", "share"])

    found = grouped(sequences.select("group", "key", "n")).mapInArrow(upward, "code long, zeros double, ones double, below double")
    sums = found.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    return sums.mapInArrow(weigh, "code long, zeros double, ones double, weighted double, one double, share double")


def model(sequences: DataFrame) -> DataFrame:
    """key, n, logp: log10 probability of the last byte of every listed sequence. Give it a written table."""
    sequences = sequences.select(F.shiftright("key", _GROUP).alias("group"), "key", "n")
    deepest = common.saved(joined_depth(sequences), "depth")
    shorter = F.shiftleft(F.shiftright("code", 16), 8).bitwiseOR(F.col("code").bitwiseAND(255))
    sums = deepest.groupBy(shorter.alias("code")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toArrow()  # at most 2^8 contexts of 255 decisions
    shared = sequences.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in sums.columns))

    # Each group beside the decisions of its context without the last byte: at most 256 groups meet 255 decisions.
    groups = sequences.select("group").distinct().withColumn("context", F.shiftright("group", 8))
    beside = groups.join(deepest.select(F.shiftright("code", 8).alias("of"), "code", "one", "share"), F.col("context") == F.col("of"))
    bits = F.shiftleft("group", 8).bitwiseOR(F.col("code").bitwiseAND(255))
    none = F.lit(None).cast("double")
    beside = beside.select("group", F.lit(False).alias("listed"), bits.alias("key"), F.lit(0).cast("long").alias("n"), "one", "share")
    listed = sequences.select("group", F.lit(True).alias("listed"), "key", "n", none.alias("one"), none.alias("share"))

    def downward(batches):
        upper = None
        for _, own, key, n, one, share in _whole_groups(batches):
            upper = upper or top_levels(*shared.value, LOCAL - 1)
            beside, key, n = Joined(key[~own], one[~own], share[~own]), key[own], n[own]
            logp = log_probability(key, [*upper, beside, *local_levels(key, n)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(logp, pa.float64())], names=["key", "n", "logp"])

    return grouped(listed.unionByName(beside)).mapInArrow(downward, "key long, n long, logp double")


def frequent(table: DataFrame, most: int, *columns: str):
    """At most `most` entries of the table that have the highest n: all whose n reaches a power of two."""
    level = F.length(F.bin("n")) - 1
    sizes = {r["l"]: r["c"] for r in table.where("n > 0").groupBy(level.alias("l")).agg(F.count("*").alias("c")).collect()}  # at most 64 rows
    least = 64
    while least > 0 and sum(c for lev, c in sizes.items() if lev >= least - 1) <= most:
        least -= 1
    found = table.where(F.col("n") >= 2**least).select("key", *columns).toArrow() if least < 63 else None
    if found is None:
        return np.zeros(0, np.int64), *(np.zeros(0) for _ in columns)
    return tuple(found.column(c).to_numpy() for c in ("key", *columns))


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), bits_per_byte.

    Trains on the rows that `held_out` leaves and scores all. Null and empty texts are one end token. Null keys and
    repeated rows are kept, each on its own. Without training rows every token is unknown and every bit costs one bit; an
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    counted = common.saved(counts(rows.withColumn("training", ~F.col("held_out"))), "counts")
    ends = rows.where("not held_out").count()
    word_counts = counted.where(F.col("kind") == WORD)
    total, distinct = word_counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (total or 0) + ends, distinct + (ends > 0)
    sequences = common.saved(model(counted.where(F.col("kind") == SEQUENCE)), "sequences")
    shared = spark.sparkContext.broadcast((frequent(word_counts, MOST_WORDS, "n"), frequent(sequences, MOST_SEQUENCES, "logp")))
    whole = total + 0.5 * (distinct + 1)
    end_score = math.log10((ends + 0.5) / whole)

    def score(batches):
        words = chains = None
        for batch in batches:
            if words is None:
                words, chains = (Lookup(*x) for x in shared.value)
                word_score = np.log10((words.values + 0.5) / whole)
            for start, texts in _parts(batch.column(3), SCORE_BYTES):
                lines = Lines(texts)
                row = batch.column(0).slice(start, len(texts))
                n = len(texts)
                hashed = lines.words()
                at, owner = words.find(hashed), np.repeat(np.arange(n), lines.n_words)
                hit = at >= 0
                known = np.bincount(owner[hit], minlength=n) + (ends > 0)
                base = np.bincount(owner[hit], word_score[at[hit]], n) + end_score
                seq = lines.sequences()
                where, text_of = chains.find(seq), np.repeat(np.arange(n, dtype=np.int32), lines.sizes())
                met = where >= 0
                points = np.bincount(text_of[met], chains.values[where[met]], n)
                out = [(DOCUMENT, np.arange(n), np.zeros(n, np.int64)), (WORD, owner[~hit], hashed[~hit]), (SEQUENCE, text_of[~met], seq[~met])]
                for kind_, of, keys in out:
                    own, none = kind_ == DOCUMENT, pa.nulls(len(of), pa.float64())
                    of = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(of), kind_, np.int8)), row.take(of), pa.array(keys),
                        batch.column(1).slice(start, n) if own else pa.nulls(len(of), batch.schema.field(1).type),
                        batch.column(2).slice(start, n) if own else pa.nulls(len(of), pa.bool_()),
                        pa.array(lines.n_words + 1, pa.int64()) if own else pa.nulls(len(of), pa.int64()),
                        pa.array(known, pa.int64()) if own else pa.nulls(len(of), pa.int64()),
                        pa.array(base, pa.float64()) if own else none, pa.array(points, pa.float64()) if own else none,
                        pa.array(lines.sizes(), pa.int64()) if own else pa.nulls(len(of), pa.int64())],
                        names=["kind", "row", "key", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    passed = common.saved(numbered.mapInArrow(score, f"kind tinyint, row long, key long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"), "scores")
    rest = passed.where(F.col("kind") == WORD).groupBy("row", "key").agg(F.count("*").alias("m"))
    rest = rest.join(word_counts.select(F.col("key").alias("k"), "n"), F.col("key") == F.col("k"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    word_rest = rest.select("row", F.when(F.col("n") > 0, F.col("m")).otherwise(0).alias("n_known"), (F.col("m") * F.log10((F.col("n") + 0.5) / F.lit(whole))).alias("base_score"), F.lit(0.0).alias("score"))
    chain = passed.where(F.col("kind") == SEQUENCE).groupBy("row", "key").agg(F.count("*").alias("m"))
    chain = chain.join(sequences.select(F.col("key").alias("k"), "logp"), F.col("key") == F.col("k"))
    chain_rest = chain.select("row", F.lit(0).alias("n_known"), F.lit(0.0).alias("base_score"), (F.col("m") * F.col("logp")).alias("score"))
    more = word_rest.unionByName(chain_rest).groupBy("row").agg(*[F.sum(c).alias(f"_{c}") for c in ("n_known", "base_score", "score")])
    out = passed.where(F.col("kind") == DOCUMENT).join(more.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    known, base, points = (F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("n_known", "base_score", "score"))
    return out.select(
        F.col("id").alias(key), "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"), points.alias("score"), (-points / math.log10(2.0) / F.col("n_bytes")).alias("bits_per_byte"))
