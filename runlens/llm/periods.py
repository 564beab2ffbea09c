"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q and a length of at least 3 q (and of at least `least` words).
Periods under BASE are found by comparing the text with itself shifted by each of them. The others belong to dyadic
scales: scale t looks for periods in [t, 2t), with windows of t words and a reach of t/2.

A window is periodic if it has a period of at most t/3; such windows lie in runs of smaller scales, which are known by
then. Position i is in the synchronising set if, of all windows that start in [i, i + t/2] and are not periodic, the one
at i or at i + t/2 has the least hash. That depends on the words of [i, i + 3t/2), the position's context, alone. Let a
run have period p in [t, 2t) and start at s. Its first 2p words are not periodic as a whole, so one of its positions
whose context also fits one period later is in the set, and so is the position p further on: equal contexts at distance
p propose p. A context holds a window that is not periodic, so equal contexts are more than t/3 apart and a position has
at most five partners within 2t: nothing is capped. Proposals are extended word by word, so hashes decide speed only.

All texts of a batch are handled as one array of word numbers, with a number of its own after each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common

BASE = 16  # the first scale; smaller periods are compared directly
BATCH_BYTES = 4 << 20
_COMPARED = 1 << 19  # words that an extension looks at in one step
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))  # odd multipliers
_NONE = np.uint64(2**64 - 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _A
        x ^= x >> np.uint64(32)
        x += b
        x *= _B
        x ^= x >> np.uint64(29)
        x *= _C
        x ^= x >> np.uint64(32)
    return x


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def _reach(text: np.ndarray, at: np.ndarray, shift: np.ndarray, step: int) -> np.ndarray:
    """How many words from each position on, in the direction of `step`, equal those `shift` words further right."""
    out, todo = np.zeros(len(at), np.int64), np.arange(len(at))
    width = 16
    while len(todo):
        width = int(min(width * 4, max(16, _COMPARED // len(todo))))
        going = []
        for part in np.array_split(todo, -(-len(todo) * width // (2 * _COMPARED))):
            x = (at[part] + step * out[part])[:, None] + step * np.arange(width)
            y = x + shift[part][:, None]
            inside = (x >= 0) & (y < len(text))
            same = inside & (text[np.where(inside, x, 0)] == text[np.where(inside, y, 0)])
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[part] += n
            going.append(part[n == width])
        todo = np.concatenate(going)
    return out


def _extended(text: np.ndarray, owner: np.ndarray, at: np.ndarray, period: np.ndarray) -> list[np.ndarray]:
    """The maximal stretches with the proposed periods: starts, ends, periods; those of three periods at least.

    Proposals of one text and period are taken from the left; those inside a stretch that was found need no look.
    """
    order = np.lexsort((at, period, owner))
    owner, at, period = owner[order], at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (period[1:] != period[:-1])
    group = np.cumsum(new) - 1
    place = group * (len(text) + 1) + at
    now, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at))
    found = []
    while len(now):
        i, p = at[now], period[now]
        start = i - _reach(text, i - 1, p, -1)
        end = i + _reach(text, i, p, 1) + p
        long = end - start >= 3 * p
        found.append(np.stack([start[long], end[long], p[long]]))
        now = np.maximum(now + 1, np.searchsorted(place, group[now] * (len(text) + 1) + end - p))
        left = now < last
        now, last = now[left], last[left]
    return list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * 3


def runs_in(text: np.ndarray, first: np.ndarray, n_words: np.ndarray, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start and period. Texts lie at first[k] .. first[k] + n_words[k] and a number
    that occurs once stands after each."""
    found = []
    for q in range(1, min(BASE, int(n_words.max(initial=0)) // 3 + 1)):
        a, b = _stretches(text[q:] == text[:-q])
        long = b - a + q >= max(BASE, 3 * q)
        found.append(np.stack([a[long], b[long] + q, np.full(int(long.sum()), q)]))
    # The part that scales still look at: texts of three windows at least, where they came from, and window hashes.
    part, origin = text, np.arange(len(text))
    window = _mixed(text.view(np.uint64), np.full(len(text), _B))
    have, scale = 1, BASE
    while len(n_words) and 3 * scale <= n_words.max():
        while have < scale:
            window = _mixed(window, np.append(window[have:], np.zeros(min(have, len(window)), np.uint64)))
            have *= 2
        large = n_words >= 3 * scale
        if n_words[large].sum() + large.sum() < 0.7 * len(part):
            kept = _covered(first[large], first[large] + n_words[large] + 1, len(text))[origin]
            part, origin, window = part[kept], origin[kept], window[kept]
        size, reach = len(part), scale // 2
        own = window.copy()
        smaller = [f for f in found if f.shape[1]]
        if smaller:
            a, b, q = np.concatenate(smaller, axis=1)
            periodic = (3 * q <= scale) & (b - a >= scale)
            own[_covered(a[periodic], b[periodic] - scale + 1, len(text))[origin]] = _NONE
        low, step = own.copy(), 1
        while step < reach:
            low[:-step] = np.minimum(low[:-step], low[step:])
            step *= 2
        usable = size - scale - reach + 1  # positions with a whole context
        low = np.minimum(low[:usable], low[1 : usable + 1])
        chosen = np.flatnonzero((low != _NONE) & ((own[:usable] == low) | (own[reach : reach + usable] == low)))
        context = _mixed(window[chosen], window[chosen + reach])
        order = np.argsort(context, kind="stable")
        context, chosen = context[order], chosen[order]
        at, period = [], []
        for k in range(1, 6):
            gap = chosen[k:] - chosen[:-k]
            near = (context[k:] == context[:-k]) & (gap >= scale) & (gap < 2 * scale)
            at.append(chosen[:-k][near])
            period.append(gap[near])
        at, period = origin[np.concatenate(at)], np.concatenate(period)
        # Kept texts stay whole, so distances are those of the text itself, unless the two lie in different texts.
        owner = np.searchsorted(first, at, side="right") - 1
        same = at + period < first[owner] + n_words[owner]
        found.append(np.stack(_extended(text, owner[same], at[same], period[same])))
        scale *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, q = np.concatenate(found, axis=1)
    long = b - a >= least
    a, b, q = a[long], b[long], q[long]
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    smallest = np.ones(len(a), bool)  # a stretch with a smaller period is the run of that period
    smallest[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, q = a[smallest], b[smallest], q[smallest]
    order = np.lexsort((q, a))
    return a[order], b[order], q[order]


class Words:
    """The words of a batch of texts as numbers, equal exactly if the words are."""

    def __init__(self, texts: pa.Array):
        raw, offsets = common.bytes_of(texts)
        self.starts, ends = common.word_bounds(raw, offsets)
        self.length = ends - self.starts
        self.n = common.per_text(self.starts, offsets)
        self.raw = np.append(raw, np.uint8(32))
        bounds = np.concatenate([[0], np.cumsum(self.length)])
        plain = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[common._is_word_byte[raw]])])
        numbers = pc.dictionary_encode(plain).indices.to_numpy().astype(np.int64)
        self.before = np.cumsum(self.n) - self.n  # words of earlier texts
        self.first = self.before + np.arange(len(self.n))
        self.text = np.empty(len(numbers) + len(self.n), np.int64)
        self.slot = np.arange(len(numbers)) + np.repeat(np.arange(len(self.n)), self.n)
        self.text[self.slot] = numbers
        self.text[self.first + self.n] = -1 - np.arange(len(self.n))

    def joined(self, which: np.ndarray, count: np.ndarray) -> pa.Array:
        """One text for each row: the next count[k] of the listed words, joined by one space."""
        size = self.length[which] + 1
        upto = np.concatenate([[0], np.cumsum(size)])
        out = self.raw[np.minimum(np.repeat(self.starts[which] - upto[:-1], size) + np.arange(upto[-1]), len(self.raw) - 1)]
        out[upto[1:] - 1] = 32
        texts = upto[np.concatenate([[0], np.cumsum(count)])]
        keep = np.ones(len(out), bool)
        filled = np.diff(texts) > 0
        keep[texts[1:][filled] - 1] = False  # no space after the last word
        bounds = np.concatenate([[0], np.cumsum(np.diff(texts) - filled)])
        return pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(bounds), pa.py_buffer(out[keep])])


def parts(texts: pa.Array):
    """First row and texts of about BATCH_BYTES each; a text is never cut."""
    texts = texts.fill_null("") if texts.null_count else texts
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BATCH_BYTES, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def found_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24) -> DataFrame:
    """One row per row of `docs`: key, runs (start, length and period of each run, by start, then period) and collapsed (the
    words joined by one space, without those that a run holds after its first period).

    Null and empty texts have no words, no run and an empty collapsed text. Null keys and repeated rows are kept, each on
    its own; other columns are not read, whatever their names; an empty table gives an empty result. Nothing is shuffled. A text is
    held whole by one task, by estimate 150 bytes a word, also a very long one.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches):
        for batch in batches:
            for row, texts in parts(batch.column(1)):
                words = Words(texts)
                a, b, q = runs_in(words.text, words.first, words.n, least)
                owner = np.searchsorted(words.first, a, side="right") - 1
                each = pa.StructArray.from_arrays([pa.array(x) for x in (a - words.first[owner], b - a, q)], fields=list(fields))
                per_text = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
                kept = np.flatnonzero(~_covered(a + q, b, len(words.text))[words.slot])
                count = np.diff(np.searchsorted(kept, np.append(words.before, len(words.slot))))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(texts)), pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), each),
                    words.joined(kept, count).cast(pa.string())], names=[key, "runs", "collapsed"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(find, f"`{key}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def looped(docs: DataFrame, number: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, where each word from a on repeats the p words that start at a: a = g mod n and
    p = 1 + floor((n - a) / (3 + g mod 8)) for n words and the row's number g. Null and empty texts become empty."""
    kind = docs.schema[key].dataType.simpleString()

    def loop(batches):
        for batch in batches:
            g = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, texts in parts(batch.column(1)):
                words = Words(texts)
                of = np.repeat(np.arange(len(texts)), words.n)
                own = g[row : row + len(texts)]
                a = own % np.maximum(words.n, 1)
                p = 1 + (words.n - a) // (3 + own % 8)
                i = np.arange(len(of)) - words.before[of]
                source = np.where(i >= a[of], a[of] + (i - a[of]) % p[of], i) + words.before[of]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), words.joined(source, words.n).cast(pa.string())], names=[key, text])

    return docs.select(F.col(key), F.col(text).cast("string"), F.col(number)).mapInArrow(loop, f"`{key}` {kind}, `{text}` string")
