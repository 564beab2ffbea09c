"""Quality classifier from positive and unlabelled texts: non-negative unbiased risk with an estimated class prior.

Trusted positives and the unlabelled corpus (a mixture of both classes) are all it learns from. With a share p of positives
in the corpus, the risk of a score g is p E_pos[l(g)] + max(0, E_all[l(-g)] - p E_pos[l(-g)]): the second part estimates the
risk on negatives, which cannot be below zero. l is the logistic loss and g linear in what is measured of a text, so
sigmoid(g) is the probability of a positive.

p comes from a first fit of positives against the whole corpus: above any threshold the corpus holds at least p times the
share of the positives, so the least ratio of the two shares, with a margin for the size of both samples, bounds p, and
reaches it where hardly any negative scores high.

Texts are measured once, in Arrow batches, and written. Every step of the fit sums losses, gradients and second derivatives
over all rows, training texts without a bound; what reaches the driver are the sums, about 2 (k + 1)^2 numbers for k measures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import common, periods

RIDGE = 1e-3  # weight of the squared coefficients in the risk
MOST_STEPS = 25  # of one fit; it ends before when the risk stops falling
BINS = 512  # of the scores from which the prior is read
#: Bytes by kind: letters, digits, white space, marks, symbols, and what is left.
_KINDS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " ", "line": "\n",
          "end": ".", "call": "!?", "pause": ",;:", "quote": "'\"()-", "symbol": "#*$%&|<>", "rare": "=+/\\_~^@[]{}`"}
_NAMES = [*_KINDS, "other", "control", "wide"]
_kind = np.full(256, _NAMES.index("other"), np.uint8)
_kind[:32] = _NAMES.index("control")
_kind[128:] = _NAMES.index("wide")
for _i, _chars in enumerate(_KINDS.values()):
    _kind[[ord(c) for c in _chars]] = _i
MEASURES = [f"share_{n}" for n in _NAMES] + [
    "words", "word_length", "length_spread", "long_words", "capital_words", "marked_words", "bare_words", "short_lines", "line_words",
    "repeated_words", "distinct_words", "commonest_word", "distinct_pairs", "fewest_pairs"]


def measured(texts: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text, shares as square roots; all zero for texts without bytes."""
    raw, offsets = common.bytes_of(texts)
    n, size = len(texts), np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = _kind[raw]
    share = np.bincount(owner * len(_NAMES) + kinds, minlength=n * len(_NAMES)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    words = periods.Words(texts)
    count, start, length = words.n, words.starts, words.length
    of = np.repeat(np.arange(n), count)
    least = np.maximum(count, 1)
    per = lambda x: np.bincount(of, x, n) / least

    def inside(name: str) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kinds == _NAMES.index(name))])
        return upto[start + length] - upto[start]

    lower, upper, wide, mark = (inside(x) for x in ("lower", "upper", "wide", "symbol"))
    mean = per(length)
    lines = share[:, _NAMES.index("line")] * size + (count > 0)
    line = np.concatenate([[0], np.cumsum(raw == 10)])[start]  # the line each word stands in
    opens = np.ones(len(start), bool)
    opens[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    in_line = np.diff(np.flatnonzero(np.append(opens, True)))
    short = np.bincount(of[opens], in_line <= 3, n) / np.maximum(np.bincount(of[opens], minlength=n), 1)
    number = words.text[words.slot]
    before = np.empty(len(number), np.int64)
    before[:1], before[1:] = -1, number[:-1]
    follows = np.ones(len(number), bool)
    follows[:1] = False
    follows[1:] = of[1:] == of[:-1]
    again = per(follows & (number == before))

    def distinct(code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values each text has, and how often its commonest."""
        order = np.lexsort((code, rows))
        code, rows = code[order], rows[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])
        most = np.zeros(n, np.int64)
        np.maximum.at(most, rows[first], np.diff(np.flatnonzero(np.append(first, True))))
        return np.bincount(rows[first], minlength=n), most

    values, most = distinct(number, of)
    pair_of = of[follows]
    pairs, _ = distinct(before[follows] * (int(number.max(initial=0)) + 1) + number[follows], pair_of)
    n_pairs = np.maximum(np.bincount(pair_of, minlength=n), 1)
    few = np.where(count > 0, values / least, 0)
    rare = np.where(count > 1, pairs / n_pairs, count > 0)
    out = np.stack([
        np.log1p(count), mean, np.sqrt(np.maximum(per(length.astype(float) ** 2) - mean**2, 0)), np.sqrt(per(length > 15)),
        np.sqrt(per((upper > 1) & (lower == 0))), np.sqrt(per(mark > 0)), np.sqrt(per((lower + upper + wide) == 0)), np.sqrt(short),
        np.log1p(count / np.maximum(lines, 1)), np.sqrt(again), few, np.sqrt(most / least), rare, np.sqrt((count > 0) - rare)], axis=1)
    return np.concatenate([np.sqrt(share), out], axis=1)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of `docs`, and x: the measures of its text in double precision."""
    keep = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def measure(batches):
        for batch in batches:
            for row, part in periods.parts(batch.column(batch.num_columns - 1)):
                x = measured(part)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(part)) for c in batch.columns[:-1]), flat], names=[*keep, "x"])

    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(measure, f"{kinds}, x array<double>")


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Sums:
    """What a step needs of one class: rows, losses of g and -g, sums of x, of sigmoid(g) x, and of the second derivatives."""

    def __init__(self, flat: np.ndarray, k: int):
        self.n = max(flat[0], 1e-300)
        self.against, self.towards = flat[1:3] / self.n  # mean loss if the row were negative, positive
        self.x, self.pull = flat[3 : 3 + k] / self.n, flat[3 + k : 3 + 2 * k] / self.n
        self.bend = flat[3 + 2 * k :].reshape(k, k) / self.n

    @staticmethod
    def of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        g = x @ w
        s = _sigmoid(g)
        return np.concatenate([[len(x), _softplus(g).sum(), _softplus(-g).sum()], x.sum(axis=0), s @ x, ((s * (1 - s))[:, None] * x).T @ x if len(x) else np.zeros(x.shape[1] ** 2).reshape(x.shape[1], -1)], axis=None)


def _rows(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, k)


def summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum over all rows of the vector that work(batch) gives; parts are added up by Spark."""
    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    out = np.zeros(size)
    for row in rows.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # at most `size` rows
        out[row["at"]] = row["v"]
    return out


def sums(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[Sums, Sums]:
    """Of the positives and of all rows; x is centred and scaled, with a one in front."""
    k = len(w)

    def work(batch):
        x = np.concatenate([np.ones((batch.num_rows, 1)), (_rows(batch, 1, k - 1) - shift) / scale], axis=1)
        return np.concatenate([Sums.of(x[batch.column(0).to_numpy(zero_copy_only=False)], w), Sums.of(x, w)])

    flat = summed(rows.select("positive", "x"), work, 2 * (3 + 2 * k + k * k))
    return Sums(flat[: len(flat) // 2], k), Sums(flat[len(flat) // 2 :], k)


def _risk(pos: Sums, all_: Sums, w: np.ndarray, prior: float | None):
    """Risk, its gradient and second derivatives. Without a prior: of telling positives from the corpus."""
    ridge = RIDGE * np.append(0.0, np.ones(len(w) - 1))
    if prior is None:
        value, slope, bend = pos.towards + all_.against, pos.pull - pos.x + all_.pull, pos.bend + all_.bend
    else:
        value, slope, bend = prior * pos.towards, prior * (pos.pull - pos.x), prior * pos.bend
        negative = all_.against - prior * pos.against
        if negative > 0:  # otherwise the estimate counts as zero
            value, slope, bend = value + negative, slope + all_.pull - prior * pos.pull, all_.bend
    return value + (ridge * w * w).sum() / 2, slope + ridge * w, bend + np.diag(ridge + 1e-9)


def fit(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, prior: float | None, w: np.ndarray) -> np.ndarray:
    """Newton steps over all rows, halved when the risk does not fall."""
    best, best_w, step, reach = np.inf, w, None, 1.0
    for _ in range(MOST_STEPS):
        value, slope, bend = _risk(*sums(rows, shift, scale, w), w, prior)
        if value < best:
            done, best, best_w = best - value < 1e-6 * max(1.0, value), value, w
            if done:
                break
            step, reach = np.linalg.solve(bend, slope), 1.0
        else:
            reach /= 4
            if reach < 1e-3:
                break
        w = best_w - reach * step
    return best_w


def estimated_prior(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    """The least ratio, over thresholds, of the corpus's share above to the positives' share above, with a margin of sampling."""
    def work(batch):
        x = np.concatenate([np.ones((batch.num_rows, 1)), (_rows(batch, 1, len(w) - 1) - shift) / scale], axis=1)
        place = np.minimum((_sigmoid(x @ w) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(place[batch.column(0).to_numpy(zero_copy_only=False)], minlength=BINS), np.bincount(place, minlength=BINS)])

    pos, all_ = summed(rows.select("positive", "x"), work, 2 * BINS).reshape(2, BINS)
    pos, all_ = (x[::-1].cumsum() for x in (pos, all_))
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(max(pos[-1], 1)) + 1 / np.sqrt(max(all_[-1], 1)))
    above, in_corpus = pos / max(pos[-1], 1), all_ / max(all_[-1], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(above > 0, (in_corpus + margin) / above, np.inf)
        ratio = np.where(above > 0, in_corpus / above, np.inf)
    return float(np.clip(ratio[int(bound.argmin())], 0.01, 0.99))


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
           prior: float | None = None, least: float = 0.7) -> DataFrame:
    """One row per row of `docs`: key, held_out, score (0 to 1, the probability of a positive), predicted (1 if score >= least).

    Learns from the rows that `held_out` leaves: those whose key has only labels 1 are trusted positives, all of them are the
    unlabelled corpus; labels of other rows and labels 0 are not used. `prior` is estimated if not given. Null and empty
    texts measure zero and are scored like any other; null keys have no label; repeated rows count as often as they stand;
    without positives every score is 0.5 and an empty table gives an empty result. Only key and text are read.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    found = common.saved(measures(rows), "measures")
    trusted = labels.groupBy(F.col(key).alias("k")).agg((F.min(label) == 1).alias("trusted"))
    training = found.where(~F.col("held_out")).join(trusted.where("trusted"), F.col("id") == F.col("k"), "left")
    training = common.saved(training.select(F.col("trusted").isNotNull().alias("positive"), "x"), "training")
    k = len(MEASURES)
    total = summed(training, lambda b: np.concatenate([[b.num_rows, b.column(0).true_count], (x := _rows(b, 1, k)).sum(axis=0), (x * x).sum(axis=0)]), 2 + 2 * k)
    n, positives = total[:2]
    shift = total[2 : 2 + k] / max(n, 1)
    spread = np.sqrt(np.maximum(total[2 + k :] / max(n, 1) - shift**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    w = np.zeros(k + 1)
    if positives:
        if prior is None:
            prior = estimated_prior(training, shift, scale, fit(training, shift, scale, None, w))
        w = fit(training, shift, scale, prior, np.append(np.log(prior / (1 - prior)), np.zeros(k)))
    kind = docs.schema[key].dataType.simpleString()

    def score(batches):
        for batch in batches:
            s = _sigmoid(w[0] + (_rows(batch, 2, k) - shift) / scale @ w[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= least).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return found.select("id", "held_out", "x").mapInArrow(score, f"`{key}` {kind}, held_out boolean, score double, predicted int")
