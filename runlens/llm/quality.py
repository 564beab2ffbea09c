"""Quality rules: counts of words, symbols and repeats within a document, and line frequency across documents.

Only DataFrame functions. A line is normalised (A-Z to lower case, digits to 0, white space to single spaces) and hashed.
A line that stands in more documents of a host than the limit is boilerplate there and is removed; a document that loses
more than `most_lost` of its words is depleted and rejected. Documents vote by their id (`judged`, the contract of the
query's SQL) or by their normalised text (`cleaned`), so that copies of a text are one vote.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import common

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words, and per cent of words in repeated windows
#: A line is above the limit if more documents of its host hold it than LEAST_DOCS and than this share of the host's.
LEAST_DOCS, SHARE, MOST_LOST = 20, 0.01, 0.5

_plain_from = string.ascii_uppercase + string.digits + common.SEPARATORS[1:]
_plain_to = string.ascii_lowercase + "0" * 10 + " " * (len(common.SEPARATORS) - 1)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _plain_from, _plain_to), "  +", " "))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    filled = F.filter(lines(text), lambda x: F.translate(x, common.SEPARATORS, "") != "")
    return bound(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words that stand in a window of `width` words that occurs twice or more, each word counted once.

    Windows are hashed. If all differ, nothing repeats; else hashes are sorted with their positions, equal neighbours give
    the positions of repeated windows, and each position adds the words that the one before it doesn't cover.
    """
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, other: F.coalesce(x["h"] == F.get(s, other)["h"], F.lit(False))
            return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

        at = F.sort_array(F.transform(bound(placed, repeats), lambda x: x["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    def windows(w: Column) -> Column:
        last = F.size(w) - width + 1
        hashed = F.transform(F.slice(w, F.lit(1), F.greatest(last, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        return bound(hashed, counted)

    return bound(tokens, windows).cast("long")


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = common.words(body)
    counts = bound(tokens, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    out = docs.select(*keep, body.alias("_body"), counts.alias("_counts"))
    body = F.col("_body")
    out = out.select(
        *keep, F.col("_counts.n").alias("n_words"), F.length(F.translate(body, common.SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(body).alias("n_dup_lines"), F.col("_counts.repeated").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _identity(key: str, host: str, text: str) -> Column:
    """The same for equal rows, which get the same verdict."""
    return F.xxhash64(F.col(key).isNull(), F.col(key), F.col(host).isNull(), F.col(host), F.col(text).isNull(), F.col(text))


def _line_rows(text: Column) -> Column:
    """Hash and words of each line that has a word."""
    rows = F.transform(lines(text), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(common.words(x)).alias("words")))
    return F.filter(rows, lambda x: x["words"] > 0)


def frequent_lines(rows: DataFrame, host: str, least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """host, line, _wide: lines in more than `least_docs` documents of a host, and whether they are above its share too.
    `rows` has the host, _doc (the hash of what has one vote) and lines."""
    docs = rows.groupBy(host).agg(F.count_distinct("_doc").alias("_docs"))
    each = rows.select(host, "_doc", F.explode("lines").alias("x")).select(host, "_doc", "x.line")
    held = each.groupBy(host, "line").agg(F.count_distinct("_doc").alias("_held")).where(F.col("_held") > least_docs)
    docs = docs.withColumnRenamed(host, "_host")
    return held.join(docs, F.col(host).eqNullSafe(F.col("_host"))).select("_host", "line", (F.col("_held") > share * F.col("_docs")).alias("_wide"))


def judged(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", most_lost: float = MOST_LOST, per_text: bool = False, any_size: bool = False, **limits) -> DataFrame:
    """Key, host, the features, removed_words, kept, and identity with removed (hashes of the lines to remove), of every row.

    Null and empty texts have no words and fail. A null host is a host of its own, a null key one document of its own;
    repeated rows count as one document and are all returned. With `per_text`, documents whose lines are the same after
    normalising count as one, whatever their keys, for lines as for the host's number of documents. With `any_size`, a line
    in more than `least_docs` documents is removed however large the host is, but only lines above the share too can make a
    document depleted: one that would be by the others (a group of near copies in a large host) keeps those. The features and line hashes of a document are written to
    the shared folder once; texts are read once. An empty table gives an empty result.
    """
    base = features(docs.withColumn("_identity", _identity(key, host, text)).withColumn("lines", _line_rows(F.col(text).cast("string"))),
                    [key, host, "_identity", "lines"], text)
    vote = F.xxhash64("lines.line") if per_text else F.xxhash64(F.col(key).isNull(), F.col(key))
    base = base.withColumn("_doc", vote).withColumn("_row", F.monotonically_increasing_id())
    base = common.saved(base, "features")
    frequent = frequent_lines(base, host, **limits)
    frequent = frequent if any_size else frequent.where("_wide")
    each = base.select("_row", F.col(host).alias("_h"), F.explode("lines").alias("x")).select("_row", "_h", F.col("x.line").alias("_line"), "x.words")
    hits = each.join(frequent, F.col("_h").eqNullSafe(F.col("_host")) & (F.col("_line") == F.col("line")))
    wide = lambda x: F.when(F.col("_wide"), F.col(x))
    lost = hits.groupBy("_row").agg(
        F.sum("words").alias("_lost"), F.collect_set("line").alias("_lines"), F.sum(wide("words")).alias("_wide_lost"), F.collect_set(wide("line")).alias("_wide_lines"))
    out = base.join(lost.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left")
    every = F.col("_lost") <= most_lost * F.col("n_words")
    out = out.withColumn("removed", F.when(every, F.col("_lines")).otherwise(F.col("_wide_lines")))
    out = out.withColumn("removed_words", F.coalesce(F.when(every, F.col("_lost")).otherwise(F.col("_wide_lost")), F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("removed_words") <= most_lost * F.col("n_words"))
    return out.withColumn("kept", kept).select(
        key, host, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words",
        F.col("_identity").alias("identity"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def cleaned(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows that are kept, all columns, without the lines above the limit, whatever the host's size. Copies of a text are one vote."""
    own, same, gone = common.free_names(docs, "own", "same", "gone")
    verdict = judged(docs, key, host, text, per_text=True, any_size=True, **limits).where("kept").dropDuplicates(["identity"])
    verdict = verdict.select(F.col("identity").alias(same), F.col("removed").alias(gone))
    rows = docs.withColumn(own, _identity(key, host, text)).join(verdict, F.col(own) == F.col(same))
    left = F.filter(lines(F.col(text)), lambda x: ~F.array_contains(F.col(gone), F.xxhash64(normalised(x))) | (F.size(common.words(x)) == 0))
    return rows.withColumn(text, F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(F.col(text))).select(*docs.columns)
