"""Token ids and counts of whole texts with a byte-level BPE vocabulary, in Arrow batches.

A single space between two characters that are no white space is a safe boundary: the pre-tokenizer always cuts before
it, so the ids of a text are the ids of its pieces in order. Each batch holds about equally many bytes; a longer text
is cut at safe boundaries and its parts go to several batches. Equal pieces of a batch are encoded once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded together, and pieces whose ids a worker keeps.
BATCH_BYTES = 24 << 20
KEPT_PIECES = 250_000

FIRST = "\x01"  # marks the first piece of a text, which has no space before it
SPECIAL = "<|endoftext|>"  # the library reads it as one token
_ODD = "[ \n][ \n]|[^!-~ \nÀ-ɏ]|<\\|endoftext\\|>"
_PLAIN = "^[\x01\n]?[!-~À-ɏ]+$"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of pieces. Plain pieces of Latin script go through the rank file in one call, all others through the library."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.spaced = np.zeros(1 << 16, dtype=bool)
        self.spaced[[i for b, i in table.items() if b[:1] == b" "]] = True
        self.line_feed = table[b"\n"]
        self.kept: tuple | None = None  # pieces with their ids, of the first batch

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool of ids, and where each piece's ids start in it and how many they are.

        Words after a space are joined by spaces, each word's first id then holds the space; words at the start of a line
        are joined by line feeds, whose id then stands between them.
        """
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        plain &= ~pc.match_substring(pieces, SPECIAL).to_numpy(zero_copy_only=False)
        opening = pc.starts_with(pieces, FIRST).to_numpy(zero_copy_only=False)
        head = opening | pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        first, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        pool, used = [], 0
        for kind, mark in ((plain & ~head, " "), (plain & head, "\n"), (~plain, None)):
            at = np.flatnonzero(kind)
            if not len(at):
                continue
            own = pieces.take(pa.array(at))
            if mark is None:
                found = [e.ids for e in self.library.encode_batch([_raw(p) for p in own.to_pylist()], add_special_tokens=False)]
                ids, n = np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)
                starts = np.cumsum(n) - n
            else:
                own = own if mark == " " else pc.utf8_slice_codeunits(own, 1)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), mark)[0].as_py()
                ids = np.array(self.plain.encode_ordinary(mark + joined), dtype=np.uint32)
                starts = np.flatnonzero(self.spaced[ids] if mark == " " else ids == self.line_feed)
                n = np.diff(starts, append=len(ids))
                if mark == "\n":  # the first piece of a text has no line feed of its own
                    starts, n = starts + opening[at], n - opening[at]
            first[at], length[at] = starts + used, n
            pool.append(ids)
            used += len(ids)
        return np.concatenate(pool) if pool else np.zeros(0, np.uint32), first, length

    def _table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.kept is None:
            found = self._new(pieces)
            n = min(len(pieces), KEPT_PIECES)
            size = int((found[1] + found[2]).max(initial=0))
            self.kept = (pa.concat_arrays([pieces.slice(0, n)]), found[0][:size], found[1][:n], found[2][:n])
            return found
        kept, pool, first, length = self.kept
        at = pc.index_in(pieces, value_set=kept)
        is_new = pc.is_null(at).to_numpy(zero_copy_only=False)
        own_pool, own_first, own_length = self._new(pieces.filter(pa.array(is_new)))
        old = at.drop_null().to_numpy()
        firsts, lengths = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        firsts[is_new], lengths[is_new] = own_first + len(pool), own_length
        firsts[~is_new], lengths[~is_new] = first[old], length[old]
        return np.concatenate([pool, own_pool]), firsts, lengths

    def encode(self, texts: pa.Array) -> tuple:
        """For texts without nulls: the row of each listed text, where each listed text's pieces end; for each piece where
        its ids start in the pool and how many they are; the pool."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        rows = [np.flatnonzero(~odd), np.flatnonzero(odd)]
        even = texts if not len(rows[1]) else texts.take(pa.array(rows[0]))
        even = pc.binary_join_element_wise(FIRST, pc.replace_substring(even, "\n", " \n"), "")
        lists = [pc.split_pattern(even, " ")]
        if len(rows[1]):
            lists.append(pa.array([_pieces(x) for x in texts.take(pa.array(rows[1])).to_pylist()], pa.list_(pa.string())))
        lists = pa.concat_arrays(lists)
        coded = lists.flatten().dictionary_encode()
        pool, first, length = self._table(coded.dictionary)
        slots = coded.indices.to_numpy()
        return np.concatenate(rows), np.cumsum(lists.value_lengths().to_numpy()), first[slots], length[slots], pool


def _raw(piece: str) -> str:
    return piece[1:] if piece[:1] == FIRST else piece if piece[:1] == "\n" else " " + piece


def _pieces(text: str) -> list[str]:
    first, *others = _SAFE.split(text)
    return [FIRST + first, *(f"{FIRST} {p}" if p[0] == FIRST else p for p in others)]


@cache
def encoder(vocabulary: str, ranks: str) -> Encoder:
    return Encoder(vocabulary, ranks)


def balanced(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows and texts of about BATCH_BYTES each. A longer text is cut at safe boundaries; each part stands alone."""
    texts = texts.fill_null("") if texts.null_count else texts
    sizes = pc.binary_length(texts).to_numpy()
    start = 0
    while start < len(texts):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), BATCH_BYTES, side="right")))
        if sizes[start] > BATCH_BYTES:
            text, at = texts[start].as_py(), 0
            while at < len(text):
                cut = _SAFE.search(text, at + BATCH_BYTES // 4)
                end = cut.start() if cut else len(text)
                yield np.array([start]), pa.array([text[at:end]], pa.string())
                at = end
        else:
            yield np.arange(start, stop), texts.slice(start, stop - start)
        start = stop


def counts_of(texts: pa.Array, vocabulary: str, ranks: str) -> np.ndarray:
    """Tokens of each text; null is empty."""
    enc, out = encoder(vocabulary, ranks), np.zeros(len(texts), dtype=np.int64)
    for rows, part in balanced(texts):
        at, ends, _, n, _ = enc.encode(part)
        sums = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])]
        np.add.at(out, rows[at], np.diff(sums))
    return out


def ids_of(texts: pa.Array, vocabulary: str, ranks: str) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ids (unsigned 32 bits) of each text; a text that spans batches is put together again."""
    enc, held = encoder(vocabulary, ranks), (-1, [])
    for rows, part in balanced(texts):
        at, ends, first, n, pool = enc.encode(part)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[np.concatenate([[0], ends])]
        for i, row in enumerate(rows[at]):
            if row != held[0]:
                if held[1]:
                    yield held[0], np.concatenate(held[1])
                held = (int(row), [])
            held[1].append(ids[cuts[i] : cuts[i + 1]])
            if len(rows) > 1:
                yield held[0], held[1][0]
                held = (-1, [])
    if held[1]:
        yield held[0], np.concatenate(held[1])


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024,
                 vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per row of `docs`: key, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts count 0 bytes and 0 tokens; null keys and repeated rows are kept as they are; other columns are
    not read. Only lengths leave the Arrow function. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        for batch in batches:
            n = counts_of(batch.column(1), vocabulary, ranks)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
