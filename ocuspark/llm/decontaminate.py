"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window. Winnowing keeps, of each `window - gram + 1`
consecutive `gram`-word hashes, the smallest: any span of `window` shared words
shares a kept hash. Kept hashes of documents are joined with those of the
benchmark, and each hit is extended: the whole windows around it are looked up
by the hash of all their words. For an item shorter than a window, every run of
so many words is a fingerprint, so the guarantee holds for it as well.

The benchmark side is small by nature, but its size is checked: it is cut into
blocks of at most `block_words` words (a longer item is cut, into pieces that
overlap by a window less a word), and documents pass all blocks one after
another, so no shuffle is needed and no more than a block is in a worker's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .job import beside, cut, ship

WINDOW, GRAM = 13, 6
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Fingerprints:
    """Windows of a block of items: kept hashes, hashes of whole windows, and whose they are."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, gram: int) -> None:
        self.window, self.gram, self.ids = window, gram, ids
        data, offsets = K.text_bytes(pa.array(texts, type=pa.string()))
        words = K.Words(data, offsets, K.ALNUM, fold=True)
        at, hashes = words.windows(window)
        owners = words.doc[at]
        self.kept = np.unique(_winnow(words, window, gram)[1])
        self.full = _index(hashes, owners)
        self.short: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(words.per_doc[(words.per_doc > 0) & (words.per_doc < window)]).tolist():
            items = np.flatnonzero(words.per_doc == n)
            at, hashes = words.windows(n)
            mine = np.isin(words.doc[at], items)
            self.short[n] = _index(hashes[mine], words.doc[at][mine])

    def hits(self, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each occurrence of a window: first word, number of words; and pairs of document and item."""
        starts, sizes, docs, items = [], [], [], []

        def look_up(at: np.ndarray, hashes: np.ndarray, n: int, index: tuple[np.ndarray, ...]) -> None:
            distinct, first, count, owners = index
            slot = np.searchsorted(distinct, hashes)
            ok = slot < len(distinct)
            ok[ok] = distinct[slot[ok]] == hashes[ok]
            at, slot = at[ok], slot[ok]
            starts.append(at)
            sizes.append(np.full(len(at), n))
            pairs = np.unique(np.stack([words.doc[at], slot], axis=1), axis=0) if len(at) else np.empty((0, 2), dtype=np.int64)
            times = count[pairs[:, 1]]
            docs.append(np.repeat(pairs[:, 0], times))
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            items.append(owners[np.repeat(first[pairs[:, 1]], times) + within])

        if len(self.kept):
            at, kept, first, last = _winnow(words, self.window, self.gram)
            slot = np.minimum(np.searchsorted(self.kept, kept), len(self.kept) - 1)
            hit = self.kept[slot] == kept
            if hit.any():
                first, last = first[hit], last[hit]
                times = last - first + 1
                around = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                spread = np.unique(around[:, None] + np.arange(self.window))  # only words near hits are hashed again
                part = np.zeros(len(words) + 1, dtype=np.int64)
                part[spread] = np.arange(len(spread))
                hashes = K.rolling(words.hash[spread], self.window)
                look_up(around, hashes[part[around]], self.window, self.full)
        for n, index in self.short.items():
            look_up(*words.windows(n), n, index)
        if not starts:
            none = np.empty(0, dtype=np.int64)
            return none, none, none, none
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(docs), np.concatenate(items)


def _index(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes, and for each its first place in, and number of, owners."""
    pairs = np.unique(np.stack([hashes, owners.astype(np.uint64)], axis=1), axis=0) if len(hashes) else np.empty((0, 2), dtype=np.uint64)
    distinct, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    return distinct, first, count, pairs[:, 1].astype(np.int64)


def _winnow(words: K.Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Place and hash of each kept gram, and the first and last window that keep it."""
    w = window - gram + 1
    grams = K.rolling(words.hash, gram)
    chosen = K.minimizers(grams, w)
    ok = np.flatnonzero(words.doc[: len(chosen)] == words.doc[window - 1 : window - 1 + len(chosen)])
    chosen = chosen[ok]
    if not len(ok):
        none = np.empty(0, dtype=np.int64)
        return none, np.empty(0, dtype=np.uint64), none, none
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(ok)]]) - 1
    return chosen[first], grams[chosen[first]], ok[first], ok[last]


def _pieces(text: str, n_words: int, window: int, block_words: int) -> Iterator[tuple[str, int]]:
    """The text of an item and its number of words; of over block_words words, pieces that have all its windows.

    Neighbours share window - 1 words, so each window is whole in one piece, and
    no piece has fewer words than a window.
    """
    if n_words <= block_words:
        yield text, n_words
        return
    places = [m.span() for m in re.finditer(WORD, text)]
    for at in range(0, max(n_words - window + 1, 1), block_words):
        own = places[at : at + block_words + window - 1]
        yield text[own[0][0] : own[-1][1]], len(own)


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[tuple[list[str], list[str | None]]]:
    ids: list[str] = []
    texts: list[str | None] = []
    size = 0
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    for row in items.toLocalIterator():
        for text, n in _pieces(row.t, row.n, window, block_words):
            if ids and size + n > block_words:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(row.i if row.i is not None else "")
            texts.append(text)
            size += n
    yield ids, texts


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = 4_000_000
) -> DataFrame:
    """All rows and columns of docs, with n_words, hit_spans and item_ids.

    hit_spans: maximal word spans [start, end) that occurrences of windows cover.
    item_ids: ids (as strings, sorted) of the items whose windows occur.
    Null and empty texts have no words and no hits; repeated rows get equal
    results; items that are null or have no word match nothing. A column of docs
    that has one of the three new names gives way to it.
    """
    return beside(docs, ("text",), tuple(_EXTRA.names), lambda d: _find(d, benchmark, window, gram, block_words))


def _find(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, block_words: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    ship(spark)
    added = T.StructType.fromDDL("n_words bigint, hit_spans array<struct<start:int,end:int>>, item_ids array<string>")
    out = T.StructType([*docs.schema.fields, *added.fields])
    found = docs
    for number, (ids, texts) in enumerate(_blocks(benchmark, window, block_words)):
        shared = spark.sparkContext.broadcast(Fingerprints(ids, texts, window, gram))
        if number:
            found = cut(found)
        found = found.mapInArrow(_scanner(shared, bool(number)), out)
    return found


_EXTRA = pa.schema(
    [
        ("n_words", pa.int64()),
        ("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("item_ids", pa.list_(pa.string())),
    ]
)


def _scanner(shared, again: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: Fingerprints = shared.value
        for whole in batches:
            for batch in K.slices(whole):
                words = K.Words(*K.text_bytes(batch.column("text")), K.ALNUM, fold=True)
                starts, sizes, docs, items = prints.hits(words)
                spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                named: list[set] = [set() for _ in range(batch.num_rows)]
                if again:
                    for i, (s, n) in enumerate(zip(batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)):
                        named[i] |= set(n)
                        starts = np.concatenate([starts, [words.first[i] + x["start"] for x in s]]).astype(np.int64)
                        sizes = np.concatenate([sizes, [x["end"] - x["start"] for x in s]]).astype(np.int64)
                if len(starts):
                    covered = K.cover(starts, sizes, len(words))
                    # a run of hit words ends where its text ends
                    a, b = K.runs(covered)
                    cuts = words.first[1:-1]
                    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(words))])
                    cuts = cuts[covered[cuts - 1] & covered[cuts]] if len(cuts) else cuts
                    a, b = np.sort(np.concatenate([a, cuts])), np.sort(np.concatenate([b, cuts]))
                    for x, y, d in zip(a.tolist(), b.tolist(), words.doc[a].tolist(), strict=True):
                        f = int(words.first[d])
                        spans[d].append({"start": x - f, "end": y - f})
                    for d, i in zip(docs.tolist(), items.tolist(), strict=True):
                        named[d].add(prints.ids[i])
                own = [c for c in batch.schema.names if c not in _EXTRA.names] if again else batch.schema.names
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in own],
                        pa.array(words.per_doc, type=pa.int64()),
                        pa.array(spans, type=_EXTRA.field(1).type),
                        pa.array([sorted(x) for x in named], type=_EXTRA.field(2).type),
                    ],
                    names=[*own, *_EXTRA.names],
                )

    return scan


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to the result of find_overlaps().

    A document is contaminated if 1 / share of its words, at least, are hit.
    """
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.withColumns({"n_hit": hit, "n_items": F.size("item_ids").cast("long")}).withColumns(
        {
            "items_sha256": F.sha2(F.concat_ws(",", "item_ids"), 256),
            "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")),
        }
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns only."""
    return beside(docs, ("text",), (), lambda d: contamination(find_overlaps(d, benchmark)).where(~F.col("contaminated")))


def digest(ids: list[str]) -> str:
    """items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
