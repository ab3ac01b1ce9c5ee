"""Substring deduplication: Rabin-Karp hashes of every window of `WINDOW` words, counted in Spark.

Every window of every text is hashed and counted (see repeats.py); windows that
start anywhere else too, in the same text or in another, are marked, and marked
windows that overlap or touch are merged into maximal spans to remove. Windows
are judged on the input, not on what is left.

Hashes have 64 bits: of n windows, about n**2 / 2**65 are taken for repeated
without being so (none is missed).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats as R
from . import textkit as K
from .job import beside, ship

WINDOW = 35


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key (text_key() of a text) and spans (pairs of int32, in words) of each text with repeated windows."""
    ship(docs.sparkSession)
    bits, chunk_bytes = R.plan(docs)

    def windows(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        words = K.Words(*K.text_bytes(batch.column("text")), K.SPACED, fold=False)
        at, hashes = words.windows(window)
        return batch.column("key").to_pylist(), np.bincount(words.doc[at], minlength=batch.num_rows).astype("<i8"), hashes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, slices in R.chunks(batches, chunk_bytes, windows):
            keys, per_doc, hashes = zip(*slices, strict=True)
            hashes = np.concatenate(hashes)
            if not len(hashes):
                continue
            rows, known = R.entries(chunk, hashes, bits)
            # notes: a key and a number of windows for each text, then the windows already known
            notes = np.int64(sum(map(len, keys))).tobytes() + b"".join(k for part in keys for k in part) + np.concatenate(per_doc).tobytes()
            rows.append((R.notes_bucket(chunk), chunk, notes, R.pack_ids(np.flatnonzero(known))))
            for i in range(0, len(rows), 256):
                yield R.entry_batch(rows[i : i + 256])

    def gather(table: pa.Table) -> pa.Table:
        notes, found = R.answers(table)
        known = next(R.unpack_ids(i) for n, i in zip(table.column("notes").to_pylist(), table.column("ids").to_pylist(), strict=True) if n is not None)
        n = int(np.frombuffer(notes, dtype="<i8", count=1)[0])
        keys = [notes[8 + 16 * i : 24 + 16 * i] for i in range(n)]
        per_doc = np.frombuffer(notes, dtype="<i8", offset=8 + 16 * n)
        first = np.concatenate([[0], np.cumsum(per_doc)])
        marked = np.zeros(int(first[-1]), dtype=bool)
        marked[found] = True
        marked[known] = True
        out: dict[bytes, bytes] = {}
        for i in np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(marked)])[first])):
            starts, ends = merged(marked[first[i] : first[i + 1]], window)
            out[keys[i]] = np.stack([starts, ends], axis=1).astype("<i4").tobytes()
        return pa.table({"key": pa.array(list(out), pa.binary()), "spans": pa.array(list(out.values()), pa.binary())})

    keyed = docs.select(K.text_key(F.col("text")).alias("key"), "text")
    settled = R.settle(keyed.mapInArrow(emit, R.ENTRIES), R.shared_by_sorting)
    # equal texts have equal spans, whatever chunk they are in
    return settled.groupBy("chunk").applyInArrow(gather, "key binary, spans binary").groupBy("key").agg(F.first("spans").alias("spans"))


def merged(marked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans that the marked windows cover."""
    at = np.flatnonzero(marked)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] > at[:-1] + window
    starts = at[new]
    ends = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + window
    return starts, ends


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """All rows and columns of docs, with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    kept_text: the words that are left, joined by one space. Null and empty
    texts have no words; repeated rows are all removed from `window` words on,
    and get equal results. A column of docs that has a new name gives way to it.
    """
    added = ("n_words", "n_removed", "kept_sha256") + ("kept_text",) * with_text
    return beside(docs, ("text",), added, lambda d: _removed(d, window, with_text))


def _removed(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    spans = repeated_spans(docs, window)
    added = T.StructType.fromDDL("n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)
    joined = R.with_spans(docs, spans)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, limit=R.CHUNK_BYTES):
                total, removed, sha, kept = [], [], [], []
                for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    words = (text or b"").split()
                    left, n = words, 0
                    if spans is not None:
                        left, at = [], 0
                        for a, b in np.frombuffer(spans, dtype="<i4").reshape(-1, 2).tolist():
                            left += words[at:a]
                            n, at = n + b - a, b
                        left += words[at:]
                    joined_words = b" ".join(left)
                    total.append(len(words))
                    removed.append(n)
                    sha.append(hashlib.sha256(joined_words).hexdigest())
                    if with_text:
                        kept.append(joined_words)
                own = [c for c in batch.schema.names if c not in ("key", "spans")]
                columns = [batch.column(c) for c in own] + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *added.names])

    return joined.mapInArrow(cut_out, T.StructType([*docs.schema.fields, *added.fields]))
