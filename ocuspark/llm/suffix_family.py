"""Suffix-array deduplication with a logarithmic family of indexes.

Suffixes. Every `LENGTH`-byte string picks, of its `GRAM`-byte strings, the one
of the smallest hash: an anchor. Equal strings pick equal anchors at equal
places, so suffixes are indexed at anchors only, about one in 140 places. An
anchor's context is all bytes of the strings that picked it.

Arrays. A suffix array is a run of anchors in the order of their text: of their
first eight bytes, then of the fingerprint of the whole anchor, then of that of
the context. So suffixes that share a long prefix are next to each other, and
what two neighbours share (lcp()) is known as a number of bytes, as a whole
anchor, or as a whole context, which is `LENGTH` bytes or more.

Family. New batches of documents get suffix arrays, dealt to buckets by
fingerprint. A batch is merged with the existing levels in one scan: neighbours
that share a context are a match of the whole context; neighbours that share an
anchor only are an open match. Levels of equal size merge, as in a binary
counter, so n batches are held in log2(n) levels, each a table in the shared
folder.

Matches. Contexts that match are removed whole. Strings of open anchors are
compared one by one: their hashes are counted in Spark. So each string that
starts anywhere else is found, and no other but for colliding 64-bit hashes.

Frequent passages. A chunk of texts sends one entry for each anchor: where an
anchor has several contexts in the chunk, all are open at once. So a passage
that a third of all documents share costs its bucket one entry a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats as R
from . import textkit as K
from .job import anew, beside, cut, ship

LENGTH, GRAM, BATCHES = 400, 120, 8
SAME, OPEN = 1, 2  # bits of an answer
ENTRY, NOTES, ANSWER = -1, -2, -3  # kinds of rows; a level's rows have its number
ROWS = "bucket int, kind int, chunk bigint, data binary, ids binary"
WORD = 8  # bytes of text by which suffixes are put in order


class Anchors:
    """Anchors of texts laid end to end: text, hash, context hash, and first and last string that picks each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> None:
        values = K.byte_values(data)
        grams = K.rolling(values, gram)
        picked = K.minimizers(grams, length - gram + 1)
        at = np.arange(len(picked))
        text = np.searchsorted(offsets, at, side="right") - 1
        ok = at + length <= offsets[text + 1]
        at, picked, text = at[ok], picked[ok], text[ok]
        first = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])])) if len(at) else at
        last = np.append(first[1:], len(at))[: len(first)] - 1
        self.text, self.place, self.first, self.last = text[first], picked[first], at[first], at[last]
        self.word = leading(data, self.place)
        self.strings = K.rolling(values, length)
        self.hash = grams[self.place]
        shape = ((self.place - self.first) << 20) + (self.last - self.first)
        self.context = K.mix(self.strings[self.first] * K.U64(3) + self.strings[self.last] + K.mix(shape.astype(np.uint64)))
        self.per_text = np.bincount(self.text, minlength=len(offsets) - 1)


def leading(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first WORD bytes from each place on, as numbers that are in the order of the bytes."""
    out = np.zeros(len(place), dtype=np.uint64)
    for k in range(WORD):
        out = (out << K.U64(8)) | data[place + k]
    return out


def _encode(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _decode(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, dtype=k, count=n, offset=at))
        at += n * np.dtype(k).itemsize
    return out


class Run:
    """A suffix array, or several that are being merged: word, anchor and context fingerprints, flag, chunk and number of each anchor.

    flag: whether the anchor has several contexts in its chunk.
    """

    KINDS = ("<u8", "<u4", "<u8", "u1")
    COLUMNS = ("word", "anchor", "context", "flag", "chunk", "ids")

    def __init__(self, *columns: np.ndarray) -> None:
        self.word, self.anchor, self.context, self.flag, self.chunk, self.ids = columns

    def __len__(self) -> int:
        return len(self.word)

    def take(self, which: np.ndarray) -> Run:
        return Run(*[getattr(self, c)[which] for c in self.COLUMNS])

    @classmethod
    def joined(cls, runs: list[Run]) -> Run:
        return cls(*[np.concatenate([getattr(r, c) for r in runs]) for c in cls.COLUMNS])

    def order(self) -> np.ndarray:
        """Places of the suffixes in the order of their text. Runs that lie end to end are in order, so this merges them."""
        return np.lexsort((self.context, self.anchor, self.word))

    def lcp(self, length: int, gram: int) -> np.ndarray:
        """Bytes that each suffix of a run in order shares with the one before it, as far as is known: up to WORD, gram, or length."""
        differ = self.word[1:] ^ self.word[:-1]
        shared = sum((differ >> K.U64(8 * k) == 0).astype(np.int64) for k in range(WORD))
        anchor = (shared == WORD) & (self.anchor[1:] == self.anchor[:-1])
        context = anchor & (self.context[1:] == self.context[:-1])
        return np.concatenate([np.zeros(min(1, len(self)), dtype=np.int64), np.where(context, length, np.where(anchor, gram, shared))])

    def packed(self) -> bytes:
        chunks, which = np.unique(self.chunk, return_inverse=True)
        return np.int64(len(chunks)).tobytes() + chunks.astype("<i8").tobytes() + _encode(self.word, self.anchor, self.context, self.flag, which.astype("<u4"), self.ids.astype("<i4"))

    @classmethod
    def unpacked(cls, data: bytes) -> Run:
        n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
        *own, which, ids = _decode(data[8 + 8 * n :], [*cls.KINDS, "<u4", "<i4"])
        return cls(*own, np.frombuffer(data, dtype="<i8", count=n, offset=8)[which], ids)


class SuffixFamily:
    """Levels of suffix arrays. add() takes a batch and returns its matches with itself and with all levels.

    Level k holds 2**k batches, or none. Levels are tables cut from their
    lineage in the shared checkpoint folder, so a lost executor loses nothing.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM) -> None:
        self.spark, self.length, self.gram = spark, length, gram
        self.levels: list[DataFrame | None] = []
        self.merges: list[int] = []  # into which level each batch went

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: rows of suffix_entries(). Returns rows of kind NOTES and ANSWER (ids, and their bits in data)."""
        full = next((i for i, level in enumerate(self.levels) if level is None), len(self.levels))
        rows = batch
        for level in self.levels:
            if level is not None:
                rows = rows.unionByName(level)
        out = cut(rows.groupBy("bucket").applyInArrow(_adder(full, self.length, self.gram), ROWS))
        self.levels = [None] * full + [out.where(F.col("kind") == full)] + self.levels[full + 1 :]
        self.merges.append(full)
        return out.where(F.col("kind") < 0)


def scan(run: Run, level: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a merged run in order: bits to tell each anchor's chunk, and which anchors are the first of a context that is new.

    level: the level of each anchor, -1 for those of the batch.
    """
    new = level < 0
    shared = run.lcp(length, gram)
    context, anchor = np.cumsum(shared < length) - 1, np.cumsum(shared < gram) - 1
    start = np.flatnonzero(shared < length)
    of_start = anchor[start]
    has_new, has_old = np.bincount(context, new) > 0, np.bincount(context, ~new) > 0
    n_anchors = int(anchor[-1]) + 1
    # an anchor is open if it has two contexts, in all or in one chunk; what is new about it is told to those that were there
    opened = (np.bincount(of_start, minlength=n_anchors) > 1) | (np.bincount(anchor, run.flag, n_anchors) > 0)
    changed = (np.bincount(of_start, has_new & ~has_old, n_anchors) > 0) | (np.bincount(anchor, new & (run.flag > 0), n_anchors) > 0)
    bits = np.where(((np.bincount(context) > 1) & has_new)[context], SAME, 0)
    first = np.zeros(len(run), dtype=bool)
    first[start[~has_old]] = True
    bits |= np.where(opened[anchor] & (first | (~new & changed[anchor])), OPEN, 0)
    return bits, first


def _adder(merged: int, length: int, gram: int):
    """The step for one bucket; the levels below `merged` and the batch become level `merged`."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "data", "ids")), strict=True), key=lambda r: r[:2])
        bucket = table.column("bucket")[0].as_py()
        out = [r for r in rows if r[0] == NOTES]
        runs, levels = [], []
        for kind, chunk, data, ids in rows:
            if kind == ENTRY:
                own = _decode(data, list(Run.KINDS))
                runs.append(Run(*own, np.full(len(own[0]), chunk), R.unpack_ids(ids)))
            elif kind >= 0:
                runs.append(Run.unpacked(data))
            if kind != NOTES:
                levels.append(np.full(len(runs[-1]), max(kind, -1)))
        if runs:
            every, level = Run.joined(runs), np.concatenate(levels)
            order = every.order()
            every, level = every.take(order), level[order]
            bits, first = scan(every, level, length, gram)
            kept = every.take(first | ((level >= 0) & (level < merged)))
            if len(kept):
                out.append((merged, 0, kept.packed(), b""))
            told = np.flatnonzero(bits)
            told = told[np.lexsort((every.ids[told], every.chunk[told]))]
            chunk, ids, bits = every.chunk[told], every.ids[told], bits[told]
            edges = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(chunk)) if len(chunk) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                out.append((ANSWER, int(chunk[a]), bits[a:b].astype("u1").tobytes(), R.pack_ids(ids[a:b])))
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32())} | {f: pa.array(c, k) for f, c, k in zip(("kind", "chunk", "data", "ids"), cols, kinds, strict=True)})

    return run


def suffix_entries(keyed: DataFrame, bits_of_bucket: int, chunk_bytes: int, length: int, gram: int) -> DataFrame:
    """Rows of ROWS for all anchors of the texts (key, text), one for each chunk and bucket, and a chunk's notes.

    Notes: number, keys and numbers of anchors of the texts; what the chunk knows itself.
    """

    def anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        a = Anchors(*K.text_bytes(batch.column("text")), length, gram)
        return a.word, a.hash, a.context, a.per_text, batch.column("key").to_pylist()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, slices in R.chunks(batches, chunk_bytes, anchors):
            *own, keys = zip(*slices, strict=True)
            word, hashes, contexts, per_text = (np.concatenate(x) for x in own)
            if not len(hashes):
                continue
            order = np.lexsort((np.arange(len(hashes)), contexts, hashes))
            h, c = hashes[order], contexts[order]
            anchor = np.concatenate([[True], h[1:] != h[:-1]])
            context = np.concatenate([[True], (c[1:] != c[:-1])]) | anchor
            of_context, of_anchor = np.cumsum(context) - 1, np.cumsum(anchor) - 1
            several = np.bincount(of_anchor, context) > 1
            # what the chunk knows by itself: repeated contexts, and all contexts of an anchor that has several
            bits = np.where((np.bincount(of_context) > 1)[of_context], SAME, 0) | np.where(context & several[of_anchor], OPEN, 0)
            known = np.flatnonzero(bits)
            known = known[np.argsort(order[known])]
            sent, flag = order[anchor], several.astype("u1")
            bucket = (hashes[sent] >> K.U64(64 - bits_of_bucket)).astype(np.int64)
            by_bucket = np.lexsort((sent, bucket))
            sent, flag, bucket = sent[by_bucket], flag[by_bucket], bucket[by_bucket]
            edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
            low = hashes.astype("<u4")  # with the bucket's number, enough to tell anchors apart: a wrong pair is compared, no more
            rows = [
                (int(bucket[s]), ENTRY, chunk, _encode(word[sent[s:e]], low[sent[s:e]], contexts[sent[s:e]], flag[s:e]), R.pack_ids(sent[s:e]))
                for s, e in zip(edges[:-1], edges[1:], strict=True)
            ]
            notes = np.int64(len(per_text)).tobytes() + b"".join(k for part in keys for k in part) + per_text.astype("<i8").tobytes() + bits[known].astype("u1").tobytes()
            rows.append((R.notes_bucket(chunk), NOTES, chunk, notes, R.pack_ids(order[known])))
            for i in range(0, len(rows), 256):
                cols = list(zip(*rows[i : i + 256], strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "kind", "chunk", "data", "ids"])

    return keyed.mapInArrow(emit, ROWS)


def _by_text(table: pa.Table) -> pa.Table:
    """A chunk's answers by text: key, how many texts it is of, and the numbers (in the text) of matched and of open anchors."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "data", "ids")), strict=True))
    notes, known = next((d, R.unpack_ids(i)) for k, d, i in rows if k == NOTES)
    n = int(np.frombuffer(notes, dtype="<i8", count=1)[0])
    keys = [notes[8 + 16 * i : 24 + 16 * i] for i in range(n)]
    first = np.concatenate([[0], np.cumsum(np.frombuffer(notes, dtype="<i8", offset=8 + 16 * n, count=n))])
    bits = np.zeros(int(first[-1]), dtype=np.uint8)
    bits[known] = np.frombuffer(notes, dtype=np.uint8, offset=8 + 24 * n)
    for k, d, i in rows:
        if k == ANSWER:
            bits[R.unpack_ids(i)] |= np.frombuffer(d, dtype=np.uint8)
    out: dict[bytes, np.ndarray] = {}
    times: dict[bytes, int] = {}
    for i in np.flatnonzero(np.diff(first)):
        own = bits[first[i] : first[i + 1]]
        out[keys[i]] = out[keys[i]] | own if keys[i] in out else own
        times[keys[i]] = times.get(keys[i], 0) + 1
    pick = lambda own, bit: R.pack_ids(np.flatnonzero(own & bit)) if (own & bit).any() else None
    columns = [pa.array(list(out), pa.binary()), pa.array(list(times.values()), pa.int64())] + [pa.array([pick(o, bit) for o in out.values()], pa.binary()) for bit in (SAME, OPEN)]
    return pa.table(dict(zip(("key", "times", "same", "open"), columns, strict=True)))


def matched(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """key (text_key() of a text), whole, same and spans (int32 pairs, in bytes): what is to be removed from each text.

    whole: the text is there more than once, so all of it goes. Its strings are
    counted once, for the sake of other texts. Documents come in `batches`
    batches, by the number of their chunk.
    """
    spark = docs.sparkSession
    ship(spark)
    bits, chunk_bytes = R.plan(docs)
    keyed = docs.select(K.text_key(F.col("text")).alias("key"), "text")
    entries = cut(suffix_entries(keyed, bits, chunk_bytes // 2, length, gram))
    family = SuffixFamily(spark, length, gram)
    answers = [family.add(entries.where(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == b)) for b in range(batches)]
    rows = answers[0]
    for more in answers[1:]:
        rows = rows.unionByName(more)
    of_texts = rows.groupBy("chunk").applyInArrow(_by_text, "key binary, times bigint, same binary, open binary")
    # a text of one row is in one chunk, and so has one answer
    of_texts = of_texts.groupBy("key").agg((F.sum("times") > 1).alias("whole"), F.first("same").alias("same"), F.collect_set("open").alias("open"))
    of_texts = cut(of_texts.where("whole or same is not null or size(open) > 0"))
    strings = _open_strings(docs, of_texts.where(F.size("open") > 0).select("key", "open"), bits, length, gram)
    return of_texts.select("key", "whole", "same").join(strings, "key", "left")


def _open_strings(docs: DataFrame, opened: DataFrame, bits: int, length: int, gram: int) -> DataFrame:
    """key and spans of the strings at open anchors that start anywhere else."""
    texts = R.squeeze(docs.select("text"), distinct=True)
    one = texts.join(opened.hint("shuffle_hash"), "key").groupBy("key").agg(F.first("packed").alias("packed"), F.first("open").alias("open"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = R.chunk_numbers()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                chunk = next(numbers)
                firsts, sizes, hashes = [], [], []
                for packed, opened in zip(part.column("packed").to_pylist(), part.column("open").to_pylist(), strict=True):
                    data = np.frombuffer(R.unsqueeze(packed), dtype=np.uint8)
                    a = Anchors(data, np.array([0, len(data)]), length, gram)
                    which = np.unique(np.concatenate([R.unpack_ids(o) for o in opened]))
                    size = a.last[which] - a.first[which] + 1
                    at = np.repeat(a.first[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    firsts.append(a.first[which])
                    sizes.append(size)
                    hashes.append(a.strings[at])
                rows, known = R.entries(chunk, np.concatenate(hashes), bits)
                # notes: texts, their keys, and of each the number of open anchors; first string and number of strings of each anchor
                counts = np.array([len(f) for f in firsts], dtype="<i8")
                notes = np.int64(part.num_rows).tobytes() + b"".join(part.column("key").to_pylist()) + _encode(counts, np.concatenate(firsts).astype("<i4"), np.concatenate(sizes).astype("<i4"))
                rows.append((R.notes_bucket(chunk), chunk, notes, R.pack_ids(np.flatnonzero(known))))
                for i in range(0, len(rows), 256):
                    yield R.entry_batch(rows[i : i + 256])

    def gather(table: pa.Table) -> pa.Table:
        notes, found = R.answers(table)
        known = next(R.unpack_ids(i) for n, i in zip(table.column("notes").to_pylist(), table.column("ids").to_pylist(), strict=True) if n is not None)
        n = int(np.frombuffer(notes, dtype="<i8", count=1)[0])
        keys = [notes[8 + 16 * i : 24 + 16 * i] for i in range(n)]
        counts = np.frombuffer(notes, dtype="<i8", offset=8 + 16 * n, count=n)
        firsts, size = (x.astype(np.int64) for x in _decode(notes[8 + 24 * n :], ["<i4", "<i4"]))
        ends = np.cumsum(size)
        places = np.repeat(firsts - (ends - size), size) + np.arange(size.sum())
        first = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        marked = np.zeros(len(places), dtype=bool)
        marked[found] = True
        marked[known] = True
        out = {}
        for i in range(n):
            at = places[first[i] : first[i + 1]][marked[first[i] : first[i + 1]]].astype(np.int64)
            if len(at):
                out[keys[i]] = _spans(np.stack([at, at + length], axis=1)).astype("<i4").tobytes()
        return pa.table({"key": pa.array(list(out), pa.binary()), "spans": pa.array(list(out.values()), pa.binary())})

    # sorted, so that a partition that is computed again has the same chunks
    return R.settle(one.sortWithinPartitions("key").mapInArrow(emit, R.ENTRIES), R.shared_by_sorting).groupBy("chunk").applyInArrow(gather, "key binary, spans binary")


def _spans(pairs: np.ndarray) -> np.ndarray:
    """Maximal runs that the intervals [start, end) cover."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    if not len(pairs):
        return pairs.reshape(0, 2)
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[new, 0], reach[np.append(new[1:] - 1, len(pairs) - 1)]], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, with_bytes: bool = True) -> DataFrame:
    """The columns of docs but text, with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_bytes.

    A byte goes if a string of `length` bytes over it also starts anywhere else,
    in the same text or another. What is left may break a character in two, so
    it is bytes. Null and empty texts have no bytes; repeated rows of `length`
    bytes or more lose all, and get equal results; a text shorter than `length`
    is kept. A column of docs that has a new name gives way to it.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256") + ("kept_bytes",) * with_bytes
    return beside(docs, ("text",), added, lambda d: _removed(d, length, gram, batches, added)).drop("text")


def _removed(docs: DataFrame, length: int, gram: int, batches: int, added: tuple[str, ...]) -> DataFrame:
    ship(docs.sparkSession)
    found = matched(docs, length, gram, batches)
    texts = R.squeeze(docs.select("text"), distinct=True).join(anew(found, "key").hint("shuffle_hash"), "key", "left")
    one = texts.groupBy("key").agg(*[F.first(c).alias(c) for c in ("packed", "whole", "same", "spans")])
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_bytes": pa.binary()}

    def cut_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: dict[str, list] = {c: [] for c in kinds}
                for packed, all_of_it, same, spans in zip(*(batch.column(c).to_pylist() for c in ("packed", "whole", "same", "spans")), strict=True):
                    data, pairs = R.unsqueeze(packed), np.empty((0, 2), dtype=np.int64)
                    if all_of_it:
                        pairs, same = np.array([[0, len(data)]]), None
                    elif spans is not None:
                        pairs = np.frombuffer(spans, dtype="<i4").reshape(-1, 2).astype(np.int64)
                    if same is not None:
                        a, which = Anchors(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), length, gram), R.unpack_ids(same)
                        pairs = np.concatenate([pairs, np.stack([a.first[which], a.last[which] + length], axis=1)])
                    pairs, left, end = _spans(pairs), [], 0
                    for s, e in pairs.tolist():
                        left.append(data[end:s])
                        end = e
                    kept = b"".join([*left, data[end:]])
                    for c, v in zip(kinds, (len(data), len(data) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(out[c], kinds[c]) for c in added]], names=["key", *added])

    # once for each text; its rows, a third of all perhaps, meet the result by key
    sql = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "kept_bytes": "binary"}
    results = one.mapInArrow(cut_out, "key binary, " + ", ".join(f"{c} {sql[c]}" for c in added))
    rows = docs.select(*[c for c in docs.columns if c != "text"], K.text_key(F.col("text")).alias("key"))
    return rows.join(anew(results, "key").hint("shuffle_hash"), "key").withColumn("text", F.lit(None).cast("string"))
