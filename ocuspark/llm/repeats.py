"""Counting window hashes without a row for each window.

A chunk is a few megabytes of text, or one long text. Its window hashes are dealt to buckets by
their leading bits, each bucket's share is packed into one binary value, and
only these values are shuffled. Windows that repeat inside a chunk are settled
there and announced once, so a window that a third of all rows hold costs a
bucket one entry for each chunk. A bucket answers with the chunk's windows that
other chunks hold too; each chunk then joins its answers.

A chunk's number is its place in its input partition. Partitions must be the
same when they are computed again, as those of files are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .job import anew

#: Text that is worked on at once, at all sizes; a chunk holds the hashes of one such slice or more.
CHUNK_BYTES = 1 << 21
BUCKET_BYTES = 1 << 23
#: Most text that a chunk's hashes, or a bucket's, come from: about 10 million word windows, under 1 GB in a worker.
MOST_BYTES = 1 << 26
#: Text bytes of a chunk times those of a bucket, over the text's: about 6 times the windows in a packed value.
SPREAD = 400
LEAST_BUCKETS = 512

ENTRIES = "bucket int, chunk bigint, hashes binary, ids binary"
U8 = np.uint8


def plan(docs: DataFrame) -> tuple[int, int]:
    """log2 of the number of buckets, and text bytes of a chunk, for texts of this size.

    Chunks and buckets grow with the square root of the text, up to MOST_BYTES: a
    value that a chunk packs for a bucket then keeps its length up to about 10
    TB of text. Beyond that values get shorter, at 100 TB to some 5 windows; what
    a worker holds does not grow.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    side = min(MOST_BYTES, int(np.sqrt(SPREAD * size)))
    return int(np.ceil(np.log2(max(LEAST_BUCKETS, size / max(BUCKET_BYTES, side))))), max(CHUNK_BYTES, side)


def pack(hashes: np.ndarray) -> bytes:
    """Low 7 bytes of each hash; a bucket's number implies the rest."""
    return hashes.view(U8).reshape(-1, 8)[:, :7].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), dtype=U8)
    out[:, :7] = np.frombuffer(data, dtype=U8).reshape(-1, 7)
    return out.reshape(-1).view(np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ascending numbers as differences of 1, 2 or 4 bytes; the first byte says which."""
    steps = np.diff(ids, prepend=0)
    most = int(steps.max(initial=0))
    kind = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([kind]) + steps.astype(f"<u{kind}").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=f"<u{data[0]}", offset=1), dtype=np.int64)


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int, work: Callable[[pa.RecordBatch], object]) -> Iterator[tuple[int, list]]:
    """Number of each chunk, and what work() gives for each of its slices of texts. Texts are let go slice by slice."""
    numbers = chunk_numbers()
    held, size = [], 0
    for batch in K.gathered(batches, limit=min(CHUNK_BYTES, chunk_bytes)):
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + own > chunk_bytes + chunk_bytes // 8:
            yield next(numbers), held
            held, size = [], 0
        held.append(work(batch))
        size += own
    if held:
        yield next(numbers), held


def chunk_numbers() -> Iterator[int]:
    part = TaskContext.get().partitionId()
    n = 0
    while True:
        yield (part << 32) | n
        n += 1


def entries(chunk: int, hashes: np.ndarray, bits: int) -> tuple[list[tuple[int, int, bytes, bytes]], np.ndarray]:
    """Rows of ENTRIES for a chunk's window hashes, and which windows repeat inside the chunk.

    A repeated hash is announced once, without a number: it comes before the
    others, and there are fewer numbers than hashes.
    """
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    last = np.ones(len(ranked), dtype=bool)
    last[:-1] = new[1:]
    repeated = np.zeros(len(ranked), dtype=bool)
    repeated[order] = ~(new & last)
    told = ranked[new & ~last]
    single = np.flatnonzero(~repeated)
    mine = hashes[single]
    shift = K.U64(64 - bits)
    bucket, told_bucket = (mine >> shift).astype(np.int64), (told >> shift).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    single, mine, bucket = single[by_bucket], mine[by_bucket], bucket[by_bucket]
    present = np.unique(np.concatenate([bucket, told_bucket]))
    a, b = np.searchsorted(bucket, present), np.searchsorted(bucket, present, side="right")
    c, d = np.searchsorted(told_bucket, present), np.searchsorted(told_bucket, present, side="right")
    rows = [
        (int(p), chunk, pack(np.ascontiguousarray(np.concatenate([told[c[i] : d[i]], mine[a[i] : b[i]]]))), pack_ids(single[a[i] : b[i]])) for i, p in enumerate(present)
    ]
    return rows, repeated


def entry_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["bucket", "chunk", "hashes", "ids"]
    )


def notes_bucket(chunk: int) -> int:
    """Notes of a chunk travel beside its entries, in a bucket below 0."""
    return -1 - (chunk * 2654435761 >> 7) % 4096


def shared_by_sorting(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each chunk's (hashes, numbers) in a bucket: the numbers whose hashes another entry has too."""
    every = np.concatenate([h for h, _ in parts])
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    met = np.zeros(len(every), dtype=bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    out, at = [], 0
    for h, ids in parts:
        out.append(ids[met[at + len(h) - len(ids) : at + len(h)]])
        at += len(h)
    return out


def settle(packed: DataFrame, shared: Callable[[list[tuple[np.ndarray, np.ndarray]]], list[np.ndarray]]) -> DataFrame:
    """From all chunks' entries: for each chunk and bucket, the numbers of the windows that others share; notes pass."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        chunks, hashes, ids = (table.column(c).to_pylist() for c in ("chunk", "hashes", "ids"))
        if bucket >= 0:
            order = np.argsort(np.array(chunks), kind="stable")
            chunks, hashes, ids = ([x[i] for i in order] for x in (chunks, hashes, ids))
            found = shared([(unpack(h), unpack_ids(i)) for h, i in zip(hashes, ids, strict=True)])
            keep = [i for i, f in enumerate(found) if len(f)]
            chunks, hashes, ids = [chunks[i] for i in keep], [None] * len(keep), [pack_ids(found[i]) for i in keep]
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "notes": pa.array(hashes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, "chunk bigint, notes binary, ids binary")


def answers(table: pa.Table) -> tuple[bytes | None, np.ndarray]:
    """A chunk's notes, and the numbers of its windows that others share, from its rows of settle()."""
    notes, ids = table.column("notes").to_pylist(), table.column("ids").to_pylist()
    own = next((n for n in notes if n is not None), None)
    found = [unpack_ids(i) for n, i in zip(notes, ids, strict=True) if n is None]
    return own, np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with key, and with spans (null if it has none) of its text.

    spans has a row for each key. It is the built side, so documents are not
    sorted, and a key that many documents share can be split.
    """
    keyed = docs.withColumn("key", K.text_key(F.col("text")))
    return keyed.join(anew(spans, "key").hint("shuffle_hash"), "key", "left")


def squeeze(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """docs with text as compressed bytes (`packed`, null for null) and its key: what a shuffle of texts moves.

    distinct: of rows of equal text, only the first in a task.
    """
    rest = [f for f in docs.schema.fields if f.name != "text"]
    keyed = docs.select(*[f.name for f in rest], K.text_key(F.col("text")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        seen: set[bytes] = set()
        for whole in batches:
            for batch in K.slices(whole, limit=CHUNK_BYTES):
                if distinct:
                    keep = []
                    for k in batch.column("key").to_pylist():
                        keep.append(k not in seen)
                        seen.add(k)
                    batch = batch.filter(pa.array(keep, pa.bool_()))
                packed = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-1], "packed"])

    added = T.StructType.fromDDL("key binary, packed binary")
    return keyed.mapInArrow(run, T.StructType([*rest, *added.fields]))


def unsqueeze(packed: bytes | None) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True) if packed is not None else b""
