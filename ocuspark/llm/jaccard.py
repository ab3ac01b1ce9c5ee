"""N-gram Jaccard join: a size-aware heavy-light join over shingle sets.

A document's set is its distinct `SHINGLE`-word shingles. Two sets link at a
Jaccard similarity of `PERCENT` hundredths or more.

1. Of each set, the shingles of the smallest hashes are counted over all sets
   (packed, see repeats.py): |A| - ceil(0.8 |A|) + c of them, of which sets that
   link share c; c is a fifth of the set, and small sets are counted whole. A
   set with fewer shared ones has no links at all; what is left is small. Equal
   sets are one set from here on.
2. The counted shingles, or tokens, are put in one global order, rare ones
   first, and by the same rule sets that link share one token, or two, near the
   front of it. Light sets publish all
   subsets of c = 2 of these; heavy sets, and light ones near the boundary, are
   put in the inverted lists of single tokens (c = 1). The boundary is the size
   for which rows and comparisons cost least, counted over all sets.
3. Verification stays inside lists (of a subset or a token). Each member is
   compared with its list's leader; what links is one class. A list whose
   members are of one class is done. In the others, members of different classes
   are compared: pair by pair in a list of up to `SHORT` members, else in blocks
   of sets, in which those of the largest class are not compared with each
   other. A pair is first held against the counted tokens that sets which link
   must share, and only then, if the sets are large, against whole sets. So links
   alone tie sets together; sets that merely share a rare shingle never form a
   group, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import repeats as R
from . import textkit as K
from .graph import components
from .job import anew, beside, cut, ship

SHINGLE, PERCENT, BLOCK, SHORT = 5, 80, 1024, 8
#: Relative cost of a published row and of a comparison of two sets' tokens; assumed, not timed.
ROW_COST, PAIR_COST = 1, 8
MEMBERS = "doc_id bigint, has_doc boolean, n bigint, skey binary, tkey binary, tokens binary"
WHOLE = 64


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles of each text, and their hashes, ascending within a text."""
    words = K.Words(*K.text_bytes(text), K.SPACED, fold=True)
    at, hashes = words.windows(size)
    docs, found = [words.doc[at]], [hashes]
    for n in np.unique(words.per_doc[(words.per_doc > 0) & (words.per_doc < size)]).tolist():
        at, hashes = words.windows(n)
        whole = words.per_doc[words.doc[at]] == n
        docs.append(words.doc[at][whole])
        found.append(hashes[whole])
    doc, value = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return np.bincount(doc[new], minlength=len(words.per_doc)), value[new]


def _keys(counts: np.ndarray, hashes: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, None for an empty one."""
    some = np.flatnonzero(counts)
    if not len(some):
        return [None] * len(counts)
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    two = np.stack([np.add.reduceat(K.mix(hashes), starts), np.add.reduceat(K.mix(hashes ^ K.U64(0x5851F42D4C957F2D)), starts) + counts[some].astype(np.uint64)], axis=1)
    out: list[bytes | None] = [None] * len(counts)
    for i, k in zip(some.tolist(), two, strict=True):
        out[i] = k.tobytes()
    return out


def least_shared(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Shingles that a set of n has in common with any set that it links with, at least."""
    return -(-n * percent // 100)


def counted(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Number of shingles of a set of n that are counted: those of the smallest hashes."""
    return np.where(n <= WHOLE, n, n - least_shared(n, percent) + n // 5)


def common(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray:
    """Counted shingles that a set of n shares with the counted ones of any set that it links with, at least.

    Sets A and B that link share the smallest min(c_A, c_B) of their common
    shingles, counted for both. A partner has percent hundredths of n shingles or more.
    """
    n = np.asarray(n)
    return np.where(100 * n <= percent * WHOLE, least_shared(n, percent), np.maximum(1, least_shared(n, percent) // 5))


def shared_shingles(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """MEMBERS: a row for each document, and one for each set (in a chunk) that may have links.

    tokens: the set's counted shingles that other sets have too, rarest first;
    tkey: text_key() of a text that has the set, and if keyed also of each
    document's. Null and empty texts have n 0 and no skey.
    """
    ship(docs.sparkSession)
    bits, chunk_bytes = R.plan(docs)

    def sets(batch: pa.RecordBatch) -> tuple:
        """Of each text: size, key and counted shingles of its set; doc_id and text key."""
        counts, hashes = shingle_sets(batch.column("text"), size)
        rank = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        few = rank < np.repeat(counted(counts, percent), counts)
        return counts, hashes[few], _keys(counts, hashes), batch.column("doc_id"), batch.column("key").to_pylist()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, slices in R.chunks(batches, chunk_bytes, sets):
            counts, hashes, keys, ids_of, text_keys = zip(*slices, strict=True)
            counts, hashes, ids_of = np.concatenate(counts), np.concatenate(hashes), pa.concat_arrays(ids_of)
            keys, text_keys = ([k for part in x for k in part] for x in (keys, text_keys))
            place: dict[bytes, int] = {}
            of_doc = np.array([-1 if k is None else place.setdefault(k, len(place)) for k in keys], dtype="<i4")
            chosen = np.unique(of_doc[of_doc >= 0], return_index=True)[1] if len(place) else np.empty(0, dtype=np.int64)
            chosen = np.flatnonzero(of_doc >= 0)[chosen]
            few = counted(counts, percent)
            starts = np.concatenate([[0], np.cumsum(few)])
            mine = np.concatenate([hashes[starts[i] : starts[i + 1]] for i in chosen]) if len(chosen) else np.empty(0, dtype=np.uint64)
            sizes = counts[chosen]
            owner = np.repeat(np.arange(len(chosen)), few[chosen])
            order = np.argsort(mine, kind="stable")
            new = np.ones(len(mine), dtype=bool)
            new[1:] = mine[order][1:] != mine[order][:-1]
            group = np.cumsum(new) - 1
            first = order[new]
            times = np.bincount(group, minlength=len(first)) if len(mine) else np.empty(0, dtype=np.int64)
            again = order[~new]
            rows = []
            by_place = np.argsort(first)
            ids, many = first[by_place], times[by_place]
            bucket = (mine[ids] >> K.U64(64 - bits)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            ids, many, bucket = ids[by_bucket], many[by_bucket], bucket[by_bucket]
            edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, dtype=np.int64)
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                more = np.flatnonzero(many[s:e] > 1)
                head = np.int32(len(more)).tobytes() + more.astype("<i4").tobytes() + many[s:e][more].astype("<i4").tobytes()
                rows.append((int(bucket[s]), chunk, head + R.pack(np.ascontiguousarray(mine[ids[s:e]])), R.pack_ids(ids[s:e])))
            notes = b"".join(
                [
                    np.array([len(keys), len(chosen), len(again)], dtype="<i8").tobytes(),
                    ids_of.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                    np.asarray(ids_of.is_valid().to_numpy(zero_copy_only=False), dtype="u1").tobytes(),
                    of_doc.tobytes(),
                    sizes.astype("<i8").tobytes(),
                    b"".join(place),
                    b"".join(text_keys[i] for i in chosen),
                    first[group[~new]].astype("<i4").tobytes(),  # a shingle's first place in the chunk,
                    owner[again].astype("<i4").tobytes(),  # and another set that has it
                    b"".join(text_keys) if keyed else b"",
                ]
            )
            rows.append((R.notes_bucket(chunk), chunk, notes, b""))
            for i in range(0, len(rows), 256):
                yield R.entry_batch(rows[i : i + 256])

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "hashes", "ids")), strict=True))
        if bucket >= 0:
            values, times = [], []
            for _, data, _ in rows:
                m = int(np.frombuffer(data, dtype="<i4", count=1)[0])
                v = R.unpack(data[4 + 8 * m :])
                t = np.ones(len(v), dtype=np.int64)
                t[np.frombuffer(data, dtype="<i4", count=m, offset=4)] = np.frombuffer(data, dtype="<i4", count=m, offset=4 + 4 * m)
                values.append(v)
                times.append(t)
            every, weight = np.concatenate(values), np.concatenate(times)
            order = np.argsort(every, kind="stable")
            new = np.ones(len(every), dtype=bool)
            new[1:] = every[order][1:] != every[order][:-1]
            total = np.empty(len(every), dtype=np.int64)
            total[order] = np.add.reduceat(weight[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            out, at = [], 0
            for (chunk, _, ids), v in zip(rows, values, strict=True):
                df = total[at : at + len(v)]
                at += len(v)
                if (df > 1).any():
                    code = np.minimum(255, 8 * np.log2(df[df > 1])).astype("u1")
                    out.append((chunk, code.tobytes() + R.pack(v[df > 1]), R.pack_ids(R.unpack_ids(ids)[df > 1])))
            rows = out
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({"chunk": pa.array(cols[0], pa.int64()), "notes": pa.array(cols[1], pa.binary()), "ids": pa.array(cols[2], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("notes").to_pylist(), table.column("ids").to_pylist(), strict=True))
        notes = next(n for n, i in rows if not i)
        n_docs, n_sets, n_again = np.frombuffer(notes, dtype="<i8", count=3).tolist()
        at = 24

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(notes, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        doc_ids, valid, of_doc, sizes = read("<i8", n_docs), read("u1", n_docs), read("<i4", n_docs), read("<i8", n_sets)
        keys = [notes[at + 16 * i : at + 16 * i + 16] for i in range(n_sets)]
        text_keys = [notes[at + 16 * i : at + 16 * i + 16] for i in range(n_sets, 2 * n_sets)]
        at += 32 * n_sets
        again_first, again_owner = read("<i4", n_again), read("<i4", n_again)
        own_keys = [notes[at + 16 * i : at + 16 * i + 16] for i in range(n_docs)] if keyed else [None] * n_docs
        ids, tokens, codes = [], [], []
        for n, i in rows:
            if i:
                own = R.unpack_ids(i)
                ids.append(own)
                codes.append(np.frombuffer(n, dtype="u1", count=len(own)))
                tokens.append(R.unpack(n[len(own) :]))
        out: list[tuple] = [(int(d) if v else None, True, int(sizes[s]) if s >= 0 else 0, keys[s] if s >= 0 else None, k, None) for d, v, s, k in zip(doc_ids, valid, of_doc, own_keys, strict=True)]
        if ids:
            ids, tokens, codes = np.concatenate(ids), np.concatenate(tokens), np.concatenate(codes)
            owner = np.repeat(np.arange(n_sets), counted(sizes, percent))
            order = np.argsort(ids)
            if n_again:
                spot = order[np.minimum(np.searchsorted(ids, again_first, sorter=order), len(ids) - 1)]
                owner = np.concatenate([owner[ids], again_owner])
                tokens, codes = np.concatenate([tokens, tokens[spot]]), np.concatenate([codes, codes[spot]])
            else:
                owner = owner[ids]
            enough = np.bincount(owner, minlength=n_sets) >= common(sizes, percent)
            keep = enough[owner]
            owner, tokens, codes = owner[keep], tokens[keep], codes[keep]
            order = np.lexsort((tokens, codes, owner))
            owner, tokens, codes = owner[order], tokens[order], codes[order]
            ends = np.searchsorted(owner, np.arange(n_sets + 1))
            for s in np.flatnonzero(enough).tolist():
                out.append((None, False, int(sizes[s]), keys[s], text_keys[s], tokens[ends[s] : ends[s + 1]].tobytes()))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({f: pa.array(c, k) for f, c, k in zip(("doc_id", "has_doc", "n", "skey", "tkey", "tokens"), cols, kinds, strict=True)})

    packed = docs.select(F.col("doc_id").cast("bigint"), K.text_key(F.col("text")).alias("key"), "text").mapInArrow(emit, R.ENTRIES)
    answered = packed.groupBy("bucket").applyInArrow(count, "chunk bigint, notes binary, ids binary")
    return answered.groupBy("chunk").applyInArrow(gather, MEMBERS)


def _prefix(n: np.ndarray | int, shared: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Of a set of n shingles with so many shared tokens: how many of them, from the front, meet one of any set that it links with.

    Tokens of one set only come first in the order, but meet nothing.
    """
    return shared - common(n, percent) + 1


def _published(n: int, tokens: np.ndarray, light: bool, percent: int) -> np.ndarray:
    """Signatures of a set: of its two-token subsets if light, else of single tokens."""
    p = int(_prefix(n, len(tokens), percent))
    if light:
        i, j = np.triu_indices(max(0, min(p + 1, len(tokens))), 1)
        return K.mix(tokens[i] ^ K.mix(tokens[j] + K.U64(1)))
    return K.mix(tokens[: max(0, p)])


def costs(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """light, step (a quarter of a power of two of the size), rows and pairs: what sets of that size publish, and whom they are compared with.

    Counted once as if all sets of up to WHOLE shingles were heavy, and once as
    if all were light; larger ones are heavy, as they would publish thousands of
    subsets each. pairs: each set with the leaders of its lists, once each, be
    they false candidates or not; what subsets save are false ones.
    """

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, key, data in zip(*(batch.column(c).to_pylist() for c in ("n", "skey", "tokens")), strict=True):
                tokens = np.frombuffer(data, dtype="<u8")
                for light in (False, True):
                    own = _published(n, tokens, light, percent)
                    if len(own):
                        arrays = [pa.array([light] * len(own)), pa.array(own.view(np.int64)), pa.array([key] * len(own), pa.binary()), pa.array([int(4 * np.log2(n))] * len(own), pa.int32())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["light", "sig", "skey", "step"])

    each = cut(sets.where(F.col("n") <= WHOLE).select("n", "skey", "tokens").mapInArrow(publish, "light boolean, sig bigint, skey binary, step int"))
    leaders = each.groupBy("light", "sig").agg(F.min("skey").alias("leader"))
    met = each.join(leaders, ["light", "sig"]).where(F.col("skey") != F.col("leader")).select("light", "step", "skey", "leader").distinct()
    rows = each.groupBy("light", "step").agg(F.count("*").alias("rows"))
    return rows.join(met.groupBy("light", "step").agg(F.count("*").alias("pairs")), ["light", "step"], "left").fillna(0, ["pairs"])


def boundary(sets: DataFrame, percent: int = PERCENT) -> int:
    """Largest light size: that for which the rows of all sets and the comparisons of their candidates cost least; the larger one of two that cost the same."""
    # two rows for each quarter of a power of two up to WHOLE: 50 at most
    found = {(r.light, r.step): ROW_COST * r.rows + PAIR_COST * r.pairs for r in costs(sets, percent).collect()}
    best = now = at = 0
    for step in sorted({k for _, k in found}):
        now += found.get((True, step), 0) - found.get((False, step), 0)
        if now <= best:  # sizes of this step are light
            best, at = now, min(WHOLE, int(np.ceil(2 ** ((step + 1) / 4))) - 1)
    return at


def signatures(sets: DataFrame, x: int, percent: int = PERCENT) -> DataFrame:
    """sig, skey and n: two-token subsets of light sets (of up to x shingles), single tokens of heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, keys, sizes = [], [], []
            for n, key, data in zip(*(batch.column(c).to_pylist() for c in ("n", "skey", "tokens")), strict=True):
                tokens = np.frombuffer(data, dtype="<u8")
                light = 1 < n <= x
                own = [_published(n, tokens, True, percent)] if light else []
                if not light or 100 * n >= percent * x:
                    own.append(_published(n, tokens, False, percent))
                own = np.concatenate(own)
                if len(own):
                    sigs.append(own.view(np.int64))
                    keys += [key] * len(own)
                    sizes += [n] * len(own)
                if len(keys) > 100_000:
                    yield _signature_batch(sigs, keys, sizes)
                    sigs, keys, sizes = [], [], []
            if keys:
                yield _signature_batch(sigs, keys, sizes)

    return sets.select("n", "skey", "tokens").mapInArrow(run, "sig bigint, skey binary, n bigint")


def _signature_batch(sigs: list, keys: list, sizes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], names=["sig", "skey", "n"])


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes for which sets can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def with_leaders(tied: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of a set and the leader, its smallest set, of one of its lists, once each; tied: signatures()."""
    leader = F.min(F.struct("skey", "n"))
    leaders = tied.groupBy("sig").agg(leader.alias("l"), F.count("*").alias("members")).where("members > 1").select("sig", F.col("l.skey").alias("b"), F.col("l.n").alias("bn"))
    met = tied.join(leaders, "sig").where(F.col("skey") != F.col("b")).where(_alike("n", "bn", percent))
    return met.select(F.col("skey").alias("a"), "b").distinct()


def _linked(inter: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def link_classes(sizes: np.ndarray, tokens: list[np.ndarray], start: np.ndarray, percent: int) -> np.ndarray:
    """Class of each set: its links' transitive closure, given classes to start with. Exact.

    Each set is compared with all later ones that are not yet of its class.
    """
    label = start.copy()
    lengths = np.array([len(t) for t in tokens])
    order = np.argsort(sizes - lengths, kind="stable")
    _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    ends = np.cumsum(lengths)
    parts = [inverse[e - n : e] for e, n in zip(ends, lengths, strict=True)]
    mark = np.zeros(int(inverse.max()) + 1, dtype=np.int32)
    for at, i in enumerate(order):
        later = order[at + 1 :]
        other = later[(label[later] != label[i]) & (100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i]))]
        if not len(other):
            continue
        mark[parts[i]] = 1
        starts = np.concatenate([[0], np.cumsum(lengths[other])[:-1]])
        inter = np.add.reduceat(mark[np.concatenate([parts[j] for j in other])], starts)
        mark[parts[i]] = 0
        for old in np.unique(label[other[_linked(inter, sizes[i], sizes[other], percent)]]):
            label[label == old] = label[i]
    return label


def _verifier(percent: int):
    """Of a block of sets (skey, n, tokens, class): each set with one of those that links tie it to, within its class or beyond."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("skey").to_pylist()
        sizes = table.column("n").to_numpy()
        tokens = [np.frombuffer(t, dtype="<u8") for t in table.column("tokens").to_pylist()]
        start = np.unique(np.array([c.hex() for c in table.column("class").to_pylist()]), return_inverse=True)[1]
        label = link_classes(sizes, tokens, start, percent)
        roots: dict[int, bytes] = {}
        for k, i in zip(keys, label.tolist(), strict=True):
            roots[i] = min(roots.get(i, k), k)
        return pa.table({"a": pa.array(keys, pa.binary()), "b": pa.array([roots[i] for i in label.tolist()], pa.binary())})

    return run


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with size and tokens of both: an, at, bn, bt."""
    of = lambda x: sets.select(F.col("skey").alias(x), F.col("n").alias(f"{x}n"), F.col("tokens").alias(f"{x}t"))
    return pairs.join(anew(of("a"), "a"), "a").join(anew(of("b"), "b"), "b")


def _judged(pairs: DataFrame, whole: bool, percent: int) -> DataFrame:
    """a, b and linked of the pairs that can link. By counted tokens, linked is null where only whole sets can tell; by whole sets it is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, linked = [], []
            for k, (an, at, bn, bt) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("an", "at", "bn", "bt")), strict=True)):
                inter = len(np.intersect1d(np.frombuffer(at, dtype="<u8"), np.frombuffer(bt, dtype="<u8"), assume_unique=True))
                if whole or max(an, bn) <= WHOLE:  # sets of up to WHOLE shingles are counted whole
                    yes = bool(_linked(inter, an, bn, percent))
                elif inter >= max(int(common(an, percent)), int(common(bn, percent))):
                    yes = None
                else:
                    yes = False
                if yes is not False:
                    keep.append(k)
                    linked.append(yes)
            chosen = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return pairs.mapInArrow(run, "a binary, b binary, linked boolean")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The columns of wanted (key, and others), and tokens: all shingles of the text of that key.

    Equal texts are read once; a null text has the key of an empty one, and no
    shingles; keys of no text give no row.
    """
    texts = R.squeeze(docs.select("text"), distinct=True)
    rest = [c for c in wanted.columns if c != "key"]
    one = texts.join(wanted.hint("shuffle_hash"), "key").groupBy("key").agg(F.first("packed").alias("packed"), *[F.first(c).alias(c) for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                plain = [R.unsqueeze(p) for p in batch.column("packed").to_pylist()]
                counts, hashes = shingle_sets(pa.array(plain, pa.binary()).cast(pa.string()), size)
                ends = np.cumsum(counts)
                tokens = [hashes[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(tokens, pa.binary())], names=[*rest, "tokens"])

    return one.mapInArrow(run, ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in rest) + ", tokens binary")


def links(sets: DataFrame, whole: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) of sets that link; exact. sets: skey, n and counted tokens; whole: all tokens of each."""
    judged = cut(_judged(_beside(pairs, sets), False, percent))
    found, left = judged.where("linked").select("a", "b"), judged.where("linked is null").select("a", "b")
    return found.unionByName(_judged(_beside(left, whole), True, percent).select("a", "b"))


def open_lists(tied: DataFrame, classes_now: DataFrame) -> DataFrame:
    """sig, skey, n, class, top (the list's largest class) and members of lists with more than one class; of lists of the same sets, one."""
    own = tied.join(anew(classes_now.select(F.col("node").alias("skey"), F.col("component").alias("class")), "skey"), "skey", "left").withColumn("class", F.coalesce("class", "skey"))
    mixed = [F.bit_xor(F.xxhash64(F.lit(i), "skey")).alias(f"x{i}") for i in (0, 1)]
    by_class = own.groupBy("sig", "class").agg(F.count("*").alias("k"), *mixed)
    lists = by_class.groupBy("sig").agg(F.count("*").alias("kinds"), F.sum("k").alias("members"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"), F.max(F.struct("k", "class"))["class"].alias("top"))
    once = lists.where("kinds > 1").groupBy("x0", "x1", "members").agg(F.min(F.struct("sig", "top")).alias("l")).select("l.sig", "l.top", "members")
    return own.join(once, "sig")


def across(listed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of sets of different classes, once each, of lists of up to SHORT members."""
    other = listed.select("sig", F.col("skey").alias("b"), F.col("n").alias("bn"), F.col("class").alias("b_class"))
    met = listed.join(other, "sig").where(F.col("skey") < F.col("b")).where(F.col("class") != F.col("b_class")).where(_alike("n", "bn", percent))
    return met.select(F.col("skey").alias("a"), "b").distinct()


def in_blocks(whole: DataFrame, listed: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) by which the links of each list tie its sets, from tasks of at most `block` sets.

    Lists of the same largest class are one family: that class, and the sets that
    are in its lists but not in it. So a set is moved once for a family, not for
    each list, and a family is no larger than a class and its next neighbours.
    Sets of the class are not compared with each other: blocks of the others meet
    each other and those of the class.
    """
    listed = listed.groupBy("top", "skey").agg(F.first("class").alias("class"))
    half = max(1, block // 2)
    done = F.col("class") == F.col("top")
    counts = listed.groupBy("top").agg(F.ceil(F.count_if(~done) / half).alias("open_blocks"), F.ceil(F.count_if(done) / half).alias("done_blocks"))
    dealt = listed.join(anew(counts, "top"), "top").withColumn("mine", F.pmod(F.xxhash64("skey"), F.when(done, F.col("done_blocks")).otherwise(F.col("open_blocks"))))
    task = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_open = F.transform(upto("open_blocks"), lambda k: task(F.least(k, F.col("mine")), F.greatest(k, F.col("mine"))))
    with_done = F.transform(upto("done_blocks"), lambda k: task(F.col("mine"), -k - 1))
    from_done = F.transform(upto("open_blocks"), lambda k: task(k, -F.col("mine") - 1))
    tasks = dealt.select("top", "skey", "class", F.explode(F.when(done, from_done).otherwise(F.concat(with_open, with_done))).alias("task"))
    placed = tasks.join(anew(whole, "skey"), "skey").select("top", "task", "skey", "n", "tokens", "class")
    return placed.groupBy("top", "task").applyInArrow(_verifier(percent), "a binary, b binary").where(F.col("a") != F.col("b"))


def classes(docs: DataFrame, members: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """node and component (set keys) of all sets that link with others; members: shared_shingles(docs).

    Rows of documents, and of sets without shared tokens, are left out; of a set
    in several chunks one row counts. No sets give no rows, and null tokens none.
    """
    some = ("n", "tkey", "tokens")
    sets = cut(members.where("tokens is not null").groupBy("skey").agg(*[F.first(c).alias(c) for c in some]))
    tied = cut(signatures(sets, boundary(sets, percent), percent))
    # read once: what verification compares in all its steps
    whole = cut(full_sets(docs, sets.select(F.col("tkey").alias("key"), "skey", "n"), size))
    now = components(links(sets, whole, with_leaders(tied, percent), percent))
    left = cut(open_lists(tied, now))
    short = F.col("members") <= min(SHORT, block)
    more = links(sets, whole, across(left.where(short), percent), percent).unionByName(in_blocks(whole, left.where(~short), percent, block))
    # classes so far are stars; new links join them
    stars = now.where(F.col("node") != F.col("component")).select(F.col("node").alias("a"), F.col("component").alias("b"))
    more = cut(more)
    return now if more.isEmpty() else components(stars.unionByName(more))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of each row of docs.

    Null texts and texts without words have no shingles and are their own
    component. Repeated rows have equal sets and so are linked; a null doc_id
    links like any other but is never the smallest, unless all are null.
    Other columns are not read.
    """
    labelled = _labelled(docs, size, percent)
    least = labelled.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return labelled.join(anew(least, "class"), "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _labelled(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """doc_id, n, class (null without shingles), and if keyed tkey, of each row of docs."""
    members = cut(shared_shingles(docs, size, percent, keyed))
    found = classes(docs, members, size, percent).select(F.col("node").alias("skey"), F.col("component").alias("class"))
    own = ("doc_id", "n", "tkey") if keyed else ("doc_id", "n")
    rows = members.where("has_doc").select(*own, "skey")
    return cut(rows.join(anew(found, "skey"), "skey", "left").select(*own, F.coalesce("class", "skey").alias("class")))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """Of each component, the rows whose doc_id is its smallest, with all their columns.

    It is decided by row, that is by doc_id and text: other rows of an id may be
    in other components. Rows that repeat the id of a representative in its
    component stay with it. Rows of a null id go if a row of their component has
    an id; if none has, one of them stays, of the smallest text key.
    """
    rows = _labelled(docs, keyed=True).where("class is not null").groupBy("class", "doc_id", "tkey").agg(F.count("*").alias("times"))
    first = F.min(F.when(F.col("doc_id").isNull(), F.col("tkey")))
    least = rows.groupBy("class").agg(F.min("doc_id").alias("least"), first.alias("first"))
    placed = rows.join(anew(least, "class"), "class")
    stays = F.when(F.col("least").isNull(), F.col("tkey") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("least")))
    alone = F.col("doc_id").isNotNull() | (F.col("times") == 1)
    gone = cut(placed.where(~(stays & alone)).select(F.col("doc_id").alias("gone"), F.col("tkey").alias("gone_key"), stays.alias("one")))
    copied = gone.where("one").select("gone_key")

    def kept(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("_key", K.text_key(F.col("text")))
        rest = keyed.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("_key") == F.col("gone_key")), "left_anti").select(*d.columns)
        if copied.isEmpty():
            return rest
        # equal texts are one row before they meet, so that a frequent one isn't read by one task
        single = keyed.where("doc_id is null").groupBy("_key").agg(F.first(F.struct(*d.columns)).alias("row"))
        return rest.unionByName(single.join(copied, F.col("_key") == F.col("gone_key"), "left_semi").select("row.*"))

    return beside(docs, ("doc_id", "text"), (), kept)
