"""Vectors against vectors: each pair of blocks is one matrix of distances.

The number of pairs is the product of the tables' sizes, but nothing of that
size is kept. Vectors are packed, a row for each block, and written to the shared
folder; pairs of partitions then meet without a shuffle (Spark's Cartesian
product reads both from there), and what a task holds is a few blocks. What
leaves a task is made for its use: all pairs (pair_scores), sums over them
(pair_statistics), counts of distinct scores (claims), or counts in at most BINS
ranges of scores (equal_error_rate). For claims, equal vectors are one vector
that counts as often as it is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

BLOCK, BINS = 2048, 4096
#: Of a block: bytes of its vectors, and rows of the table for each vector. Blocks of a partition, at most, and vectors that are worth a partition. Rows of a matrix of distances. Pairs of one label at a time.
WIDE, COPIES, BLOCKS, FEW, TILE, MATCHES = 1 << 22, 8, 16, 1024, 128, 1 << 20
#: Squared distances below this share of the squared lengths are computed from differences: the product loses too many digits there.
NEAR = 1e-3


class Block(NamedTuple):
    """times: rows of the table that a vector stands for; columns: other columns of all these rows, in order."""

    id: int
    vectors: np.ndarray
    times: np.ndarray
    columns: dict[str, pa.Array]


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    vectors = table.column(column).combine_chunks()
    lengths = set(vectors.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError("vectors differ in size")
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)


def _packed(rows: DataFrame, side: str, merge: bool = False) -> DataFrame:
    """Rows (vector, and other columns) as blocks, dealt out evenly in the shared folder; its columns begin with side.

    With merge, equal vectors are brought together as far as partitions and
    blocks stay small, and are one vector of a block.
    """
    ship(rows.sparkSession)
    others = [f for f in rows.schema.fields if f.name != "vector"]
    block, full = BLOCK, BLOCK * (COPIES if merge else 1)

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        m = _matrix(table, "vector")
        new = np.ones(len(m), dtype=bool)
        if merge:
            new[1:] = ~(m[1:] == m[:-1]).all(axis=1)
        starts = np.append(np.flatnonzero(new), len(m))
        step = max(1, min(block, WIDE // max(1, 8 * m.shape[1])))
        for at in range(0, len(starts) - 1, step):
            own = starts[at : at + step + 1]
            vectors = np.ascontiguousarray(m[own[:-1]])
            lengths = np.sqrt((vectors * vectors).sum(axis=1))
            part = table.slice(own[0], own[-1] - own[0])
            values = [part.column(f.name).combine_chunks() for f in others]
            yield pa.RecordBatch.from_pydict({
                "size": pa.array([m.shape[1]], pa.int32()), "longest": pa.array([max(lengths[~np.isnan(lengths)], default=0.0)], pa.float64()),
                "vectors": pa.array([vectors.tobytes()], pa.binary()), "times": pa.array([np.diff(own).astype(np.int64).tobytes()], pa.binary()),
            } | {f.name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for f, v in zip(others, values, strict=True)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= full:
                table = pa.Table.from_batches(held)
                while table.num_rows >= full:
                    yield from blocks(table.slice(0, full))
                    table = table.slice(full)
                held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield from blocks(pa.Table.from_batches(held))

    if merge:
        rows = rows.withColumn("_hash", F.xxhash64("vector")).hint("rebalance", F.col("_hash")).sortWithinPartitions("_hash").drop("_hash")
    kinds = [f"`{f.name}` array<{f.dataType.simpleString()}>" for f in others]
    made = cut(rows.mapInArrow(pack, ", ".join(["size int, longest double, vectors binary, times binary", *kinds])).withColumn("id", F.monotonically_increasing_id()))
    n, vectors = made.agg(F.count("*"), F.coalesce(F.sum(F.length("times") / 8), F.lit(0))).first()
    some = min(int(np.ceil(2 * np.sqrt(rows.sparkSession.sparkContext.defaultParallelism))), -(-int(vectors) // FEW))
    parts = max(-(-n // BLOCKS), min(n, some), 1)
    return cut(made.repartition(parts)).select(*[F.col(c).alias(side + c) for c in made.columns])


def _crossed(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs of blocks, by pairs of partitions: neither side is shuffled or sent whole."""
    return left.hint("shuffle_replicate_nl").join(right, F.lit(True) if condition is None else condition)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block]]:
    """The pairs of blocks in batches of _crossed(), of sides x_ and y_."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            sides = []
            for side in ("x_", "y_"):
                of = {c.removeprefix(side): v for c, v in row.items() if c.startswith(side)}
                vectors = np.frombuffer(of.pop("vectors").as_buffer(), dtype=np.float64).reshape(-1, of.pop("size").as_py())
                times = np.frombuffer(of.pop("times").as_buffer(), dtype=np.int64)
                of.pop("longest")
                sides.append(Block(of.pop("id").as_py(), vectors, times, {c: v.values for c, v in of.items()}))
            yield sides[0], sides[1]


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of TILE rows of a at a time to all of b, and the first one's place."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors differ in size")
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # |a|² and |b|² are two more places of the product
    left, right = np.column_stack([a, own, np.ones(len(a))]), np.vstack([-2 * b.T, np.ones(len(b)), other])
    near = NEAR * (own.max() + other.max())
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    for first in range(0, len(a), TILE):
        rows = slice(first, first + TILE)
        out = left[rows] @ right
        if not out.min() > near:
            some = ~(out > near)
            i, j = np.nonzero(some if some.mean() < 0.02 else ~(out > NEAR * (own[rows, None] + other)))
            close = ~(out[i, j] > NEAR * (own[rows][i] + other[j]))
            i, j = i[close], j[close]
            for at in range(0, len(i), step):
                x, y = i[at : at + step], j[at : at + step]
                out[x, y] = ((a[rows][x] - b[y]) ** 2).sum(axis=1)
        yield first, out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.concatenate([out for _, out in _tiles(a, b)])) if len(a) and len(b) else np.empty((len(a), len(b)))


def _codes(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different value of two arrays; -1 for null."""
    both = pa.concat_arrays([x, y]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return both[: len(x)], both[len(x) :]


class _Matches:
    """Pairs of vectors of two blocks that stand for rows of one label."""

    def __init__(self, x: Block, y: Block) -> None:
        sides = []
        for block, codes in zip((x, y), _codes(x.columns["label"], y.columns["label"]), strict=True):
            each, n = np.unique(np.stack([np.repeat(np.arange(len(block.times)), block.times), codes])[:, codes >= 0], axis=1, return_counts=True)
            sides.append((*each, n))
        (self.x, codes, self.nx), (y_rows, y_codes, ny) = sides
        order = np.argsort(y_codes, kind="stable")
        self.y, self.ny = y_rows[order], ny[order]
        self.lo = np.searchsorted(y_codes[order], codes, "left")
        self.k = np.searchsorted(y_codes[order], codes, "right") - self.lo

    def of(self, first: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row (from first), column and number of pairs of table rows, some MATCHES at a time."""
        at, end = np.searchsorted(self.x, [first, first + rows])
        upto = np.cumsum(self.k[at:end])
        while at < end:
            done = upto[len(upto) - (end - at) - 1] if len(upto) > end - at else 0
            stop = max(at + 1, end - len(upto) + int(np.searchsorted(upto, done + MATCHES, "right")))
            k = self.k[at:stop]
            places = np.repeat(self.lo[at:stop] - np.cumsum(k) + k, k) + np.arange(k.sum())
            if len(places):
                yield np.repeat(self.x[at:stop] - first, k), self.y[places], np.repeat(self.nx[at:stop], k) * self.ny[places]
            at = stop


def _sides(queries: DataFrame, protos: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = queries.select("label").union(protos.select("label")).schema["label"].dataType
    side = lambda df, c: df.select(F.col("label").cast(kind).alias("label"), F.col(c).cast("array<double>").alias("vector"))
    return _packed(side(queries, "embedding"), "x_", merge=True), _packed(side(protos, "prototype"), "y_", merge=True)


def claims(queries: DataFrame, protos: DataFrame, digits: int = 6) -> DataFrame:
    """score (minus distance, rounded), genuine, and n: how many queries (label, embedding) have it with a prototype (label, prototype).

    Every query claims every label. Scores are counted where they are made.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _met(batches):
            matches = _Matches(x, y)
            for first, out in _tiles(x.vectors, y.vectors):
                value, at = np.unique(np.round(-np.sqrt(out), digits).ravel(), return_inverse=True)
                g = np.zeros(out.shape)
                for i, j, n in matches.of(first, len(out)):
                    np.add.at(g, (i, j), n)
                every = np.outer(x.times[first : first + len(out)], y.times)
                for kind, n in ((True, g), (False, every - g)):
                    times = np.bincount(at, n.ravel(), len(value)).astype(np.int64)
                    some = times > 0
                    yield pa.RecordBatch.from_pydict({"score": value[some], "genuine": np.full(some.sum(), kind), "n": times[some]})

    return _crossed(*_sides(queries, protos)).mapInArrow(count, "score double, genuine boolean, n bigint")


Range = tuple[int, int, int]  # from, to (not in it), width of a bin


def _ranges(spans: list[tuple[int, int]], bins: int) -> list[Range]:
    each = max(2, bins // len(spans))  # two at least, so that every round divides
    return [(lo, hi, -(-(hi - lo) // each)) for lo, hi in spans]


def _counted(left: DataFrame, right: DataFrame, ranges: list[Range], digits: int, full: bool) -> list[tuple[int, int, int, int]]:
    """From, to, genuine and impostor scores of each bin of the ranges that has some, in order; scores are whole numbers of 10^-digits. full: one range, and it has all of them."""
    unit = 10.0**digits
    # squared distances that scores of the ranges can have, and a little more
    least, most = min(r[0] for r in ranges), max(r[1] for r in ranges)
    near, far = max(0.0, -most / unit) ** 2 * (1 - 1e-9), max(0.0, (1 - least) / unit) ** 2 * (1 + 1e-9)
    sizes = [-(-(hi - lo) // width) for lo, hi, width in ranges]

    def add(totals: list[np.ndarray], squares: np.ndarray, n: np.ndarray | None, room: np.ndarray) -> None:
        """Counts squared distances, which are overwritten; room: for their bins, so that memory is not asked for again and again."""
        whole = np.sqrt(squares, out=squares)
        whole *= -unit
        np.rint(whole, out=whole)
        for total, (lo, hi, width), size in zip(totals, ranges, sizes, strict=True):
            if full and lo > -(1 << 53):  # division of such numbers is exact where it has to be
                whole -= lo
                whole /= width
                at, weight = room[: len(whole)] if len(whole) <= len(room) else np.empty(len(whole), dtype=np.int64), n
                np.copyto(at, whole, casting="unsafe")
            else:
                places = whole.astype(np.int64)
                inside = (places >= lo) & (places < hi)
                at, weight = (places[inside] - lo) // width, None if n is None else n[inside]
            total += np.bincount(at, weight, size).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, genuine = ([np.zeros(size, dtype=np.int64) for size in sizes] for _ in range(2))
        room = np.empty(0, dtype=np.int64)
        for x, y in _met(batches):
            matches = _Matches(x, y)
            once = x.times.max() == y.times.max() == 1
            room = room if len(room) >= TILE * len(y.times) else np.empty(TILE * len(y.times), dtype=np.int64)
            for first, out in _tiles(x.vectors, y.vectors):
                own = x.times[first : first + len(out)]
                flat = out.ravel()
                for i, j, n in matches.of(first, len(out)):
                    found = out[i, j]
                    good = (found >= near) & (found <= far)
                    add(genuine, found[good], n[good], room)
                if full and flat.max() <= far:
                    add(every, flat, None if once else np.outer(own, y.times).ravel(), room)
                else:
                    at = np.flatnonzero((flat >= near) & (flat <= far))  # no NaN
                    add(every, flat[at], None if once else own[at // len(y.times)] * y.times[at % len(y.times)], room)
        for k, (g, n) in enumerate(zip(genuine, every, strict=True)):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": np.full(len(some), k), "bin": some, "g": g[some], "m": n[some] - g[some]})

    made = _crossed(left, right).mapInArrow(count, "k bigint, bin bigint, g bigint, m bigint")
    # a row a bin at most
    found = sorted(tuple(r) for r in made.groupBy("k", "bin").agg(F.sum("g"), F.sum("m")).collect())
    place = lambda k, b: (ranges[k][0] + b * ranges[k][2], min(ranges[k][1], ranges[k][0] + (b + 1) * ranges[k][2]))
    return [(*place(k, b), g, m) for k, b, g, m in found]


def equal_error_rate(queries: DataFrame, protos: DataFrame, digits: int = 6, bins: int = BINS) -> DataFrame:
    """threshold, low, high and eer of claims of every label by every query, as metrics.eer() of claims() says; one row.

    Scores are counted in bins inside the tasks. Only the bins around the place
    where the curves cross (that of the crossing, and the next ones on both
    sides that have scores) are divided again, until a bin is one score: the
    result is exact, and a round moves at most `bins` rows a task. If the curves
    never cross, or there are no scores of a kind, rates are 1 and the threshold is null.
    """
    spark = queries.sparkSession
    left, right = _sides(queries, protos)
    longest = lambda df, c: df.agg(F.max(c)).first()[0] or 0.0
    least = -int(np.ceil((longest(left, "x_longest") + longest(right, "y_longest")) * (1 + 1e-9) * 10.0**digits)) - 2
    ranges, below, total = _ranges([(least, 1)], bins), (0, 0), None
    best = None
    while ranges:
        rows = _counted(left, right, ranges, digits, full=total is None)
        total = total or (sum(r[2] for r in rows), sum(r[3] for r in rows))
        if not all(total):
            break
        g, m, k, before = *below, None, []
        for i, row in enumerate(rows):
            before.append((g, m))
            g, m = g + row[2], m + row[3]
            if k is None and (total[1] - m) / total[1] <= g / total[0]:
                k = i
        before.append((g, m))
        if k is None:
            break
        # the curves cross behind the first score of bin k: at another one of it, or at the first one of the next bin
        near = range(max(0, k - 1), min(len(rows), k + 2))
        if all(rows[i][1] - rows[i][0] == 1 for i in near):
            point = lambda i: (rows[i][0] / 10.0**digits, (total[1] - before[i][1]) / total[1], before[i][0] / total[0])  # noqa: B023, E731
            crossed = [i for i in near if point(i)[1] <= point(i)[2]]
            if crossed:
                c = point(crossed[0])
                b = point(crossed[0] - 1) if crossed[0] else None
                best = b if b and c[1] != c[2] and b[1] + b[2] <= c[1] + c[2] else c
            break
        below = before[near[0]]
        ranges = _ranges([rows[i][:2] for i in near], bins)
    row = (None, 1.0, 1.0, 1.0) if best is None else (best[0], min(best[1:]), max(best[1:]), (best[1] + best[2]) / 2)
    return spark.createDataFrame([row], "threshold double, low double, high double, eer double")


def _own_pairs(embeddings: DataFrame, key: str) -> DataFrame:
    """Pairs of blocks of a set of vectors, each once, and each block with itself. Rows without a key are in no pair."""
    rows = embeddings.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    left = _packed(rows, "x_")
    right = left.select(*[F.col(c).alias(c.replace("x_", "y_", 1)) for c in left.columns])
    return _crossed(left, right, F.col("x_id") <= F.col("y_id"))


def pair_scores(embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
    """score (minus distance) and genuine (null if a label is) of all unordered pairs (a < b) of a set of vectors that is evaluated as a whole."""
    kind = embeddings.schema[key].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _met(batches):
            whole = x.columns["key"].type
            kx, ky = (b.columns["key"].to_numpy(zero_copy_only=False) for b in (x, y))
            lx, ly = _codes(x.columns["label"], y.columns["label"])
            for first, out in _tiles(x.vectors, y.vectors):
                own = kx[first : first + len(out)]
                i, j = np.nonzero(own[:, None] < ky[None, :] if x.id == y.id else own[:, None] != ky[None, :])
                a, b, of, other = own[i], ky[j], lx[first + i], ly[j]
                columns = [pa.array(np.where(a < b, a, b), whole), pa.array(np.where(a < b, b, a), whole), pa.array(-np.sqrt(out[i, j])), pa.array(of == other, mask=(of < 0) | (other < 0))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "score", "genuine"])

    return _own_pairs(embeddings, key).mapInArrow(meet, f"a {kind}, b {kind}, score double, genuine boolean")


def pair_statistics(embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
    """genuine, pairs, mean, least and most of the scores of pair_scores(), which are summed up where they are made: no pair leaves a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool | None, list[tuple[int, float, float, float]]] = {True: [], False: [], None: []}

        def put(kind: bool | None, n: int, total: float, least: float, most: float) -> None:
            rows = found[kind]
            rows.append((n, total, least, most))
            if len(rows) >= 10_000:
                rows[:] = [merged(rows)]

        def merged(rows: list[tuple[int, float, float, float]]) -> tuple[int, float, float, float]:
            n, total, least, most = zip(*rows, strict=True)
            return sum(n), float(np.sum(total)), float(np.fmin.reduce(least)), float(np.max(most))

        for x, y in _met(batches):
            lx, ly = _codes(x.columns["label"], y.columns["label"])
            kx, ky = _codes(x.columns["key"], y.columns["key"])
            # by label, so that the pairs of one are a rectangle
            ox, oy = np.argsort(lx, kind="stable"), np.argsort(ly, kind="stable")
            lx, ly, kx, ky = lx[ox], ly[oy], kx[ox], ky[oy]
            left_out = x.id == y.id or len(np.intersect1d(kx, ky)) > 0
            for first, out in _tiles(x.vectors[ox], y.vectors[oy]):
                rows = slice(first, first + len(out))
                of = lx[rows]
                np.negative(np.sqrt(out, out=out), out=out)
                if left_out or of[0] < 0 or ly[0] < 0 or np.isnan(out.min()):
                    taken = kx[rows, None] != ky
                    if x.id == y.id:
                        taken &= ox[rows, None] < oy
                    known, same = (of[:, None] >= 0) & (ly >= 0), of[:, None] == ly
                    for kind, those in ((True, taken & known & same), (False, taken & known & ~same), (None, taken & ~known)):
                        some = out[those]
                        if len(some):
                            put(kind, len(some), some.sum(), np.fmin.reduce(some), some.max())
                    continue
                labels, starts = np.unique(of, return_index=True)
                bands = list(zip(starts, [*starts[1:], len(of)], np.searchsorted(ly, labels, "left"), np.searchsorted(ly, labels, "right"), strict=True))
                bands = [(a, b, c, d) for a, b, c, d in bands if c < d]
                inside = 0
                for a, b, c, d in bands:
                    part = out[a:b, c:d]
                    put(True, part.size, part.sum(), part.min(), part.max())
                    inside += part.size
                if inside < out.size:
                    ends = []
                    for fill, f in ((0.0, np.sum), (np.inf, np.min), (-np.inf, np.max)):
                        for a, b, c, d in bands:
                            out[a:b, c:d] = fill
                        ends.append(f(out))
                    put(False, out.size - inside, *ends)
        rows = [(kind, *merged(found[kind])) for kind in found if found[kind]]
        if rows:
            kinds = [pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["genuine", "n", "total", "least", "most"])

    each = _own_pairs(embeddings, key).mapInArrow(sums, "genuine boolean, n bigint, total double, least double, most double")
    return each.groupBy("genuine").agg(F.sum("n").alias("pairs"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))
