import re
import struct

import pytest
import xxhash
from ocuspark.llm import mixing as M
from ocuspark.llm.queries import op7_mixing
from pyspark.sql import functions as F

from .conftest import SMALL


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check(rows, docs, near=0.05):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, source = plain_targets(sizes), {d: s for d, _, s in docs}
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, size(t)) for d, t, _ in docs)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(near * want[s], 3 * M.BLOCK), s


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = op7_mixing(spark, SMALL).collect()
    check(rows, docs)
    assert sorted(map(tuple, op7_mixing(spark, SMALL).collect())) == sorted(map(tuple, rows))


def test_edges(spark):
    docs = [(i, "w " * (i % 90), s) for i, s in enumerate([None, "b", "a", "Z", "é", "b", "b", "b", "b", "b"] * 40)]
    docs += [(1000, None, "b"), (1001, "", "empty"), (1002, "x " * 40_000, "b"), (1003, " \t\n ", None)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, number int, size int")
    check(M.taken(df.repartition(5)).collect(), docs)
    twice = df.where("doc_id < 40").union(df.where("doc_id < 40"))
    assert M.taken(twice).count() == 80
    assert M.taken(df.limit(0)).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in M.taken(df.where("doc_id in (1000, 1001)")).collect())
    assert M.taken(df.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(docs)


def hashed(*values):
    """What Spark's xxhash64() gives for longs, and for ints given as strings."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", int(v)) if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_taken(docs):
    """taken of each document of (doc_id, size, source), by a plain walk through slots and blocks."""
    sizes = {}
    for _, n, s in docs:
        sizes[s] = sizes.get(s, 0) + n
    want, out = plain_targets(sizes), {}
    for number, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        stream = sorted((hashed(str(M.SEED), d) % M.SPREAD, hashed(str(M.SEED), d), d, n) for d, n, x in docs if x == s)
        words = [d for _, _, d, n in stream for _ in range(n)]
        blocks = [words[i : i + M.BLOCK] for i in range(0, len(words), M.BLOCK)]
        for slot in range(min(int(want[s] / M.BLOCK + 0.5), 3 * len(blocks))):
            epoch, nth = divmod(slot, len(blocks))
            factor = next(p for p in M.PRIMES if len(blocks) % p)
            if len(blocks) == 1:
                factor = 1
            for d in blocks[(nth * factor + hashed(str(M.SEED), str(number), epoch) % len(blocks)) % len(blocks)]:
                out[d] = out.get(d, 0) + 1
    return {d: out.get(d, 0) for d, _, _ in docs}


def test_taken_equals_a_plain_walk(spark):
    rows = op7_mixing(spark, SMALL).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source").collect()}
    assert {r.doc_id: r.taken for r in rows} == plain_taken([(r.doc_id, r.size, source[r.doc_id]) for r in rows])


def test_slots_are_permutations_of_blocks(spark):
    sources = spark.createDataFrame([(0, 3200, 9600.0, 40_000.0)], "number int, source_size long, target double, total double")
    by_epoch = {}
    for r in M.slots(sources).collect():
        by_epoch.setdefault(r.slot // 100, []).append(r.block)
    assert len(by_epoch) == 3 and all(sorted(b) == list(range(100)) for b in by_epoch.values())
    assert by_epoch[0] != by_epoch[1] and by_epoch[0] != sorted(by_epoch[0])


def test_counts_of_shards_are_drawn(spark):
    total = 64_000_000.0
    sources = spark.createDataFrame([(i, int(total), total * p, total) for i, p in enumerate((0.5, 0.3, 0.2))], "number int, source_size long, target double, total double")
    counts = M.slots(sources).groupBy("number", "shard").count().collect()
    shards = round(total / M.BLOCK / M.SHARD)
    for i, p in enumerate((0.5, 0.3, 0.2)):
        own = [r["count"] for r in counts if r.number == i]
        mean = total * p / M.BLOCK / shards
        assert len(own) == shards and sum(own) == round(total * p / M.BLOCK)
        spread = sum((n - mean) ** 2 for n in own) / shards
        assert 0.9 < spread / mean < 1.1  # as of independent draws; even shares would have none


def test_mixed_blocks_hold_what_is_taken(spark):
    docs = spark.createDataFrame([(i, "w " * (37 + i), f"s{i % 4}") for i in range(60)], "doc_id long, text string, source string")
    by_doc = {r.doc_id: r.n for r in M.mixed(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert by_doc == {r.doc_id: r.taken for r in M.taken(docs).collect() if r.taken}
