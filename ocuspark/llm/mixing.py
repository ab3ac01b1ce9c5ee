"""Mixing sources to target weights. Native: DataFrame functions only.

Each source's words are one stream, its documents in the order of a hash, and
the stream is packed into blocks of `BLOCK` words. Its target is a number of
slots. The mix is a row of output shards of about `SHARD` slots. How many slots
of each source a shard gets is a multinomial draw, given that all shards
together meet the targets: each slot of a source draws its shard, all shards
being equally likely. (A free draw would miss the targets of small tables.)
A source's slots are mapped to its blocks by a pseudorandom permutation of
block numbers, a new one each time the source has been used up. Slots and
blocks are joined by number.

No step collects a source: positions in a stream come from sums over `SPREAD`
hash buckets of each source and a running sum inside a bucket, and slots are
made from ranges of `RANGE`, which are dealt out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .job import cut, shuffle_partitions

BLOCK, SHARD, SPREAD, RANGE, MAX_EPOCHS, SEED = 32, 1024, 1024, 4096, 3, 20

# Primes, the multipliers of the permutations; one that does not divide the number of blocks is taken.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103)


def word_count(text: Column) -> Column:
    """Number of words that white space separates; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): number (from 0, by code point, null last), weight and target of each source.

    Weights are 1, 2, 3, repeating. Targets share the total by weight and stop
    at MAX_EPOCHS times the size; what is over goes to the others by weight.
    That is the level L for which min(cap, L * weight) adds up to the total.
    One row for each source: a table of the size of the mix's configuration.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number")
    everything = Window.partitionBy()
    numbered = (
        sizes.withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", (F.col("number") % 3 + 1).cast("double"))
        .withColumn("cap", MAX_EPOCHS * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    below = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - below) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = numbered.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))
    return levels.withColumn("level", F.min(fits).over(everything)["level"]).select(
        "source", "source_size", F.col("number").cast("int").alias("number"), "weight", "total", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Place of each row in its source's stream of words, and the sources with their targets.

    Rows: doc_id, source number, bucket, nth (with the number and bucket: a key), first_word, size,
    source_size, target. Null texts and sizes of 0 keep their rows.
    """
    sized = cut(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .withColumn("order", F.xxhash64(F.lit(SEED), "doc_id"))
        .withColumn("bucket", F.pmod("order", F.lit(SPREAD)).cast("int"))
    )
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = cut(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "number", "source_size", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
    placed = sized.withColumns(
        {"nth": F.row_number().over(inside), "ahead": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    ).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = placed.select("doc_id", "number", "bucket", "nth", (F.col("bucket_start") + F.col("ahead")).alias("first_word"), "size", "source_size", "target")
    return rows, sources


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row for each slot of the mix: shard, number, slot (of the source), block.

    Sources of no words have no slots. A source is used MAX_EPOCHS times at most.
    """
    whole = lambda c: F.round(c).cast("long")
    config = (
        sources.where("source_size > 0")
        .withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("slots", F.least(whole(F.col("target") / block), MAX_EPOCHS * F.col("n_blocks")))
        .withColumn("shards", F.greatest(whole(F.col("total") / (block * shard)), F.lit(1)))
        .where("slots > 0")
        .select("number", "n_blocks", "slots", "shards")
    )
    ranges = config.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(RANGE).cast("long"))))
    dealt = ranges.repartition(shuffle_partitions(sources.sparkSession), "number", "first")
    each = dealt.withColumn("slot", F.explode(F.sequence(F.col("first"), F.least(F.col("slots"), F.col("first") + RANGE) - 1)))
    each = each.withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks")).cast("long"))
    factor = F.coalesce(*[F.when(F.col("n_blocks") % p != 0, F.lit(p)) for p in PRIMES], F.lit(1))
    shift = F.pmod(F.xxhash64(F.lit(SEED), "number", "epoch"), F.col("n_blocks"))
    wide = lambda c: c.cast("decimal(19,0)")
    place = ((wide(F.col("slot") % F.col("n_blocks")) * wide(factor % F.col("n_blocks")) + wide(shift)) % wide(F.col("n_blocks"))).cast("long")
    return each.select(F.pmod(F.xxhash64(F.lit(SEED), "number", "slot"), F.col("shards")).alias("shard"), "number", "slot", place.alias("block"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row once for each block that it has words in: block (null without words) and overlap."""
    first, end = F.col("first_word"), F.col("first_word") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(first / block).cast("long"), F.floor((end - 1) / block).cast("long")))
    overlap = F.least(end, (F.col("block") + 1) * block) - F.greatest(first, F.col("block") * block)
    return rows.withColumn("block", F.explode_outer(blocks)).withColumn("overlap", F.coalesce(overlap, F.lit(0)))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs.

    taken: words of the row that the mix has, repeats counted; at most
    MAX_EPOCHS times its size. Null and empty texts have size and taken 0; a
    null source is a source of its own; repeated rows are rows of their own; a
    table without words gives targets and taken of 0. Other columns are not read.
    """
    rows, sources = streams(docs)
    # merge: by what it knows of the sources, Spark would take the slots for a few rows
    times = slots(sources).groupBy("number", "block").agg(F.count("*").alias("times")).hint("merge")
    joined = pieces(rows).join(times, ["number", "block"], "left")
    of_row = joined.groupBy("number", "bucket", "nth", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("overlap") * F.col("times")), F.lit(0)).cast("long").alias("taken")
    )
    return of_row.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: shard, number, slot, and in word order doc_id, from_word and n_words of each piece in the slot's block."""
    rows, sources = streams(docs)
    start = F.greatest(F.col("block") * BLOCK - F.col("first_word"), F.lit(0))
    parts = pieces(rows).where("block is not null").select("number", "block", "first_word", "doc_id", start.alias("from_word"), F.col("overlap").alias("n_words"))
    return slots(sources).hint("merge").join(parts, ["number", "block"]).drop("block")
