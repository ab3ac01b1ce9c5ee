"""Targets: extraction, configuration, splits and few-shot episodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions.columns import one_hot, shuffled
from ..session import cut
from .ranks import ranked


def extract(df: DataFrame, field: str) -> DataFrame:
    """One field of the samples as strings, with their place."""
    return df.select("pos", F.col(field).cast("string").alias("target"))


def configuration(samples: DataFrame) -> DataFrame:
    """name, skip (that of the name's last sample) and pos (of its first); names that are null are left out."""
    return samples.where("name is not null").groupBy("name").agg(F.max_by("skip", "pos").alias("skip"), F.min("pos").alias("pos"))


def annotate(config: DataFrame, split: DataFrame) -> DataFrame:
    """configuration() with the dataset_type of each name; names of no split are left out."""
    return config.join(split.select("name", F.col("split").alias("dataset_type")), "name")


def index(config: DataFrame) -> DataFrame:
    """Contiguous idx over the names that are not skipped, in order of pos."""
    return ranked(config.where("not skip"), ["pos", "name"]).withColumnRenamed("rank", "idx").drop("n")


def lookup(samples: DataFrame, indexed: DataFrame) -> DataFrame:
    """Samples with the idx of their name; an error for a name that has none."""
    found = samples.join(indexed.select("name", "idx"), "name", "left")
    return found.withColumn("idx", F.when(F.col("idx").isNull(), F.raise_error(F.concat(F.lit("no index for "), F.coalesce("name", F.lit("null"))))).otherwise(F.col("idx")))


def at_index(indexed: DataFrame, idx: Sequence[int]) -> DataFrame:
    """Names of the given indexes; strict: an index out of range is an error."""
    n = indexed.count()
    if bad := [i for i in idx if not 0 <= i < n]:
        raise IndexError(f"{bad} not in 0..{n - 1}")
    return indexed.where(F.col("idx").isin(*idx))


def construct(requests: DataFrame, indexed: DataFrame) -> DataFrame:
    """requests (target: ids or names) with a struct (id, name) of each; what the configuration does not have stays null."""
    kind = requests.schema["target"].dataType
    if isinstance(kind, IntegralType):
        by, found = "idx", F.struct(F.col("target").cast("bigint").alias("id"), F.col("name"))
    elif isinstance(kind, StringType):
        by, found = "name", F.struct(F.col("idx").alias("id"), F.col("target").alias("name"))
    else:
        raise TypeError(f"a target is an id or a name, not {kind.simpleString()}")
    return requests.join(indexed.select("idx", "name"), F.col("target") == F.col(by), "left").select(*requests.columns, found.alias("constructed"))


def by_dataset_type(config: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each dataset type with the idx and name of its targets; a type whose targets are all skipped has nulls."""
    types = config.select("dataset_type").distinct()
    checked = types.withColumn("dataset_type", F.when(F.col("dataset_type").isNull(), F.raise_error(F.lit("a target has no dataset_type"))).otherwise(F.col("dataset_type")))
    return checked.join(indexed.select("dataset_type", "idx", "name"), "dataset_type", "left")


def one_hot_rows(indexed: DataFrame) -> DataFrame:
    """name and its one-hot array as rows k, v."""
    n = indexed.groupBy().agg(F.count("*").cast("int").alias("n")).withColumn("j", F.lit(0))
    wide = indexed.withColumn("j", F.lit(0)).join(F.broadcast(n), "j")
    hot = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: (k == F.col("idx")).cast("int"))
    return wide.select("name", F.posexplode(hot).alias("k", "v"))


def one_hot_column(idx: Column, n: int) -> Column:
    return one_hot(idx, n)


def proportions(splits: Mapping[str, float], targets: int | None = None, min_targets: int = 1) -> dict[str, float]:
    """Shares that add up to 1; counts become shares. Raises for names or numbers that make no split."""
    total = sum(splits.values())
    if any(v < 0 for v in splits.values()) or total <= 0:
        raise ValueError("split sizes must be 0 or more, and one of them above 0")
    shares = {k: v / total for k, v in splits.items()}
    if targets is not None:
        if targets < len(splits):
            raise ValueError(f"{targets} targets for {len(splits)} splits")
        if min(int(targets * v) for v in shares.values()) < min_targets:
            raise ValueError(f"a split gets fewer than {min_targets} of {targets} targets")
    return shares


def _slices(ranked: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """split of each name by its rank (from 0) among n: slices at the whole part of n times the cumulated shares."""
    split, reached = F.lit(None).cast("string"), 0.0
    bounds = []
    for name, share in shares.items():
        reached += share
        bounds.append((name, round(reached, 9)))
    for name, bound in reversed(bounds):
        split = F.when(F.col("rank") < F.floor(F.col("n") * F.lit(bound) + 1e-9), F.lit(name)).otherwise(split)
    return ranked.withColumn("split", split).select("name", "split")


def ordered_split(samples: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """Names by descending number of samples, ties by first sample, in slices."""
    counts = samples.groupBy("name").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    return _slices(ranked(counts, [F.col("c").desc(), F.col("p")]), shares)


def random_split(samples: DataFrame, shares: Mapping[str, float], seed: int) -> DataFrame:
    """Names shuffled by a hash of the seed and the name, in slices."""
    names = samples.select("name").distinct()
    return _slices(ranked(names, [shuffled(seed, F.col("name")), F.col("name")]), shares)


def split_samples(samples: DataFrame, split: DataFrame) -> DataFrame:
    """Samples with their split; those of a name in no split are left out. Equal types of the names are checked."""
    if samples.schema["name"].dataType != split.schema["name"].dataType:
        raise TypeError("names of samples and of the split differ in type")
    return samples.join(split.where("split is not null"), "name")


def split_report(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split").agg(F.count("*").alias("samples"), F.countDistinct("user_id").alias("users"))


def time_split(records: DataFrame, gap: str) -> DataFrame:
    """role of each record (user_id, ts, …): template, or authentication from `gap` after the user's first record on.

    Users with no such later record are left out.
    """
    w = Window.partitionBy("user_id")
    roles = records.withColumn("role", F.when(F.col("ts") >= F.min("ts").over(w) + F.expr(f"interval {gap}"), "authentication").otherwise("template"))
    return roles.withColumn("late", F.max((F.col("role") == "authentication").cast("int")).over(w)).where("late = 1").drop("late")


def time_based_split(records: DataFrame, shares: Mapping[str, float], gap: str, seed: int, late: str = "test") -> DataFrame:
    """records (user_id, ts, …) with the split of their user, and a role (template or authentication) in the split `late`.

    That split takes its share of the users from those with records at least
    `gap` apart, and so with two records or more; fewer, if there are not as
    many. All other users are dealt to the other splits by their shares. Users
    are in the order of a hash of the seed; no user is in two splits.
    """
    if late not in shares:
        raise ValueError(f"{late} is none of {', '.join(shares)}")
    spans = records.groupBy("user_id").agg((F.max("ts") >= F.min("ts") + F.expr(f"interval {gap}")).alias("apart"))
    order = [shuffled(seed, F.col("user_id")), F.col("user_id")]
    everyone = ranked(spans, [F.col("apart").desc(), *order])
    chosen = F.col("apart") & (F.col("rank") < F.floor(F.col("n") * F.lit(shares[late]) + 1e-9))
    marked = cut(everyone.select("user_id", chosen.alias("chosen")))
    rest = ranked(marked.where("not chosen").select("user_id"), order).withColumnRenamed("user_id", "name")
    others = {k: v for k, v in shares.items() if k != late}
    dealt = _slices(rest, {k: v / sum(others.values()) for k, v in others.items()}).withColumnRenamed("name", "user_id")
    users = marked.where("chosen").select("user_id", F.lit(late).alias("split")).unionByName(dealt.where("split is not null"))
    first = F.min("ts").over(Window.partitionBy("user_id"))
    role = F.when(F.col("split") == late, F.when(F.col("ts") >= first + F.expr(f"interval {gap}"), "authentication").otherwise("template"))
    return records.join(users, "user_id").withColumn("role", role)


def episodes(items: DataFrame, k_way: int, n_shot: int, iterations: int, seed: int) -> DataFrame:
    """episode, label, item: k_way random labels an episode, n_shot of each label's items.

    A label with fewer items gives some of them again. Only the items of the
    chosen labels meet an episode; labels are a small table.
    """
    labels = items.groupBy("label").agg(F.count("*").alias("size"))
    per = labels.withColumn("episode", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    by_label = Window.partitionBy("episode").orderBy(shuffled(seed, F.col("episode"), F.col("label")), "label")
    ways = per.withColumn("way", F.row_number().over(by_label)).where(F.col("way") <= k_way)
    met = ways.select("episode", "label", "size").join(items.select("label", "item"), "label")
    by_item = Window.partitionBy("episode", "label").orderBy(shuffled(seed, F.col("episode"), F.col("label"), F.col("item")), "item")
    ranked = met.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= n_shot)
    # round and round if there are not enough
    repeats = F.sequence(F.lit(0), F.floor((n_shot - F.col("rank")) / F.col("size")).cast("int"))
    return ranked.withColumn("turn", F.explode(repeats)).select("episode", "label", "item", (F.col("rank") + F.col("turn") * F.col("size")).cast("bigint").alias("shot"))


def prototypical_episodes(items: DataFrame, k_way: int, n_support: int, n_query: int, iterations: int, seed: int) -> DataFrame:
    """episodes() with a role: the first n_support shots of a label are support, the others query."""
    drawn = episodes(items, k_way, n_support + n_query, iterations, seed)
    return drawn.withColumn("role", F.when(F.col("shot") <= n_support, "support").otherwise("query"))
