"""Chains of operators that a study runs as one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import embedder as E
from ..operators import prototypes as P
from ..operators import segments as G
from ..operators import signal as S
from ..operators import targets as T
from ..operators.pairs import equal_error_rate
from ..session import cut
from ..sources import files

def _by_time(samples: DataFrame, shares: Mapping[str, float], seed: int, gap: str = "14 days", late: str = "test") -> DataFrame:
    """Names, as users, by the time between their samples; see targets.time_based_split()."""
    records = samples.where("name is not null").select(F.col("name").alias("user_id"), "ts")
    return T.time_based_split(records, shares, gap, seed, late).select(F.col("user_id").alias("name"), "split").distinct()


SCHEMES: dict[str, Callable[..., DataFrame]] = {"random": T.random_split, "ordered": lambda samples, shares, seed: T.ordered_split(samples, shares), "time_based": _by_time}


def generate_targets(samples: DataFrame, splits: Mapping[str, float], seed: int = 11, scheme: str = "random", min_targets: int = 1, path: str | None = None, **options: str) -> DataFrame:
    """Configuration of the targets of samples (pos, name, skip): extracted, split and, with a path, written.

    Scheme time_based needs ts as well; its options are gap (an interval) and late (the split of later sessions).
    """
    if scheme not in SCHEMES:
        raise ValueError(f"{scheme} is none of {', '.join(SCHEMES)}")
    config = T.configuration(samples)
    shares = T.proportions(splits, config.count(), min_targets)
    done = T.annotate(config, SCHEMES[scheme](samples, shares, seed, **options))
    if path is not None:
        files.save_targets(done, path)
    return done


def collate(samples: DataFrame, indexed: DataFrame) -> DataFrame:
    """Samples with label names as indexes; scalar text and map columns are left out, as a batch has numbers only."""
    found = T.lookup(samples, indexed).withColumnRenamed("idx", "label")
    keep = [f.name for f in found.schema.fields if f.name == "label" or not (f.dataType.simpleString() == "string" or f.dataType.simpleString().startswith(("map", "struct")))]
    return found.select(*keep)


def preprocess(recordings: DataFrame, channels: list[str], window: int = 7, order: int = 3, rate: float = 1.0, beaten_ratio: float = 30.0, min_length: int = 500) -> DataFrame:
    """Clean, number anew, and smooth to velocities: session, i and the channels."""
    cleaned = S.clean(recordings, channels, beaten_ratio, min_length)
    numbered = cleaned.withColumn("i", (F.row_number().over(Window.partitionBy("session").orderBy("i")) - 1).cast("bigint"))
    return S.savgol(numbered, channels, window, order, "first_order", rate, "drop")


def segment_vectors(signals: DataFrame, channels: list[str], length: int, min_completeness: float = 1.0, fill: float | None = None) -> DataFrame:
    """guid, session, segment_idx and data: the channels of each segment, one after the other, z-scored by channel."""
    parts = None
    for k, c in enumerate(channels):
        one = G.nonoverlapping(signals, c, length, min_completeness, fill).withColumn("ch", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    w = Window.partitionBy("session", "segment_idx", "ch")
    z = parts.withColumn("z", F.coalesce(F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)), F.lit(0.0)))
    rows = z.groupBy("session", "segment_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "pos", "z"))), lambda r: r["z"]).alias("data"))
    return G.renumber(rows)


def embed_segments(vectors: DataFrame, model: E.Embedder) -> DataFrame:
    """vectors with their embedding, as rows vec_id, label (the session), embedding."""
    made = cut(vectors)
    found = E.embed(made, model).join(made.select("guid", "session"), "guid")
    return cut(found.select(F.col("guid").alias("vec_id"), F.col("session").alias("label"), "embedding"))


def predict_onto(samples: DataFrame, model: E.Embedder, support: DataFrame, indexed: DataFrame) -> DataFrame:
    """samples (guid, data, …) with predicted_label: id, name, probability and distance of the nearest prototype.

    Prototypes are those of support (label, embedding); names are those of
    indexed (idx, name), or null. Samples that the network can't take have null.
    """
    vectors = E.embed(samples, model).where("embedding is not null")
    best = P.predict(P.distances(vectors, P.prototypes(support)), "guid").withColumn("id", F.col("predicted").cast("bigint"))
    named = best.join(indexed.select(F.col("idx").alias("id"), F.col("name")), "id", "left")
    return samples.join(named.select("guid", F.struct("id", "name", "probability", "distance").alias("predicted_label")), "guid", "left")


def verify(embeddings: DataFrame, n_support: int) -> DataFrame:
    """Equal error rate (threshold, low, high, eer) of claims of all labels by all query vectors, prototypes from each label's first n_support vectors."""
    roles = P.support_and_query(embeddings, n_support)
    return equal_error_rate(roles.where("role = 'query'"), P.prototypes(roles.where("role = 'support'")), 12)


def dataset(samples: DataFrame, on_dataset: Sequence[Callable[[DataFrame], DataFrame]] = (), on_sample: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """samples after the caller's functions: those of the whole set in their order, then those of each sample's columns."""
    for f in on_dataset:
        samples = f(samples)
    return samples.withColumns({c: f(F.col(c)) for c, f in (on_sample or {}).items()})
