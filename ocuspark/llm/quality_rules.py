"""Quality rules: fixed rules on the words of a text, and an isolation forest on rule statistics.

Each document gets counts (words, symbols, repeated lines and windows, letter
cases and so on) in one pass. Documents that fail a fixed rule are rejected.
For the others, an isolation forest says how few random splits separate the
document from a sample; the share of splits becomes a score in (0, 1]. The
score above which a document is rejected comes from labelled rows: of scores
above which at most `clean_loss` of the rows with label 1 lie, the one that
rejects most rows with label 0, and the fewest others, is taken. Subsamples are
small, so that kinds of junk that make up a few hundredths of the rows are alone
in theirs and cannot hide behind each other. The forest splits on the make-up of
words; repeated lines and windows, which good texts hold as well, are left to
the fixed rules.

Bounds: the forest is fitted on at most `fit_rows` of the labelled rows that
pass the fixed rules, chosen by a hash of doc_id. The threshold comes from
counts by score over all of them, and every other count covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .job import beside, cut, ship

FIT_ROWS, TREES, SUBSAMPLE, CLEAN_LOSS, SEED = 8192, 200, 64, 0.001, 7
LEAST_GOOD, BINS = 64, 4096
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = K._table([(0x41, 0x5A)])
_PUNCT = K._table([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
_LINE = ~K._table([(0x0A, 0x0A)])
_LEADS = (np.arange(256) & 0xC0) != 0x80


def _within(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values by document: which are met more than once in it, and which are not the first of their kind."""
    key = K.mix(hashes ^ K.mix(doc.astype(np.uint64) + K.U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeated, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    repeated[order[1:][same]] = True
    later[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return repeated, later


def counts(batch_text: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text; a null or empty text has zeros."""
    data, offsets = K.text_bytes(batch_text)
    words = K.Words(data, offsets, K.SPACED, fold=False)
    n = len(offsets) - 1

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[offsets])

    lines = K.Words(data, offsets, _LINE, fold=False)
    first_word = np.searchsorted(words.start, lines.start)
    worded = (first_word < len(words)) & (np.append(words.start, np.iinfo(np.int64).max)[first_word] < lines.end)
    line_doc = lines.doc[worded]
    _, later_line = _within(line_doc, lines.hash[worded]) if len(line_doc) else (None, np.empty(0, dtype=bool))
    at, triples = words.windows(3)
    repeated, _ = _within(words.doc[at], triples)
    covered = K.cover(at[repeated], 3, len(words))
    per_doc = lambda flags, doc: np.bincount(doc[flags], minlength=n)
    inside = K.SPACED[data]
    return {
        "n_words": words.per_doc,
        "word_chars": total(inside & _LEADS[data]),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": per_doc(later_line, line_doc),
        "n_repeat_words": per_doc(covered, words.doc),
        "n_upper": total(_UPPER[data]),
        "n_punct": total(_PUNCT[data]),
        "n_bangs": total(data == 0x21),
    }


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: square roots of shares and means, one row for each text."""
    w, ch = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    shares = np.stack(
        [
            c["word_chars"] / w,
            np.minimum(c["n_symbols"] / w, 3),
            c["n_upper"] / ch,
            c["n_punct"] / ch,
            np.minimum(c["n_bangs"] / w, 3),
        ],
        axis=1,
    )
    return np.sqrt(shares.astype(np.float64))


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


@dataclass
class Forest:
    """Random axis-parallel splits; trees as arrays, one row each, child 0 of node i is 2i + 1."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray  # at leaves: depth and the mean further depth of the rows there; else 0
    norm: float
    threshold: float = np.inf

    @staticmethod
    def _mean_depth(n: np.ndarray | float) -> np.ndarray:
        n = np.asarray(n, dtype=np.float64)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature, split, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
            while todo:
                node, level, rows = todo.pop()
                spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
                if level == depth or not len(spread):
                    length[t, node] = level + float(cls._mean_depth(len(rows)))
                    continue
                f = rng.choice(spread)
                at = rng.uniform(rows[:, f].min(), rows[:, f].max())
                feature[t, node], split[t, node] = f, at
                left = rows[:, f] <= at
                todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
        return cls(feature, split, length, max(float(cls._mean_depth(size)), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1]: the higher, the fewer splits separate the row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > split[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def fit_forest(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, clean_loss: float = CLEAN_LOSS) -> Forest | None:
    """Forest from at most fit_rows labelled rows, and threshold from all; None if under LEAST_GOOD good ones pass the fixed rules."""
    rows = labelled(docs, labels)
    n_rows, n_good = rows.agg(F.count("*"), F.sum(F.when(F.col("quality") == 1, F.col("times")))).first()
    if (n_good or 0) < LEAST_GOOD:
        return None
    # only rows of small hashes, about twice as many as are taken, are put in order
    share = 2 * fit_rows / n_rows
    near = rows if share >= 1 else rows.where(F.xxhash64("doc_id") < F.lit(int(share * 2.0**64 - 2.0**63)))
    chosen = near.select("doc_id", "quality", "x").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(fit_rows)
    forest = Forest.fit(np.array([v for *_, v in sorted((r.doc_id, r.quality, tuple(r.x)) for r in chosen.collect())]))
    forest.threshold = threshold(by_score(rows, forest), clean_loss)
    return forest


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, x (statistics) and times of all labelled rows that pass the fixed rules; equal ones are one row.

    Texts stay where they are: ids and statistics meet the labels.
    """
    ship(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole):
                c = counts(batch.column("text"))
                passed = ~base_failed(c)
                x = statistics(c)[passed]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(passed)), pa.array(x.tolist(), type=pa.list_(pa.float64()))], names=["doc_id", "x"])

    marks = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(features, "doc_id bigint, x array<double>")
    return cut(found.groupBy("doc_id", "x").agg(F.count("*").alias("times")).join(marks, "doc_id").select("doc_id", "quality", "x", "times"))


def by_score(rows: DataFrame, forest: Forest) -> DataFrame:
    """score, and how many of the rows of labelled() with it are good and junk."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("times"), pa.array(shared.value.score(x))], names=["quality", "times", "score"])

    scored = rows.select("quality", "times", "x").mapInArrow(run, "quality int, times bigint, score double")
    of = lambda kind: F.sum(F.when(kind, F.col("times")).otherwise(0))
    return cut(scored.groupBy("score").agg(of(F.col("quality") == 1).alias("good"), of(F.col("quality") != 1).alias("junk")))


def threshold(scores: DataFrame, clean_loss: float) -> float:
    """calibrate() over a table of any size: score, and the numbers of good and junk rows with it.

    Cuts above the good row that is one too many to lose are allowed. Of these,
    the one below the lowest junk score rejects most junk and fewest others.
    """
    n_good, least = scores.agg(F.sum("good"), F.min("score")).first()
    lost = int(clean_loss * (n_good or 0))
    floor = least if lost >= (n_good or 0) else max(least, _from_above(scores.where("good > 0"), lost + 1))
    at = scores.where((F.col("junk") > 0) & (F.col("score") > F.lit(floor))).agg(F.min("score")).first()[0] if floor is not None else None
    if at is None:
        return float("inf")
    return (scores.where(F.col("score") < F.lit(at)).agg(F.max("score")).first()[0] + at) / 2


def _from_above(scores: DataFrame, nth: int) -> float:
    """Score of the nth good row from above: counts in BINS ranges, then in those of one of them, till it holds one score."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        place = F.floor((F.col("score") - F.lit(low)) / F.lit(high - low) * BINS)
        bins = scores.where(F.col("score").between(low, high)).groupBy(place.alias("place")).agg(F.sum("good").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(bins.collect(), reverse=True):  # BINS + 1 rows at most
            if nth <= r.n:
                low, high = r.low, r.high
                break
            nth -= r.n
    return low


def calibrate(scores: np.ndarray, good: np.ndarray, clean_loss: float) -> float:
    """Score above which rows are rejected; infinite if no row that is not good can be rejected at that loss.

    This is the rule on arrays; threshold() follows it on tables.
    """
    order = np.argsort(scores, kind="stable")
    ranked = scores[order]
    lost = np.append(np.cumsum(good[order][::-1])[::-1], 0)  # good rows from each place on
    junk = np.append(np.cumsum(~good[order][::-1])[::-1], 0)
    cuts = np.flatnonzero(np.append(np.concatenate([[True], ranked[1:] > ranked[:-1]]), True))
    cuts = cuts[(lost[cuts] <= clean_loss * good.sum()) & (junk[cuts] > 0) & (cuts > 0)]
    if not len(cuts):
        return float("inf")
    best = cuts[np.lexsort((-cuts, -junk[cuts]))[0]]
    return float((ranked[best - 1] + ranked[best]) / 2)


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """All rows and columns of docs, with the counts, base_failed, anomaly (null without a forest) and kept.

    Null and empty texts have zero counts and fail the base rule; repeated rows
    get equal results. A column of docs that has a new name gives way to it.
    """
    return beside(docs, ("text",), (*BASE, "base_failed", "anomaly", "kept"), lambda d: _judged(d, forest))


def _judged(docs: DataFrame, forest: Forest | None) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(forest)
    added = T.StructType.fromDDL(", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Forest | None = shared.value
        for whole in batches:
            for batch in K.slices(whole):
                c = counts(batch.column("text"))
                failed = base_failed(c)
                score = model.score(statistics(c)) if model is not None else None
                kept = ~failed if score is None else ~failed & (score <= model.threshold)
                arrays = [pa.array(c[b], type=pa.int64()) for b in BASE]
                arrays += [pa.array(failed), pa.nulls(len(failed), pa.float64()) if score is None else pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules and the forest keep, with their own columns only."""
    forest = fit_forest(docs, labels)
    return beside(docs, ("text",), (), lambda d: judge(d, forest).where("kept"))
