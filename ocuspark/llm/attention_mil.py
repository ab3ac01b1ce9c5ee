"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded by
style statistics and signed hashes of its words. Gated attention weights the
passages (w . (tanh(V h) * sigmoid(U h)), softmax within the document), and the
weighted sum of passage vectors is scored. Only document labels are known;
encoder, attention and score are learned together by gradient descent.

Bounds: the model is fitted on at most `fit_rows` labelled documents of the
training folds, in the order of a hash of doc_id, and on at most `fit_passages`
passages in all. Documents are taken whole, in that order; one that would be too
many is passed over, and those after it are taken as far as they fit. Scoring
covers every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .job import beside, ship, stored
from .quality_rules import _LEADS, _PUNCT, _SYMBOL, _UPPER, _within

PASSAGE, SIGNS, HIDDEN, STEPS, FIT_ROWS, FIT_PASSAGES, SEED = 64, 16, 16, 300, 4000, 200_000, 11
N_FEATURES = 11 + SIGNS

_DIGIT = K._table([(0x30, 0x39)])


def passages(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the number of passages of each text: one at least, of zeros, if it has no words."""
    data, offsets = K.text_bytes(text)
    words = K.Words(data, offsets, K.SPACED, fold=False)
    per_doc = np.maximum(1, -(-words.per_doc // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(first[-1])
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    out[:, 0] = 1
    if not len(words):
        return out, per_doc
    place = first[words.doc] + (np.arange(len(words)) - words.first[words.doc]) // PASSAGE
    size = np.bincount(place, minlength=n)
    some = np.maximum(size, 1)
    letters = np.concatenate([[0], np.cumsum(_LEADS[data], dtype=np.int64)])

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.bincount(place, weights=sums[words.end] - sums[words.start], minlength=n)

    chars = np.maximum(np.bincount(place, weights=letters[words.end] - letters[words.start], minlength=n), 1)
    repeated, later = _within(place, words.hash)
    last = data[words.end - 1]
    columns = [
        chars / some / 8,
        np.minimum(share(_SYMBOL[data]) / some, 3),
        share(_UPPER[data]) / chars,
        share(_DIGIT[data]) / chars,
        share(_PUNCT[data]) / chars,
        np.minimum(share(data == 0x21) / some, 3),
        np.bincount(place[later], minlength=n) / some,
        np.bincount(place[repeated], minlength=n) / some,
        np.bincount(place[(last == 0x2E) | (last == 0x2C)], minlength=n) / some,
        np.minimum(size / PASSAGE, 1),
    ]
    for i, c in enumerate(columns):
        out[:, 1 + i] = c
    filled = np.flatnonzero(size)
    starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
    signs = ((words.hash[:, None] >> np.arange(SIGNS, dtype=np.uint64)) & K.U64(1)).astype(np.int8) * 2 - 1
    out[filled, 1 + len(columns) :] = np.add.reduceat(signs, starts, axis=0, dtype=np.float32) / np.sqrt(some[filled, None]) / 4
    return out, per_doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """Encoder, gated attention and score; NumPy, trained by Adam on whole bags."""

    def __init__(self, n_features: int = N_FEATURES, hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(n_features, hidden), "V": draw(hidden, hidden), "U": draw(hidden, hidden), "w": draw(hidden, 1), "c": draw(hidden, 1), "b": np.zeros((1, 1))}
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)

    def _forward(self, x: np.ndarray, per_doc: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        bag = np.repeat(np.arange(len(per_doc)), per_doc)
        h = np.tanh((x - self.mean) / self.scale @ p["W"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((t * g) @ p["w"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = (e / np.add.reduceat(e, first)[bag])[:, None]
        z = np.add.reduceat(a * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "first": first, "s": _sigmoid(z @ p["c"] + p["b"])[:, 0]}

    def score(self, x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Score of each bag."""
        return self._forward(x.astype(np.float64), per_doc)["s"]

    def weights(self, x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Attention weight of each passage; those of a bag add up to 1."""
        return self._forward(x.astype(np.float64), per_doc)["a"][:, 0]

    def gradient(self, x: np.ndarray, per_doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the bags' scores against y, by each parameter."""
        p, f = self.p, self._forward(x, per_doc)
        h, t, g, a, bag = f["h"], f["t"], f["g"], f["a"], f["bag"]
        d_logit = ((f["s"] - y) / len(y))[:, None]
        d_z = d_logit @ p["c"].T
        d_a = (d_z[bag] * h).sum(axis=1, keepdims=True)
        d_e = a * (d_a - np.add.reduceat(a * d_a, f["first"], axis=0)[bag])
        d_tg = d_e @ p["w"].T
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_h = a * d_z[bag] + d_t @ p["V"].T + d_g @ p["U"].T
        xs = (x - self.mean) / self.scale
        return {"W": xs.T @ (d_h * (1 - h * h)), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_e, "c": f["z"].T @ d_logit, "b": d_logit.sum(keepdims=True)}

    def fit(self, x: np.ndarray, per_doc: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-3) -> GatedAttention:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        self.mean[0] = 0
        self.scale[0] = 1
        p, m, v = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, steps + 1):
            grad = self.gradient(x, per_doc, y)
            for k in p:
                q = grad[k] + (decay * p[k] if k != "b" else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether the row is outside the training folds; a null id is never used for training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_passages: int = FIT_PASSAGES) -> GatedAttention:
    """A model from labelled rows of the training folds; with no such rows, or labels of one kind, it is left at its start.

    Of rows that share a doc_id one counts, whatever their number; of its labels
    the highest. Null and empty texts are one empty passage. A document of more
    than fit_passages passages is never used, and takes no other one's place.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = (
        labels.where("quality is not null and doc_id is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # at most fit_rows ids: a proven bound for the broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole):
                x, per_doc = passages(batch.column("text"))
                ends = np.cumsum(per_doc)
                rows = [x[e - n : e].tobytes() for e, n in zip(ends, per_doc, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, type=pa.binary())], names=["doc_id", "quality", "x"])

    # one row an id, fit_rows at most; their sizes are judged before any of them comes to the driver
    each = stored(texts.mapInArrow(encode, "doc_id bigint, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("one")).select("doc_id", "one.*"))
    sizes = each.select("doc_id", F.xxhash64("doc_id").alias("order"), (F.octet_length("x") / (4 * N_FEATURES)).cast("int").alias("n")).collect()
    taken, left = [], fit_passages
    for r in sorted(sizes, key=lambda r: (r.order, r.doc_id)):
        if r.n <= left:
            taken.append((r.doc_id,))
            left -= r.n
    used = each.join(F.broadcast(spark.createDataFrame(taken, "doc_id bigint")), "doc_id")
    got = sorted((r.doc_id, r.quality, bytes(r.x)) for r in used.collect())
    model = GatedAttention()
    y = np.array([q for _, q, _ in got], dtype=np.float64)
    if len(np.unique(y)) < 2:
        return model
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, N_FEATURES) for *_, b in got]
    return model.fit(np.concatenate(bags), np.array([len(b) for b in bags]), (y > 0).astype(np.float64))


def score(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """All rows and columns of docs, with score (0 to 1, higher: label 1 likelier) and n_passages.

    Null and empty texts are one empty passage and get its score; repeated rows
    get equal scores. A column of docs that has a new name gives way to it.
    """
    return beside(docs, ("text",), ("score", "n_passages"), lambda d: _scored(d, model))


def _scored(docs: DataFrame, model: GatedAttention) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole):
                x, per_doc = passages(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(shared.value.score(x, per_doc)), pa.array(per_doc, type=pa.int64())], names=[*batch.schema.names, "score", "n_passages"]
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T.StructType.fromDDL("score double, n_passages bigint").fields]))
