"""Queries of networks, their training and stored prototypes; the catalogue registers them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import layers as L
from ..operators import prototypes as P
from ..operators.embedder import ConvBlock, Embedder, EmbedderConfig, embed
from ..operators import signal as S
from ..session import table
from .catalogue import DIST, GATE_SQL, LONG, PRED, REC, SHARES, _features, _grid, _place, embeddings, query, rec, rounded

# --- a network of two blocks, as SQL and as weights -------------------------------

#: Weights at places o, c and k: ((first . (o, c, k) + plus) modulo mod, if there is one, - minus) / by.
RULES = {
    "conv0": ((3, 5, 7), 0, 9, 4, 10), "conv0_bias": ((1, 0, 0), 1, 0, 0, 20),
    "gate0_in": ((1, 1, 0), 1, 0, 0, 4), "gate0_in_bias": ((1, 0, 0), 1, 0, 0, 10), "gate0_out": ((2, -1, 0), 0, 0, 1, 5), "gate0_out_bias": ((1, 0, 0), 0, 0, 1, 10),
    "norm0_mean": ((1, 0, 0), 0, 0, 0, 50), "norm0_var": ((1, 0, 0), 3, 0, 0, 5), "norm0_gamma": ((1, 0, 0), 2, 0, 0, 3), "norm0_beta": ((-1, 0, 0), 1, 0, 0, 20),
    "conv1": ((4, 3, 5), 0, 7, 3, 8), "conv1_bias": ((-1, 0, 0), 1, 0, 0, 30), "spatial1": ((0, 3, 1), 0, 0, 2, 6),
    "spatial1_norm_mean": ((1, 0, 0), 1, 0, 0, 25), "spatial1_norm_var": ((1, 0, 0), 2, 0, 0, 4), "spatial1_norm_gamma": ((1, 0, 0), 3, 0, 0, 2), "spatial1_norm_beta": ((1, 0, 0), 1, 0, 0, 40),
    "norm1_mean": ((1, 0, 0), 0, 0, 1, 40), "norm1_var": ((1, 0, 0), 2, 0, 0, 6), "norm1_gamma": ((1, 0, 0), 4, 0, 0, 3), "norm1_beta": ((1, 0, 0), 1, 0, 0, 30),
    "fc0": ((5, 2, 0), 0, 11, 5, 9), "fc0_bias": ((1, 0, 0), 0, 0, 2, 20),
}
CONFIG = EmbedderConfig(
    [
        ConvBlock(1, 3, 3, 2, dilation=2, gate=True, reduction=2, pool=5, pool_stride=2, norm=True),
        ConvBlock(3, 2, 3, 1, 1, spatial=3, pool=3, pool_stride=2, pool_kind="avg", norm=True, activation="tanh"),
    ],
    [(4, "none")],
)


def _w(name: str, o: str = "0", c: str = "0", k: str = "0") -> str:
    """The rule of a weight as SQL, in doubles."""
    by_place, plus, mod, minus, by = RULES[name]
    whole = " + ".join(f"({n}) * ({x})" for n, x in zip(by_place, (o, c, k), strict=True)) + f" + {plus}"
    return f"((({whole}){f' % {mod}' if mod else ''} - {minus}) / {by}e0)"


def _norm_sql(name: str, v: str, o: str) -> str:
    return f"(({v}) - {_w(f'{name}_mean', o)}) / sqrt({_w(f'{name}_var', o)} + 1e-5) * {_w(f'{name}_gamma', o)} + {_w(f'{name}_beta', o)}"


def two_blocks() -> Embedder:
    """The network of CONFIG over 64 places with the weights of RULES."""
    net = Embedder(CONFIG, 64)
    for name, w in net.weights.items():
        by_place, plus, mod, minus, by = RULES[name]
        whole = sum((n * x for n, x in zip(by_place, np.indices(w.shape), strict=False)), np.full(w.shape, plus))
        net.weights[name] = ((whole % mod if mod else whole) - minus) / by
    return net


NETWORK = f"""{LONG}, outs(o) AS (VALUES (0), (1), (2)), taps(k) AS (VALUES (0), (1), (2)),
c0 AS (SELECT vec_id, o, t, sum(v * {_w("conv0", "o", "0", "k")}) + {_w("conv0_bias", "o")} AS v FROM (SELECT unnest(range(30)) AS t) CROSS JOIN outs CROSS JOIN taps JOIN long ON pos = t * 2 + k * 2 GROUP BY 1, 2, 3),
pooled AS (SELECT vec_id, o, 0 AS kind, avg(v) AS v FROM c0 GROUP BY 1, 2 UNION ALL SELECT vec_id, o, 1, max(v) FROM c0 GROUP BY 1, 2),
hidden AS (SELECT vec_id, kind, h, greatest(sum(v * {_w("gate0_in", "h", "o")}) + {_w("gate0_in_bias", "h")}, 0) AS v FROM pooled, (VALUES (0)) r(h) GROUP BY 1, 2, 3),
gate AS (SELECT vec_id, o, 1 / (1 + exp(-sum(v * {_w("gate0_out", "o", "h")} + {_w("gate0_out_bias", "o")}))) AS g FROM hidden, outs GROUP BY 1, 2),
g0 AS (SELECT vec_id, o, t, v * g AS v FROM c0 JOIN gate USING (vec_id, o)),
p0 AS (SELECT vec_id, o, s AS t, max(v) AS v FROM g0 JOIN (SELECT unnest(range(13)) AS s) ON t BETWEEN s * 2 AND s * 2 + 4 GROUP BY 1, 2, 3),
b0 AS (SELECT vec_id, o AS c, t, greatest({_norm_sql("norm0", "v", "o")}, 0) AS v FROM p0),
c1 AS (SELECT vec_id, o, s AS t, sum(v * {_w("conv1", "o", "c", "k")}) + {_w("conv1_bias", "o")} AS v FROM (SELECT unnest(range(13)) AS s) CROSS JOIN outs CROSS JOIN taps JOIN b0 ON t = s + k - 1 WHERE o < 2 GROUP BY 1, 2, 3),
two AS (SELECT vec_id, t, max(v) AS m, avg(v) AS a FROM c1 GROUP BY 1, 2),
sg AS (SELECT b.vec_id, b.t, sum(x.m * {_w("spatial1", "0", "0", "k")} + x.a * {_w("spatial1", "0", "1", "k")}) AS v FROM two b CROSS JOIN taps JOIN two x ON x.vec_id = b.vec_id AND x.t = b.t + k - 1 GROUP BY 1, 2),
g1 AS (SELECT c1.vec_id, o, c1.t, c1.v / (1 + exp(-({_norm_sql("spatial1_norm", "sg.v", "0")}))) AS v FROM c1 JOIN sg USING (vec_id, t)),
p1 AS (SELECT vec_id, o, s AS t, avg(v) AS v FROM g1 JOIN (SELECT unnest(range(6)) AS s) ON t BETWEEN s * 2 AND s * 2 + 2 GROUP BY 1, 2, 3),
b1 AS (SELECT vec_id, o * 6 + t AS j, tanh({_norm_sql("norm1", "v", "o")}) AS v FROM p1),
net AS (SELECT vec_id, i AS pos, sum(v * {_w("fc0", "i", "j")}) + {_w("fc0_bias", "i")} AS v FROM b1, (VALUES (0), (1), (2), (3)) f(i) GROUP BY 1, 2)"""


def _samples(spark, d):
    return embeddings(spark, d).select(F.col("vec_id").alias("guid"), "label", F.col("embedding").cast("array<double>").alias("data"))


@query(f"WITH {NETWORK} SELECT vec_id AS guid, CAST(pos AS INT) AS pos, round(v, 6) AS v FROM net")
def embedder_blocks(spark, d):
    """Dilated and padded convolutions, both gates, overlapping pools, normalisations and a linear layer."""
    return rounded(embed(_samples(spark, d), two_blocks()).select("guid", F.posexplode("embedding").alias("pos", "v")), "v")


@query(f"""WITH {NETWORK.replace("long AS (", "raw AS (", 1).replace("JOIN long ON", "JOIN raw ON")},
long AS (SELECT vec_id, label, pos, v FROM net JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)), {PRED.removeprefix(LONG).removeprefix(", ")}
SELECT vec_id AS guid, CAST(predicted AS BIGINT) AS id, 'c' || predicted AS name, round(probability, 6) AS probability FROM pred""")
def predictions_through_network(spark, d):
    """Samples through the network of two blocks to the nearest prototype of its own vectors."""
    from . import pipelines as PL

    samples, net = _samples(spark, d), two_blocks()
    support = embed(samples, net).join(samples.select("guid", "label"), "guid").select("label", "embedding")
    indexed = samples.select("label").distinct().select(F.col("label").cast("bigint").alias("idx"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("name"))
    found = PL.predict_onto(samples.drop("label"), net, support, indexed)
    return found.select("guid", "predicted_label.id", "predicted_label.name", F.round("predicted_label.probability", 6).alias("probability"))


_GATE_BIASED = GATE_SQL.replace("greatest(sum(v * w), 0)", "greatest(sum(v * w) + (w1.o + 1) / 10.0e0, 0)").replace("sum(v * (w - 0.5e0)) AS g", "sum(v * (w - 0.5e0)) + 2 * (w1.o - 1) / 10.0e0 AS g")


@query(f"WITH {_GATE_BIASED} SELECT id, c, t, round(v, 6) AS v FROM gated")
def channel_gate_biased(spark, d):
    """The gate's two layers with their biases; the second counts once for each kind of pooling."""
    grid = (("o", 2), ("j", 2))
    weights = (_grid(spark, *grid, weight="(o + j + 1) / 4.0"), _grid(spark, *grid, weight="(o + j + 1) / 4.0 - 0.5"))
    biases = [_grid(spark, ("o", 2), weight=w).withColumnRenamed("w", "b") for w in ("(o + 1) / 10.0", "(o - 1) / 10.0")]
    return rounded(L.channel_gate(_features(spark, d), *weights, biases=(biases[0], biases[1])), "v")


# --- stored prototypes ------------------------------------------------------------


def _stored(spark, d) -> P.Store:
    store, e = P.Store(spark, _place(spark, "prototypes")), embeddings(spark, d)
    for part in (1, 2, 0):
        store.update(e.where(F.col("vec_id") % 3 == part))
    return store


@query(f"WITH {LONG} SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS c, count(*) AS n FROM long GROUP BY 1, 2")
def stored_prototypes(spark, d):
    """Sums and counts in files, from three batches; each writes a version of its own."""
    return rounded(_stored(spark, d).prototypes().select("label", F.posexplode("prototype").alias("pos", "c"), "n"), "c")


@query(f"WITH {PRED} SELECT vec_id, predicted, round(probability, 6) AS probability FROM pred")
def cold_predictions(spark, d):
    """Queries against stored prototypes, without support vectors of their own."""
    e = embeddings(spark, d)
    return P.predict_with(e, store=_stored(spark, d)).select("vec_id", "predicted", F.round("probability", 6).alias("probability"))


@query(f"WITH {DIST} SELECT vec_id, proto_label, round(distance, 6) AS distance FROM dist")
def hot_distances(spark, d):
    """Support vectors come first, whatever is stored."""
    e = embeddings(spark, d)
    store = P.Store(spark, _place(spark, "prototypes"))
    store.update(e.where("vec_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda v: v + 1)))
    return P.distances(e, P.chosen(support=e, store=store)).select("vec_id", "proto_label", F.round("distance", 6).alias("distance"))


# --- regression, medians, schemes, cubic pieces -----------------------------------


@query(f"WITH {REC} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM rec WHERE x IS NOT NULL AND y IS NOT NULL")
def regression_head(spark, d):
    """The line of the least squares of one channel by the other, by a head of one input and one output."""
    from ..operators.training import fit_regression_head

    head = fit_regression_head(rec(spark, d).where("x is not null and y is not null").select(F.array("x").alias("embedding"), F.array("y").alias("target")))
    both = head.weights.join(head.bias, "o")
    return rounded(both.select(F.col("w").alias("slope"), F.col("b").alias("intercept")), "slope", "intercept")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def quantitative_stats_by_counts(spark, d):
    """Medians of groups of any size, from counts in bins."""
    return rounded(S.quantitative_stats(table(spark, d, "events"), ["event_type"], "value", whole_groups=False), "mean", "std", "median")


@query("""WITH u AS (SELECT CAST(o_custkey AS VARCHAR) AS name, max(o_orderdate) >= min(o_orderdate) + INTERVAL 365 DAY AS apart, min(o_orderkey) AS pos FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY apart DESC, md5(concat_ws('|', '11', name)), name) - 1 AS rank, count(*) OVER () AS n FROM u),
m AS (SELECT *, apart AND rank < floor(n * 0.2e0 + 1e-9) AS chosen FROM r),
o AS (SELECT name, pos, row_number() OVER (ORDER BY md5(concat_ws('|', '11', name)), name) - 1 AS rank, count(*) OVER () AS n FROM m WHERE NOT chosen)
SELECT name, false AS skip, pos, CASE WHEN rank < floor(n * 0.75e0 + 1e-9) THEN 'train' ELSE 'validation' END AS dataset_type FROM o UNION ALL SELECT name, false, pos, 'test' FROM m WHERE chosen""")
def target_generation_by_time(spark, d):
    """The time-based scheme of the generator: customers as targets, their orders as samples."""
    from . import pipelines as PL

    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("name"), F.lit(False).alias("skip"), F.col("o_orderdate").alias("ts"))
    return PL.generate_targets(samples, SHARES, 11, "time_based", gap="365 days")


_GAPS = f"""{REC}, gaps AS (SELECT session, i, CASE WHEN i % 5 NOT IN (1, 2) THEN x END AS x FROM rec),
knots AS (SELECT session, i, x, lag(i) OVER w AS pi, lag(x) OVER w AS px, lead(i) OVER w AS ni, lead(x) OVER w AS nx, lead(i, 2) OVER w AS n2i, lead(x, 2) OVER w AS n2x, lag(i, 2) OVER w AS p2i, lag(x, 2) OVER w AS p2x
  FROM gaps WHERE x IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY i)),
steps AS (SELECT *, (x - px) / (i - pi) AS mp, (nx - x) / (ni - i) AS mn, i - pi AS hp, ni - i AS hn, (n2x - nx) / (n2i - ni) AS mn2, n2i - ni AS hn2, (px - p2x) / (pi - p2i) AS mp2, pi - p2i AS hp2 FROM knots),
raw AS (SELECT *, ((2 * hn + hn2) * mn - hn * mn2) / (hn + hn2) AS e1, ((2 * hp + hp2) * mp - hp * mp2) / (hp + hp2) AS e2 FROM steps),
sloped AS (SELECT session, i, x, CASE WHEN pi IS NULL AND ni IS NULL THEN 0 WHEN pi IS NULL AND n2i IS NULL THEN mn WHEN ni IS NULL AND p2i IS NULL THEN mp
  WHEN pi IS NULL THEN CASE WHEN sign(e1) <> sign(mn) THEN 0 WHEN sign(mn) <> sign(mn2) AND abs(e1) > 3 * abs(mn) THEN 3 * mn ELSE e1 END
  WHEN ni IS NULL THEN CASE WHEN sign(e2) <> sign(mp) THEN 0 WHEN sign(mp) <> sign(mp2) AND abs(e2) > 3 * abs(mp) THEN 3 * mp ELSE e2 END
  WHEN mp * mn <= 0 THEN 0 ELSE 3 * (hp + hn) / ((2 * hn + hp) / mp + (hn + 2 * hp) / mn) END AS s FROM raw),
spans AS (SELECT session, i AS a, x AS ya, s AS sa, lead(i) OVER w AS b, lead(x) OVER w AS yb, lead(s) OVER w AS sb FROM sloped WINDOW w AS (PARTITION BY session ORDER BY i)),
spots AS (SELECT g.session, g.i, s.a, s.ya, s.sa, s.b, s.yb, s.sb, (g.i - s.a) / CAST(s.b - s.a AS DOUBLE) AS t FROM gaps g ASOF JOIN spans s ON g.session = s.session AND g.i >= s.a)"""


@query(f"""WITH {_GAPS} SELECT session, i, round(CASE WHEN i = a OR b IS NULL THEN ya
  ELSE ya * (1 + 2 * t) * (1 - t) * (1 - t) + (b - a) * sa * t * (1 - t) * (1 - t) + yb * t * t * (3 - 2 * t) + (b - a) * sb * t * t * (t - 1) END, 6) AS x FROM spots""")
def interpolate_pchip(spark, d):
    """Two of five values are taken out and come back as pieces of cubics that keep the shape."""
    gaps = rec(spark, d).select("session", "i", F.when(~(F.col("i") % 5).isin(1, 2), F.col("x")).alias("x"))
    return rounded(S.interpolate(gaps, ["x"], "pchip", block=64), "x")
