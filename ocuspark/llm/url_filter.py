"""URL filter: rules, and for the rest a logistic regression on hashed character n-grams.

The host (between `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased)
and the path (up to `?`, `#` or the end) are column expressions, and so are
rules: a rule fits its host and all subdomains, if the path starts with the
rule's. URLs that no rule fits are judged by a logistic regression on the
n-grams of 3 and 4 characters of host and path, each in its own half of a table
of `BUCKETS` weights. Ends of host and path are marked, so n-grams know them.

Bounds: the model is fitted on the driver on at most `FIT_ROWS` labelled URLs of
at most `FIT_CHARS` characters each, in the order of a hash; a URL's n-grams are
worked on in pieces, whatever its length. Rules are a list of at most
`MOST_RULES`, as each is tried on each row. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .job import beside, let, ship

SIZES, BUCKETS, FIT_ROWS, FIT_CHARS, STEPS, THRESHOLD, MOST_RULES = (3, 4), 1 << 17, 20_000, 2_000, 400, 0.5, 1_000
DECAY = 1e-4

# Rules of the contract (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# A small labelled table to start from: invented hosts of kinds that web corpora leave out, and of ordinary sites.
BLOCKED_NAMES = (
    "online-casino casino-royal best-casino-games casino.slots lucky-slots poker-room poker-stars-club roulette-king jackpot-city bingo-bonus "
    "sports-betting live-bets bets-today betting-tips free-bet-bonus win-big-money "
    "adult-video adult-dating adults-only xxx-tube xxx-movies porn-hd free-porn sex-cams sexy-girls hot-escorts nude-photos "
    "adserver ad-track-net ads.banner ads-network track-clicks tracking-pixel click-tracker popup-ads "
    "cheap-viagra buy-pills pills-online online-pharmacy cheap-meds pharma-discount weight-loss-pills "
    "spam-mail bulk-spam link-farm seo-link-farms content-farm replica-watches payday-loans crack-keygen warez-download torrent-free "
    "casino-bonus gambling-house slots-of-gold poker-online bets-and-odds football-betting adult-chat adult-shop porn-tube xxx-live sex-shop hot-girls "
    "pills-shop cheap-pharmacy viagra-online ads-server ad-clicks popup-tracker spam-links seo-spam payday-cash warez-keygen torrent-movies replica-bags"
).split()
ALLOWED_NAMES = (
    "news daily-herald city-times weather cooking garden-notes history-museum science-review library university physics-dept school travel-guide "
    "mountain-hiking music-lessons painting-club books poetry film-archive theatre opera train-timetable harbour health-ministry hospital "
    "parliament town-council court-rulings statistics bank-of-north insurance market-report engineering software-docs python-notes linux-wiki "
    "open-source astronomy biology-lab chemistry mathematics philosophy language-course dictionary translation recipes bread-baking bicycle "
    "football-club chess running swimming farming forest-trust animals birds-watch photography architecture furniture family-tree parents "
    "other thorn that thing there northern station nation section motion able table either weather-blog the-reader"
).split()
_PATHS = ("/", "/en/12", "/de/archive/7.html", "/fr/2041", "/es/page/3/", "/2020/05/post", "/en/8133.html", "/index.html")
_ENDS = ("example.com", "example.org", "example.net", "example")
_BEFORE = ("", "www.", "blog.", "m.")


def starting_table(spark: SparkSession) -> DataFrame:
    """url and blocked: each name above under each ending, with the prefixes and paths in turn, so that these say nothing."""
    rows = []
    for blocked, names in ((True, BLOCKED_NAMES), (False, ALLOWED_NAMES)):
        for i, name in enumerate(names):
            for j, end in enumerate(_ENDS):
                rows.append((f"https://{_BEFORE[(i + j) % len(_BEFORE)]}{name}.{end}{_PATHS[(3 * i + j) % len(_PATHS)]}", blocked))
    return spark.createDataFrame(rows, "url string, blocked boolean")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null and for a URL without `://`."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """rule (host and path together) and verdict of the longest rule that fits, else null.

    Of rules of one length, the one of the longer host counts, then the first by code points.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; each is tried on each row, so at most {MOST_RULES} are taken")
    if bad := [r for r in rules if r[0] not in ("allow", "block") or not r[1]]:
        raise ValueError(f"a rule is ('allow' or 'block', host, path): {bad}")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string,host:string,path:string>")
    ranked = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[1], r[2]))
    table = F.array(*[F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(f".{h}").alias("host"), F.lit(p).alias("path")) for v, h, p in ranked])
    return let(F.concat(F.lit("."), host), lambda h: F.get(F.filter(table, lambda r: F.endswith(h, r["host"]) & F.startswith(path, r["path"])), F.lit(0)))


def grams(host: Sequence[str], path: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of each n-gram of the hosts and paths, in pieces of bounded size. Both must be free of nulls."""
    for half, column in ((0, host), (1, path)):
        whole = "".join(f"\x02{t}\x03" for t in column)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.array([len(t) + 2 for t in column], dtype=np.int64)
        ends = np.cumsum(sizes)
        for lo in range(0, len(codes), K.PIECE):
            part = codes[lo : lo + K.PIECE + max(SIZES) - 1].astype(np.uint64)
            row = np.searchsorted(ends, np.arange(lo, lo + len(part)), side="right")
            for n in SIZES:
                hashes = K.rolling(K.mix(part + K.U64(1)), n)[: K.PIECE]
                if not len(hashes):
                    continue
                inside = row[: len(hashes)] == row[n - 1 : n - 1 + len(hashes)]
                yield row[: len(hashes)][inside], (K.mix(hashes[inside] + K.U64(n)) % K.U64(BUCKETS // 2)).astype(np.int64) + half * (BUCKETS // 2)


class NgramRegression:
    """Logistic regression; a row's features are its n-grams' counts over the root of their number."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(BUCKETS), 0.0

    def logits(self, host: Sequence[str], path: Sequence[str]) -> np.ndarray:
        total, many = np.zeros(len(host)), np.zeros(len(host))
        for row, bucket in grams(host, path):
            total += np.bincount(row, weights=self.weights[bucket], minlength=len(host))
            many += np.bincount(row, minlength=len(host))
        return self.bias + total / np.sqrt(np.maximum(many, 1))

    def score(self, host: Sequence[str], path: Sequence[str]) -> np.ndarray:
        """Chance, from 0 to 1, that a URL is to be blocked; without host and path the bias decides."""
        return 1 / (1 + np.exp(-np.clip(self.logits(host, path), -40, 40)))

    def fit(self, host: Sequence[str], path: Sequence[str], y: np.ndarray, steps: int = STEPS, rate: float = 2.0, decay: float = DECAY) -> NgramRegression:
        """Gradient descent with momentum on the mean cross entropy, the allowed class weighing twice as much as the blocked one, since a good page that goes costs more; the bias is not decayed."""
        found = list(grams(host, path))
        row, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
        used, bucket = np.unique(bucket, return_inverse=True)
        weight = np.where(y > 0, 1 / 3 / max(1, (y > 0).sum()), 2 / 3 / max(1, (y <= 0).sum()))
        w, b, vw, vb = np.zeros(len(used)), 0.0, 0.0, 0.0
        for _ in range(steps):
            z = b + np.bincount(row, weights=w[bucket], minlength=len(y)) * scale
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
            vw = 0.9 * vw + np.bincount(bucket, weights=(d * scale)[row], minlength=len(used)) + decay * w
            vb = 0.9 * vb + d.sum()
            w, b = w - rate * vw, b - rate * vb
        self.weights[used], self.bias = w, float(b)
        return self


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> NgramRegression:
    """A model from url and blocked; without rows of both kinds it is left at its start, and allows.

    Rows with a null label or without a host are not used, nor are URLs of over
    FIT_CHARS characters; equal URLs are one row, which is blocked if any of them is.
    """
    host, path = host_and_path(F.col("url"))
    rows = (
        labelled.where(F.col("blocked").isNotNull() & (F.length("url") <= FIT_CHARS)).select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y"))
        .where("host <> ''").groupBy("host", "path").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(fit_rows).collect()
    )
    y = np.array([r.y for r in rows], dtype=np.float64)
    model = NgramRegression()
    return model.fit([r.host for r in rows], [r.path for r in rows], y) if len(np.unique(y)) == 2 else model


def judge(pages: DataFrame, model: NgramRegression, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of pages, with host, path, rule (null if none fits), verdict (allow or block) and score.

    The verdict is the rule's, else block where the model's score is at least
    threshold, never at 0.5 or below it for an untrained model. A null URL, an
    empty one and one without `://` have no host and no path and fit no rule;
    the model's bias judges them, and it allows them if it has no opinion.
    Repeated rows get equal results. A column of pages that has a new name gives way to it.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(host: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(host.to_pylist(), path.to_pylist()))

    def use(d: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        split = d.select(*d.columns, host.alias("host"), path.alias("path"))
        scored = split.withColumn("score", F.arrow_udf(run, "double")("host", "path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
        verdict = F.coalesce("_rule.verdict", F.when((F.col("score") >= threshold) & (F.col("score") != 0.5), "block").otherwise("allow"))
        return scored.select(*d.columns, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")

    return beside(pages, ("url",), ("host", "path", "rule", "verdict", "score"), use)
