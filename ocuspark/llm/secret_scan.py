"""Secret scans. Native: DataFrame functions only.

Base spans come from three patterns. Candidate strings (long runs of key
characters) are scanned by a sliding window of Shannon entropy, one threshold
for each character class; the counts of the window's characters, and with them
the entropy, are carried from place to place, one character in and one out.
Candidates that an allow-list knows, or that touch a base span, are dropped.

Everything is a projection of the row: no shuffle, no state between rows.
Places are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .job import beside, let

KINDS = ("assign", "access", "hex", "entropy")

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

# Character classes of candidates: name, pattern of the whole candidate, window, least bits a character.
CLASSES = (
    ("hex", r"[0-9A-Fa-f]+", 24, 3.0),
    ("key", r"[A-Za-z0-9+/_=-]+", 20, 3.5),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

# Candidates that are no secrets: documentation keys, UUIDs, alphabets, words joined by - or _ or /, numbers.
ALLOW = (
    r"(?i).*EXAMPLE.*",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(abcdefghij|0123456789).*",
    r"[A-Za-z]*([-_/=+][A-Za-z]*)*",
    r"[0-9]+([-_/=+][0-9]+)*",
    r"[A-Za-z]+[0-9]{1,4}",
)

_GROUP = 256


def _places(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping: array of (start, end, text)."""
    sizes = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("m"))
    )
    matched = F.filter(sizes, lambda x: x["m"].isNotNull())

    def walk(part: Column, at: Column) -> Column:
        # places within a group of matches; the lists stay short, so growing them is cheap
        start = F.struct(at.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))
        return F.aggregate(
            part,
            start,
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["m"].alias("text")))).alias("out"),
            ),
        )["out"]

    def grouped(real: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(real) - 1) / _GROUP).cast("int")), lambda g: F.slice(real, g * _GROUP + 1, _GROUP))

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        starts = F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(parts, starts, walk))

    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    return F.when(F.rlike(text, F.lit(pattern)), let(let(matched, grouped), placed)).otherwise(none)


def _plogp(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def window_entropy(text: Column, width: int) -> Column:
    """Largest entropy, in bits a character, of width characters in a row; -1 if the text is shorter.

    The state is the count of each ASCII character in the window and the sum of
    c * log2(c) over the counts c; each step changes one or two counts.
    """
    letters = F.transform(F.split(text, ""), lambda c: F.least(F.ascii(c), F.lit(127)))

    def step(a: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        before = F.element_at(a["counts"], enters + 1)
        after = F.element_at(a["counts"], F.greatest(leaves, F.lit(0)) + 1) + F.when(leaves == enters, 1).otherwise(0)
        total = a["sum"] + _plogp(before + 1) - _plogp(before) + F.when(leaves >= 0, _plogp(after - 1) - _plogp(after)).otherwise(0.0)
        counts = F.transform(a["counts"], lambda c, i: c + F.when(i == enters, 1).otherwise(0) - F.when(i == leaves, 1).otherwise(0))
        bits = F.lit(math.log2(width)) - total / width
        return F.struct(
            counts.alias("counts"), total.alias("sum"), (a["n"] + 1).alias("n"), F.when(a["n"] + 1 >= width, F.greatest(a["best"], bits)).otherwise(a["best"]).alias("best")
        )

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1.0).alias("best"))
    pairs = let(letters, lambda codes: F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.coalesce(F.get(codes, i - width), F.lit(-1)).alias("leaves"))))
    return F.aggregate(pairs, start, step)["best"]


def _of_kind(places: Column, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _random_looking(m: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.rlike(m, F.lit(f"^(?:{pattern})$"))
    high = F.lit(False)
    for _, pattern, width, bits in CLASSES:
        high = high | (F.rlike(m, F.lit(f"^(?:{pattern})$")) & (window_entropy(m, width) >= bits))
    mixed = F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]"))
    return mixed & ~allowed & high


def find_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with base and extra: arrays of (start, kind, end), kind a place in KINDS.

    Null and empty texts have none; repeated rows get equal results; very long
    texts are scanned whole. A column of docs that has a new name gives way to it.
    """
    return beside(docs, ("text",), ("base", "extra"), _found)


def _found(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    long_enough = lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)) >= 8
    base = F.array_sort(
        F.concat(
            _of_kind(F.filter(_places(text, ASSIGN), long_enough), "assign"),
            _of_kind(_places(text, ACCESS), "access"),
            _of_kind(_places(text, HEX), "hex"),
        )
    )
    found = docs.withColumn("base", base)
    candidates = F.filter(_places(text, CANDIDATE), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.withColumn("extra", _of_kind(F.filter(candidates, lambda x: _random_looking(x["text"])), "entropy"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "extra")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text replaced by mark, and n_chars, where there is one, counted anew.

    Overlapping spans are replaced once. A null text stays null.
    """
    return beside(docs, ("text", "n_chars"), (), lambda d: _redacted(d, mark))


def _redacted(docs: DataFrame, mark: str) -> DataFrame:
    found = find_secrets(docs)
    spans = F.array_sort(F.concat("base", "extra"))
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit(mark)))).otherwise(a["out"]).alias("out"),
        ),
    )
    rest = F.substring(F.col("text"), walk["at"] + 1, F.length("text"))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(walk["out"], ""), rest)).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
