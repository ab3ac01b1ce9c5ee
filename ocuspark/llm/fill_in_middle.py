"""Fill-in-middle transformation by repeated-capture matching.

One fullmatch of `(unit)*` by the regex library keeps every repetition of its
group. The ends of group 1 are the ends of all units, so they give the number
of units and both cuts: no unit is visited one by one. A text is cut into
prefix, middle and suffix where two hashes of its doc_id say, and written in one
of three forms: plain (the text), psm (prefix, suffix, middle) or spm (suffix,
prefix, middle), each part behind its mark.

Bound: the regex library keeps some 100 bytes a repetition and gives up at about
7 million, so a text of over `PIECE` code points is matched as fullmatches of
`PIECE` units, one behind the other; what a task holds beside the text is then
4 bytes a unit. Hashes, forms and outputs are column expressions; only texts go
to Python, and only numbers come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .job import beside, ship

#: A code point. Other units: r"\X" (a character as seen), r"\s*\S+\s*" (a word), r"[^\n]*\n|[^\n]+" (a line).
UNIT = r"(?s:.)"
PIECE = 1 << 20
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_ends(text: str, unit: str = UNIT, piece: int = PIECE) -> np.ndarray | None:
    """Where each unit ends, in code points; None if units do not cover the text."""
    if len(text) <= piece:
        whole = regex.compile(f"({unit})*").fullmatch(text)
        return None if whole is None else np.array(whole.ends(1), dtype=np.int32)
    some = regex.compile(f"({unit}){{1,{piece}}}")
    found, at = [], 0
    while at < len(text):
        part = some.match(text, at)
        if part is None or part.end() == at:
            return None
        found.append(np.array(part.ends(1), dtype=np.int32))
        at = part.end()
    return np.concatenate(found)


def _cuts(unit: str, piece: int):
    def run(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        rows = []
        for t, a, b in zip(text, h1.to_pylist(), h2.to_pylist(), strict=True):
            ends = unit_ends(t.as_py(), unit, piece)
            if ends is None:
                rows.append((None, 0, 0))
                continue
            n = len(ends)
            first, second = sorted((a % (n + 1), b % (n + 1)))
            rows.append((n, int(ends[first - 1]) if first else 0, int(ends[second - 1]) if second else 0))
        n, first, second = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], names=["n", "first", "second"])

    return F.arrow_udf(run, "n bigint, first bigint, second bigint")


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of sha256 of `seed:doc_id`; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, unit: str = UNIT, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, piece: int = PIECE) -> DataFrame:
    """All rows and columns of docs, with n (units), form, prefix_chars, middle_chars (code points, null if plain) and output.

    Null and empty texts have n 0 and are plain, with an empty output. A text is
    plain, too, if it holds a mark itself (else it couldn't be read back), or if
    h3 % 100 >= plain_from. A text that units do not cover has n null and is
    plain. Draws depend on doc_id and n only: repeated rows get equal results,
    and rows of a null doc_id those of an empty one. A column of docs that has a
    new name gives way to it.
    """
    ship(docs.sparkSession)

    def use(d: DataFrame) -> DataFrame:
        h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
        text = F.coalesce("text", F.lit(""))
        held = d.withColumn("_cut", _cuts(unit, piece)(text, h1, h2))
        marked = F.lit(False)
        for m in (PREFIX, SUFFIX, MIDDLE):
            marked = marked | F.contains(text, F.lit(m))
        plain = (text == "") | marked | F.col("_cut.n").isNull() | (h3 % 100 >= plain_from)
        form = F.when(plain, "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
        first, second = F.col("_cut.first").cast("int"), F.col("_cut.second").cast("int")
        before = F.concat(F.lit(PREFIX), F.substring(text, F.lit(1), first))
        middle = F.concat(F.lit(MIDDLE), F.substring(text, first + 1, second - first))
        after = F.concat(F.lit(SUFFIX), F.substring(text, second + 1, F.length(text)))
        formed = held.withColumn("form", form)
        is_plain = F.col("form") == "plain"
        return formed.select(
            *[c for c in d.columns],
            F.col("_cut.n").alias("n"),
            "form",
            F.when(~is_plain, F.col("_cut.first")).alias("prefix_chars"),
            F.when(~is_plain, F.col("_cut.second") - F.col("_cut.first")).alias("middle_chars"),
            F.when(is_plain, text).when(F.col("form") == "spm", F.concat(after, before, middle)).otherwise(F.concat(before, after, middle)).alias("output"),
        )

    return beside(docs, ("doc_id", "text"), ADDED, use)


def restore(output: Column, form: Column) -> Column:
    """The text from output and form alone. Marks begin and end with other signs, so none can arise at a seam of two parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def digests(transformed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
