import hashlib

import pytest
from ocuspark.llm import fill_in_middle as M
from ocuspark.llm.queries import op12_fill_in_middle
from ocuspark.llm.sql import OP12

from ..oracle import connect, spark_rows, sql_rows
from .conftest import SMALL, rows

MARKS = ("<P>", "<S>", "<M>")


def brute(doc_id, text, ends=None):
    """n, form, prefix_chars, middle_chars, output; ends: of the units, by default of code points."""
    text = text or ""
    ends = list(range(1, len(text) + 1)) if ends is None else ends
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(ends)
    a, b = ([0, *ends][k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, suffix + prefix + middle if form == "spm" else prefix + suffix + middle


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_sql_and_brute_force(spark, documents):
    df = op12_fill_in_middle(spark, SMALL)
    assert spark_rows(df) == sql_rows(connect(), OP12)
    got = rows(df)
    assert got.keys() == documents.keys() and {r.form for r in got.values()} == {"plain", "psm", "spm"}
    for d, text in documents.items():
        *numbers, output = brute(d, text)
        assert tuple(got[d]) == (d, *numbers, sha(output), sha(text))


TEXTS = [None, "", "a", "é", "x<P>y", "<M", "M><S", "<S>", "a\nb\r\n\x00c\u2028d", "👩‍👩‍👧 flag 🇫🇷 e\u0301", "<" * 50, ">P<" * 40, "word " * 3000, "<S<P<M" * 9, "S>P>M>" * 9, "\u0301", "日本語" * 40]


@pytest.mark.parametrize("piece", [M.PIECE, 7])
def test_edges(spark, piece):
    """Nulls, marks and parts of marks, combining signs; long texts in pieces; repeated rows; clashing columns."""
    many = [(i, t, "n", "form", "x", 3) for i, t in enumerate(TEXTS * 12)] + [(None, "no id at all", "n", "form", "x", 3)] * 2 + [(5, "same id", "n", "form", "x", 3)] * 2
    df = spark.createDataFrame(many, "doc_id long, text string, N string, form string, `a.b` string, _cut int")
    out = M.transform(df, piece=piece)
    assert out.columns == ["doc_id", "text", "a.b", "_cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", M.restore(out.output, out.form)).collect()
    assert len(got) == len(many)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and r["a.b"] == "x" and r["_cut"] == 3
    assert M.transform(df.limit(0)).collect() == []


def test_other_units(spark):
    """Words with their gaps; what the units do not cover stays plain."""
    words = r"\s*\S+\s*?(?=\s|$)|\s+$"
    texts = ["one two  three four five", "  a b c ", "", "x", "ab " * 500]
    df = spark.createDataFrame(list(enumerate(texts * 6)), "doc_id long, text string")
    import regex

    for r in M.transform(df, unit=words).collect():
        ends = [m.end() for m in regex.finditer(words, r.text)]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, ends)
    for r in M.transform(df, unit="[a-w]", piece=3).where("text <> ''").collect():
        assert r.output == r.text and r.form == "plain" and r.n is None


def test_pieces_give_the_units_of_one_match():
    text = "é👩‍👧a\n" * 50
    for unit in (M.UNIT, r"\X"):
        assert M.unit_ends(text, unit, 8).tolist() == M.unit_ends(text, unit).tolist()
    assert M.unit_ends("", M.UNIT).tolist() == [] and len(M.unit_ends("ab" * M.PIECE)) == 2 * M.PIECE
