import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from ocuspark.llm import divergence as D
from ocuspark.llm.queries import op11_source_divergence
from ocuspark.llm.sql import OP11

from ..oracle import connect, spark_rows, sql_rows
from .conftest import SMALL

UPPER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, key string, n long, term string, `a.b` string"


def brute(docs, least=3, top=200):
    """Rows of the contract, by Python's own integers; docs: (text, lang, source)."""
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in in_docs[lang].items() if k >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b, t: (a[t] - b[t]) ** 2 // b[t]
        for s in sources:
            pair = [(sum(far(p[s], p[o], t) for t in kept), o) for o in sources if o != s]
            term = [(far(p[s], q, t), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_sql_and_brute_force(spark):
    df = op11_source_divergence(spark, SMALL)
    assert spark_rows(df) == sql_rows(connect(), OP11)
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(df) == brute(docs)


ODD = [
    ("one two Two three", "en", "a"), ("one two Two three", "en", "a"), ("one two Two three", "en", "b"), ("one two Two three", "en", None), (None, "en", "c"), ("", "en", "c"), ("12 34 _", "en", "d"),
    ("Éa éa ÉA x\x00y one", "en", "é"), ("Éa éa ÉA x\x00y one two", "en", "z"), ("Éa three one", "en", ""), ("one one one", None, None), ("one", None, "a"), ("one", "", "a"), ("rare", "fr", "a"), ("words", "fr", "b"),
    ("one two Two three", "de", "a"), ("long " * 300 + "one two", "en", "z"), ("tie tia tib " * 5, "en", "b"), ("tie tia tib", "en", "a"), ("tie tia tib", "en", "é"),
]


@pytest.mark.parametrize(("sources", "terms", "piece", "held"), [(32, 1 << 14, 1 << 20, 300_000), (1, 2, 7, 3)])
def test_edges(spark, monkeypatch, sources, terms, piece, held):
    """Nulls, copies, ties, empty texts, clashing columns; the same in blocks of one source and two terms, and in pieces of a text."""
    monkeypatch.setattr(D.K, "PIECE", piece)
    monkeypatch.setattr(D, "HELD", held)
    monkeypatch.setattr(D.evaluate, "__defaults__", (D.TOP, sources, terms))
    rows = [(i % 3 or None, t, lang, s, "k", 7, "one", "x") for i, (t, lang, s) in enumerate(ODD * 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(D.audit(df)) == brute(ODD * 2)
    assert found(D.audit(df, least_docs=1, top=2)) == brute(ODD * 2, 1, 2)
    assert D.audit(df.limit(0)).collect() == []


def test_a_text_is_tokenized_once(spark):
    """Copies leave a task as one text; their rows only count."""
    df = spark.createDataFrame([("same text", "en", f"s{i % 4}") for i in range(400)], "text string, lang string, source string").coalesce(2)
    got = D.copies(df).collect()
    assert sum(r.packed is not None for r in got) == 2
    assert sum(r.n or 0 for r in got) == 400


def test_large_counts_are_exact():
    for n in (0, 8 * 10**9, 10**15, 3 * 10**17):
        total = max(3 * n, 7)
        assert D.share(np.array([n, 0]), np.array([total, total]), 5).tolist() == [1 + 10**9 * (n + 1) // (total + 5), 1 + 10**9 // (total + 5)]
    assert D.distance(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18]
