import hashlib
import re
from collections import Counter

from ocuspark.llm import substring as S
from ocuspark.llm.queries import op9_substring_dedup

from .conftest import SMALL


def brute(docs, n=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def test_query_equals_brute_force(spark, documents):
    got = sorted(tuple(r) for r in op9_substring_dedup(spark, SMALL).collect())
    assert got == sorted(brute(list(documents.items())))
    assert sum(r[2] for r in got) > 0


def test_edges(spark):
    a = " ".join(f"w{i}" for i in range(60))
    docs = [(1, a), (1, a), (2, None), (3, ""), (None, "x " + a[:300]), (4, "é ü \t\n" * 90), (5, " ".join(f"v{i % 7}" for i in range(80))), (6, "\x0b".join(f"u{i}" for i in range(36))), (7, "long " * 4000 + a)]
    df = spark.createDataFrame([(d, t, "k", "s") for d, t in docs], "doc_id long, text string, chunk string, bucket string")
    got = S.remove_repeats(df)
    assert got.columns[:4] == df.columns
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == sorted(brute(docs), key=str)
    assert S.remove_repeats(df.limit(0)).collect() == []
