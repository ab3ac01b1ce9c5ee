import hashlib
import random
from collections import Counter

import numpy as np
from ocuspark.llm import suffix_family as S
from ocuspark.llm.queries import op4_suffix_dedup
from pyspark.sql import functions as F

from .conftest import SMALL


def brute(docs, n=400):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for (k, _), d in zip(docs, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_query_equals_brute_force(spark, documents):
    got = sorted(tuple(r) for r in op4_suffix_dedup(spark, SMALL).collect())
    want = sorted(brute(list(documents.items())))
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_edges(spark):
    a = " ".join(f"w{i * 7919}" for i in range(120))
    docs = [
        (1, a), (1, a), (2, None), (3, ""), (None, "x " + a[:450]), (4, "é ü \t\n" * 90), (5, "ab" * 500), (6, a[:399]), (7, "q" * 200 + a[100:560] + "r" * 50),
        (8, "y" * 30 + a[90:300] + "z" + a[300:760]), (9, "long " * 4000 + a), (10, a[200:]), (11, "k" + a[3:403] + "k"), (12, "k" + a[4:403] + "k"),
    ]
    df = spark.createDataFrame([(d, t, "k", "s") for d, t in docs], "doc_id long, text string, chunk string, kind string").repartition(3)
    got = S.remove_repeats(df, batches=3)
    rows = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted(brute(docs), key=str)
    assert S.remove_repeats(df.limit(0)).collect() == []


def run_texts(spark, batches):
    """A family of one bucket for each batch of texts, and the text of each anchor of chunk and number."""
    family, texts = S.SuffixFamily(spark), {}
    for n, batch in enumerate(batches):
        df = spark.createDataFrame([(t,) for t in batch], "text string").selectExpr("cast(lpad('', 16, 'k') as binary) key", "text").coalesce(1)
        rows = S.suffix_entries(df, 9, 1 << 20, S.LENGTH, S.GRAM).withColumn("chunk", F.lit(n).cast("bigint"))
        data = np.frombuffer("".join(batch).encode(), dtype=np.uint8)
        a = S.Anchors(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in batch])]), S.LENGTH, S.GRAM)
        texts |= {(n, i): data[p : p + S.GRAM].tobytes() for i, p in enumerate(a.place)}
        yield family, family.add(rows), texts


def test_levels_are_runs_in_text_order_and_merge_as_a_binary_counter(spark):
    rng = random.Random(5)
    shared = "".join(chr(97 + rng.randrange(26)) for _ in range(1200))
    batches = [[shared[: 900 + n], "".join(chr(97 + rng.randrange(26)) for _ in range(1500 + n))] for n in range(8)]
    shape = []
    for family, _, texts in run_texts(spark, batches):
        shape.append([level is not None for level in family.levels])
        for level in family.levels:
            for r in level.collect() if level is not None else ():
                run = S.Run.unpacked(r.data)
                words = [texts[c, i][: S.WORD] for c, i in zip(run.chunk.tolist(), run.ids.tolist(), strict=True)]
                assert words == sorted(words) and (run.order() == np.arange(len(run))).all()
                assert all(k == (S.WORD if a == b else next(j for j in range(S.WORD) if a[j] != b[j])) for a, b, k in zip(words, words[1:], np.minimum(run.lcp(400, 120)[1:], S.WORD), strict=False))
    assert shape == [[True], [False, True], [True, True], [False, False, True], [True, False, True], [False, True, True], [True, True, True], [False, False, False, True]]
    assert family.merges == [0, 1, 0, 2, 0, 1, 0, 3]


def test_batches_do_not_change_results(spark):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    docs = []
    for n in range(60):  # a passage in many surroundings, near copies, and copies
        at = rng.randrange(1500)
        docs.append((n, [base[at : at + 700], f"{n} " * rng.randrange(150) + base[300:800] + f" {n}" * rng.randrange(150), base[:600] + str(n) + base[601:]][n % 3]))
    docs += [(100 + n, docs[n % 60][1]) for n in range(0, 90, 2)]  # in other chunks, beside other surroundings of the same passages
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = sorted(brute(docs))
    for batches in (1, 2, 5):
        found = S.remove_repeats(df, batches=batches).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(tuple(r) for r in found.collect()) == want
