import random
import re

import numpy as np
from ocuspark.llm import jaccard as J
from ocuspark.llm.queries import op10_jaccard_join
from pyspark.sql import functions as F

from .conftest import SMALL

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, documents):
    found = got(op10_jaccard_join(spark, SMALL))
    assert found == brute(list(documents.items()))
    assert any(c != d for d, _, c in found)


def variants(seed=3):
    rng = random.Random(seed)
    docs, n = [], 0
    for size in (1, 2, 4, 5, 6, 7, 9, 12, 20, 33, 60, 150):
        for _ in range(6):
            base = [f"t{rng.randrange(10**9)}" for _ in range(size)]
            for _ in range(5):
                w = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                    if not w:
                        break
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], ["x"], [w[at], f"y{rng.randrange(99)}"]])
                docs.append((n, " ".join(w)))
                n += 1
                base = w if rng.random() < 0.3 else base
    return docs


def test_edges_and_both_kinds_of_sets(spark):
    docs = variants() + [(None, "a b c d e f"), (900, None), (901, ""), (902, "A b C d e F"), (902, "A b C d e F"), (903, "one"), (904, "ONE"), (905, " \n"), (906, "word " * 9000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, skey string")
    want = brute(docs)
    assert got(J.near_duplicates(df)) == want
    members = J.cut(J.shared_shingles(df))
    by_set = {}
    for x in (0, 10, 40, 10**6):  # all heavy to all light
        sets = members.where("tokens is not null").dropDuplicates(["skey"])
        tied = J.signatures(sets, x).collect()
        by_sig = {}
        for r in tied:
            by_sig.setdefault(r.sig, set()).add(bytes(r.skey))
        by_set[x] = {frozenset((a, b)) for s in by_sig.values() for a in s for b in s if a != b}
    wanted = members.where("tokens is not null").select(F.col("tkey").alias("key"), "skey", "n")
    rows = {bytes(r.skey): (r.n, set(np.frombuffer(r.tokens, dtype="<u8").tolist())) for r in J.full_sets(df, wanted).collect()}
    linked = {frozenset((a, b)) for a in rows for b in rows if a < b and 100 * (i := len(rows[a][1] & rows[b][1])) >= 80 * (rows[a][0] + rows[b][0] - i)}
    assert linked and all(linked <= found for found in by_set.values())
    assert J.near_duplicates(df.limit(0)).collect() == []
    kept = J.keep_representatives(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in want if d == c}


def test_large_groups_are_compared_in_blocks(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    docs = []
    for n in range(90):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
            w[at] = f"z{rng.randrange(40)}"
        docs.append((n, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    members = J.cut(J.shared_shingles(df))
    label = {bytes(r.node): bytes(r.component) for r in J.classes(df, members, block=8).collect()}
    plain = {bytes(r.node): bytes(r.component) for r in J.classes(df, members).collect()}
    same = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert {g for g in same(label) if len(g) > 1} == {g for g in same(plain) if len(g) > 1}
    assert len({c for _, _, c in brute(docs)}) > 1


def test_representatives_are_chosen_by_row(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    near = lambda t: t + " more"
    docs = [
        (1, a), (None, near(a)), (None, "alone " + b),  # a null id that copies a document, and one that is unique
        (None, c), (None, c), (None, c), (None, near(c)),  # null ids that are linked with each other only
        (5, d), (3, near(d)), (5, e), (7, e),  # an id of two texts, one of them a copy of another document
        (None, None), (None, ""), (8, ""), (8, None), (1, a),
    ]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n long")
    kept = J.keep_representatives(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert all(docs[r.n] == (r.doc_id, r.text) for r in rows)
    places = {r.n for r in rows}
    assert len(places) == len(rows) and len(places & {3, 4, 5, 6}) == 1
    assert places - {3, 4, 5, 6} == {0, 2, 8, 9, 11, 12, 13, 14, 15}


def _family(size=60, many=90, seed=9):
    """Near copies of one text, some too far from each other to link, and texts that share single tokens with them."""
    rng = random.Random(seed)
    base, docs = [f"t{i}" for i in range(size)], []
    for n in range(many):
        w = list(base)
        for at in rng.sample(range(size), rng.choice([0, 1, 1, 2, 3])):
            w[at] = f"z{rng.randrange(40)}"
        docs.append((n, " ".join(w)))
    return docs


def test_links_that_only_short_or_long_lists_show(spark):
    """The same classes whether lists are taken pair by pair, in small blocks, or in large ones, and as brute force says."""
    docs = _family() + [(1000 + d, t) for d, t in variants(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {shingles(t) for _, t in docs}
    want = {c for _, _, c in brute(docs)}
    for block in (2, 8, 1024):
        members = J.cut(J.shared_shingles(df))
        found = J.classes(df, members, block=block)
        assert found.groupBy("node").count().where("count > 1").isEmpty()
        rows = members.where("has_doc").join(found.select(F.col("node").alias("skey"), "component"), "skey", "left").select("doc_id", F.coalesce("component", "skey").alias("c")).collect()
        groups = {}
        for r in rows:
            groups.setdefault(bytes(r.c) if r.c is not None else r.doc_id, []).append(r.doc_id)
        assert {min(g) for g in groups.values()} == want and len(groups) == len(want) <= len(sets)


def test_lists_without_links_tie_nothing(spark):
    """Each text shares a fifth of itself with the next one: candidates of a chain, of which none link."""
    words = [f"w{i}" for i in range(40 * 60)]
    docs = [(i, " ".join(words[40 * i : 40 * i + 50])) for i in range(59)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(J.near_duplicates(df)) == brute(docs) and all(c == d for d, _, c in brute(docs))
    assert J.classes(df, J.cut(J.shared_shingles(df))).collect() == []


def test_costs_are_counted_over_all_sets(spark):
    df = spark.createDataFrame(variants() + _family(), "doc_id long, text string")
    sets = J.cut(J.shared_shingles(df).where("tokens is not null").dropDuplicates(["skey"]))
    rows, lists, step = {}, {}, {}
    for r in sets.where(f"n <= {J.WHOLE}").collect():
        tokens, key = np.frombuffer(r.tokens, dtype="<u8"), bytes(r.skey)
        step[key] = int(4 * np.log2(r.n))
        p = max(0, len(tokens) - int(J.common(r.n)) + 1)
        for light, own in ((False, [(int(t),) for t in tokens[:p]]), (True, [(int(a), int(b)) for i, a in enumerate(tokens[: p + 1]) for b in tokens[i + 1 : p + 1]])):
            rows[light, step[key]] = rows.get((light, step[key]), 0) + len(own)
            for sig in own:
                lists.setdefault((light, sig), set()).add(key)
    pairs = {}
    for (light, _), keys in lists.items():
        for k in keys - {min(keys)}:
            pairs.setdefault((light, step[k]), set()).add((k, min(keys)))
    want = {k: (n, len(pairs.get(k, ()))) for k, n in rows.items() if n}
    assert {(r.light, r.step): (r.rows, r.pairs) for r in J.costs(sets).collect()} == want
    cost = lambda light, s: J.ROW_COST * want.get((light, s), (0, 0))[0] + J.PAIR_COST * want.get((light, s), (0, 0))[1]
    steps = sorted({s for _, s in want})
    total = [sum(cost(s <= last, s) for s in steps) for last in (-1, *steps)]
    best = max(i for i, c in enumerate(total) if c == min(total))
    x = J.boundary(sets)
    assert (x == 0) == (best == 0) and (best == 0 or int(4 * np.log2(x)) >= steps[best - 1] and x < 2 ** ((steps[best - 1] + 1) / 4))
