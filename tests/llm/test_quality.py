import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from ocuspark.llm import attention_mil as A
from ocuspark.llm import quality_rules as Q
from ocuspark.llm.queries import op3_quality_rules, op5_quality_classifier

from .conftest import SMALL, rows

MEDIUM = "/root/testdata/sf0.01"
WEIRD = [None, "", " \n", "a b c a b c", "x\n\nx\n x\nx", "é\x85　é #<>|", "one two three " * 60, "\r\n".join(["l l l"] * 4), "w " * 30_000, "#" * 40]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_columns_equal_brute_force(spark, documents):
    got = rows(op3_quality_rules(spark, SMALL))
    assert got.keys() == documents.keys()
    for d, text in documents.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        assert not (r.base_failed and r.kept)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(WEIRD * 2)], "doc_id long, text string, quality int")
    for r in Q.judge(df, None).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert r.kept == (not r.base_failed)
    empty = df.limit(0)
    assert Q.judge(empty, Q.fit_forest(empty, empty)).collect() == []


def test_forest_rejects_junk_and_keeps_good_rows(spark):
    got = rows(op3_quality_rules(spark, "/root/testdata/sf0.1"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    judged = [(labels[d], r.kept) for d, r in got.items() if d in labels and not r.base_failed]
    good, junk = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert np.mean(good) >= 0.998 and np.mean(junk) <= 0.05


def test_anomaly_and_verdict_equal_plain_walks_through_the_trees(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    forest, text = Q.fit_forest(docs, labels), {r.doc_id: r.text for r in docs.collect()}

    def plain(t):
        w, ch = re.findall(r"[^\x20\x09-\x0D]+", t or ""), 0
        ch = max(sum(map(len, w)), 1)
        n = max(len(w), 1)
        count = lambda kind: len(re.findall(kind, t or ""))
        x = [sum(map(len, w)) / n if w else 0, min(count(r"[#*$%&|<>]") / n, 3), count("[A-Z]") / ch, count(r"[!-/:-@\[-`{-~]") / ch, min(count("!") / n, 3)]
        depth = 0.0
        for feature, split, length in zip(forest.feature, forest.split, forest.length, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + (x[feature[node]] ** 0.5 > split[node])
            depth += length[node]
        return 2 ** (-depth / len(forest.feature) / forest.norm)

    got = {r.doc_id: r for r in op3_quality_rules(spark, MEDIUM).collect()}
    score = {d: plain(t) for d, t in text.items()}
    assert all(abs(r.anomaly - score[d]) < 1e-12 for d, r in got.items())
    known = [(score[r.doc_id], r.quality == 1) for r in labels.collect() if r.doc_id in got and not got[r.doc_id].base_failed]
    limit = Q.calibrate(np.array([s for s, _ in known]), np.array([g for _, g in known]), Q.CLEAN_LOSS)
    assert abs(limit - forest.threshold) < 1e-12
    assert all(r.kept == (not base(text[d])[5] and score[d] <= limit) for d, r in got.items())


def test_threshold_holds_on_labels_that_it_has_not_seen(spark):
    """Five folds: forest and threshold from four, judged on the fifth."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.doc_id in labels]
    c = Q.counts(pa.array([r.text for r in rows]))
    passed = np.flatnonzero(~Q.base_failed(c))
    x, good = Q.statistics(c)[passed], np.array([labels[rows[i].doc_id] == 1 for i in passed])
    fold = np.array([zlib.crc32(str(rows[i].doc_id).encode()) % 5 for i in passed])
    gone = np.zeros(len(x), dtype=bool)
    for k in range(5):
        forest = Q.Forest.fit(x[fold != k])
        limit = Q.calibrate(forest.score(x[fold != k]), good[fold != k], Q.CLEAN_LOSS)
        gone[fold == k] = forest.score(x[fold == k]) > limit
    assert gone[~good].mean() >= 0.95 and gone[good].mean() <= 0.002


def test_threshold():
    scores, good = np.array([0.1, 0.2, 0.3, 0.7, 0.8, 0.9]), np.array([True, True, True, False, False, False])
    assert Q.calibrate(scores, good, 0.0) == 0.5
    assert Q.calibrate(scores, ~good, 0.0) == float("inf") == Q.calibrate(scores, good | True, 0.5)
    assert Q.calibrate(scores, np.array([True, True, False, True, False, True]), 0.0) == float("inf")
    assert Q.calibrate(scores, np.array([True, True, False, True, False, True]), 0.34) == (0.7 + 0.8) / 2


def test_threshold_of_a_table_equals_that_of_arrays(spark):
    rng = np.random.default_rng(5)
    for n, junk, digits, loss in ((3000, 0.1, 3, 0.01), (3000, 0.002, 9, 0.001), (50, 0.5, 1, 0.3), (500, 0.0, 2, 0.1), (400, 0.2, 6, 0.0), (20, 0.5, 0, 1.0), (30, 1.0, 2, 0.1)):
        good = rng.random(n) >= junk
        scores = np.round(rng.random(n) + 0.5 * ~good, digits)
        rows = spark.createDataFrame([(float(s), int(g), int(not g)) for s, g in zip(scores, good, strict=True)], "score double, good long, junk long")
        table = rows.groupBy("score").sum("good", "junk").toDF("score", "good", "junk")
        assert Q.threshold(table, loss) == Q.calibrate(scores, good, loss)
    assert Q.threshold(table.limit(0), 0.1) == float("inf")


def test_all_labels_count_for_the_threshold(spark):
    order = [r.id for r in spark.sql("select id from range(400) order by xxhash64(id), id").collect()]
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghA"), rng.integers(2, 9))) + rng.choice(["", ".", "!", "#"], p=[0.7, 0.1, 0.1, 0.1])
    # the forest's rows are the first by hash; the only junk is last
    docs = [(d, " ".join(word() if n < 395 else f"#{k}$XYZABC!!%" for k in range(80)), int(n < 395)) for n, d in enumerate(order)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    for fit_rows in (200, 32):
        forest = Q.fit_forest(df, df, fit_rows)
        got = Q.judge(df, forest).collect()
        assert {r.doc_id for r in got if not r.kept} == set(order[395:])
        assert forest.threshold == Q.calibrate(np.array([r.anomaly for r in got]), np.array([r.quality == 1 for r in got]), Q.CLEAN_LOSS)
    assert Q.fit_forest(df, df.where("quality = 1").limit(63)) is None


def test_forest_isolates_an_outlier():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    s = Q.Forest.fit(x, 100, 64).score(x)
    assert s[-1] == s.max() and 0 < s.min() and s.max() <= 1


def test_classifier_on_held_out_rows(spark):
    got = op5_quality_classifier(spark, MEDIUM).collect()
    assert len(got) == 1000
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) >= 0.95
    again = {r.doc_id: r.score for r in op5_quality_classifier(spark, MEDIUM).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_classifier_edges(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(WEIRD)] + [(None, "x", 0)], "doc_id long, text string, quality int")
    model = A.fit(df, df)
    got = A.score(df, model).withColumn("h", A.held_out()).collect()
    assert len(got) == len(WEIRD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).h
    assert A.score(df.limit(0), model).collect() == []
    assert A.fit(df, df.limit(0)).p.keys() == model.p.keys()
    more = df.union(df.where("doc_id in (3, 4)")).union(df.where("doc_id = 3"))  # rows that repeat an id add nothing to a fit
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    assert all((A.fit(more, labels).p[k] == A.fit(df, labels).p[k]).all() for k in model.p)
    assert (A.fit(df, labels, fit_passages=1).p["c"] == A.GatedAttention().p["c"]).all()


def test_gradient_and_attention():
    rng = np.random.default_rng(1)
    per_doc = np.array([3, 1, 4, 2])
    x = rng.normal(size=(10, A.N_FEATURES))
    model = A.GatedAttention()
    w = model.weights(x, per_doc)
    assert np.allclose(np.add.reduceat(w, [0, 3, 4, 8]), 1)
    y = np.array([1.0, 0, 1, 0])
    # a plain forward pass, passage by passage
    p, at = model.p, 0
    for n, score in zip(per_doc, model.score(x, per_doc), strict=True):
        h = [np.tanh(v @ p["W"]) for v in x[at : at + n]]
        e = [np.exp(((np.tanh(k @ p["V"]) / (1 + np.exp(-k @ p["U"]))) @ p["w"])[0]) for k in h]
        z = sum(a / sum(e) * k for a, k in zip(e, h, strict=True))
        assert np.isclose(score, 1 / (1 + np.exp(-(z @ p["c"])[0] - p["b"][0, 0])))
        at += n
    cost = lambda: -np.mean(y * np.log(s := model.score(x, per_doc)) + (1 - y) * np.log(1 - s))
    for name, g in model.gradient(x, per_doc, y).items():
        for i in list(np.ndindex(g.shape))[:40]:
            old, sides = p[name][i], []
            for step in (1e-5, -1e-5):
                p[name][i] = old + step
                sides.append(cost())
            p[name][i] = old
            assert np.isclose(g[i], (sides[0] - sides[1]) / 2e-5, rtol=1e-4, atol=1e-8), name
    loss = lambda m: -np.mean(y * np.log(s := m.score(x, per_doc)) + (1 - y) * np.log(1 - s))
    start = loss(model)
    assert loss(model.fit(x, per_doc, y, steps=60)) < start / 2


def test_a_giant_document_takes_no_other_ones_place(spark):
    order = [r.id for r in spark.sql("select id from range(400) where crc32(cast(cast(id as string) as binary)) % 5 <> 0 order by xxhash64(id), id").collect()][:200]
    text = lambda n, d: ("#$% XY!! " if n % 2 else "plain quiet words, ") * (60 * A.PASSAGE if d == order[0] else 5)
    df = spark.createDataFrame([(d, text(n, d), n % 2) for n, d in enumerate(order)], "doc_id long, text string, quality int")
    with_it, without = A.fit(df, df, fit_passages=50), A.fit(df.where(f"doc_id <> {order[0]}"), df, fit_passages=50)
    assert all((with_it.p[k] == without.p[k]).all() for k in with_it.p)
    assert not (with_it.p["c"] == A.GatedAttention().p["c"]).all()
    scores = {r.doc_id: r.score for r in A.score(df, with_it).collect()}
    assert np.mean([(scores[d] >= 0.5) == n % 2 for n, d in enumerate(order)]) > 0.95
    # one that would be too many is passed over: of 3, 1 and 2 passages with room for 4, the first two are used
    sizes = {order[0]: 3, order[1]: 1, order[2]: 2}
    three = spark.createDataFrame([(d, "word " * (n * A.PASSAGE), d == order[1]) for d, n in sizes.items()], "doc_id long, text string, quality boolean")
    used = A.fit(three, three, fit_passages=4)
    two = A.fit(three.where(f"doc_id <> {order[2]}"), three, fit_passages=4)
    assert all((used.p[k] == two.p[k]).all() for k in used.p)


def plain_passages(text):
    """Features of one passage after the other, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = []
    for at in range(0, max(1, len(words)), A.PASSAGE):
        own = words[at : at + A.PASSAGE]
        n, chars, seen = max(1, len(own)), max(1, sum(map(len, own))), Counter(own)
        count = lambda allowed: sum(c in allowed for w in own for c in w)  # noqa: B023, E731
        hashes = [int(A.K.Words(*A.K.text_bytes(A.pa.array([w])), A.K.SPACED, fold=False).hash[0]) for w in own]
        signs = [sum(1 if h >> k & 1 else -1 for h in hashes) / np.sqrt(n) / 4 for k in range(A.SIGNS)]
        out.append([
            1, sum(map(len, own)) / n / 8 if own else 0, min(count("#*$%&|<>") / n, 3), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, count("0123456789") / chars, count("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") / chars,
            min(count("!") / n, 3), sum(k - 1 for k in seen.values()) / n, sum(k for k in seen.values() if k > 1) / n, sum(w[-1] in ".," for w in own) / n, min(len(own) / A.PASSAGE, 1), *signs,
        ])
        if not own:
            out[-1] = [1] + [0] * (A.N_FEATURES - 1)
    return out


def test_features_equal_a_plain_walk(documents):
    texts = [*documents.values(), *WEIRD]
    x, per_doc = A.passages(A.pa.array(texts, A.pa.string()))
    want = [plain_passages(t) for t in texts]
    assert per_doc.tolist() == [len(w) for w in want]
    whole = np.array([row for w in want for row in w])
    # an empty passage's mean word length counts one character
    empty = whole[:, 10] == 0
    assert np.allclose(x[~empty], whole[~empty], rtol=0, atol=2e-5)
    assert np.allclose(x[empty][:, [0, *range(2, A.N_FEATURES)]], whole[empty][:, [0, *range(2, A.N_FEATURES)]], rtol=0, atol=2e-5)
