import re

from ocuspark.llm import decontaminate as D
from ocuspark.llm.queries import op1_decontamination

from .conftest import SMALL, rows

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, window=13):
    index = {}
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            index.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    sizes = {len(x) for x in index}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (who := index.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= who
        out.append((d, len(w), len(hit), len(found), D.digest(list(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_query_equals_brute_force(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in op1_decontamination(spark, SMALL).collect())
    assert got == sorted(brute(documents.items(), items))
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_edges_and_blocks(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    items = [(1, "Alpha beta"), (2, None), (3, ""), (4, long[100:400]), (5, "one"), (6, " ".join(f"w{i}" for i in range(50, 63))), (7, "alpha BETA"), (None, "zz yy xx")]
    docs = [(1, None), (2, ""), (3, long), (3, long), (4, "x alpha beta one"), (5, "ONE"), (6, " ".join(f"w{i}" for i in range(50, 62))), (7, "!!! --"), (None, "zz yy xx"), (8, "one one one alpha, Beta")]
    docs_df = spark.createDataFrame([(d, t, "other", 1) for d, t in docs], "doc_id long, text string, item_id string, n int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted(brute(docs, [("" if i is None else i, t) for i, t in items if t is not None]), key=str)
    for block in (1_000_000, 20):
        found = D.contamination(D.find_overlaps(docs_df, bench, block_words=block))
        got = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert D.drop_contaminated(docs_df, bench).columns == docs_df.columns
    none = D.contamination(D.find_overlaps(docs_df, bench.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert D.find_overlaps(docs_df.limit(0), bench).collect() == []


def test_long_items_are_cut_into_pieces_with_all_windows():
    for n in (12, 13, 20, 21, 33, 100):
        text = ", ".join(f"É{i}A" for i in range(n)) + "!"
        pieces = [words(t) for t, size in D._pieces(text, n, 13, 20) if len(words(t)) == size]
        assert all(len(w) <= 20 + 12 for w in pieces) and (len(pieces) > 1) == (n > 32)
        cut = [tuple(w[i : i + 13]) for w in pieces for i in range(max(1, len(w) - 12))]
        assert cut == [tuple(words(text)[i : i + 13]) for i in range(max(1, n - 12))]


def test_spans_end_with_their_text(spark):
    bench = spark.createDataFrame([(1, "a b"), (2, "b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b c x b c")], "doc_id long, text string").coalesce(1)
    got = rows(D.find_overlaps(docs, bench))
    assert [tuple(x) for x in got[1].hit_spans] == [(0, 2)]
    assert [tuple(x) for x in got[2].hit_spans] == [(0, 3), (4, 6)] and got[2].item_ids == ["1", "2"]
