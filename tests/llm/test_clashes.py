"""Extra columns whose names the operators use themselves."""

import corpus_pipeline
import pytest
from ocuspark.llm import attention_mil, chat, decontaminate, jaccard, license_scan, mixing, quality_rules, secret_scan, substring, suffix_family

NAMES = (
    "key spans n_words n_hit hit_spans item_ids contaminated kept base extra anomaly score n_passages chunk bucket hashes ids notes skey tokens packed same open gone class least "
    "number block first_word size target taken order nth ahead s b label quality n at gram place template n_chars source base_failed _own0 N_Removed _text a.b whole times component leaders"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    text = "some words of a text with password=abcdefgh1234 cc by " + " ".join(f"w{i}" for i in range(90))
    rows = [(i, text if i < 2 else f"other {i}", *[f"{c}{i}" for c in NAMES]) for i in range(4)]
    return spark.createDataFrame(rows, ["doc_id", "text", *NAMES])


def test_columns_stay_or_give_way(spark, docs):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13", "x")], "item_id long, text string, item_ids string")
    labels = docs.selectExpr("doc_id", "1 quality", "text", "kept")
    added = {
        "decontaminate": (decontaminate.find_overlaps(docs, bench), {"n_words", "hit_spans", "item_ids"}),
        "quality": (quality_rules.judge(docs, None), {*quality_rules.BASE, "base_failed", "anomaly", "kept"}),
        "attention": (attention_mil.score(docs, attention_mil.fit(docs, labels)), {"score", "n_passages"}),
        "secrets": (secret_scan.find_secrets(docs), {"base", "extra"}),
        "substring": (substring.remove_repeats(docs), {"n_words", "n_removed", "kept_sha256", "kept_text"}),
        "suffix": (suffix_family.remove_repeats(docs), {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"}),
    }
    for name, (df, new) in added.items():
        stay = [c for c in docs.columns if c.lower() not in new and not (name == "suffix" and c == "text")]
        assert df.columns[: len(stay)] == stay and set(df.columns[len(stay) :]) == new, name
        rows = {r.doc_id: r for r in df.collect()}
        assert all(rows[i][c] == f"{c}{i}" for i in range(4) for c in stay if c in NAMES), name


def test_filters_keep_all_columns(spark, docs):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")], "item_id long, text string")
    labels = docs.selectExpr("doc_id", "1 quality", "kept")
    for df, ids in (
        (decontaminate.drop_contaminated(docs, bench), {2, 3}),
        (quality_rules.keep_good(docs, labels), {0, 1}),
        (jaccard.keep_representatives(docs), {0, 2, 3}),
        (secret_scan.redact(docs.withColumn("n_chars", docs.doc_id)), {0, 1, 2, 3}),
    ):
        assert df.columns == docs.columns
        rows = {r.doc_id: r for r in df.collect()}
        assert rows.keys() == ids and all(rows[i]["key"] == f"key{i}" and rows[i]["kept"] == f"kept{i}" for i in ids)


def test_reports_do_not_see_them(spark, docs):
    assert mixing.taken(docs).count() == license_scan.scan(docs).count() == jaccard.near_duplicates(docs).count() == 4
    turns = docs.selectExpr("doc_id conv_id", "1L turn", "'user' role", *[f"`{c}`" for c in docs.columns if c not in ("doc_id",)])
    assert chat.digests(chat.read_back(chat.render(chat.fold(chat.turn_events(turns))))).count() == 4


def test_stages_of_the_pipeline(spark, docs):
    odd = docs.selectExpr("doc_id", "text", "'en' lang", *[f"`{c}`" for c in NAMES if c != "n_chars"], "cast(length(text) as bigint) n_chars")
    kept = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == odd.columns, name
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows.keys() == {0} and all(rows[0][c] == f"{c}0" for c in NAMES if c not in ("n_chars",))
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001").count() == 1
