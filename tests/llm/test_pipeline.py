import re

import corpus_pipeline as P
from ocuspark.llm import jaccard, secret_scan
from ocuspark.llm.decontaminate import contamination, find_overlaps

from .conftest import SMALL, rows
from .test_jaccard import brute
from .test_mixing import check
from .test_quality import base


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in P.STAGES:
        stage(spark, kept[-1], SMALL).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    raw, good, single, clean, safe, mixed = kept
    assert all(df.columns == docs.columns for df in kept[:-1])
    texts = {r.doc_id: r.text for r in raw.collect()}
    assert all(not base(r.text)[5] for r in good.collect())
    assert sum(not base(t)[5] for t in texts.values()) - good.count() <= 12
    stays = {d for d, _, c in brute([(r.doc_id, r.text) for r in good.collect()]) if d == c}
    assert {r.doc_id for r in single.collect()} == stays
    dirty = contamination(find_overlaps(single, spark.read.parquet(f"{SMALL}/benchmark.parquet"))).where("contaminated")
    assert {r.doc_id for r in clean.collect()} == stays - {r.doc_id for r in dirty.collect()}
    found = rows(secret_scan.digests(secret_scan.find_secrets(clean)))
    for r in safe.collect():
        assert (r.text == texts[r.doc_id]) == (found[r.doc_id].spans == "")
        assert not re.search(r"[0-9a-f]{32}", r.text)
    check(mixed.collect(), [(r.doc_id, r.text, r.source) for r in safe.collect()])
    whole = sorted(map(tuple, P.run(spark, SMALL).collect()))
    assert whole == sorted(map(tuple, mixed.collect()))


def test_empty_and_odd_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 9000, "en", "s", 45000)], schema)
    for docs in (none, odd):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SMALL)
        docs.collect()
    assert jaccard.keep_representatives(odd).count() == 4
