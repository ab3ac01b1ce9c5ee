import re

from ocuspark.llm import license_scan as L
from ocuspark.llm.queries import op8_license_scan

from .conftest import SMALL, rows

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def added(text, templates=None):
    """Labels and score, by trying every band of diagonals of every template."""
    w, out = words(text), {label: 1.0 for label in base(text)[4].split(",") if label}
    for label, template in (L.TEMPLATES if templates is None else templates).items():
        t = words(template)
        votes = sorted((at, -p) for at in range(len(w) - 1) for p in range(len(t) - 1) if w[at : at + 2] == t[p : p + 2])
        for low in {(at + p) // L.SPREAD * L.SPREAD - k * L.SPREAD for at, p in votes for k in (0, 1)}:
            own = [(at, -p) for at, p in votes if low <= at + p < low + 2 * L.SPREAD]
            best = []
            for i, (at, p) in enumerate(own):  # longest row that ascends in text and template
                best.append(1 + max((best[j] for j in range(i) if own[j][0] < at and own[j][1] < p), default=0))
            share = max(best, default=0) / (len(t) - 1)
            if share >= L.LEAST:
                out[label] = max(out.get(label, 0), share)
    return ",".join(sorted(out)), max(out.values(), default=0.0)


def check(r, text):
    assert (r.labels, round(r.score, 9)) == (added(text)[0], round(added(text)[1], 9))
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
    assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_query_equals_brute_force(spark, documents):
    got = rows(op8_license_scan(spark, SMALL))
    assert got.keys() == documents.keys()
    for d, text in documents.items():
        check(got[d], text)


def test_edges_and_whole_license_texts(spark):
    mit = L.TEMPLATES["mit"]
    edited = mit.replace("free of charge", "entirely free of any charge").replace("documentation", "docs")
    texts = [None, "", "CC-BY", "cc cc by by", "General  public\nLICENSE general public license", "all rights\x00reserved All Rights Reserved", "x " * 5000 + mit, edited, mit[:60], "by cc", "É CC BY é", "cc by " * 3000, "the end of all rights"]
    apache, bsd = L.TEMPLATES["apache"], L.TEMPLATES["bsd"]
    texts += ["licensed under " * 40 + apache, "licensed under x " * 30 + apache, apache + " licensed under the apache" * 50]  # 13, 14, 15
    texts += [" ".join(reversed(words(apache))), " ".join(words(apache)[10:] + words(apache)[:10]), " word ".join(words(bsd)), bsd[:60] + " a b c d e f" + bsd[60:], (mit + " ") * 3]  # 16 to 20
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)] * 2 + [(None, "cc by", "x", 3)], "doc_id long, text string, label string, key int")
    found = L.scan(df).collect()
    assert len(found) == 2 * len(texts) + 1
    for r in found:
        check(r, "cc by" if r.doc_id is None else texts[r.doc_id])
    got = {r.doc_id: r for r in found}
    assert got[6].labels == "mit" and got[6].score == 1 and got[7].labels == "mit" and 0.6 <= got[7].score < 1 and got[8].labels == ""
    assert all(got[i].labels == "apache" and got[i].score == 1 for i in (13, 14, 15)) and not got[16].labels
    spans = [r for r in L.matches(df.where("doc_id in (13, 20)")).collect() if r.share == 1]
    assert sorted((r.label, r.first, r.last) for r in spans) == sorted([("apache", 80, 79 + len(words(apache)))] + [("mit", i * len(words(mit)), (i + 1) * len(words(mit)) - 1) for i in range(3)])
    assert L.scan(df.limit(0)).collect() == []


def test_templates_of_ones_own(spark):
    """Labels of the caller's texts alone; phrases stay; the same brute force at another table."""
    own = {"house": "You may read this text aloud to your friends but you must not print it on paper without asking us first", "short": "one two", "void": ""}
    texts = [own["house"], own["house"].replace("aloud ", ""), "You may read this text. " * 3, "one two one two", "All rights reserved. " + own["house"].upper(), L.TEMPLATES["mit"], None, "", "one", own["house"][40:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for templates in (own, {}):
        for r in L.scan(df, templates).collect():
            assert (r.labels, round(r.score, 9)) == (added(texts[r.doc_id], templates)[0], round(added(texts[r.doc_id], templates)[1], 9))
    assert {r.labels for r in L.scan(df, own).collect()} == {"house", "", "short", "house,reserved"}
    try:
        L.template_positions(spark, {"long": "word " * (L.MOST_WORDS + 1)})
        raise AssertionError
    except ValueError as e:
        assert "words" in str(e)


def test_each_known_license_is_found_as_itself(spark):
    df = spark.createDataFrame([(i, f"Before it. {t} After it.", label) for i, (label, t) in enumerate(L.TEMPLATES.items())], "doc_id long, text string, want string")
    want = {r.doc_id: r.want for r in df.collect()}
    for r in L.scan(df).collect():
        assert want[r.doc_id] in r.labels.split(",") and r.score == 1
