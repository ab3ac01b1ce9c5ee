"""Source divergence audit by duplicate-text collapse.

How far the words of each source of a language are from those of each other
source, and which words a source has more of than its language.

1. Collapse. Each task keeps one copy of a text of a language and counts its
   rows by source; these go to one place by the text's SHA-256, where a text is
   tokenized once, however many copies there are, and its terms' counts and
   document frequencies are added with the multiplicities of its sources.
2. Counts travel as a row for each term, with its sources in it. Each language
   keeps the terms of at least `LEAST_DOCS` of its documents.
3. Sources are evaluated in blocks of about `SOURCES` sources and `TERMS` terms: a task
   holds the counts of two blocks of sources. Only terms that one of both
   sources has are visited for a pair; the rest of a language's terms have the
   same value for it and are added as a number times that value. Of the terms
   that a source has more of, a task keeps the `TOP` first ones, as the result does.

Arithmetic is exact, in integers of 64 bits or, for counts of over nine billion,
of any size. Texts that share a SHA-256 are taken for equal.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .job import ship, stored

LEAST_DOCS, TOP = 3, 200
SOURCES, TERMS, HELD = 32, 1 << 14, 300_000
COPIES = "lang string, key binary, source string, n bigint, packed binary"
COUNTS = "lang string, term string, of array<struct<source:string,n:bigint,docs:bigint>>"
FOUND = "lang string, source string, part string, item string, value bigint, visited bigint, p bigint, q bigint, kept bigint"

# Bytes of terms (a-z and all of other code points) stay, A-Z are lower-cased, all others part terms.
_PARTED = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in pieces that are cut at its gaps."""
    plain, at = text.translate(_PARTED), 0
    while at < len(plain):
        end = plain.find(b" ", at + K.PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def copies(docs: DataFrame) -> DataFrame:
    """COPIES: from each task, a row with the packed text for each text of a language, and one with n rows for each of its sources.

    Nulls in text, lang and source count as empty.
    """
    ship(docs.sparkSession)
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    keyed = docs.select(*plain).select("lang", "source", F.unhex(F.sha2("text", 256)).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        seen: dict[tuple, int] = {}
        texts: set[tuple] = set()

        def told() -> pa.RecordBatch:
            lang, key, source = zip(*seen, strict=True)
            return _copies(lang, key, source, list(seen.values()), [None] * len(seen))

        for whole in batches:
            for batch in K.slices(whole):
                new = []
                for i, (lang, source, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "key")), strict=True)):
                    seen[lang, key, source] = seen.get((lang, key, source), 0) + 1
                    if (lang, key) not in texts:
                        texts.add((lang, key))
                        new.append((lang, key, i))
                if new:
                    lang, key, place = zip(*new, strict=True)
                    data = [t.encode() for t in batch.column("text").take(pa.array(place)).to_pylist()]
                    packed = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in data]
                    yield _copies(lang, key, [None] * len(new), [None] * len(new), packed)
                if len(seen) > HELD:
                    yield told()
                    seen.clear()
                    texts.clear()
        if seen:
            yield told()

    return keyed.mapInArrow(run, COPIES)


def _copies(lang, key, source, n, packed) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((lang, key, source, n, packed), kinds, strict=True)], names=["lang", "key", "source", "n", "packed"])


def weighted_counts(docs: DataFrame) -> DataFrame:
    """COUNTS, several rows a term: its occurrences, and the documents that have it, by source."""
    together = copies(docs).repartition("lang", "key").sortWithinPartitions("lang", "key", F.col("packed").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        counts: dict[tuple, Counter] = defaultdict(Counter)
        docs_of: dict[tuple, Counter] = defaultdict(Counter)
        now, packed, weights, grown = None, None, Counter(), 0

        def settle() -> int:
            """Adds the text's terms to each of its sources; at most so many are new."""
            text = codec.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
            whole = Counter()
            if list(weights.values()) == [1]:
                group = (now[0], *weights)
                distinct: set[bytes] = set()
                for some in terms_of(text):
                    counts[group].update(some)
                    distinct.update(some)
                docs_of[group].update(distinct)
                return len(distinct)
            for some in terms_of(text):
                whole.update(some)
            for source, m in weights.items():
                counts[now[0], source].update({t: m * k for t, k in whole.items()})
                docs_of[now[0], source].update(dict.fromkeys(whole, m))
            return len(whole) * len(weights)

        def told() -> Iterator[pa.RecordBatch]:
            for lang in {g[0] for g in counts}:
                names = [s for x, s in counts if x == lang]
                held: dict[bytes, list[int]] = defaultdict(list)
                for i, source in enumerate(names):
                    for t in counts[lang, source]:
                        held[t].append(i)
                if held:
                    yield _counted(lang, names, held, [counts[lang, s] for s in names], [docs_of[lang, s] for s in names])
            counts.clear()
            docs_of.clear()

        for batch in batches:
            for lang, key, source, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, key) != now:
                    if now is not None:
                        grown += settle()
                    if grown > HELD:  # most are known terms: only what is held counts
                        grown = sum(map(len, counts.values()))
                        if grown > HELD:
                            yield from told()
                            grown = 0
                    now, packed, weights = (lang, key), None, Counter()
                if text is None:
                    weights[source] += n
                elif packed is None:
                    packed = text
        if now is not None:
            settle()
        yield from told()

    return together.mapInArrow(run, COUNTS)


def _counted(lang: str, names: list[str], held: dict[bytes, list[int]], counts: list[Counter], docs: list[Counter]) -> pa.RecordBatch:
    at = np.fromiter((i for own in held.values() for i in own), dtype=np.int32)
    ends = np.cumsum([0, *map(len, held.values())], dtype=np.int32)
    each = [(counts[i][t], docs[i][t]) for t, own in held.items() for i in own]
    n, d = (pa.array(x, pa.int64()) for x in zip(*each, strict=True))
    source = pa.array(names, pa.string()).take(pa.array(at))
    of = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([source, n, d], names=["source", "n", "docs"]))
    terms = pa.array(list(held), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), terms, of], names=["lang", "term", "of"])


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n and of (source, n) of each term of at least so many documents of its language; counts: weighted_counts()."""
    each = counts.repartition("lang", "term").select("lang", "term", F.inline("of")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", F.col("total").alias("n"), "of")


def share(n: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / (total + kept)), exactly."""
    if int(n.max(initial=0)) < 9 * 10**9:
        return 1 + 10**9 * (n + 1) // (total + kept)
    return (1 + 10**9 * (n.astype(object) + 1) // (np.asarray(total, dtype=object) + kept)).astype(np.int64)


def distance(p: np.ndarray | int, q: np.ndarray | int) -> np.ndarray | int:
    """Shares are 10^9 at most, and those of a source add up to 10^9 and its number of terms, so sums fit in 64 bits."""
    return (p - q) * (p - q) // q


def pair_sums(zero: np.ndarray, block: np.ndarray, at: np.ndarray, term: np.ndarray, p: np.ndarray, across: bool) -> list[tuple[int, int, int, int]]:
    """For each ordered pair of sources, the sum over the terms that either has, and their number.

    zero and block: of each source, the share of a term that it does not have,
    and its block; entries (at: source, term, p: share), sorted by source.
    across: only pairs of two blocks.
    """
    starts = np.searchsorted(at, np.arange(len(zero) + 1))
    some = np.flatnonzero(starts[1:] > starts[:-1])

    def by_source(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(zero), dtype=np.int64)
        if len(some):
            out[some] = np.add.reduceat(values, starts[some])
        return out

    out, row = [], np.zeros(int(term.max(initial=-1)) + 1, dtype=np.int64)
    for g in range(len(zero)):
        own = slice(starts[g], starts[g + 1])
        row[term[own]] = p[own]
        mine = row[term]
        row[term[own]] = 0
        both = mine > 0
        theirs = by_source(distance(np.where(both, mine, zero[g]), p))
        less = by_source(np.where(both, distance(mine, zero[at]), 0))
        shared = by_source(both.astype(np.int64))
        for h in range(len(zero)):
            if h != g and not (across and block[h] == block[g]):
                rest = int(distance(p[own], zero[h]).sum()) - int(less[h])
                visited = int(starts[g + 1] - starts[g] + starts[h + 1] - starts[h] - shared[h])
                out.append((g, h, int(theirs[h]) + rest, visited))
    return out


def _evaluator(top: int):
    def run(table: pa.Table) -> pa.Table:
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
        is_head = pc.is_null(table.column("term"))
        head, rows = table.filter(is_head), table.filter(pc.invert(is_head)).combine_chunks()
        names = [s[0] for s in head.column("sources").to_pylist()]
        total, kept, lang_total = np.array(head.column("counts").to_pylist(), dtype=np.int64).T
        kept, lang_total = int(kept[0]), int(lang_total[0])
        zero = share(np.zeros(len(names), dtype=np.int64), total, kept) if kept else np.ones(len(names), dtype=np.int64)
        out: list[tuple] = []
        at, term, n = (np.empty(0, dtype=np.int64) for _ in range(3))
        if rows.num_rows:
            lists = rows.column("sources").combine_chunks()
            # a term has a row for each block of sources
            term = np.repeat(rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), lists.value_lengths().to_numpy())
            at = pc.index_in(lists.flatten(), value_set=pa.array(names, pa.string())).to_numpy().astype(np.int64)
            n = rows.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, term, n = at[order], term[order], n[order]
        p = share(n, total[at], kept)
        for g, h, value, visited in pair_sums(zero, head.column("block").to_numpy(), at, term, p, i != j):
            out.append((names[g], "pair", names[h], value, visited, int(zero[g]), int(zero[h])))
        if rows.num_rows and i == j:
            q = share(rows.column("n").to_numpy().astype(np.int64), lang_total, kept)[term]
            texts = rows.column("term").combine_chunks()
            rank = np.empty(rows.num_rows, dtype=np.int64)
            rank[pc.sort_indices(texts.cast(pa.binary())).to_numpy()] = np.arange(rows.num_rows)
            value = distance(p, q)
            starts = np.searchsorted(at, np.arange(len(names) + 1))
            for g, name in enumerate(names):
                more = starts[g] + np.flatnonzero((p > q)[starts[g] : starts[g + 1]])
                first = more[np.lexsort((rank[term[more]], -value[more]))[:top]]
                out += [(name, "term", t, int(v), 0, 0, 0) for t, v in zip(texts.take(pa.array(term[first])).to_pylist(), value[first], strict=True)]
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4)
        arrays = [pa.array([lang] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array([kept] * len(out), pa.int64())]
        return pa.table(arrays, names=["lang", "source", "part", "item", "value", "visited", "p", "q", "kept"])

    return run


def evaluate(kept: DataFrame, groups: DataFrame, top: int = TOP, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item and value, of terms with more than the `top` first ones of a source.

    kept: kept_terms(); groups: lang and source of all there are.
    """
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    of_group = kept.select("lang", F.inline("of")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(of_lang, "lang", "left").fillna(0, ["kept", "lang_total"])
    n_blocks, parts = F.ceil(F.col("sources") / sources), F.greatest(F.lit(1), F.ceil(F.col("kept") / terms))
    langs = stored(langs.select("lang", "kept", "lang_total", n_blocks.alias("n_blocks"), parts.alias("parts")))
    block = lambda source: F.pmod(F.xxhash64(source), F.col("n_blocks"))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    info = groups.join(of_group, ["lang", "source"], "left").join(langs, "lang")
    heads = info.select(
        "lang", F.explode(upto("parts")).alias("part"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), F.array("source").alias("sources"),
        F.array(F.coalesce("total", F.lit(0).cast("bigint")), "kept", "lang_total").alias("counts"), block("source").alias("block"), "n_blocks",
    )
    placed = kept.join(langs, "lang").withColumn("of", F.transform("of", lambda e: F.struct(e["source"].alias("source"), e["n"].alias("n"), block(e["source"]).alias("block"))))
    dealt = placed.select("lang", F.pmod(F.xxhash64("term"), "parts").alias("part"), "term", "n", "of", "n_blocks", F.explode(F.array_distinct("of.block")).alias("block"))
    dealt = dealt.withColumn("of", F.filter("of", lambda e: e["block"] == F.col("block")))
    rows = dealt.select("lang", "part", "term", "n", F.col("of.source").alias("sources"), F.col("of.n").alias("counts"), "block", "n_blocks")
    met = heads.unionByName(rows).withColumn("other", F.explode(upto("n_blocks")))
    met = met.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "part", "term", "n", "sources", "counts", "block")
    found = met.groupBy("lang", "i", "j", "part").applyInArrow(_evaluator(top), FOUND)
    summed = found.groupBy("lang", "source", "part", "item").agg(*[F.sum(c).alias(c) for c in ("value", "visited")], *[F.first(c).alias(c) for c in ("p", "q", "kept")])
    rest = F.expr("case when part = 'pair' then (kept - visited) * (((p - q) * (p - q)) div q) else 0 end")
    return summed.select("lang", "source", "part", "item", (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank; see the module.

    Part pair has each other source of the language, part term the terms that
    the source has a greater share of than the language, up to rank top. Null
    texts, languages and sources count as empty ones; repeated rows count as
    often as they are there; ties are ranked by the item's bytes; a source
    without terms has only pairs, and a language without kept terms only pairs
    of value 0. Other columns are not read. No rows give no rows.
    """
    kept = stored(kept_terms(weighted_counts(docs), least_docs))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = evaluate(kept, groups, top).withColumn("rank", F.row_number().over(by_value))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
