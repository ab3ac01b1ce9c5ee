import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from ocuspark.llm import repeats as R
from ocuspark.llm import textkit as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b#9😀", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_patterns(texts):
    data, offsets = K.text_bytes(pa.array(texts, pa.string()))
    for table, fold, pattern in ((K.SPACED, False, r"[^\x20\x09-\x0D]+"), (K.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = K.Words(data, offsets, table, fold)
        got = [(int(d), bytes(words.data[s:e]).decode()) for d, s, e in zip(words.doc, words.start, words.end, strict=True)]
        fixed = [(t or "").replace("B", "b") if fold else t or "" for t in texts]
        want = [(i, w) for i, t in enumerate(fixed) for w in re.findall(pattern, t)]
        assert got == want
        hashes = {w: h for (_, w), h in zip(got, words.hash.tolist(), strict=True)}
        assert len(set(hashes.values())) == len(hashes)
        at, windows = words.windows(3)
        seen = {}
        for i, h in zip(at.tolist(), windows.tolist(), strict=True):
            assert got[i][0] == got[i + 2][0]
            assert seen.setdefault(h, [w for _, w in got[i : i + 3]]) == [w for _, w in got[i : i + 3]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 12))
def test_minimizers_are_leftmost_minima(values, w):
    hashes = K.mix(np.array(values, dtype=np.uint64))
    got = K.minimizers(hashes, w).tolist()
    high = hashes >> K.U64(21)
    assert got == [i + int(np.argmin(high[i : i + w])) for i in range(len(values) - w + 1)]


def test_pieces_do_not_matter(monkeypatch):
    rng = np.random.default_rng(0)
    values, text = K.mix(rng.integers(0, 2**63, 5000).astype(np.uint64)), " ".join("x" * int(n) for n in rng.integers(1, 90, 300))
    data, offsets = K.text_bytes(pa.array([text, None, text[7:]]))
    whole = K.rolling(values, 40), K.minimizers(values, 50), K.Words(data, offsets, K.SPACED, False).hash
    monkeypatch.setattr(K, "PIECE", 64)
    parts = K.rolling(values, 40), K.minimizers(values, 50), K.Words(data, offsets, K.SPACED, False).hash
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**31), unique=True, max_size=50), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(ids, hashes):
    ids = np.array(sorted(ids), dtype=np.int64)
    assert (R.unpack_ids(R.pack_ids(ids)) == ids).all()
    values = np.array(hashes, dtype=np.uint64)
    assert (R.unpack(R.pack(values)) == (values & K.U64((1 << 56) - 1))).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=20), min_size=1, max_size=5))
def test_entries_settle_to_counts(chunks):
    every = [K.mix(np.array(c, dtype=np.uint64)) for c in chunks]
    flat, times = np.unique(np.concatenate(every), return_counts=True)
    repeated = set(flat[times > 1].tolist())
    known, by_bucket = [], {}
    for n, h in enumerate(every):
        rows, own = R.entries(n, h, 9)
        known.append(own.copy())
        for bucket, chunk, packed, ids in rows:
            by_bucket.setdefault(bucket, []).append((chunk, (R.unpack(packed), R.unpack_ids(ids))))
    for parts in by_bucket.values():
        for (chunk, _), found in zip(parts, R.shared_by_sorting([p for _, p in parts]), strict=True):
            known[chunk][found] = True
    for h, flags in zip(every, known, strict=True):
        assert flags.tolist() == [int(x) in repeated for x in h]


def test_gathered_batches_keep_all_rows_in_order():
    texts = ["a" * n for n in (5, 0, 100, 3, 3, 3, 50, 50)] + [None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 2], pa.string()), "n": list(range(i, min(i + 2, len(texts))))}) for i in range(0, len(texts), 2)]
    got = list(K.gathered(iter(batches), limit=60))
    assert [n for b in got for n in b.column("n").to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 60 for b in got)
    assert list(K.gathered(iter([]), limit=9)) == []


def test_chunks_hold_slices_of_one_size_whatever_their_own(monkeypatch):
    monkeypatch.setattr(R, "chunk_numbers", itertools.count)
    texts = pa.array(["x" * 700_000] * 40 + ["y" * 9_000_000, None, ""])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for chunk_bytes in (1 << 20, 1 << 21, 1 << 23, 1 << 26):
        seen = []
        numbers = []
        for n, slices in R.chunks(iter([batch]), chunk_bytes, lambda b: [len(t.as_py() or "") for t in b.column("text")]):
            numbers.append(n)
            seen += slices
        assert [x for part in seen for x in part] == [len(t.as_py() or "") for t in texts]
        assert all(sum(part) <= R.CHUNK_BYTES or len([x for x in part if x]) == 1 for part in seen)
        assert numbers == list(range(len(numbers)))
    assert len(numbers) == 1


def test_plan_has_constant_bounds(spark):
    class Sized:
        def __init__(self, n):
            self.n = n

        def agg(self, *_):
            return self

        def first(self):
            return self

    for n in (0, 10**9, 10**12, 10**14, 10**16):
        bits, chunk_bytes = R.plan(Sized(n))
        assert R.CHUNK_BYTES <= chunk_bytes <= R.MOST_BYTES and n / 2**bits <= R.MOST_BYTES
