from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerflow.llm import buckets


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_pad_least(seed):
    rng = np.random.default_rng(seed)
    length = np.sort(rng.choice(60, 8, replace=False) + 1)
    count = rng.integers(0, 30, 8)
    pad = lambda ends: sum(int(c) * (min(e for e in ends if e >= n) - int(n)) for n, c in zip(length, count, strict=True))
    for k in (1, 2, 3, 8, 12):
        ends = buckets.boundaries(length, count, k)
        least = min(pad([*some, length[-1]]) for n in range(min(k, 8)) for some in combinations(length[:-1], n))
        assert len(ends) <= k and ends == sorted(ends) and pad(ends) == least


def test_all_pieces_are_packed_once(documents, monkeypatch):
    monkeypatch.setattr(buckets, "RANGE_ROWS", 16)
    options = {"longest": 512, "align": 8, "buckets": 4, "budget": 2048}
    rows = buckets.pack(documents, **options).collect()
    sizes = {r.doc_id: r.n for r in documents.select("doc_id", buckets.words().alias("n")).collect()}
    joined = {}
    for r in rows:
        joined[r.doc_id] = joined.get(r.doc_id, 0) + r.length
        assert r.start == 512 * r.piece and r.n_tokens == sizes[r.doc_id] and 0 < r.length <= r.padded
    assert joined == sizes
    ends = sorted({r.padded for r in rows})
    assert len(ends) == 4 and all(r.padded == min(e for e in ends if e >= r.length) for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), held in batches.items():
        fits = 2048 // held[0].padded
        assert sorted(r.slot for r in held) == list(range(len(held))) and len(held) <= fits
        assert len(held) == fits or (bucket, batch + 1) not in batches
    total = sum(r.padded - r.length for r in rows)
    assert total <= sum(512 * 1 - r.length for r in rows)


def test_odd_rows(odd_documents, no_documents):
    rows = buckets.pack(odd_documents).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == 13 and len(by[10]) == 5 and sum(r.length for r in by[10]) == 40000
    for doc in (1, 2, 3):
        assert [(r.piece, r.length, r.bucket, r.batch, r.slot) for r in by[doc]] == [(0, 0, None, None, None)]
    assert buckets.pack(no_documents).count() == 0
    twice = odd_documents.union(odd_documents).withColumn("bucket", F.lit("x"))
    places = [(r.bucket, r.batch, r.slot) for r in buckets.pack(twice).where("length > 0").collect()]
    assert len(places) == len(set(places)) == 2 * sum(r.length > 0 for r in rows)
