import sys
from pathlib import Path

import brute
import numpy as np
import test_suffixes

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from layerflow.llm import language, mixture  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plain_cut(docs):
    """Texts without the bytes that 200-byte repeats cover, of (doc_id, text) pairs."""
    seen = {}
    data = {i: t.encode() for i, t in docs}
    for i, d in data.items():
        for k in range(len(d) - 199):
            seen[d[k : k + 200]] = seen.get(d[k : k + 200], 0) + 1
    result = {}
    for i, d in data.items():
        out = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                out[k : k + 200] = b"\x01" * 200
        rest = bytes(b for b, o in zip(d, out, strict=True) if not o)
        if rest.decode("utf-8", "ignore") or not any(out):
            result[i] = rest.decode("utf-8", "ignore")
    return result


def test_each_stage_against_plain_versions(spark, documents, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "suffix_dedup", "mixing", "packing"]
    docs, held = documents, [{r.doc_id: r for r in documents.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SMALL)
        if k < 4:
            assert result.columns == documents.columns
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs.collect())
        if k < 4:
            held[-1] = {r.doc_id: r for r in held[-1]}
    every, known, single, cut, mixed, packed = held
    # Language: what has no letter goes; what the fitted model finds clear stays as it is.
    scored = {r.doc_id: r for r in language.predictions(documents).collect()}
    assert set(known) == {i for i, r in scored.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert all(known[i] == every[i] for i in known) and len(known) >= 0.95 * len(every)
    # Near-duplicates: the first document of each group.
    parts = brute.near_duplicates([(i, r.text) for i, r in known.items()], 80)
    assert set(single) == {i for i, (_, top) in parts.items() if i == top} and len(single) < len(known)
    assert all(single[i] == known[i] for i in single)
    # Repeated strings: cut on what was left.
    expected = plain_cut([(i, r.text) for i, r in single.items()])
    assert {i: r.text for i, r in cut.items()} == expected
    assert all(r.n_chars == len(r.text) for i, r in cut.items() if r.text != single[i].text)
    # Mixing: whole documents, about nine tenths of the tokens.
    size = {i: len(brute.WORD.findall(r.text)) for i, r in cut.items()}
    assert set(mixed) < set(cut) and all(mixed[i] == cut[i] for i in mixed)
    total, used = sum(size.values()), sum(size[i] for i in mixed)
    assert int(0.9 * total) <= used <= int(0.9 * total) + len(mixture.WEIGHTS) * 3 * max(size.values())
    # Packing: each word of each document once.
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert r.length <= r.padded
    assert lengths == {i: size[i] for i in mixed}


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "length", "bucket", "batch", "slot"} <= set(rows.columns)
    places = [(r.bucket, r.batch, r.slot) for r in rows.collect()]
    assert len(places) == len(set(places)) > 100


def test_stages_take_odd_rows_and_empty_tables(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs.collect()
    assert test_suffixes.brute([(1, None)])[1][0] == 0


def test_a_row_stored_twice_stays_once(spark, documents):
    """Neither row of a document of 200 bytes or more may be cut as the other's repeat."""
    once = [r for r in documents.collect() if len((r.text or "").encode()) >= 400][:12]
    docs = spark.createDataFrame([*once, *once[:5]], documents.schema)
    stages = dict(corpus_pipeline.STAGES)
    single = stages["near_dedup"](spark, docs, SMALL)
    expected = stages["near_dedup"](spark, spark.createDataFrame(once, documents.schema), SMALL)
    assert sorted(single.collect()) == sorted(expected.collect())
    cut = {r.doc_id: r.text for r in stages["suffix_dedup"](spark, single, SMALL).collect()}
    assert cut == plain_cut([(r.doc_id, r.text) for r in expected.collect()]) and len(cut) > 5


def test_text_of_near_copies_stays_once(spark, documents):
    """Copies alike to 80 to 85 %: one of them stays, with the whole of the text."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrst")
    words = lambda n: ["".join(rng.choice(letters, 5)) for _ in range(n)]
    rows, pairs = [], []
    for k in range(20):
        base = words(300)
        other = list(base)
        for at in range(8, 8 + 40 * (6 + k % 2), 40):
            other[at] = "changed"
        a, b = " ".join(base), " ".join(other)
        shared = len(brute.shingles(a) & brute.shingles(b))
        alike = shared / (2 * 296 - shared)
        assert 0.78 < alike < 0.86
        pairs.append((2 * k, 2 * k + 1, alike))
        rows += [(2 * k, a, "en", "s", len(a)), (2 * k + 1, b, "en", "s", len(b))]
    assert sum(0.8 <= alike < 0.85 for _, _, alike in pairs) > 5
    docs = spark.createDataFrame(rows, documents.schema)
    stages = dict(corpus_pipeline.STAGES)
    single = stages["near_dedup"](spark, docs, SMALL)
    single = {r.doc_id: r.text for r in stages["suffix_dedup"](spark, single, SMALL).collect()}
    for a, b, alike in pairs:
        if alike >= 0.8:
            assert b not in single and single[a] == rows[a][1]
