import brute
import numpy as np

from layerflow.llm import sketches
from layerflow.llm.components import connected


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force_on_the_small_table(documents):
    expected = brute.near_duplicates([(r.doc_id, r.text) for r in documents.collect()])
    result = sketches.near_duplicates(documents)
    assert got(result) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in result.collect())


def test_odd_rows(odd_documents, no_documents):
    expected = brute.near_duplicates([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert got(sketches.near_duplicates(odd_documents)) == expected
    assert expected[1] == (0, 1) and expected[9][1] == 7 and expected[5][1] == 4
    assert sketches.near_duplicates(no_documents).count() == 0
    assert sketches.deduplicated(odd_documents).columns == odd_documents.columns


def test_repeated_rows_are_returned_for_each(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in sketches.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_blocks_lose_no_link(spark, monkeypatch):
    """A hot group of different near copies, cut into many blocks."""
    monkeypatch.setattr(sketches, "BLOCK", 8)
    monkeypatch.setattr(sketches, "TEXT_BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(1000)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(sketches.near_duplicates(df)) == brute.near_duplicates(docs)


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**32, (50, sketches.SAMPLES), dtype=np.uint32)
    b = a.copy()
    b[:, : sketches.SAMPLES // 5] = rng.integers(0, 2**32, (50, sketches.SAMPLES // 5), dtype=np.uint32)
    bits = np.bitwise_count(sketches.odd_sketch(a) ^ sketches.odd_sketch(b)).sum(1)
    assert abs(sketches.similarity(bits).mean() - 0.8) < 0.01


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(20, 60)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(path, "a long, b long")
    expected = brute.parts([(a, b) for a, b in path if a is not None and a != b], {*range(100, 141), 7, *range(20, 60)})
    assert {r.id: r.component for r in connected(df).collect()} == expected
    assert connected(df.where("a < 0")).count() == 0


def test_one_row_of_each_kept_id_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", None), (2, "a b c d e f", "x"), (3, "g h i", "y"), (4, None, "z"), (4, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `component.id` string")
    result = sketches.deduplicated(df)
    assert result.columns == df.columns
    found = sorted((r[0], r[1]) for r in result.collect())
    assert found == [(1, "a b c d e f"), (3, "g h i"), (4, None)]
    assert sorted(result.collect(), key=str) == sorted(sketches.deduplicated(df.repartition(3)).collect(), key=str)


def test_rows_without_an_id_are_documents(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(7, text, "a"), (None, text, "a"), (None, "p q r s t u", "a"), (None, "p q r s t u", "a"), (None, "p q r s t u", "b"), (None, "", "a"), (None, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted(((r.doc_id, r.text) for r in sketches.deduplicated(df).collect()), key=str)
    assert found == sorted([(7, text), (None, "p q r s t u"), (None, ""), (None, None)], key=str)
