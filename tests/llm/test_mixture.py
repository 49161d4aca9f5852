import brute
from pyspark.sql import functions as F

from layerflow.llm import mixture


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000, ("b", "y"): 1000}
    given = mixture.budgets(leaves, {}, 400)
    assert given == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    leaves[("a", "y")] = 20  # now the whole of a is short
    given = mixture.budgets(leaves, {}, 400)
    assert given == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 185, ("b", "y"): 185}


def test_weights_rounding_and_limits():
    assert mixture.share_out(10, [(1, 100), (1, 100), (1, 100)]) == [4, 3, 3]
    assert mixture.share_out(100, [(3, 100), (1, 100)]) == [75, 25]
    assert mixture.share_out(100, [(0, 100), (1, 30)]) == [0, 30]
    assert mixture.share_out(5, []) == []
    assert mixture.budgets({}, {}, 5) == {}
    assert mixture.budgets({("a", "x"): 50, ("b", "x"): 50}, {("a",): 0.0}, 80) == {("a", "x"): 0, ("b", "x"): 50}


def words(text):
    return len(brute.WORD.findall(text or ""))


def test_leaf_prefixes_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(mixture, "RANGE_ROWS", 3)
    docs = mixture.with_domain(documents)
    weights = {**mixture.WEIGHTS, ("curated",): 8.0}
    rows = mixture.select(docs, weights, share=0.8, epochs=3, seed=5).collect()
    size, held = {}, {}
    for r in docs.collect():
        leaf = (r.domain, r.lang or "(none)", r.source or "(none)")
        size[r.doc_id] = (leaf, words(r.text))
        held[leaf] = held.get(leaf, 0) + words(r.text)
    given = mixture.budgets({k: 3 * v for k, v in held.items()}, weights, int(0.8 * sum(held.values())))
    assert any(given[k] > held[k] for k in held) and any(0 < given[k] < held[k] for k in held)
    key = spark.createDataFrame([(i, given[leaf] // held[leaf] if held[leaf] else 0) for i, (leaf, _) in size.items()], "i long, w long")
    place = {r.i: r.h for r in key.select("i", F.xxhash64(F.lit(5), "w", "i").alias("h")).collect()}
    expected = {}
    for leaf in held:
        whole, rest = divmod(given[leaf], held[leaf]) if held[leaf] else (0, 0)
        for i in sorted((i for i in size if size[i][0] == leaf), key=lambda i: (place[i], i)):
            n = size[i][1]
            expected[i] = (whole + (rest > 0), whole * n + min(n, rest))
            rest -= min(n, rest)
    assert {r.doc_id: (r.copies, r.tokens_taken) for r in rows} == expected
    assert sum(r.tokens_taken for r in rows) == sum(given.values())


def test_odd_rows(odd_documents, no_documents):
    clash = odd_documents.withColumn("copies", F.lit("x")).withColumn("domain", F.lit(None).cast("string"))
    rows = {r.doc_id: r for r in mixture.select(clash, {}, share=1.0).collect()}
    assert len(rows) == 13 and rows[10].n_tokens == rows[10].tokens_taken == 40000
    assert rows[1].n_tokens == 0 and rows[1].tokens_taken == 0
    assert mixture.select(mixture.with_domain(no_documents), {}, share=0.5).count() == 0
    used = mixture.mixed_documents(odd_documents, share=0.5)
    assert used.columns == odd_documents.columns and 0 < used.count() < 13


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 3 + [(2, "d e", "s")], "doc_id long, text string, source string")
    rows = mixture.select(df, {}, total=11, levels=["source"]).collect()
    assert len(rows) == 4 and sum(r.tokens_taken for r in rows) == 11
