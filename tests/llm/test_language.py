import brute
import numpy as np

from layerflow.llm import language


def test_held_out_accuracy(documents):
    rows = language.predictions(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == brute.held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.lang is not None]
    assert judged and sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = {r.doc_id: r for r in language.predictions(odd_documents).collect()}
    for doc in (1, 2, 3, 12):
        assert (rows[doc].lang_pred, rows[doc].score, rows[doc].languages) == ("und", 0.0, [])
    assert all(r.lang_pred in ("en", "de", "fr") for d, r in rows.items() if d not in (1, 2, 3, 12))
    assert language.predictions(no_documents).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predictions(unlabelled).collect()] == ["und"]
    kept = language.accepted(odd_documents)
    assert kept.columns == odd_documents.columns and kept.where("doc_id IN (1, 2, 3, 12)").count() == 0


def test_mixture_of_two_languages(spark):
    rng = np.random.default_rng(1)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    train = [(2 * k, make("abcdef", 200), "x") for k in range(10)] + [(2 * k + 1, make("ghijkl", 200), "y") for k in range(10)]
    model = language.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(1, make("abcdef", 75) + " " + make("ghijkl", 25)), (2, make("ghijkl", 30))], "doc_id long, text string")
    mixed, plain = sorted(language.identify(ask, model).collect(), key=lambda r: r.doc_id)
    assert mixed.languages == ["x", "y"] and abs(mixed.score - 0.75) < 0.02
    assert plain.languages == ["y"] and plain.score == 1.0


def test_em_does_not_lower_the_likelihood():
    rng = np.random.default_rng(2)
    ll = np.log(rng.random((300, 3)))
    first = np.array([0, 100, 150])
    start = np.full((3, 3), 1 / 3)
    share, value = language._expectation(ll, first, start)
    before = np.add.reduceat(np.log((np.exp(ll) / 3).sum(1)), first)
    assert np.all(value >= before - 1e-9) and np.allclose(share.sum(1), 1)
