"""The rule ensemble: its statistics, its compiled column, and what it tells apart."""

import math
import zlib

import numpy as np
import pytest

from layerflow.llm import rules
from layerflow.llm.rules import Ensemble, Rule


def test_held_out_documents_are_told_apart(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.predictions(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    judged = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in judged)
    assert all(r.predicted == int(r.score >= 0.5) for r in judged)
    assert sum(r.predicted == r.quality for r in judged) >= 0.95 * len(judged)
    assert sum(r.predicted == 0 for r in judged if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in judged)


def plain(text):
    """Some of the statistics, text by text."""
    words = text.encode().split()
    lines = [x for x in text.encode().split(b"\n") if x]
    n, size = max(1, len(words)), max(1, len(text.encode()))
    triples = list(zip(words, words[1:], words[2:]))
    return {
        "words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n,
        "top_word": max((words.count(w) for w in words), default=0) / n, "distinct_triples": len(set(triples)) / max(1, len(words) - 2),
        "symbols": sum(text.count(c) for c in "#*$%&|<>") / size, "beyond_ascii": sum(b >= 128 for b in text.encode()) / size,
        "lines": math.log1p(len(lines)), "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
    }


def test_statistics():
    texts = ["", "one", "a b a b a b", "ü ## ü\nü ## ü\n\nTHE end.", " \n ", "x" * 30 + " 1, 2; 3", "to be or not to be"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = rules.measure(np.frombuffer(data, np.uint8), bounds)
    assert list(got) == list(rules.STATISTICS)
    for k, text in enumerate(texts):
        if text.split():
            for name, value in plain(text).items():
                assert got[name][k] == pytest.approx(value), (name, text)
        else:
            assert not any(got[name][k] for name in got)


def test_compiled_rules_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    some = []
    for k in range(41):
        names = rng.choice(rules.STATISTICS, size=rng.integers(1, 4), replace=False)
        bounds = [(str(n), *sorted(rng.normal(size=2).tolist())) for n in sorted(names)]
        bounds[0] = (bounds[0][0], -math.inf, bounds[0][2]) if k % 2 else (bounds[0][0], bounds[0][1], math.inf)
        some.append(Rule(tuple(bounds), float(rng.normal())))
    for used in (some, some[:1], []):
        model = Ensemble(tuple(used), 0.3)
        values = [tuple(map(float, rng.normal(size=len(rules.STATISTICS)))) for _ in range(60)]
        df = spark.createDataFrame(values, ", ".join(f"{n} double" for n in rules.STATISTICS))
        got = [r[0] for r in df.select(model.chance()).collect()]
        for row, value in zip(values, got, strict=True):
            z = 0.3 + sum(r.weight for r in used if r.met(dict(zip(rules.STATISTICS, row))))
            assert value == pytest.approx(1 / (1 + math.exp(-z)))


def test_lasso_leaves_few_rules_and_finds_the_right_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(600, len(rules.STATISTICS)))
    label = ((x[:, 3] > 0.5) & (x[:, 6] <= 0.6)).astype(float)
    rows = [(float(y), *map(float, v)) for y, v in zip(label, x)]
    sample = spark.createDataFrame(rows, "label double, " + ", ".join(f"{n} double" for n in rules.STATISTICS)).coalesce(1)
    model = rules.fit(sample)
    assert 0 < len(model.rules) < 120
    best = max(model.rules, key=lambda r: r.weight)
    found = {name: (above, upto) for name, above, upto in best.bounds}
    assert abs(found[rules.STATISTICS[3]][0] - 0.5) < 0.05 and abs(found[rules.STATISTICS[6]][1] - 0.6) < 0.05
    right = [r for r in sample.select("label", (model.chance() >= 0.5).alias("good")).collect() if r.good == (r.label > 0.5)]
    assert len(right) >= 0.95 * len(rows)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(k, k % 2, "x") for k in range(1, 14)] + [(3, None, "x"), (None, 1, "x"), (4, 1, "y"), (4, 0, "y"), (99, 1, "z")],
        "doc_id long, quality int, text string",
    )
    got = rules.predictions(odd_documents, labels).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert rows[1].score == rows[2].score == rows[3].score
    assert rules.predictions(no_documents, labels).count() == 0
    assert {r.score for r in rules.predictions(odd_documents, labels.where("false")).collect()} == {0.5}
    one = rules.predictions(odd_documents, labels.where("quality = 1")).collect()
    assert all(r.predicted == 1 for r in one)
    twice = odd_documents.select("doc_id", "text").union(spark.createDataFrame([(None, "no id"), (1, "stored twice")], "doc_id long, text string"))
    assert rules.predictions(twice, labels).count() == 15
    assert rules.predictions(twice, labels).where("doc_id IS NULL").first().held_out


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    base = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    first = {r.doc_id: r.score for r in rules.predictions(docs, labels).collect()}
    assert first == {r.doc_id: r.score for r in rules.predictions(docs, turned).collect()}
