import math
import re
from collections import Counter

import brute
import numpy as np
import pytest

from layerflow.llm import toxicity


def test_held_out_documents_are_told_apart(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.predictions(docs, labels)
    assert rows.count() == docs.count()
    judged = rows.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == brute.held_out(r.doc_id) and 0 <= r.score <= 1 for r in judged)
    assert all(r.predicted == int(r.score >= 0.5) for r in judged)
    assert sum(r.predicted == r.toxic for r in judged) >= 0.95 * len(judged)


def test_rare_and_balanced_words_are_no_evidence(spark):
    rng = np.random.default_rng(0)
    names = ["".join(rng.choice(list("abcdefghi"), 6)) for _ in range(300)]
    make = lambda n, extra: " ".join([*(names[k] for k in rng.integers(0, 300, n)), *extra])
    rows = [(make(60, []), False) for _ in range(80)] + [(make(60, ["vile"]), True) for _ in range(20)]
    model = toxicity.learn_counts(spark.createDataFrame(rows, "text string, toxic boolean"))
    text = [" ".join([*names[:3], "unseen words"]).encode(), " ".join([names[1], "vile", names[3]]).encode(), b""]
    data, bounds = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])
    value, count = toxicity.evidence(model, data, bounds)
    assert abs(value[0]) < 0.02 and value[1] > 0.3 and value[2] == 0
    assert list(count) == [5, 3, 0]


def test_ordinary_endings_of_a_common_stem_are_no_evidence(spark):
    """A stem with fewer different words before it than its endings have together."""
    rng = np.random.default_rng(1)
    ends = ["".join(rng.choice(list("abcdefghi"), 5)) for _ in range(100)]
    pair = lambda: f"p{rng.integers(10)} comm{ends[rng.integers(100)]}"
    make = lambda extra: " ".join(w for _ in range(60) for w in [pair(), *(["vile"] if rng.random() < extra else [])])
    rows = [(make(0), False) for _ in range(100)] + [(make(0.06), True) for _ in range(12)]
    model = toxicity.learn_counts(spark.createDataFrame(rows, "text string, toxic boolean"))
    assert not len(model.words) and len(model.stems) == 1
    text = [" ".join(f"comm{e}" for e in ends).encode(), b"vile"]
    value, _ = toxicity.evidence(model, np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
    assert abs(value[0] - model.other) < 1e-9 and value[1] > 0.3


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(k, k % 2, "x") for k in range(1, 12)] + [(3, None, "x"), (None, 1, "x"), (4, 1, "y"), (99, 1, "z")],
        "doc_id long, toxic int, text string",
    )
    rows = {r.doc_id: r for r in toxicity.predictions(odd_documents, labels).collect()}
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows.values())
    assert rows[1].score == rows[2].score == rows[3].score and rows[1].n_words == 0
    assert toxicity.predictions(no_documents, labels).count() == 0
    assert toxicity.predictions(odd_documents, labels.where("false")).count() == 13


def plain_evidence(rows, text):
    """The same model with plain counts of words, for one text."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    seen = {(w, ws[k - 1] if k else None, int(c)) for t, c in rows for ws in [words(t)] for k, w in enumerate(ws)}
    stem = lambda w: w.encode()[: toxicity.STEM]
    of_word, of_stem = Counter(), Counter()
    for w, _, c in seen:
        of_word[w, c] += 1
    for s, _, c in {(stem(w), b, c) for w, b, c in seen}:
        of_stem[s, c] += 1
    size = [max(1, sum(n for (_, c), n in of_stem.items() if c == k)) for k in (0, 1)]
    discount = [toxicity.DISCOUNT * s / min(size) for s in size]
    stems = {s for s, _ in of_stem}
    share = {s: (of_stem[s, 0] + of_stem[s, 1]) / sum(size) for s in stems}
    over = {(s, c): max(of_stem[s, c] - discount[c] - toxicity.EXPECTED * size[c] * share[s], 0) for s in stems for c in (0, 1)}
    left = [1 - sum(over[s, c] for s in stems) / size[c] for c in (0, 1)]

    def one(w):
        s = stem(w)
        common = (1 - toxicity.UNSEEN) * share.get(s, 0) + toxicity.UNSEEN / len(stems)
        chance = [over.get((s, c), 0) / size[c] + left[c] * common for c in (0, 1)]
        value = math.log(chance[1] / chance[0])
        own = {x for x, _ in of_word if stem(x) == s}
        whole = max(sum(of_word[x, c] for x in own for c in (0, 1)), of_stem[s, 0] + of_stem[s, 1], 1)
        end = {(x, c): max(of_word[x, c] - discount[c] - toxicity.EXPECTED * of_stem[s, c] * (of_word[x, 0] + of_word[x, 1]) / whole, 0) for x in own for c in (0, 1)}
        every = whole + toxicity.TRUST
        shared = (1 - sum(end.values()) / every) * (of_word[w, 0] + of_word[w, 1] + 0.1) / every
        given = [end.get((w, c), 0) / (of_stem[s, c] + toxicity.TRUST * size[c] / sum(size)) + shared for c in (0, 1)]
        return value + math.log(given[1] / given[0])

    asked = set(words(text))
    return sum(map(one, asked)) / max(1, len(asked)), len(asked)


def corpus(seed):
    rng = np.random.default_rng(seed)
    names = ["".join(rng.choice(list("abcde"), rng.integers(4, 8))) for _ in range(150)]
    make = lambda n, extra: " ".join([*(names[k] for k in rng.integers(0, 150, n)), *extra])
    some = ["vile", "vilest", "vileness", *[x for k in rng.integers(0, 150, 4) for x in (names[k], names[3][:4] + "zz")]]
    rows = [(make(40, []), False) for _ in range(60)] + [(make(40, some), True) for _ in range(15)]
    return rows, names


@pytest.fixture
def small_discounts(monkeypatch):
    """So that words of small corpora have evidence too."""
    monkeypatch.setattr(toxicity, "DISCOUNT", 0.4)
    monkeypatch.setattr(toxicity, "EXPECTED", 0.8)


def test_as_plain_counts_say(spark, small_discounts):
    rows, names = corpus(3)
    model = toxicity.learn_counts(spark.createDataFrame(rows, "text string, toxic boolean"))
    assert len(model.words) and len(model.stems)
    texts = [*(t for t, _ in rows[::9]), "vile words vilest", "nothing known here", names[3][:4] + "zz " + names[4], "", "Vile VILE é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    value, count = toxicity.evidence(model, data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for k, text in enumerate(texts):
        want = plain_evidence(rows, text)
        assert count[k] == want[1] and abs(value[k] - want[0]) < 1e-9


def test_a_table_too_large_to_send_gives_the_same(spark, monkeypatch, small_discounts):
    rows, _ = corpus(4)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(None, None), (7, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(c)) for k, (_, c) in enumerate(rows)], "doc_id long, toxic int")
    shown = lambda: sorted(((r.doc_id, r.n_words, round(r.evidence, 9), round(r.score, 9)) for r in toxicity.predictions(docs, labels).collect()), key=str)
    sent = shown()
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 0)
    monkeypatch.setattr(toxicity, "MOST_LABELS", 0)
    assert shown() == sent and len(sent) == len(rows) + 2


def test_the_lists_grow_with_the_text(spark, small_discounts):
    small, _ = corpus(5)
    large = [row for seed in range(5, 9) for row in corpus(seed)[0]]
    sizes = []
    for rows in (small, large):
        model = toxicity.learn_counts(spark.createDataFrame(rows, "text string, toxic boolean"))
        sizes.append(len(model.words) + len(model.stems))
    assert sizes[1] > sizes[0]
