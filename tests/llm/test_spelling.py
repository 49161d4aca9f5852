"""Spelling variants against a comparison of all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from layerflow.llm import spelling

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(docs):
    """Counter of the words of (doc_id, text)."""
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: sorted((-words[x], x) for x in words if one_edit(w, x)) for w in words}
    form = {w: x[0][1] if x and -x[0][0] >= 10 * words[w] else None for w, x in near.items()}
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def same(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long")
    got = sorted((tuple(r) for r in spelling.variants(df).collect()), key=repr)
    assert got == plain_variants(plain_words(docs))
    return got


def made_up(n, seed, letters="abcé"):
    """Texts of words that are close to each other, some far more frequent."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), size=rng.integers(6, 10))) for _ in range(120)]
    words += [w[:3] + "z" + w[3:] for w in words[:40]] + [w[:-1] for w in words[:40]] + [w[:2] + "y" + w[3:] for w in words[:40]]
    weight = 1.0 / np.arange(1, len(words) + 1) ** 1.5
    return [(k, " ".join(rng.choice(words, size=60, p=weight / weight.sum()))) for k in range(n)]


def test_as_a_comparison_of_all_words(spark):
    got = same(spark, made_up(60, 1))
    assert any(r[1] for r in got) and max(r[4] for r in got) > 2


def test_roots_follow_forms(spark):
    words = {"abcdefghij": 400, "abcdefghix": 30, "abcdefghx": 3, "abcdefghij" + "j": 39, "abcdefghi": 41}
    got = same(spark, [(None, " ".join(w for w, n in words.items() for _ in range(n)))])
    form = {r[0]: r[1:3] for r in got}
    assert form["abcdefghx"] == ("abcdefghix", "abcdefghij") or form["abcdefghx"] == ("abcdefghi", "abcdefghi")
    assert form["abcdefghix"] == ("abcdefghij",) * 2 and form["abcdefghi"] == (None, "abcdefghi")
    assert [r for r in same(spark, [(None, "stretch " * 300 + "stretsh " * 30 + "stretshs " * 3)]) if r[0] == "stretshs"][0][1:3] == ("stretsh", "stretch")


def test_odd_texts(spark):
    """Nulls, empty texts, repeated rows, rows without an id, case, letters beyond ASCII, anagrams, ties."""
    docs = [
        (None, "Schreiben SCHREIBEN schreibenn schreibenn"), (1, None), (2, ""), (3, " \n 1234567 -- "), (4, "short words only"),
        (5, "École1école2ÉCOLE abcdefg abcdefg×÷ß abcdefg×÷ß"), (6, "stained sainted destain instead stained sainted destain instead"),
        (7, "parents parents entraps entraps pastern pastern"), (7, "parents parents entraps entraps pastern pastern"),
        (8, " ".join(["letters"] * 40 + ["lettera"] * 2 + ["letterb"] * 2 + ["lettersa"] * 2 + ["etters"] * 9)),
        (9, "漢字 languages漢字languages languagesü languagesü"), (10, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3001 + " " + "a" * 3001),
    ]
    same(spark, docs)


def test_no_texts(spark):
    assert same(spark, []) == []
    assert same(spark, [(1, "one word"), (2, None)]) == []


def test_a_very_long_text(spark):
    """One text with most of the words."""
    docs = made_up(40, 3)
    same(spark, [(1, " ".join(t for _, t in docs) * 3), *docs[:3]])


def test_many_cells_change_nothing(spark, monkeypatch):
    """Lists that are split into cells by a sample, and compared in small runs."""
    for name, value in (("CELL_WORDS", 12), ("SAMPLE", 40), ("SAMPLE_PER_CELL", 4), ("LEAF", 2), ("PAIRS", 50), ("ASKING", 16)):
        monkeypatch.setattr(spelling, name, value)
    docs = made_up(60, 2)
    words = spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"))
    trees, cells = spelling.fitted(words)
    assert trees and cells > 8
    same(spark, docs)


@pytest.mark.parametrize("seed", [5, 6])
def test_boxes_hold_what_is_near(seed):
    """A tree is asked for no leaf in vain, and for none too few."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(97, 102, (900, 8)).astype(np.uint8)
    counts = spelling.letter_counts(codes)
    tree = spelling.plant(counts, 8)
    leaf_of = np.empty(len(counts), int)
    for k, rows in enumerate(tree.leaves):
        leaf_of[rows] = k
    assert (tree.home(counts) == leaf_of).all()
    ask = counts[:60]
    row, leaf = tree.meets(ask, 1)
    asked = set(zip(row.tolist(), leaf.tolist()))
    assert len(asked) == len(row) < 0.6 * 60 * len(tree.leaves)
    for k in range(60):
        step = counts - ask[k]
        close = (np.maximum(step, 0).sum(1) <= 1) & (np.maximum(-step, 0).sum(1) <= 1)
        assert {(k, x) for x in leaf_of[close].tolist()} <= asked


def test_letter_order_decides():
    a = np.frombuffer(b"abcdefgabcdefgabcdefg", np.uint8).reshape(3, 7)
    b = np.frombuffer(b"abcdefhabdcefgabcdefg", np.uint8).reshape(3, 7)
    assert spelling.near(a, b).tolist() == [True, False, False]
    c = np.frombuffer(b"abcdefghzabcdefgabdcefgz", np.uint8).reshape(3, 8)
    assert spelling.near(a, c).tolist() == [True, True, False]
