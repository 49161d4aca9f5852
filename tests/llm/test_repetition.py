import brute
import numpy as np

from layerflow.llm import repetition


def plain(text, window=8):
    words = brute.WORD.findall(text or "")
    seen = {}
    for k in range(len(words) - window + 1):
        seen.setdefault(tuple(words[k : k + window]), []).append(k)
    out = {j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + window)}
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(out),
    )


def got(df):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


def test_equals_brute_force_on_the_small_table(documents):
    expected = {r.doc_id: plain(r.text) for r in documents.collect()}
    result = repetition.judged(documents)
    assert got(result) == expected
    for r in result.collect():
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        assert r.kept == (not failed and r.n_repeat_words <= 0.25 * r.n_words and r.longest_repeat <= 100)


def test_odd_rows(odd_documents, no_documents):
    assert got(repetition.repetition(odd_documents)) == {r.doc_id: plain(r.text) for r in odd_documents.collect()}
    assert repetition.judged(no_documents).count() == 0
    assert repetition.judged(odd_documents.union(odd_documents)).count() == 26


def test_longest_repeats_equal_brute_force():
    rng = np.random.default_rng(4)
    for n, kinds in ((1, 1), (30, 2), (60, 3), (80, 1), (50, 9)):
        row = np.sort(rng.integers(0, 4, n))
        word = rng.integers(0, kinds, n).astype(np.uint64)
        expected = []
        for k in range(n):
            best = 0
            for j in range(n):
                m = 0
                while j != k and max(j, k) + m < n and row[j + m] == row[k + m] == row[j] == row[k] and word[j + m] == word[k + m]:
                    m += 1
                best = max(best, m)
            expected.append(best)
        assert list(repetition.longest_repeats(word, row)) == expected


def test_lines_and_symbols():
    texts = ["a\nb\na\n\n \n \na", "#x\r\n#x\r\n", "\n", "last line\nno end\nno end", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = np.stack(repetition.measures(data, bounds, 8), 1)[:, :5]
    assert [tuple(r) for r in found] == [plain(t) for t in texts]
