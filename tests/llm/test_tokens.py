from pathlib import Path

import numpy as np
import pytest

from layerflow.llm import tokens


def documents_of(rows, width):
    """Texts put together again from packed rows."""
    encode = tokens.encoder(Path(tokens.TOKENIZER).read_bytes())
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == width and r.n_ids == r.cu_seqlens[-1] and r.position_resets == r.cu_seqlens[:-1]
        assert (ids[r.n_ids :] == tokens.END_ID).all()
        for k, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            assert parts.setdefault(doc, {}).setdefault(piece, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]) is not None
    texts = {}
    for doc, pieces in parts.items():
        ids = np.concatenate([pieces[k] for k in range(len(pieces))])
        assert ids[-1] == tokens.END_ID and (ids[:-1] != tokens.END_ID).all()
        texts[doc] = encode.decode(ids[:-1].tolist())
    return texts


def test_round_trip_is_exact(documents):
    rows = tokens.packed(documents, width=256).collect()
    assert documents_of(rows, 256) == {r.doc_id: r.text for r in documents.collect()}
    assert sum(r.n_ids for r in rows) > 0.98 * 256 * len(rows)


def test_odd_rows(odd_documents, no_documents):
    rows = tokens.packed(odd_documents).collect()
    assert documents_of(rows, tokens.WIDTH) == {r.doc_id: r.text or "" for r in odd_documents.collect()}
    assert tokens.packed(no_documents).count() == 0
    twice = tokens.round_trip(odd_documents.union(odd_documents)).collect()
    assert len(twice) == 2 * sum(len(r.doc_ids) for r in rows)
    once = {(r.doc_id, r.piece, r.length, r.ids_sha256) for r in tokens.round_trip(odd_documents).collect()}
    assert once == {(r.doc_id, r.piece, r.length, r.ids_sha256) for r in twice}


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.integers(5, 70))
    sizes = rng.integers(1, width + 1, 200)
    rows, free = tokens.best_fit(sizes, width), []
    for k in np.argsort(-sizes, kind="stable"):
        fits = [f for f in free if f >= sizes[k]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[k])
        else:
            free.append(width - sizes[k])
    assert sorted(width - sizes[r].sum() for r in rows) == sorted(free)
    assert sorted(k for r in rows for k in r) == list(range(200))


def test_positions():
    assert list(tokens.positions([0, 3, 5], 7)) == [0, 1, 2, 0, 1, 0, 0]
    assert tokens.id_type(70000).itemsize == 4
