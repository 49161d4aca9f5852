import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerflow.llm import suffixes
from layerflow.llm.common import materialize


def brute(docs, length=200):
    seen = Counter()
    for _, text in docs:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            seen[data[k : k + length]] += 1
    result = {}
    for i, text in docs:
        data = (text or "").encode()
        out = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                out[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum())
        rest = np.frombuffer(data, np.uint8)[~out].tobytes()
        result[i] = (len(data), int(out.sum()), spans, hashlib.sha256(rest).hexdigest())
    return result


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force_on_the_small_table(documents):
    expected = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert any(e[1] for e in expected.values())
    assert got(suffixes.without_repeats(documents)) == expected


def test_odd_rows(odd_documents, no_documents):
    expected = brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    result = suffixes.without_repeats(odd_documents)
    assert got(result) == expected
    assert set(odd_documents.columns) < set(result.columns)
    assert suffixes.without_repeats(no_documents).count() == 0
    assert suffixes.cut_documents(odd_documents).columns == odd_documents.columns


@pytest.mark.parametrize("shard", [512, 3])
def test_shared_passages_in_many_contexts(spark, monkeypatch, shard):
    """Passages across documents, within one, periodic text, and multi-byte
    characters, with minimizers cut into several shards."""
    monkeypatch.setattr(suffixes, "SHARD_RUNS", shard)
    rng = np.random.default_rng(shard)
    make = lambda n: "".join(rng.choice(list("abcdefghé ü"), n))
    passage, other = make(90), make(60)
    docs = [(k, make(rng.integers(0, 80)) + passage[rng.integers(0, 40) :] + make(rng.integers(0, 50))) for k in range(25)]
    docs += [(100, "ab" * 90), (101, "x" * 75), (102, other + make(20) + other), (103, make(39)), (104, "ab" * 20 + "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(suffixes.without_repeats(df, 40, 8)) == brute(docs, 40)


def test_suffix_ranks():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    order, rank = suffixes.suffix_ranks(data, 21)
    text = data.tobytes()
    assert [text[k:] for k in order] == sorted(text[k:] for k in range(len(text)))
    _, rank = suffixes.suffix_ranks(data, 3)
    assert rank[0] == rank[15] and rank[0] == rank[7] and rank[1] != rank[8]


def test_rows_without_an_id_hide_no_repeats(spark):
    """Passages shared with a row without an id, by it and by others, and texts stored twice without one."""
    rng = np.random.default_rng(11)
    make = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, other, twice = make(90), make(90), make(120)
    docs = [(1, make(50) + shared + make(20)), (None, make(30) + shared + make(40) + other), (2, make(9) + other + make(8)),
            (3, shared + make(60)), (None, twice), (None, twice), (None, None), (None, ""), (42, make(70))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(list(enumerate(t for _, t in docs)), 40)
    rows = suffixes.without_repeats(df, 40, 8).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert sorted(found, key=str) == sorted([(i, *expected[k]) for k, (i, _) in enumerate(docs)], key=str)


def test_one_id_with_several_texts(spark):
    """Each row is a document; one id may have any texts, the same one twice included."""
    rng = np.random.default_rng(12)
    make = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, whole = make(90), make(150)
    docs = [(1, make(50) + shared), (1, shared + make(70)), (1, None), (2, whole), (2, whole), (2, make(400)), (3, make(30) + whole[20:100]), (4, make(60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(list(enumerate(t for _, t in docs)), 40)
    rows = suffixes.without_repeats(df, 40, 8).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert sorted(found, key=str) == sorted([(i, *expected[k]) for k, (i, _) in enumerate(docs)], key=str)


def test_texts_are_read_and_shuffled_once_for_the_result(spark, documents, monkeypatch, capsys, tmp_path):
    """Shards that were split take their strings from what was written, and no text goes beside its copy."""
    monkeypatch.setattr(suffixes, "SHARD_RUNS", 3)
    documents.write.parquet(str(tmp_path / "texts"))
    docs = spark.read.parquet(str(tmp_path / "texts"))
    result = suffixes.without_repeats(docs)
    result.explain()
    plan = capsys.readouterr().out
    assert plan.count(f"{tmp_path.name}/texts") == 1 and "slice#" in plan
    assert len(re.search(r"MapInArrow run\((.*?)\)", plan)[1].split(", ")) == len(docs.columns) + 1
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(result) == expected
    assert got(suffixes.without_repeats(docs.withColumn("text", F.col("text").cast("binary")))) == expected


def test_a_written_stage_leaves_no_shuffle_files(spark):
    files = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    written = materialize(spark.range(1000).withColumn("k", F.col("id") % 10).groupBy("k").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and written.count() == 10 and spark.conf.get(key, None) == own
