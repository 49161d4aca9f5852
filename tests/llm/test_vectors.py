import brute
import numpy as np
from pyspark.sql import functions as F

from layerflow.llm import vectors


def plain(rows, threshold=0.95):
    units, result = {}, {i: [0, i] for i, _ in rows}
    for i, v in rows:
        if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        v = np.array(v, float) / np.abs(v).max()
        units[i] = v / np.sqrt((v * v).sum())
    pairs = []
    ids = sorted(units)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                pairs.append((a, b))
                result[a][0] += 1
                result[b][0] += 1
    top = brute.parts(pairs, result)
    return {i: (n, top[i]) for i, (n, _) in result.items()}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_equals_brute_force_on_the_table_with_near_copies(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rng = np.random.default_rng(8)
    near = [(10000 + k, (np.array(given[k % 40][1]) + 0.03 * rng.standard_normal(64)).tolist()) for k in range(90)]
    rows = given + near + [(20000 + k, given[7][1]) for k in range(30)]
    expected = plain(rows)
    result = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    exact = plain([(i, np.float32(v).tolist()) for i, v in rows])
    assert got(result) == exact and any(n for n, _ in expected.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in result.collect())


def test_odd_rows_and_a_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(k, (base + 0.18 * rng.standard_normal(16)).tolist()) for k in range(70)]
    rows += [(100 + k, base.tolist()) for k in range(5)] + [(110, (3 * base).tolist()), (111, (-base).tolist())]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [None, 1.0]), (204, [float("nan")] * 16), (205, [float("inf")] + [1.0] * 15)]
    rows += [(300, [1.0, 0.0]), (301, [1.0, 1e-3]), (302, [1.0]), (303, [2.0]), (304, [1e-300, 1e-300]), (305, [1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(vectors.near_vectors(df.withColumn("unit", F.lit("x")).withColumn("n", F.lit(1)))) == plain(rows)
    assert vectors.near_vectors(df.where("false")).count() == 0
    assert got(vectors.near_vectors(df.where("vec_id = 202"))) == {202: (0, 202)}


def test_recall_of_the_graph_against_brute_force():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[1500:2000] = x[1000] + 0.02 * rng.standard_normal((500, 64))  # one dense group
    x = x[rng.permutation(3000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.audited(vectors.build(x), 0.95)
    noise = rng.standard_normal((400, 64)).astype(np.float32)
    asked = x[:400] + 0.3 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    exact = int((asked @ x.T >= 0.95).sum())
    found = 0
    for k in range(0, 400, 100):
        node, cosine = graph.search(asked[k : k + 100], graph.beam, 0.95)
        hit = cosine >= 0.95
        assert all(len(set(n[h])) == h.sum() for n, h in zip(node, hit, strict=True))
        found += int(hit.sum())
    assert exact > 400 and found >= 0.9 * exact


def test_rows_of_one_id_and_without_one(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01]), (None, [1.0, 0.0]), (4, [0.0, 0.0]), (4, [1.0, 0.0]), (4, None), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=str)
    # Id 1 is (0, 1), the lesser of its two; id 4 is its only vector that has a direction.
    expected = [(1, 1, 1, True)] * 2 + [(2, 1, 1, False)] + [(3, 1, 3, True)] * 2 + [(4, 1, 3, False)] * 3 + [(5, 0, 5, True), (None, 0, None, True)]
    assert got == sorted(expected, key=str)
