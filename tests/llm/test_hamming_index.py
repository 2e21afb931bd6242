"""Multi-index hashing against brute force: what probing gathers, recall, and odd vectors."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorelake.llm import common
from scorelake.llm import hamming_index as H

SCHEMA = "vec_id long, embedding array<float>"


def _brute(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = (u * u[q]).sum(1)
        at = np.flatnonzero(ids != ids[q])
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in at[np.lexsort((ids[at], -s[at]))][:k]]
    return out


def _found(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def _recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def _clustered(n, dim=64, centres=200, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return (c[rng.integers(0, centres, n)] + 0.05 * rng.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize("radius", [0, 3, 15, 16, 40, 58, 128])
def test_probing_finds_every_code_in_the_radius(radius):
    rng = np.random.default_rng(1)
    codes, q = rng.integers(0, 256, (300, 16), dtype=np.uint8), rng.integers(0, 256, (40, 16), dtype=np.uint8)
    codes[:40] = q ^ (rng.random((40, 16)) < 0.2).astype(np.uint8)
    apart = np.unpackbits(q[:, None] ^ codes, axis=2).sum(2)
    got = set()
    for qs, rows, _ in H.Tables(codes).within(q, radius):
        pairs = set(zip(qs.tolist(), rows.tolist(), strict=True))
        assert not pairs & got
        got |= pairs
    assert got == set(zip(*(a.tolist() for a in np.nonzero(apart <= radius)), strict=True))
    assert (H.reaches(radius, 16) + 1).sum() == max(0, radius + 1) and H.reaches(radius, 16).min() >= -1


def test_few_codes_are_compared_on_clustered_vectors():
    x = _clustered(20000).astype(float)
    ids = np.arange(len(x))
    coder, q = H.learn(x[:8000]), np.arange(0, len(x), 50)
    compared, found = 0, defaultdict(list)
    for lo in range(0, len(x), H.BLOCK):
        got, n = H.search_block(coder, ids[q], x[q], ids[lo : lo + H.BLOCK], x[lo : lo + H.BLOCK], 5)
        compared += n
        for i, v, s in got:
            found[int(ids[q[i]])].append((-s, v))
    assert compared < 0.05 * len(q) * len(x)
    got = {i: [(v, -s) for s, v in sorted(r)[:5]] for i, r in found.items()}
    assert _recall(got, _brute(ids, x, q)) >= 0.9


def test_search_over_several_blocks_equals_brute_force(spark):
    """More rows than the sample holds and than a block, in one partition and in several."""
    x = _clustered(10000, dim=20, centres=40)
    ids = np.random.default_rng(0).permutation(10000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    want = _brute(ids, x.astype(float), np.flatnonzero(ids % 50 == 0))
    one = _found(H.query(df.coalesce(1)))
    assert _recall(one, want) >= 0.9 and one == _found(H.query(df.repartition(7)))
    score = {q: dict(w) for q, w in want.items()}
    assert all(s == pytest.approx(score[q][v], abs=1e-12) for q, w in one.items() for v, s in w if v in score[q])


def test_recall_on_isotropic_vectors_beyond_the_sample(spark):
    """40,000 vectors of no structure at all, five times the sample and ten blocks; several batches of queries."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((40_000, 64)).astype(np.float32)
    ids = np.arange(len(x))
    folder = common.folder(spark, "isotropic")
    spark.createDataFrame(pa.table({"vec_id": pa.array(ids), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(6).write.parquet(folder)
    got = _found(H.query(spark.read.parquet(folder)))
    recall = _recall(got, _brute(ids, x.astype(float), ids[::50]))
    assert len(got) == 800 and recall >= 0.9, recall


def test_small_batches_and_blocks_find_the_same(spark, monkeypatch):
    x = _clustered(3000, dim=12, centres=20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)
    want = _found(H.query(df))
    for name, value in (("BLOCK", 700), ("QUERY_BATCH", 13), ("MOST_BEST", 50)):
        monkeypatch.setattr(H, name, value)
    assert _found(H.query(df)) == want and len(want) == 60


def test_very_large_and_small_components(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e200, 0.0]), (3, [-1e300, 1e300]), (50, [0.0, 5e-324]), (4, [1.0, 1e-320]), (5, [1e308, 1e308])]
    got = _found(H.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    half = 2**0.5 / 2
    near = lambda pairs: [(i, pytest.approx(s, abs=1e-12)) for i, s in pairs]
    assert got[0] == near([(2, 1.0), (4, 1.0), (1, half), (5, half), (50, 0.0)])
    assert got[50] == near([(1, half), (3, half), (5, half), (4, 0.0), (0, 0.0)])


def test_recall_on_the_test_table(spark):
    """2000 vectors, fewer than the sample holds."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    assert _recall(_found(H.query(e)), _brute(ids, x, np.flatnonzero(ids % 50 == 0))) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (100, [float("nan"), 1.0]), (4, [0.0, 1.0]), (150, [None, 1.0]), (200, [1.0]), (None, [1.0, 0.0]), (250, []), (300, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _found(H.query(df)) == {0: [(1, 1.0), (2, 1.0), (4, 0.0)]}
    assert H.query(df.limit(0)).count() == 0
    assert H.query(df.where("vec_id = 0")).count() == 0


def test_fewer_than_k_in_the_radius_are_all_found(spark):
    """Far outliers have no five codes near them: they get what a search of all rows gives."""
    x = _clustered(600, dim=16, centres=3)
    x[0], x[1] = -x[0], x[1] * 0 + np.eye(16, dtype=np.float32)[3]
    ids = np.arange(600) * 25
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got, want = _found(H.query(df)), _brute(ids, x.astype(float), [0])
    assert all(len(r) == 5 for r in got.values()) and [i for i, _ in got[0]] == [i for i, _ in want[0]]


def test_repeated_ids_rows_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 0.1]), (7, [1.0, 0.1]), (9, [0.1, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "id": F.lit(1), "key": F.lit(2), "query_id": F.lit(3)})
    got = H.query(df).collect()

    assert {r["query_id"] for r in got} == {0} and len(got) == 6
    first = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in got)
    assert [x[1] for x in first if x[0] == 1] == [7, 9] and [x[1] for x in first if x[0] == 3] == [7, 9]
