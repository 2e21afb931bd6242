"""The most alike texts against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import hashed
from scorelake.operators import similar


def _brute(rows, k, dim=64):
    places = hashed.Places(dim)
    v = hashed.unit(np.array([places.weights(t) for _, t in rows], float).reshape(-1, dim))
    out = {}
    for i, (q, _) in enumerate(rows):
        if q is None or q % 4:
            continue
        found = out.setdefault(q, [])
        for j, (x, _) in enumerate(rows):
            if x is not None and x != q:
                found.append((-round(float(sum(v[i] * v[j])), 10) + 0.0, x))
    return {q: sorted(f)[:k] for q, f in out.items()}


@pytest.mark.parametrize(("block", "step", "k"), [(7, 1, 1), (50, 8, 5), (4096, 5, 400)])
def test_equals_brute_force(spark, monkeypatch, block, step, k):
    """Families of texts, copies, blank and null texts, negative and null ids, several blocks and packs."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "STEP", step)
    rng = np.random.default_rng(block)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        base = base if i % 3 else rng.choice(words, int(rng.integers(1, 60)))
        rows.append((i - 40, " ".join(rng.permutation(base)[: int(rng.integers(1, 60))])))
    rows += [(1000, None), (1001, " "), (1004, ""), (None, "w1 w2"), (1008, rows[5][1]), (1009, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "score": F.lit(1)}).repartition(4)
    got = {}
    for r in similar.most_alike(df, F.col("doc_id") % 4 == 0, "doc_id", k=k).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((-round(r["score"], 10) + 0.0, r["id"]))
    want = _brute(rows, k)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-9) and [i for _, i in got[q]] == [i for _, i in want[q]]
    assert similar.most_alike(df.limit(0), F.lit(True), "doc_id").count() == 0
    with pytest.raises(ValueError):
        similar.most_alike(df, F.lit(True), "doc_id", k=0)


def test_rows_that_cannot_win_are_not_read_to_the_end():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    x = hashed.unit(centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 64)))
    lists = similar.Lists(np.arange(4000), x)
    for q in range(0, 4000, 100):
        ids, scores = lists.best(q, x[q], 5, -2.0)
        s = x @ x[q]
        s[q] = -2
        assert scores == pytest.approx(np.sort(s)[::-1][:5], abs=1e-9) and len(ids) == 5
    assert lists.read < 0.5 * 40 * 4000 * 64


def test_a_pack_finds_what_single_queries_find():
    """Ties, copies, own rows that come twice, zero vectors, and rows that differ by less than single precision shows."""
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (3000, 64)).astype(float)
    x[100:160] = x[7]
    x[200:260] = x[8] + 1e-9 * rng.standard_normal((60, 64))
    x[300:310] = 0
    x, ids = hashed.unit(x), rng.permutation(3000)
    ids[5] = ids[6]
    for k in (1, 5, 90):
        best = similar.Best(ids[:400], k)
        for lo in (0, 1000, 1100, 2900):
            hi = {0: 1000, 1000: 1100, 1100: 2900, 2900: 3000}[lo]
            best.meet(similar.Lists(ids[lo:hi], x[lo:hi]), x[:400])
        rows, found, scores = best.found
        whole = similar.Lists(ids, x)
        for q in range(400):
            want_ids, want = whole.best(int(ids[q]), x[q], k, -2.0)
            assert found[rows == q].tolist() == want_ids.tolist() and scores[rows == q].tolist() == want.tolist()


def test_only_a_few_of_equal_texts_meet_the_queries(spark, monkeypatch):
    """Of 3000 copies only the k + 1 smallest ids go on; copies that share an id stay copies."""
    rows = [(i, "same text") for i in range(3000)] + [(i, f"other {i}") for i in range(5000, 5040)] + [(5001, "other 5001")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held, packed = [], similar._packed
    monkeypatch.setattr(similar, "_packed", lambda rows, dim: held.append(rows.count()) or packed(rows, dim))
    got = similar.most_alike(df, F.col("doc_id").isin(2, 2999, 5000), "doc_id", k=3).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got if r["query_id"] == 2] == [0, 1, 3] and [r["id"] for r in got if r["query_id"] == 2999] == [0, 1, 2]
    assert [(-r["score"], r["id"]) for r in got if r["query_id"] == 5000] == sorted((-r["score"], r["id"]) for r in got if r["query_id"] == 5000)
    assert held[0] <= 4 + 41
