"""Large components of proposed links, and doc_ids that many rows bear."""

import time

import numpy as np

from scorelake.llm import chosen_path, common

SCHEMA = "doc_id long, text string"


def _words(rng, n, of=20_000):
    return [f"w{x}" for x in rng.integers(0, of, n)]


def _spied(monkeypatch, name):
    seen, real = [], getattr(chosen_path, name)

    def spy(*a):
        out = common.written(real(*a), "seen")
        seen.append(out.count())
        return out

    monkeypatch.setattr(chosen_path, name, spy)
    return seen


def test_boilerplate_is_not_compared(spark, monkeypatch):
    """3000 texts that share 100 words of 140 (Jaccard index about 0.55) and link to nothing, and 40 near copies of one."""
    common.prepare(spark)
    monkeypatch.setattr(chosen_path, "LOOSE", 2048)
    rng = np.random.default_rng(3)
    shared = _words(rng, 100)
    rows = [(i, " ".join(shared + _words(rng, 40, 10**9))) for i in range(3000)]
    near = rows[7][1].split()
    for i in range(40):
        w = list(near)
        w[int(rng.integers(100, 140))] = f"x{i}"
        rows.append((10_000 + i, " ".join(w)))
    seen = _spied(monkeypatch, "_tightened")
    begin = time.time()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.query(spark.createDataFrame(rows, SCHEMA)).collect()}
    took = time.time() - begin
    assert all(got[i] == (i, 0) for i in range(3000) if i != 7) and got[7][0] == 7
    assert {got[10_000 + i][0] for i in range(40)} == {7} and all(got[10_000 + i][1] >= 35 for i in range(40))
    assert len(seen) == 1 and seen[0] <= 60, took  # some 41 of 3040 records are left to compare


def test_parted_components_lose_no_link(spark, monkeypatch):
    """Families at all distances around the threshold, joined by a common passage, all parted: the same links as by brute
    force."""
    from test_llm_operators import _brute_links

    common.prepare(spark)
    monkeypatch.setattr(chosen_path, "LOOSE", 4)
    monkeypatch.setattr(chosen_path, "ALIKE", 1.1)
    rng = np.random.default_rng(4)
    shared, rows = _words(rng, 80), []
    for family in range(12):
        base = shared + _words(rng, 60)
        for i in range(12):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = f"y{family}-{i}-{at}"
            rows.append((len(rows), " ".join(w)))
    seen = _spied(monkeypatch, "_tightened")
    got = sorted(map(tuple, chosen_path.query(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == _brute_links(rows) and len(seen) == 1 and max(n for _, _, n in got) > 3


def test_a_doc_id_of_many_rows_moves_one_text(spark, monkeypatch):
    common.prepare(spark)
    words = [f"w{i}" for i in range(60)]
    hot, near = " ".join(words), " ".join([*words[:-1], "x"])
    df = spark.range(20_000).selectExpr("1L AS doc_id", f"'{hot}' AS text").union(spark.createDataFrame([(2, near), (1, hot.replace("w3 ", "W3  ")), (1, "another text of the same number entirely")], SCHEMA))
    moved, real = [], chosen_path._with_sets

    def spy(rows):
        moved.append(rows.count())
        return real(rows)

    monkeypatch.setattr(chosen_path, "_with_sets", spy)
    got = {tuple(r) for r in chosen_path.query(df).collect()}
    assert got == {(1, 1, 20_001), (2, 1, 20_001), (1, 1, 0)} and max(moved) <= 4


def test_few_texts_are_moved_to_meet_some_ids(spark, monkeypatch):
    """A sieve parts the rows, loses none of the wanted ones, and lets few others through; with more ids than it has bits
    for it only lets more through."""
    common.prepare(spark)
    rows = spark.createDataFrame([(i - 500, "x") for i in range(20_000)] + [(None, "y"), (7, "z")], SCHEMA)
    wanted = spark.createDataFrame([(i,) for i in range(0, 4000, 4)], "id long")
    for most in (chosen_path.SIEVE[1], 4):
        monkeypatch.setattr(chosen_path, "SIEVE", (4, most))
        may, others = (x.select("doc_id", "text").collect() for x in chosen_path._sieved(rows, "doc_id", wanted))
        assert sorted(map(str, may + others)) == sorted(map(str, rows.collect()))
        assert not {r["doc_id"] for r in others} & set(range(0, 4000, 4))
        assert most == 4 or len(may) < 1000 + 0.15 * 19_000
    assert sorted(x.count() for x in chosen_path._sieved(rows, "doc_id", wanted.limit(0))) == [0, 20_002]
