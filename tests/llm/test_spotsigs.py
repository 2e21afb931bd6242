"""Signatures against a plain reading, and near duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from scorelake.llm import common, spotsigs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def _ready(spark):
    common.prepare(spark)


def _is_word(c):
    return c.isalnum() or c == "_"


def _plain_words(text):
    return "".join(c if _is_word(c) else " " for c in text.lower()).split()


def plain_signatures(text):
    """Each anchor with the two content words behind it, by looking ahead from each word; only for texts that need no other rule."""
    words = _plain_words(text)
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            ahead = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            found.add(f"{w} {' '.join(ahead)}")
        elif not any(x in spotsigs.ANCHORS for x in words[max(0, i - spotsigs.GAP - 1) : i]):
            ahead = [x for x in words[i:] if x not in spotsigs.ANCHORS][:3]
            found.add(f"- {' '.join(ahead)}")
    return found


def test_signatures_equal_a_plain_reading(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    seen = 0
    for t in texts:
        words = _plain_words(t or "")
        if not words or max(map(len, words)) > spotsigs.LONG:
            continue
        seen += 1
        assert set(spotsigs.signatures(t).tolist()) == {xxhash.xxh32_intdigest(x) for x in plain_signatures(t)}
    assert seen > 100


def _classes(rows, least):
    """Classes by comparing all pairs."""
    sets = [set(spotsigs.signatures(t or "").tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (both >= least * either if either else True):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, low[root(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]


def _edited(text, rng, share):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(spark):
    """Texts with near copies of every degree, two large groups of copies, repeated rows and ids, null and empty texts."""
    rng = random.Random(5)
    base = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("text").limit(120).collect() if r["text"]]
    texts = list(base)
    for t in base[:40]:
        texts += [_edited(t, rng, s) for s in (0.005, 0.01, 0.02, 0.04)] + [t[: int(len(t) * 0.85)]]
    texts += [_edited(base[50], rng, 0.01) for _ in range(60)] + [base[51]] * 60
    out = [(1000 - 2 * i, t) for i, t in enumerate(texts)]
    return out + [(7, None), (8, ""), (7, "a b"), (9, "a b"), (9, "a b"), (None, base[0]), (None, None), (10, "the"), (11, base[3])]


@pytest.mark.parametrize(("least", "block"), [(0.8, 1024), (0.8, 8), (0.5, 16), (1.0, 1024)])
def test_near_duplicates_equal_all_pairs(spark, rows, least, block):
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, rec int")
    got = sorted(map(tuple, spotsigs.near_duplicates(table, least, block).collect()), key=str)
    want = sorted(_classes(rows, least), key=str)
    assert got == want
    assert len({c for _, c in want}) < len(want) - 60  # copies alone: there is something to find


def test_near_duplicates_of_nothing(spark):
    assert spotsigs.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spotsigs.near_duplicates(spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string"))
    assert sorted(map(tuple, only.collect()), key=str) == [(1, 1), (None, None)]


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9, 1.0])
def test_alike_lengths_lie_in_neighbouring_partitions(least):
    starts = np.array(spotsigs.length_partitions(least, 400))
    for a in range(1, 401):
        for b in range(a, 401):
            if a >= least * b - 1e-9:
                assert np.searchsorted(starts, b, "right") - np.searchsorted(starts, a, "right") <= 1
