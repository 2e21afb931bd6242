"""The manifest against a plain tree over all rows in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scorelake.llm import common, merkle

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _way(levels, i):
    """The runs that node i and its ancestors are in, each with their place."""
    out = []
    for level in levels[:-1]:
        out.append((level[i // 16 * 16 : i // 16 * 16 + 16], i % 16))
        i //= 16
    return out


def plain(rows):
    leaf = lambda r, text: _h(*map(_field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: _levels([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = _levels([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, value, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            way = _way(built[s], i) + _way(top, k)
            proof = _h(*(x for run, at in way for x in run[:at] + run[at + 1 :]))
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for run, at in way:
                node = _h(*run[:at], node, *run[at + 1 :])
            out.append((r["doc_id"], value, built[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.query(df).collect()), key=str)


def test_manifest_of_documents_equals_a_plain_tree(spark):
    common.prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain([r.asDict() for r in docs.collect()])
    assert _got(docs.repartition(7)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 2


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_hot_source_over_many_partitions(spark, partitions):
    """4370 rows of one source (16 ** 3 + 274), sources of 1, 16, 17, 256 and 257 rows, and 300 lone ones."""
    common.prepare(spark)
    sizes = {"hot": 4370, "one": 1, "sixteen": 16, "seventeen": 17, "square": 256, "more": 257, None: 33} | {f"lone{i}": 1 for i in range(300)}
    rows, at = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((at * 3, f"Text {at % 50}", "en", s, at % 7))
            at += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, SCHEMA).orderBy(F.xxhash64("doc_id"))
        assert _got(df) == plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, a doc_id that a third of the rows bear, and clashing names."""
    common.prepare(spark)
    rows = [(None, None, None, None, None), (None, "X", "en", "s", 1), (1, "", "", "", 0), (1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (-5, "É\U0001f600Z" * 9000, "fr", "ž", 2), (5, "ABC", None, "z", None)]
    rows += [(9, f"Q{i % 2}", "en", "s", 2) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", leaf string, number int")
    assert _got(df) == plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert merkle.query(df.limit(0)).count() == 0


def test_a_task_of_any_rows_is_right():
    """Runs are recorded only where a task has all sixteen; everything else is left open, on its level."""
    out = []
    m = merkle.Mountains("t", 1000, out)
    for i in range(250, 530):
        m.add(i, f"{i:064d}", i)
    m.close()
    runs = [r for r in out if r[5] is not None]
    assert [(r[2], r[3]) for r in runs] == [(0, i) for i in range(16, 32)] + [(1, 1)] + [(0, 32)] or {(r[2], r[3]) for r in runs} == {(0, i) for i in range(16, 33)} | {(1, 1)}
    assert sorted((r[2], r[3]) for r in out if r[4] is not None) == [(0, i) for i in (*range(250, 256), 528, 529)] + [(1, 32), (2, 1)]
