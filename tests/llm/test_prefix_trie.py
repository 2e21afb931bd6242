"""The trie of rebuilt conversations against a plain one, node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from scorelake.llm import common, prefix_trie

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [x[-1] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        bytes_ = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * bytes_
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.query(df).collect()), key=str)


def test_trie_equals_a_plain_one_and_sql(spark):
    common.prepare(spark)
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = plain([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    cur = con.execute(prefix_trie.ORACLE)
    names = [c[0] for c in cur.description]
    assert sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()), key=str) == want
    assert _got(df) == want


def test_shared_beginnings_and_hot_conversations(spark, monkeypatch):
    """Turns from a small alphabet, so that prefixes are shared at every depth; 60 equal conversations, one of 300 turns."""
    common.prepare(spark)
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 4)  # several blocks of ends a node
    rng, rows = random.Random(5), []
    for c in range(200):
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bé", "c\U0001f600"])))
    rows += [(1000 + 7 * i, t, "user", "hot") for i in range(60) for t in range(12)]
    rows += [(5000, t, "user", "long" if t % 3 else "hot") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert _got(df) == plain(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "user", "x")],
        [(3, 1, "user", "x")],  # turnless: the base is absent and h covers its turns
        [(None, 0, "u", "x"), (0, None, None, None), (0, 1, "", ""), (0, 1, "", ""), (0, 1, "u", "b"), (0, 1, "u", "a"), (1, 0, "u", ""), (5, 5, "u", "z" * 100_000), (6, None, "u", "z" * 100_000)],
        [(i % 4, 7, "u", "same") for i in range(40)],
    ],
)
def test_odd_rows(spark, rows):
    """Nulls in every column, ties, repeated rows, long texts, empty tables, clashing names."""
    common.prepare(spark)
    df = spark.createDataFrame([(*r, 1, "n", 2.0) for r in rows], SCHEMA + ", d int, node string, n double")
    assert _got(df) == plain(rows)
