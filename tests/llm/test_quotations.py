"""Quotation linking against a plain linker and against SQL: rings, repeats, deep threads, odd rows."""

import random

import duckdb
import pytest

from scorelake.llm import quotations as Q

SCHEMA = "conv_id long, turn long, role string, text string"


def _sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cur = con.execute(Q.ORACLE)
    names = [c[0] for c in cur.description]
    return sorted((tuple(map(str, (dict(zip(names, r, strict=True))[n] for n in sorted(names)))) for r in cur.fetchall()))


def _spark(df):
    return sorted(tuple(str(r[n]) for n in sorted(df.columns)) for r in df.collect())


def _both(spark, rows):
    df = Q.query(spark.createDataFrame(rows, SCHEMA))
    got = _spark(df)
    assert got == _sql(rows)
    return {(r["conv_id"], r["turn"]): r for r in df.collect()}


def _flat(x):
    return " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())


def _passages(text):
    out, level_before = [], None
    for line in (text or "").split("\n"):
        level, rest = 0, line
        while rest.lstrip(" \t").startswith(">"):
            level, rest = level + 1, rest.lstrip(" \t")[1:]
        if not _flat(rest):
            level_before = None
        elif level == level_before:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
            level_before = level
    return out


def _plain_parents(rows):
    """A plain linker: every quoted line looks at every message."""
    said = [(c, t, {_flat(x) for level, ls in _passages(x0) if level == 0 for x in [*ls, " ".join(ls)]}) for c, t, _, x0 in rows]
    parents = []
    for c, t, _, text in rows:
        votes = {}
        for level, lines in _passages(text):
            for line in lines if level and c is not None else ():
                for key in (_flat(" ".join(lines)), _flat(line)):
                    who = [(a != c, a, b) for a, b, s in said if key in s and (a != c or b < t)]
                    # the first turn of the first conversation
                    if who:
                        best = min(who)
                        votes[level, best[1:]] = votes.get((level, best[1:]), 0) + 1
                        break
        if votes:
            least = min(level for level, _ in votes)
            parents.append(max((n, p[1], -p[0], p) for (level, p), n in votes.items() if level == least)[-1])
        else:
            parents.append((None, None))
    return parents


def test_links_and_order(spark):
    rows = [(1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> How are you?\nFine, thanks."), (1, 2, "u", "> > How are you?\n> Fine, thanks.\nGood."), (2, 0, "u", ">Good.\nIndeed"), (2, 1, "u", "> nobody said this"), (3, 0, "u", None), (3, 1, "u", ">> fine THANKS\n> Indeed!")]
    got = _both(spark, rows)
    none = (None, None)
    assert [(got[r[:2]]["parent_conv"], got[r[:2]]["parent_turn"]) for r in rows] == _plain_parents(rows) == [none, (1, 0), (1, 1), (1, 2), none, none, (2, 0)]
    assert got[1, 2]["text"] == "Good." and got[3, 1]["thread_conv"] == 1 and got[3, 1]["depth"] == 4
    assert got[1, 1]["reply_order"].startswith(got[1, 0]["reply_order"])


def test_threads_of_any_depth_and_rings(spark):
    rows = [(5, 0, "u", "say 0")] + [(5, i, "u", f"> say {i - 1}\nsay {i}") for i in range(1, 501)]
    rows += [(10, 0, "u", "> beta\nalpha"), (11, 0, "u", "> alpha\nbeta\ngamma"), (12, 0, "u", "> gamma\ndelta"), (12, 1, "u", "> delta\nfine")]
    got = _both(spark, rows)
    assert all((got[5, i]["depth"], got[5, i]["thread_conv"]) == (i, 5) for i in range(501))
    assert all(got[5, i]["reply_order"].startswith(got[5, i - 1]["reply_order"] + "/") for i in range(1, 501))
    assert [(got[k]["thread_conv"], got[k]["depth"]) for k in [(10, 0), (11, 0), (12, 0), (12, 1)]] == [(10, 0), (11, 0), (11, 1), (11, 2)]


def test_passages_come_before_lines_and_any_wrapping(spark):
    rows = [(1, 0, "u", "One two three\nfour five."), (2, 0, "u", "One two three"), (3, 0, "u", "> One two\n> three four five\nyes"), (4, 0, "u", "> One two three\n> four, five"), (5, 0, "u", "> four five")]
    rows += [(20, 1, "u", "> X y"), (20, 2, "u", "X y"), (21, 0, "u", "x y")]
    got = _both(spark, rows)
    assert [(got[r[:2]]["parent_conv"], got[r[:2]]["parent_turn"]) for r in rows] == _plain_parents(rows)
    assert got[3, 0]["parent_conv"] == got[4, 0]["parent_conv"] == got[5, 0]["parent_conv"] == 1 and got[3, 0]["n_linked"] == 2 and got[20, 1]["parent_conv"] == 21


@pytest.mark.parametrize("seed", range(2))
def test_planted_quotes_equal_the_plain_linker(spark, seed):
    rng = random.Random(seed)
    words = ["red", "blue", "Über", "fox", "2nd", "day", "sun"]
    rows, said = [], []
    for c in range(12):
        for t in range(rng.randint(1, 5)):
            own = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice([".", "!", ""]) for _ in range(rng.randint(0, 2))]
            quoted = [("> " if rng.random() < 0.7 else ">>") + rng.choice(said) for _ in range(rng.randint(0, 3))] if said else []
            said += own
            rows.append((c, t, rng.choice("ua"), "\n".join([*quoted, *([""] if rng.random() < 0.3 else []), *own])))
    rows += [rows[3], rows[3], rows[7]]
    got = _both(spark, rows)
    assert all((got[r[:2]]["parent_conv"], got[r[:2]]["parent_turn"]) == p for r, p in zip(rows, _plain_parents(rows), strict=True))


def test_odd_rows(spark):
    rows = [(None, 1, "u", "> Good"), (1, None, "u", "> Good"), (1, 0, None, "Good"), (1, 0, None, "Good"), (2, 0, "u", None), (3, 0, "u", ">"), (4, 0, "u", "> Good\n" + "> line\n" * 20000 + "end"), (-5, -1, "u", "> end")]
    got = _spark(Q.query(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", hash string, level int")))
    assert got == _sql(rows) and len(got) == len(rows)
    assert Q.query(spark.createDataFrame([], SCHEMA)).count() == 0
