"""Secrets: stated spans against plain patterns, guess costs against every segmentation, lookups against a plain count."""

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import common, guess_cost

DATA = "/root/testdata/sf0.01"  # the smallest tables hold no secret
#: The stated patterns as they are stated.
STATED = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
ODD = [
    None, "", "x", 'PassWord : "abcdef" token=abc api_key==/+-._= apikey="', "AKIA" + "Z9" * 9 + " AKIAAKIA AKIA" + "0" * 16 + "a", "deadbeef" * 3 + "G" + "0123456789abcdef" * 2, "É\U0001f600 secret = 'a.b.c-d' " * 3,
    "token" * 3000 + "=abcdef", "password=" * 500, "api__key=abcdef apikey = abcde. Toſen=abcdef toKen=abcdef", "see https://joe:kV7%wq2Zp0@db.example.org/x and pwd => 'zX81!pQ vv09#', auth-key: Bearer mF_9.B5f-4.1JqM9",
]


def _base(text):
    text = text or ""
    out = [(m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(STATED) for m in p.finditer(text) if ok(m)]
    return [f"{n}:{s}:{e}" for s, _, e, n in sorted(out)]


def _check(rows, got):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    for r in got:
        want = _base(texts[r["doc_id"]][0])
        assert [x for x in r["spans"].split(",") if x and not x.startswith("guess")] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]


def _plain_spans(texts):
    """Values found, costed with words counted in one plain pass, as the operator's spans should be."""
    seen = Counter()
    for t in texts:
        t = t or ""
        hidden = {i for s, e in guess_cost.credential_values(t) for i in range(s, e)}
        t = "".join(" " if i in hidden else c for i, c in enumerate(t))
        for w in t.split():
            w = w.strip(".,;:!?\"'()[]{}<>-*_`«»“”‘’…").lower()
            if 3 <= len(w) <= 32 and w.isalpha():
                seen[w] += 1
    total = sum(seen.values())
    words = {w: math.log2(total / n) for w, n in seen.items()} if total else {}
    for w, b in guess_cost.listed_bits().items():
        words[w] = min(b, words.get(w, b))
    return [[(s, e) for s, e in guess_cost.credential_values(t or "") if guess_cost.guess_bits(t[s:e], words) >= 40] for t in texts]


def test_documents(spark):
    common.prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = guess_cost.query(docs).collect()
    _check(rows, got)
    want = {i: [f"guess:{s}:{e}" for s, e in spans] for (i, _), spans in zip(rows, _plain_spans([t for _, t in rows]), strict=True)}
    assert {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("guess")] for r in got} == want
    assert sum(map(bool, want.values())) >= 1


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names, an empty table."""
    common.prepare(spark)
    rows = [*enumerate(ODD), (2, "x"), (None, None), (None, None)]
    df = spark.createDataFrame([(*r, "a", 1.0, "w") for r in rows], "doc_id long, text string, secret_spans string, id double, row string")
    _check(rows, guess_cost.query(df).collect())
    found = guess_cost.find_secrets(df)
    assert found.columns == ["doc_id", "text", "id", "row", "secret_spans"] and found.count() == len(rows)
    last = next(r for r in found.collect() if r["doc_id"] == len(ODD) - 1)
    assert [last["text"][s["start"] : s["end"]] for s in last["secret_spans"] if s["kind"] == "guess"] == ["kV7%wq2Zp0", "zX81!pQ vv09#", "mF_9.B5f-4.1JqM9"]
    assert guess_cost.query(df.limit(0)).count() == 0


def test_easy_values_are_no_secrets(spark):
    """A phrase of the corpus, a listed password, a date, a walk and a repeat in a credential's place; a value that many
    texts repeat is no word of the corpus by that."""
    common.prepare(spark)
    easy = ["thesilentriver", "Passw0rd1", "19870412", "qwertyuiop[]", "abcabcabcabcabc", "changeme"]
    hard = "kdvqzjwxpfhb"
    texts = ["the silent river"] * 50 + [f"password: {v}" for v in easy] + [f"password: {hard}"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: "guess" in r["spans"] for r in guess_cost.query(df).collect()}
    assert [got[i] for i in range(50, 50 + len(easy))] == [False] * len(easy)
    assert all(got[i] for i in range(50 + len(easy), len(texts)))


WORDS = guess_cost.listed_bits() | {"abc": 5.0, "cab": 6.0, "ab": 1.0}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc1Q2w@9-", min_size=1, max_size=9))
def test_cost_is_the_least_over_all_segmentations(value):
    per_sign = math.log2(guess_cost._alphabet(value))
    parts = {}
    for i, j, bits in guess_cost.segments(value, WORDS):
        parts[i, j] = min(bits, parts.get((i, j), math.inf))
    least = math.inf
    for cuts in range(1 << (len(value) - 1)):  # every way to cut the value
        at = [0, *(k + 1 for k in range(len(value) - 1) if cuts >> k & 1), len(value)]
        least = min(least, sum(guess_cost.KIND_BITS + min(parts.get((i, j), math.inf), per_sign * (j - i)) for i, j in zip(at, at[1:], strict=False)))
    assert guess_cost.guess_bits(value, WORDS) == pytest.approx(least)


def test_values_that_overlap_or_abound():
    """A password in a URL that is itself a value; 20,000 values in one text, taken out in linear time."""
    text = "secret=https://joe:kV7wq2Zp0@db.example.org/x after it"
    values = guess_cost.credential_values(text)
    assert [text[s:e] for s, e in values] == ["https://joe:kV7wq2Zp0@db.example.org/x", "kV7wq2Zp0"]
    assert guess_cost._without(text, values).split() == ["secret=", "after", "it"]
    import time

    begin, text = time.time(), "token=abcdefgh word " * 20_000
    assert len(guess_cost._without(text, guess_cost.credential_values(text)).split()) == 40_000 and len(guess_cost.base_spans(text)) == 20_000
    assert time.time() - begin < 5


def test_segments():
    by = lambda v: {(v[i:j], round(b, 3)) for i, j, b in guess_cost.segments(v, WORDS)}
    assert ("@bC", round(5 + 1 + guess_cost._case_bits("@bC"), 3)) in by("1@bC")
    assert ("12/04/1987", round(math.log2(36600) + 2, 3)) in by("a12/04/1987") and ("1987", round(math.log2(100), 3)) in by("x1987")
    assert ("7", 0) not in by("777") and any(p == "qwer" for p, _ in by("qwer"))
    assert ("zzzz", round(math.log2(26) + guess_cost.KIND_BITS + 2, 3)) in by("zzzz")
    assert ("efgh", round(math.log2(2 * 26 * 4), 3)) in by("efgh") and ("4321", round(math.log2(2 * 11 * 4), 3)) in by("4321")


def test_long_values_take_linear_time():
    import time

    value = hashlib.sha256(b"x").hexdigest() * 1500
    begin = time.time()
    assert guess_cost.guess_bits("0z" + value[:64], {}) > 250 and guess_cost.guess_bits(value, WORDS) > 250
    assert time.time() - begin < 20
