"""Texts with many spans: results over many blocks, in a time that grows with the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scorelake.llm import common, pii

IBANS = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"]


def _masked(text, spans):
    """Overlapping spans go together, by the kind of the first, then longest."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("block", [2, 5, 256])
def test_blocks_do_not_change_spans_or_masks(spark, monkeypatch, block):
    """Spans of all kinds beside, inside and across each other, so that groups of overlaps lie over blocks' edges."""
    common.prepare(spark)
    monkeypatch.setattr(pii, "BLOCK", block)
    rng = random.Random(block)
    parts = ["a.b@c.org", "10.0.0.1", "4111 1111 1111 1111", "+1 555 123 4567", "+1 555 123 4567@mail.com", "1.2.3.4@5.6.7.8", "x", "é😀", "4111111111111111@z.de", *IBANS, "DE89370400440532013001"]
    texts = [" ".join(rng.choices(parts, k=n)) for n in (0, 1, 2, 7, 40, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["pii_spans"]] for r in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        emails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert [s[:2] for s in found[i] if s[2] == "email"] == emails
        ibans = [m.span() for m in re.finditer("|".join(IBANS), t)]
        assert [s[:2] for s in found[i] if s[2] == "iban"] == ibans
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} == {i: _masked(t, found[i]) for i, t in enumerate(texts)}


def test_time_is_linear_in_the_spans(spark):
    common.prepare(spark)

    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"ab{i}@x.org" for i in range(n)))], "doc_id long, text string")
        begin = time.time()
        assert pii.query(df).first()["n_email"] == n
        assert pii.redact(df).select(F.length("text")).first()[0] == 8 * n - 1
        return time.time() - begin

    took(10)
    base = took(1000)
    assert took(40_000) < base + 20  # some 200 s when each span copied what was found so far
