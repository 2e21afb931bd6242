"""Drift of a stream, and answers against what is expected of them."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from scorelake.functions import text as T
from scorelake.operators import matching
from scorelake.streaming import drift_stream

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _at(hours):
    return DAY + dt.timedelta(hours=hours)


def _jsd(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return (half(p, q) + half(q, p)) / 2


def test_late_texts_count_until_the_watermark(spark, tmp_path):
    """Three arrivals: a late text within the delay rewrites its window, one beyond it is dropped; a replay of the same
    files after the last adds nothing."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "ts timestamp, text string"
    texts = spark.createDataFrame([("a" * n,) for n in (1, 40, 40, 200)], "text string")
    golden = drift_stream.stored_counts(texts, T.length_bucket(F.col("text")), 9)
    assert golden == [1, 2, 0, 1, 0, 0, 0, 0, 0]

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        drift_stream.write(drift_stream.windows(stream, "ts", T.length_bucket(F.col("text")), golden, "1 hour", "2 hours"), out, checkpoint).awaitTermination()
        return {r["window_start"].astimezone(dt.UTC).hour: r for r in drift_stream.latest(spark, out).collect()}

    got = arrive([(_at(0.5), "a"), (_at(1.5), "b" * 50), (_at(1.6), "b" * 5000), (None, "no time"), (_at(1.7), None)])
    assert [got[h]["n"] for h in (0, 1)] == [1, 3] and got[1]["counts"] == [0, 1, 0, 0, 0, 0, 0, 0, 1]
    assert got[0]["drift_score"] == pytest.approx(_jsd(golden, [1, 0, 0, 0, 0, 0, 0, 0, 0]))
    got = arrive([(_at(6.5), "c"), (_at(1.1), "late" * 20)])  # late, but no watermark has passed its window yet
    assert got[1]["n"] == 4 and got[1]["counts"] == [0, 1, 1, 0, 0, 0, 0, 0, 1] and got[6]["n"] == 1
    got = arrive([(_at(0.2), "too late"), (_at(5.2), "late" * 20)])  # the watermark is at 4:30
    assert got[0]["n"] == 1 and got[5]["n"] == 1 and sorted(got) == [0, 1, 5, 6]
    batch = drift_stream.windows(spark.createDataFrame([(_at(1.5), "b" * 50), (_at(1.6), "b" * 5000)], schema), "ts", T.length_bucket(F.col("text")), golden, "1 hour", "2 hours").first()
    assert batch["status"] == "drifted" and batch["drift_score"] == pytest.approx(_jsd(golden, [0, 1, 0, 0, 0, 0, 0, 0, 1]))
    with pytest.raises(ValueError):
        drift_stream.windows(texts, "ts", F.lit(0), [], "1 hour", "1 hour")
    with pytest.raises(ValueError):
        drift_stream.windows(texts, "ts", F.lit(0), golden, "1 hour", "1 hour", 2.0)




def test_any_expected_output_is_enough(spark):
    """Exact, regular expressions by row and likeness, alone and together; nulls, empty arrays and clashing names."""
    cases = [
        ([("exact", " Yes\u00a0")], "yes\n", [0]), ([("exact", "yes")], "yes.", []), ([("regex", r"^\d{4}-\d\d$")], "2024-05", [0]), ([("regex", "b+")], "abbbc", [0]), ([("regex", "^b+$")], "abbbc", []),
        ([("semantic", "the cat sat")], "Sat the CAT!", [0]), ([("semantic", "the cat sat")], "rates went up by ten", []), ([("exact", "no"), ("regex", "y.s"), ("semantic", "yes")], "yes", [1, 2]),
        ([("exact", None), ("regex", None), ("semantic", None)], "x", []), ([], "x", []), (None, "x", []), ([("exact", "x")], None, []), ([("semantic", "")], "", []), ([("exact", "")], " ", [0]),
    ]
    rows = [(i, e, a, "m", 1) for i, (e, a, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, expected_outputs array<struct<kind:string,value:string>>, answer string, matched string, _sims0 int")
    got = matching.matched(df)
    assert sorted(got.columns) == sorted(["id", "expected_outputs", "answer", "_sims0", "met", "matched"])
    assert {r["id"]: (r["met"], r["matched"]) for r in got.collect()} == {i: (m, bool(m)) for i, (_, _, m) in enumerate(cases)}
    assert matching.matched(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        matching.matched(spark.createDataFrame([([("fuzzy", "x")], "x")], "expected_outputs array<struct<kind:string,value:string>>, answer string")).collect()
    bad = spark.createDataFrame([([("regex", "("), ("exact", "("), ("regex", "a")],)], "expected_outputs array<struct<kind:string,value:string>>")
    assert [r["value"] for r in matching.regexes_are_sound(bad).collect()] == ["("]
    with pytest.raises(ValueError):
        matching.matched(df, least=1.5)


def test_texts_in_capitals_are_equal_to_the_texts(spark):
    """Letters whose capitals are several letters, other letters' or none."""
    pairs = [("STRASSE", "Straße"), ("Straße", "STRASSE"), ("STRAẞE", "straße"), ("ISI", "ısı"), ("İ", "i\u0307"), ("\u039c", "\u00b5"), ("ΟΔΟΣ", "οδος"), ("ΟΔΟΣ", "οδοσ"), ("ﬁn", "FIN"), ("s", "ſ"), ("ß", "s"), ("é", "e")]
    rows = [(i, [("exact", e)], a) for i, (e, a) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, expected_outputs array<struct<kind:string,value:string>>, answer string")
    assert {r["id"] for r in matching.matched(df).where("matched").collect()} == set(range(10))
