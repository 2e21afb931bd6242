"""Queries of the evaluation operators over the test tables, with their SQL.

Stand-ins: texts are documents (golden side: lang 'en', candidate side: all other languages), human labels come from
labels, run history from events (suite: event type, run: suite and day, example: user), prompts and responses from
conversations, ready vectors from embeddings. Every run is compared with the one before it in its suite.

No table holds lines of data sets or texts of judges, so those are planted: ``validate_*`` and ``files_*`` make their lines
of doc_id, lang and source, ``judge_parse`` its texts of doc_id, and neither reads a document's text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import hashed, markdown
from scorelake.functions import text as T
from scorelake.operators import drift, judging, matching, ordinals, runs, similar, validate
from scorelake.sources import scratch
from scorelake.streaming import drift_stream


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sides(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", drift.GOLDEN).otherwise(drift.CANDIDATE).alias("side"), "text").where("text is not null")


def _cells(s, d) -> DataFrame:
    return hashed.cells(_read(s, d, "documents"), "doc_id", "text", T.DIM)


def _length_hist(s, d):
    return drift.histogram(_sides(s, d), T.length_bucket(F.col("text")), len(T.LENGTH_BOUNDS))


def _judge_hist(s, d):
    return drift.histogram(_sides(s, d), T.judge_bucket(T.word_count_judge(F.col("text"))), T.JUDGE_BUCKETS)


def _report(hist: DataFrame, axis: str) -> DataFrame:
    return drift.axis_report(drift.jensen_shannon(hist, drift.GOLDEN, drift.CANDIDATE), axis).withColumn("drift_score", F.round("drift_score", 6))


def _history(s, d) -> DataFrame:
    e = _read(s, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(F.col("event_type").alias("suite"), F.concat_ws("_", "event_type", day).alias("run_id"), F.concat(day, F.lit("T00:00:00Z")).alias("started_at"), F.col("user_id").cast("string").alias("example_id"), "value")


def _rows(s, d) -> DataFrame:
    g = _history(s, d).groupBy("suite", "run_id", "started_at", "example_id").agg(F.avg("value").alias("v"))
    return g.select("suite", "run_id", "started_at", "example_id", F.round(F.least(F.lit(1.0), F.col("v") / 100), 6).alias("score"))


def _exact_mean(score: str) -> Column:
    """Mean of scores of six digits; the sum is a decimal, so the order of rows does not move the last digit."""
    return F.sum(F.col(score).cast("decimal(18,6)")).cast("double") / F.count("*")


def _runs(s, d) -> DataFrame:
    return _rows(s, d).groupBy("suite", "run_id", "started_at").agg(F.count("*").alias("n_rows"), _exact_mean("score").alias("mean_score"))


_PAIR = ("suite", "run_id")


def _paired(s, d) -> DataFrame:
    """(suite, run_id, prior_run_id) of all runs but each suite's first."""
    return runs.with_prior(_runs(s, d)).where("prior_run_id is not null").select("suite", "run_id", "prior_run_id")


def _prior_as(s, d, rows: DataFrame) -> DataFrame:
    """What belongs to a run, under the name of the run that follows it."""
    return rows.withColumnRenamed("run_id", "prior_run_id").join(_paired(s, d), ["suite", "prior_run_id"]).drop("prior_run_id")


def _diff(s, d) -> DataFrame:
    rows = _rows(s, d).select(*_PAIR, "example_id", "score")
    current = rows.join(_paired(s, d).select(*_PAIR), [*_PAIR], "left_semi")
    return runs.diff(current, _prior_as(s, d, rows), by=_PAIR).withColumn("delta", F.round("delta", 6))


def _diff_summary(s, d) -> DataFrame:
    stored = _runs(s, d).select(*_PAIR, "mean_score")
    out = runs.with_means(runs.summary(_diff(s, d), _PAIR), stored, _prior_as(s, d, stored), _PAIR)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_score_current", "mean_score_baseline", "mean_delta")})


def _calibration(s, d) -> DataFrame:
    docs, labels = _read(s, d, "documents"), _read(s, d, "labels")
    human = ((F.col("quality") + 1 - F.col("toxic")) / 2.0).alias("human")
    return labels.join(docs, "doc_id").select("doc_id", human, T.word_count_judge(F.col("text")).alias("judge"))


def _binary(s, d) -> DataFrame:
    return _calibration(s, d).select("doc_id", "human", "judge", runs.binarize(F.col("human")).alias("h"), runs.binarize(F.col("judge")).alias("j"))


def _tagged(s, d) -> DataFrame:
    return _read(s, d, "documents").select("doc_id", F.array("lang", "source").alias("tags"))


class CountingBackend:
    """A judge for the queries: by the number of words of the response, written as a judge writes."""

    def complete(self, system: str, user: str) -> str:
        response = user.split("\n\nRESPONSE: ", 1)[1]
        return f"Here you are.\nSCORE: {len(response.split()) % 13 / 10:.3f}\nREASONING: counted {len(response.split())} words\n"


def _asked(s, d) -> DataFrame:
    """Examples made of conversations: what a user says, and the reply to it as the expected output."""
    c = _read(s, d, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.array(F.struct(F.lit("semantic").alias("kind"), F.col("text").alias("value"))).alias("expected_outputs"))
    name = F.concat_ws("-", "conv_id", "turn").alias("id")
    return ask.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", name, "input", "expected_outputs")


def _suite(s, d) -> DataFrame:
    rows = judging.with_answers(_asked(s, d))
    return judging.score(rows, F.col("input"), F.col("answer"), F.lit(judging.RUBRIC), CountingBackend).select("conv_id", "turn", F.round("score", 6).alias("score"), "reasoning")


def _ledger_run(s, d) -> DataFrame:
    """First turns are judged, then all turns with the same ledger: what was asked before is not asked again."""
    ledger = judging.Ledger(scratch.folder(s, "ledger"), "counting")
    rows = judging.with_answers(_asked(s, d))
    judged = lambda part: scratch.written(judging.score(part, F.col("input"), F.col("answer"), F.lit(judging.RUBRIC), CountingBackend, ledger), "judged")
    judged(rows.where("turn = 0"))
    whole = judged(rows).agg(F.count("*").alias("n_rows"), F.round(F.avg("score"), 6).alias("mean_score"))
    return whole.crossJoin(F.broadcast(s.read.parquet(ledger.folder).agg(F.count("*").alias("n_asked"))))  # one row each


def _replayed(s, d) -> DataFrame:
    """All events but views, replayed as a stream in four batches that each hold rows of all times, so that most rows are
    late, against the stored histogram of the views; a window is a day, 40 days are waited for."""
    e = _read(s, d, "events")
    at = F.to_timestamp_ltz(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX"))
    e = e.select("event_id", "event_type", at.alias("ts"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))
    golden = drift_stream.stored_counts(e.where("event_type = 'view'"), T.judge_bucket(F.col("score")), T.JUDGE_BUCKETS)
    source, out, checkpoint = (scratch.folder(s, f"stream-{x}") for x in ("source", "out", "checkpoint"))
    e.where("event_type <> 'view'").repartition(4, "event_id").write.parquet(source)
    stream = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    drift_stream.write(drift_stream.windows(stream, "ts", T.judge_bucket(F.col("score")), golden, "1 day", "40 days"), out, checkpoint).awaitTermination()
    return drift_stream.latest(s, out).select(F.unix_timestamp("window_start").alias("window_start"), "n", F.array_join("counts", ",").alias("counts"), F.round("drift_score", 6).alias("drift_score"), "status")


def _expected(s, d) -> DataFrame:
    """Replies with what is expected of them: the same text in capitals for every third conversation, an expression made
    of what was asked, and a meaning like that of what was asked."""
    rows = judging.with_answers(_asked(s, d)).drop("expected_outputs")
    exact = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("  "), F.upper("answer"), F.lit("\u00a0"))).otherwise("nothing")
    stem = F.regexp_replace(F.lower(F.substring("input", 1, 3)), "[^a-z]", "")
    made = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("exact", exact), ("regex", F.concat(stem, F.lit("[a-z]+e "))), ("semantic", F.col("input")))))
    return matching.matched(rows.withColumn("expected_outputs", made), least=0.5).select("conv_id", "turn", "matched", F.array_join("met", ",").alias("met"))


def _calibration_set(s, d) -> DataFrame:
    """Calibration rows made of labels and documents: the prompt is a text's first three words, the rubric its source."""
    docs, labels = _read(s, d, "documents"), _read(s, d, "labels")
    human = (F.col("quality") + 1 - F.col("toxic")) / 2.0
    prompt = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 3), " ")
    return labels.join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("id"), prompt.alias("prompt"), F.coalesce("text", F.lit("")).alias("response"), F.col("source").alias("rubric"), human.alias("human_score"))


def _calibrated(s, d) -> tuple[DataFrame, DataFrame]:
    rows, report = judging.calibrate(_calibration_set(s, d), judging.ByColumn(T.overlap_judge))
    return rows.select(F.col("id").cast("long").alias("doc_id"), "human_score", F.round("judge_score", 6).alias("judge_score"), "human_class", "judge_class"), report.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"), "kappa_label", F.round("r", 6).alias("r"), "r_label", "status")


#: Texts of judges in every form that counts; {} is a digit.
_SAID = [
    "SCORE: 0.{}\nREASONING: fine", "score:\t.{}  \nReasoning:   spaced out \t", "SCORE:\n0.{}5\nREASONING: on the next line", "x\n\n SCORE: +{}.\n y\n REASONING:\n below", "SCORE: -0.{}\nREASONING: below nought",
    "SCORE: 1.{}\nREASONING: above one", "SCORE: {}e0\nREASONING: not plain", "SCORE: 0.{}", "REASONING: no score {}", "SCORE: 0.{} of 1\nSCORE: 0.2\nREASONING: the second counts\nREASONING: not this", "", "SCORE: 0.{}\r\nREASONING: carriage\r\n",
]


def _said(s, d) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return _read(s, d, "documents").select("doc_id", F.replace(text, F.lit("{}"), (F.col("doc_id") % 10).cast("string")).alias("said"))


def _drift_report(s, d) -> DataFrame:
    axes, _ = drift.report(_sides(s, d), "doc_id", T.word_count_judge(F.col("text")))
    return axes.select("axis", F.round("drift_score", 6).alias("drift_score"), "threshold", "status", F.array_join("golden_counts", ",").alias("golden_counts"), F.array_join("candidate_counts", ",").alias("candidate_counts"), *(F.round(c, 6).alias(c) for c in ("golden_mean", "candidate_mean")))


def _record(**changed) -> str:
    return json.dumps({"id": "x", "input": "q", "expected_outputs": [{"kind": "exact", "value": "a"}], "dataset_version": "v1", "provenance": {}} | changed)


#: Lines that break a rule, with the reason.
_BROKEN = [
    ('{"id": "x"}', "missing required field(s): ['input', 'expected_outputs', 'dataset_version', 'provenance']"),
    ("[1]", "top-level value must be JSON object, got list"),
    (_record(id=""), "field 'id' must be a non-empty string"),
    (_record(input=3), "field 'input' must be a string"),
    (_record(provenance=[]), "field 'provenance' must be an object"),
    (_record(expected_outputs=[]), "field 'expected_outputs' must be a non-empty list"),
    (_record(expected_outputs=[{"kind": "exact", "value": "a"}, {"kind": "fuzzy", "value": "a"}]), "expected_outputs[1]: invalid expected_output kind 'fuzzy'"),
    (_record(expected_outputs=[{"kind": "exact", "value": 1}]), "expected_outputs[0]: expected_output value must be str, got int"),
    (_record(tags=[1]), "field 'tags' must be a list of strings"),
    (_record(more=1), "unknown top-level field(s): ['more']"),
]


def _lines(s, d) -> DataFrame:
    """Golden records made of documents, with a defect of a known kind in some."""
    doc = _read(s, d, "documents").select("doc_id", "lang", "source")
    k = F.col("doc_id") % 10
    name = F.when(k == 4, F.concat(F.lit("d"), (F.col("doc_id") - 1).cast("string"))).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    version = F.when(k == 5, "v2").otherwise("v1")
    body = F.to_json(F.struct(name.alias("id"), F.lit("q").alias("input"), F.array(F.struct(F.lit("exact").alias("kind"), F.lit("a").alias("value"))).alias("expected_outputs"), version.alias("dataset_version"), F.struct(F.lit(1).alias("by")).alias("provenance"), F.array("lang", "source").alias("tags")))
    line = F.when(k == 1, "").when(k == 2, "{not json").when(k == 3, F.element_at(F.array(*(F.lit(x) for x, _ in _BROKEN)), (F.floor(F.col("doc_id") / 10) % len(_BROKEN) + 1).cast("int"))).otherwise(body)
    # d3 is taken by none, so 4 has the id of a broken record (valid); 7 repeats the id of 6
    line = F.when(k == 7, F.replace(body, F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit('"')), F.concat(F.lit('"d'), (F.col("doc_id") - 1).cast("string"), F.lit('"')))).otherwise(line)
    return doc.select((F.col("doc_id") + 1).alias("line_no"), line.alias("line"))


def _file_lines(s, d) -> DataFrame:
    """A golden file for each source, with ids that come again in other files and a version of its own; the same defects in
    each: 1 blank, 2 a good record behind a space of another script, 3 broken, 5 another version, 7 the id of 6."""
    doc = ordinals.numbered(_read(s, d, "documents").select("doc_id", "lang", "source"), ["source"], ["doc_id"], "at")
    k = F.col("at") % 10
    name = F.concat(F.lit("p"), F.when(k == 7, F.col("at") - 1).otherwise(F.col("at")).cast("string"))
    version = F.when(k == 5, "other").otherwise(F.concat(F.lit("v-"), "source"))
    body = F.to_json(F.struct(name.alias("id"), F.lit("q").alias("input"), F.array(F.struct(F.lit("exact").alias("kind"), F.lit("a").alias("value"))).alias("expected_outputs"), version.alias("dataset_version"), F.struct(F.lit(1).alias("by")).alias("provenance"), F.array("lang").alias("tags")))
    broken = F.element_at(F.array(*(F.lit(x) for x, _ in _BROKEN)), (F.floor(F.col("at") / 10) % len(_BROKEN) + 1).cast("int"))
    line = F.when(k == 1, "\u2003\u00a0").when(k == 2, F.concat(F.lit("\u00a0"), body)).when(k == 3, broken).otherwise(body)
    return doc.select(F.concat("source", F.lit(".jsonl")).alias("file"), (F.col("at") + 1).alias("line_no"), line.alias("line"))


def _files(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return validate.report(validate.outcomes(_file_lines(s, d)))


def _centroids(s, d, k: int = 8) -> tuple[DataFrame, list]:
    e = _read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    step = max(e.count() // k, 1)
    first = e.where((F.col("vec_id") % step == 0) & (F.col("vec_id") < step * k)).orderBy("vec_id").collect()  # k rows
    return e, [list(r["vector"]) for r in first]


def _nearest(s, d) -> DataFrame:
    return drift.nearest(*_centroids(s, d))


def _embedded(s, d) -> tuple[DataFrame, list]:
    return drift.embedded(_sides(s, d), 8, "doc_id")


def _embedding_drift(s, d) -> DataFrame:
    vectors, centroids = _embedded(s, d)
    hist = drift.histogram(drift.nearest(vectors, centroids), F.col("cluster"), len(centroids))
    return _report(hist, "embedding")


def _validated(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return validate.report(validate.outcomes(_lines(s, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def judge_parse(s, d):
        return _said(s, d).select("doc_id", T.judge_output(F.col("said")).alias("o")).select("doc_id", "o.score", "o.reasoning", "o.error")

    return {
        "length_histogram": _length_hist,
        "length_stats": lambda s, d: drift.length_stats(_sides(s, d)).select("side", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95"))),
        "length_drift": lambda s, d: _report(_length_hist(s, d), "length"),
        "judge_histogram": _judge_hist,
        "judge_drift": lambda s, d: _report(_judge_hist(s, d), "judge"),
        "token_counts": lambda s, d: _read(s, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens")),
        "hash_embed_sparse": lambda s, d: _cells(s, d),
        "hash_embed_norm": lambda s, d: _cells(s, d).groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm")),
        "pairwise_cosine_topk": lambda s, d: similar.most_alike(_read(s, d, "documents"), F.col("doc_id") % 20 == 0, "doc_id").select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 9).alias("score")),
        "nearest_centroid_embeddings": lambda s, d: _nearest(s, d).groupBy("cluster").agg(F.count("*").alias("n")),
        "farthest_examples": lambda s, d: drift.farthest(_nearest(s, d), 5, "vec_id").select("vec_id", "cluster", F.round("distance", 6).alias("distance")),
        "embedding_drift": _embedding_drift,
        "kmeans_clusters": lambda s, d: (lambda v, c: drift.nearest(v, c).select("doc_id", "side", "cluster", F.round("distance", 6).alias("distance")))(*_embedded(s, d)),
        "calibration_rows": lambda s, d: _binary(s, d),
        "cohens_kappa": lambda s, d: runs.cohens_kappa(_binary(s, d), "h", "j").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"), runs.kappa_label(F.col("kappa")).alias("label")),
        "pearson_r": lambda s, d: runs.pearson_r(_calibration(s, d), "human", "judge").select("n", F.round("r", 6).alias("r"), runs.pearson_label(F.col("r")).alias("label")),
        "runs_list": lambda s, d: runs.recent(_runs(s, d), "click"),
        "latest_run_per_suite": lambda s, d: runs.latest_per_suite(_runs(s, d)),
        "prior_run": lambda s, d: runs.with_prior(_runs(s, d)).select("suite", "run_id", "prior_run_id"),
        "run_diff": _diff,
        "run_diff_summary": _diff_summary,
        "regressed_ids": lambda s, d: _diff(s, d).where("flagged").select(*_PAIR, "example_id"),
        "runs_with_rows": lambda s, d: runs.with_rows(_runs(s, d), _rows(s, d).select("run_id", "example_id", "score")),
        "suite_run": _suite,
        "suite_mean": lambda s, d: _suite(s, d).agg(F.count("*").alias("n_rows"), F.round(F.avg("score"), 6).alias("mean_score")),
        "ledger_run": _ledger_run,
        "stream_drift": _replayed,
        "match_outputs": _expected,
        "tag_filter": lambda s, d: _tagged(s, d).where(F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("src3")))).select("doc_id"),
        "tag_inventory": lambda s, d: _tagged(s, d).select(F.explode("tags").alias("tag")).distinct(),
        "tag_histogram": lambda s, d: validate.tag_histogram(_tagged(s, d)),
        "validate_outcomes": lambda s, d: validate.outcomes(_lines(s, d)).select("line_no", "code"),
        "validate_summary": lambda s, d: _validated(s, d)[0],
        "validate_findings": lambda s, d: _validated(s, d)[1].select("line_no", "code", "reason"),
        "valid_tags": lambda s, d: _validated(s, d)[2],
        "files_summary": lambda s, d: _files(s, d)[0],
        "files_findings": lambda s, d: _files(s, d)[1],
        "files_tags": lambda s, d: _files(s, d)[2],
        "judge_parse": judge_parse,
        "judge_overlap": lambda s, d: _calibrated(s, d)[0].select("doc_id", "judge_score"),
        "calibration_run": lambda s, d: _calibrated(s, d)[1],
        "length_judge": lambda s, d: _read(s, d, "documents").select("doc_id", F.round(T.length_judge(F.col("text")), 6).alias("score")),
        "needle_judge": lambda s, d: _asked(s, d).select("conv_id", "turn", T.needle_judge(T.judge_prompt(F.lit("r"), F.col("input"), judging.echo()), {"the": 0.25, "an": 0.75}).alias("score")),
        "drift_report": _drift_report,
        "diff_markdown": lambda s, d: markdown.diff_rows(_diff(s, d), _PAIR),
        "diff_headline": lambda s, d: markdown.headline(_diff_summary(s, d), _PAIR),
    }


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_JUDGE = f"((len({_TOK}) * 7) % 100) / 100.0::DOUBLE"
_SIDES = "s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'golden' ELSE 'candidate' END AS side, text FROM documents WHERE text IS NOT NULL)"
_LEN_BUCKET = "(" + " + ".join(f"CAST(length(text) >= {b} AS INTEGER)" for b in T.LENGTH_BOUNDS) + " - 1)"
_JUDGE_BUCKET = f"least(9, greatest(0, CAST(floor({_JUDGE} * 10) AS INTEGER)))"


def _hist_sql(bucket: str, n: int) -> str:
    return f"""{_SIDES}, c AS (SELECT side, CAST({bucket} AS INTEGER) AS bucket, count(*) AS n FROM s GROUP BY ALL),
hist AS (SELECT x.side, CAST(b.range AS INTEGER) AS bucket, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT side FROM s) x CROSS JOIN range({n}) b LEFT JOIN c ON c.side = x.side AND c.bucket = b.range)"""


def _drift_sql(hist: str, axis: str) -> str:
    return f"""WITH {hist}, w AS (SELECT bucket, sum(CASE WHEN side = 'golden' THEN n ELSE 0 END) / (SELECT sum(n) FROM hist WHERE side = 'golden') AS p,
  sum(CASE WHEN side = 'candidate' THEN n ELSE 0 END) / (SELECT sum(n) FROM hist WHERE side = 'candidate') AS q FROM hist GROUP BY bucket),
t AS (SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS v FROM w)
SELECT '{axis}' AS axis, round(least(1, greatest(0, v)), 6) AS drift_score, CAST(0.1 AS DOUBLE) AS threshold, CASE WHEN v > 0.1 THEN 'drifted' ELSE 'ok' END AS status FROM t"""


_HASH = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents),
m AS (SELECT doc_id, CAST(concat('0x', right(sha1(token), 2)) AS INTEGER) % 128 AS m FROM tok),
cells AS (SELECT doc_id, CAST(m % 64 AS INTEGER) AS bucket, CAST(sum(CASE WHEN m >= 64 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM m GROUP BY ALL)"""
_RUNS = """r0 AS (SELECT event_type AS suite, concat_ws('_', event_type, strftime(ts, '%Y-%m-%d')) AS run_id, concat(strftime(ts, '%Y-%m-%d'), 'T00:00:00Z') AS started_at,
  CAST(user_id AS VARCHAR) AS example_id, avg(value) AS v FROM events GROUP BY ALL),
rw AS (SELECT suite, run_id, started_at, example_id, round(least(1.0, v / 100), 6) AS score FROM r0),
runs AS (SELECT suite, run_id, started_at, count(*) AS n_rows, CAST(sum(CAST(score AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS mean_score FROM rw GROUP BY ALL)"""
_DIFF = _RUNS + """, pair AS (SELECT * FROM (SELECT suite, run_id, mean_score, lag(run_id) OVER w AS prior, lag(mean_score) OVER w AS prior_mean FROM runs WINDOW w AS (PARTITION BY suite ORDER BY started_at, run_id)) WHERE prior IS NOT NULL),
cur AS (SELECT p.suite, p.run_id, example_id, score FROM rw JOIN pair p ON rw.run_id = p.run_id),
base AS (SELECT p.suite, p.run_id, example_id, score FROM rw JOIN pair p ON rw.run_id = p.prior),
df AS (SELECT coalesce(cur.suite, base.suite) AS suite, coalesce(cur.run_id, base.run_id) AS run_id, coalesce(cur.example_id, base.example_id) AS example_id, base.score AS baseline_score, cur.score AS current_score, cur.score - base.score AS dl
  FROM cur FULL OUTER JOIN base ON cur.run_id = base.run_id AND cur.example_id = base.example_id),
diff AS (SELECT suite, run_id, example_id, baseline_score, current_score, round(dl, 6) AS delta, CASE WHEN baseline_score IS NULL THEN 'new' WHEN current_score IS NULL THEN 'removed'
  WHEN dl < 0 THEN 'regressed' WHEN dl > 0 THEN 'improved' ELSE 'unchanged' END AS status, coalesce(dl < -0.1, FALSE) AS flagged FROM df),
sums AS (SELECT suite, run_id, count_if(flagged)::BIGINT AS n_flagged, """ + ", ".join(f"count_if(status = '{x}')::BIGINT AS n_{x}" for x in runs.STATUSES) + " FROM diff GROUP BY ALL)"
_CAL = f"""cal AS (SELECT l.doc_id, (quality + 1 - toxic) / 2.0::DOUBLE AS human, {_JUDGE} AS judge FROM labels l JOIN documents USING (doc_id)),
bin AS (SELECT doc_id, human, judge, CAST(human >= 0.5 AS INTEGER) AS h, CAST(judge >= 0.5 AS INTEGER) AS j FROM cal)"""
_ASKED = "ask AS (SELECT u.conv_id, u.turn, u.text AS input, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"
_SUITE = _ASKED + r""", wc AS (SELECT *, len(regexp_extract_all(answer, '\S+')) AS w FROM ask),
su AS (SELECT conv_id, turn, least(1.0, round(w % 13 / 10.0::DOUBLE, 6)) AS score, 'counted ' || w || ' words' AS reasoning FROM wc)"""
_OVERLAP = r"""cs AS (SELECT l.doc_id, (quality + 1 - toxic) / 2.0::DOUBLE AS human_score, array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 1, 3), ' ') AS prompt, coalesce(text, '') AS response FROM labels l JOIN documents USING (doc_id)),
words AS (SELECT doc_id, human_score, list_filter(regexp_extract_all(string_split('PROMPT: ' || prompt, chr(10) || chr(10))[1][8:], '\S+'), lambda w: len(w) >= 4 AND regexp_full_match(w, '\p{L}+')) AS p,
  list_filter(regexp_extract_all(string_split('RESPONSE: ' || response, chr(10) || chr(10))[1][10:], '\S+'), lambda w: len(w) >= 4 AND regexp_full_match(w, '\p{L}+')) AS q FROM cs),
ov AS (SELECT doc_id, human_score, CASE WHEN list_has_any(list_transform(p, lambda w: lower(w)), list_transform(q, lambda w: lower(w))) THEN 0.85::DOUBLE ELSE 0.2::DOUBLE END AS judge_score FROM words)"""
_KAPPA_LABEL = "CASE WHEN kappa < 0 THEN 'worse than chance' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END"
_R_LABEL = "CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very strong' END"
_VALID = """v AS (SELECT doc_id + 1 AS line_no, CASE doc_id % 10 WHEN 1 THEN 'parse' WHEN 2 THEN 'parse' WHEN 3 THEN 'schema' WHEN 5 THEN 'version_drift' WHEN 7 THEN 'duplicate_id' ELSE 'valid' END AS code, lang, source FROM documents)"""
_FILES = """fl AS (SELECT source, source || '.jsonl' AS file, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents),
fv AS (SELECT *, pos + 1 AS line_no, CASE pos % 10 WHEN 1 THEN 'parse' WHEN 3 THEN 'schema' WHEN 5 THEN 'version_drift' WHEN 7 THEN 'duplicate_id' ELSE 'valid' END AS code FROM fl)"""
_BROKEN_SQL = " ".join("WHEN {} THEN '{}'".format(i, why.replace("'", "''")) for i, (_, why) in enumerate(_BROKEN))
_NEAR = """p AS (SELECT greatest(count(*) // 8, 1) AS step FROM embeddings), c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, embedding AS c FROM embeddings, p WHERE vec_id % step = 0 AND vec_id < step * 8),
sim AS (SELECT e.vec_id, c.cluster, list_sum(list_transform(list_zip(e.embedding, c.c), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS s FROM embeddings e CROSS JOIN c),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, cluster) AS k FROM sim)"""


#: Spherical k-means by recursion: a row a round with all centroids and the sum of the clusters' marks.
_KMEANS = "RECURSIVE " + _SIDES + ", " + _HASH + """,
norms AS (SELECT doc_id, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM cells GROUP BY doc_id),
grid AS (SELECT s.doc_id, s.side, CAST(i.range AS INTEGER) AS i FROM s CROSS JOIN range(64) i),
vec AS (SELECT g.doc_id, g.side, list(CASE WHEN n.norm > 0 THEN coalesce(c.weight, 0) / n.norm ELSE 0.0::DOUBLE END ORDER BY g.i) AS v
  FROM grid g LEFT JOIN cells c ON c.doc_id = g.doc_id AND c.bucket = g.i LEFT JOIN norms n ON n.doc_id = g.doc_id GROUP BY ALL),
gold AS MATERIALIZED (SELECT doc_id, v, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM vec WHERE side = 'golden'),
start AS (SELECT list(v ORDER BY o) AS cs FROM gold WHERE o % greatest(n // least(8, n), 1) = 0 AND o < greatest(n // least(8, n), 1) * least(8, n)),
loop AS (SELECT 0 AS t, cs, (SELECT list(0 ORDER BY o) FROM gold) AS seen, FALSE AS done FROM start
UNION ALL
SELECT * FROM (
  WITH now AS (SELECT t, cs, seen FROM loop WHERE NOT done AND t < 25),
  near AS (SELECT g.o, g.v, list_transform(now.cs, lambda c: list_sum(list_transform(list_zip(c, g.v), lambda z: z[1] * z[2]))) AS sims FROM gold g, now),
  put AS (SELECT o, v, list_position(sims, list_max(sims)) AS k FROM near),
  part AS (SELECT k, u.i, sum(CAST(u.x AS DECIMAL(28, 18))) AS x FROM put, LATERAL (SELECT unnest(v) AS x, unnest(range(64)) AS i) u GROUP BY ALL),
  sums AS (SELECT k, list(CAST(x AS DOUBLE) ORDER BY i) AS x FROM part GROUP BY k),
  units AS (SELECT k, CASE WHEN list_sum(list_transform(x, lambda y: y * y)) > 0 THEN list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) ELSE x END AS c FROM sums),
  fresh AS (SELECT list(coalesce(u.c, now.cs[j.i]) ORDER BY j.i) AS cs FROM now, LATERAL (SELECT unnest(range(1, len(now.cs) + 1)) AS i) j LEFT JOIN units u ON u.k = j.i)
  SELECT now.t + 1, fresh.cs, placed.ks, placed.ks = now.seen FROM now, fresh, (SELECT list(CAST(k - 1 AS INTEGER) ORDER BY o) AS ks FROM put) placed)),
final AS (SELECT cs FROM loop ORDER BY t DESC LIMIT 1),
sim AS (SELECT vec.doc_id, vec.side, list_transform(final.cs, lambda c: list_sum(list_transform(list_zip(c, vec.v), lambda z: z[1] * z[2]))) AS sims FROM vec, final),
clusters AS (SELECT doc_id, side, CAST(list_position(sims, list_max(sims)) - 1 AS INTEGER) AS cluster, round(1 - list_max(sims), 6) + 0.0 AS distance FROM sim)"""
_CLUSTER_HIST = _KMEANS + """, hist AS (SELECT x.side, CAST(b.range AS INTEGER) AS bucket, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT side FROM s) x CROSS JOIN range(8) b
  LEFT JOIN (SELECT side, cluster, count(*) AS n FROM clusters GROUP BY ALL) c ON c.side = x.side AND c.cluster = b.range)"""


def _said_sql() -> str:
    """The judge's texts, one by one, with what is right for each, as no expression is shared with the query."""
    digit = "CAST(doc_id % 10 AS VARCHAR)"
    right = [
        (f"CAST('0.' || {digit} AS DOUBLE)", "'fine'"), (f"CAST('.' || {digit} AS DOUBLE)", "'spaced out'"), (f"CAST('0.' || {digit} || '5' AS DOUBLE)", "'on the next line'"), (None, None), ("0.0::DOUBLE", "'below nought'"),
        ("1.0::DOUBLE", "'above one'"), (None, None), (None, None), (None, None), ("0.2::DOUBLE", "'the second counts'"), (None, None), (f"CAST('0.' || {digit} AS DOUBLE)", "'carriage'"),
    ]
    right[3] = ("least(1.0, (doc_id % 10)::DOUBLE)", "'below'")
    pick = lambda k: "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN {r[k]}" for i, r in enumerate(right) if r[k]) + " END"
    return f"SELECT doc_id, {pick(0)} AS score, {pick(1)} AS reasoning, CASE doc_id % 12 WHEN 6 THEN 'missing SCORE: line' WHEN 7 THEN 'missing REASONING: line' WHEN 8 THEN 'missing SCORE: line' WHEN 10 THEN 'missing SCORE: line' END AS error FROM documents"


def _axis_sql(axis: str, hist: str, value: str) -> str:
    """One axis of the drift report."""
    counts = lambda side: f"(SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY bucket) FROM hist WHERE side = '{side}')"
    mean = lambda side: f"(SELECT round(avg({value}), 6) FROM s WHERE side = '{side}')"
    more = ", ".join(f"{f(side)} AS {side}_{name}" for name, f in (("counts", counts), ("mean", mean)) for side in ("golden", "candidate"))
    return f"({_drift_sql(hist, axis).replace('AS status FROM t', f'AS status, {more} FROM t')})"


def oracle_sql() -> dict[str, str]:
    length, judge = _hist_sql(_LEN_BUCKET, len(T.LENGTH_BOUNDS)), _hist_sql(_JUDGE_BUCKET, T.JUDGE_BUCKETS)
    return {
        "length_histogram": f"WITH {length} SELECT side, bucket, n FROM hist",
        "judge_histogram": f"WITH {judge} SELECT side, bucket, n FROM hist",
        "length_drift": _drift_sql(length, "length"),
        "judge_drift": _drift_sql(judge, "judge"),
        "length_stats": f"WITH {_SIDES} SELECT side, count(*) AS n, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.95), 6) AS p95 FROM s GROUP BY side",
        "token_counts": f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens FROM documents",
        "hash_embed_sparse": f"WITH {_HASH} SELECT doc_id, bucket, weight FROM cells",
        "hash_embed_norm": f"WITH {_HASH} SELECT doc_id, round(sqrt(CAST(sum(weight * weight) AS DOUBLE)), 6) AS norm FROM cells GROUP BY doc_id",
        "pairwise_cosine_topk": f"""WITH {_HASH}, norms AS (SELECT doc_id, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM cells GROUP BY doc_id), u AS (SELECT doc_id, bucket, weight / norm AS w FROM cells JOIN norms USING (doc_id) WHERE norm > 0),
dots AS (SELECT q.doc_id AS query_id, x.doc_id, sum(q.w * x.w) AS s FROM u q JOIN u x USING (bucket) WHERE q.doc_id % 20 = 0 AND q.doc_id <> x.doc_id GROUP BY ALL),
alike AS (SELECT q.doc_id AS query_id, x.doc_id, round(coalesce(s, 0), 12) + 0.0 AS s FROM documents q CROSS JOIN documents x LEFT JOIN dots ON dots.query_id = q.doc_id AND dots.doc_id = x.doc_id WHERE q.doc_id % 20 = 0 AND q.doc_id <> x.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM alike) SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(s, 9) AS score FROM r WHERE rank <= 5""",
        "nearest_centroid_embeddings": f"WITH {_NEAR} SELECT cluster, count(*) AS n FROM best WHERE k = 1 GROUP BY cluster",
        "farthest_examples": f"WITH {_NEAR} SELECT vec_id, cluster, round(1 - s, 6) AS distance FROM best WHERE k = 1 ORDER BY 1 - s DESC, vec_id LIMIT 5",
        "calibration_rows": f"WITH {_CAL} SELECT * FROM bin",
        "cohens_kappa": f"""WITH {_CAL}, s AS (SELECT count(*) AS n, avg(CAST(h = j AS INTEGER)) AS po, avg(h) AS pa, avg(j) AS pb FROM bin), e AS (SELECT n, po, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s),
k AS (SELECT n, po, CASE WHEN pe = 1 THEN 0 ELSE (po - pe) / (1 - pe) END AS kappa FROM e)
SELECT n, round(po, 6) AS agreement, round(kappa, 6) AS kappa, CASE WHEN kappa < 0 THEN 'worse than chance' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS label FROM k""",
        "pearson_r": f"WITH {_CAL}, c AS (SELECT count(*) AS n, corr(human, judge) AS r FROM cal) SELECT n, round(r, 6) AS r, CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very strong' END AS label FROM c",
        "runs_list": f"WITH {_RUNS} SELECT * FROM runs WHERE suite = 'click' ORDER BY started_at DESC, run_id DESC LIMIT 20",
        "latest_run_per_suite": f"WITH {_RUNS} SELECT suite, max_by(run_id, started_at || run_id) AS run_id FROM runs GROUP BY suite",
        "prior_run": f"WITH {_RUNS} SELECT suite, run_id, lag(run_id) OVER (PARTITION BY suite ORDER BY started_at, run_id) AS prior_run_id FROM runs",
        "run_diff": f"WITH {_DIFF} SELECT * FROM diff",
        "tag_filter": "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'",
        "tag_inventory": "SELECT lang AS tag FROM documents UNION SELECT source FROM documents",
        "tag_histogram": "SELECT tag, count(*) AS count FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) GROUP BY tag",
        "validate_outcomes": f"WITH {_VALID} SELECT line_no, code FROM v",
        "embedding_drift": _drift_sql(_CLUSTER_HIST, "embedding"),
        "kmeans_clusters": f"WITH {_KMEANS} SELECT doc_id, side, cluster, distance FROM clusters",
        "drift_report": " UNION ALL ".join([_axis_sql("length", length, "length(text)"), _axis_sql("embedding", _CLUSTER_HIST, "CAST(NULL AS DOUBLE)"), _axis_sql("judge", judge, _JUDGE)]),
        "run_diff_summary": f"WITH {_DIFF} SELECT suite, run_id, round(mean_score, 9) AS mean_score_current, round(prior_mean, 9) AS mean_score_baseline, round(mean_score - prior_mean, 9) AS mean_delta, sums.* EXCLUDE (suite, run_id) FROM pair JOIN sums USING (suite, run_id)",
        "regressed_ids": f"WITH {_DIFF} SELECT suite, run_id, example_id FROM diff WHERE flagged",
        "runs_with_rows": f"WITH {_RUNS} SELECT runs.*, rw.example_id, rw.score FROM runs JOIN rw ON rw.run_id = runs.run_id",
        "suite_run": f"WITH {_SUITE} SELECT conv_id, turn, score, reasoning FROM su",
        "suite_mean": f"WITH {_SUITE} SELECT count(*) AS n_rows, round(avg(score), 6) AS mean_score FROM su",
        "stream_drift": f"""WITH e AS (SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS window_start, event_type = 'view' AS golden, least(9, CAST(floor(least(1.0, value / 100) * 10) AS INTEGER)) AS bucket FROM events),
g AS (SELECT b.range AS bucket, count(e.bucket) AS n FROM range(10) b LEFT JOIN e ON golden AND e.bucket = b.range GROUP BY ALL), w AS (SELECT DISTINCT window_start FROM e WHERE NOT golden),
k AS (SELECT window_start, bucket, count(*) AS n FROM e WHERE NOT golden GROUP BY ALL), c AS (SELECT w.window_start, b.range AS bucket, coalesce(k.n, 0) AS n FROM w CROSS JOIN range(10) b LEFT JOIN k ON k.window_start = w.window_start AND k.bucket = b.range),
p AS (SELECT c.window_start, c.bucket, c.n, g.n / (SELECT sum(n) FROM g) AS p, c.n / sum(c.n) OVER (PARTITION BY c.window_start) AS q FROM c JOIN g USING (bucket)),
t AS (SELECT window_start, CAST(sum(n) AS BIGINT) AS n, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bucket) AS counts, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS v FROM p GROUP BY ALL)
SELECT window_start, n, counts, round(least(1, greatest(0, v)), 6) AS drift_score, CASE WHEN v > 0.1 THEN 'drifted' ELSE 'ok' END AS status FROM t""",
        "match_outputs": f"""WITH {_ASKED}, tok AS (SELECT conv_id, turn, 0 AS side, unnest(regexp_extract_all(lower(input), '[\\p{{L}}\\p{{N}}]+')) AS token FROM ask UNION ALL SELECT conv_id, turn, 1, unnest(regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}]+')) FROM ask),
m AS (SELECT conv_id, turn, side, CAST(concat('0x', right(sha1(token), 2)) AS INTEGER) % 128 AS m FROM tok), cells AS (SELECT conv_id, turn, side, m % 64 AS bucket, sum(CASE WHEN m >= 64 THEN 1 ELSE -1 END) AS weight FROM m GROUP BY ALL),
norms AS (SELECT conv_id, turn, side, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM cells GROUP BY ALL), dots AS (SELECT a.conv_id, a.turn, sum(a.weight * b.weight) AS dot FROM cells a JOIN cells b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.bucket = b.bucket AND a.side = 0 AND b.side = 1 GROUP BY ALL),
sims AS (SELECT d.conv_id, d.turn, round(CAST(dot AS DOUBLE) / a.norm / b.norm, 12) AS sim FROM dots d JOIN norms a ON a.conv_id = d.conv_id AND a.turn = d.turn AND a.side = 0 JOIN norms b ON b.conv_id = d.conv_id AND b.turn = d.turn AND b.side = 1),
hits AS (SELECT ask.conv_id, ask.turn, [CASE WHEN ask.conv_id % 3 = 0 OR lower(trim(answer)) = 'nothing' THEN 0 END, CASE WHEN regexp_matches(answer, regexp_replace(lower(substr(input, 1, 3)), '[^a-z]', '', 'g') || '[a-z]+e ') THEN 1 END, CASE WHEN sim >= 0.5 THEN 2 END] AS h FROM ask LEFT JOIN sims USING (conv_id, turn))
SELECT conv_id, turn, len(list_filter(h, lambda x: x IS NOT NULL)) > 0 AS matched, coalesce(array_to_string(list_filter(h, lambda x: x IS NOT NULL), ','), '') AS met FROM hits""",
        "ledger_run": f"WITH {_SUITE}, sr AS (SELECT su.*, w.input, w.answer FROM su JOIN wc w USING (conv_id, turn)) SELECT count(*) AS n_rows, round(avg(score), 6) AS mean_score, count(DISTINCT (input, answer)) AS n_asked FROM sr",
        "validate_summary": f"WITH {_VALID} SELECT FALSE AS ok, count(*) AS n_rows, count_if(code = 'valid')::BIGINT AS n_valid, count_if(code <> 'valid')::BIGINT AS n_findings, 'v1' AS dataset_version FROM v",
        "validate_findings": f"""WITH {_VALID} SELECT line_no, code, CASE (line_no - 1) % 10 WHEN 1 THEN 'blank line; dataset must have one JSON object per line' WHEN 2 THEN 'invalid JSON: Expecting property name enclosed in double quotes'
  WHEN 5 THEN 'dataset_version ''v2'' does not match file version ''v1''' WHEN 7 THEN 'duplicate id ''d' || (line_no - 2) || '''; first seen at line ' || (line_no - 1) || '; ids must be unique within a file'
  ELSE CASE ((line_no - 1) // 10) % {len(_BROKEN)} {_BROKEN_SQL} END END AS reason FROM v WHERE code <> 'valid'""",
        "files_summary": f"WITH {_FILES} SELECT file, count(*) = count_if(code = 'valid') AS ok, count(*) AS n_rows, count_if(code = 'valid')::BIGINT AS n_valid, count_if(code <> 'valid')::BIGINT AS n_findings, 'v-' || any_value(source) AS dataset_version FROM fv GROUP BY file",
        "files_findings": f"""WITH {_FILES} SELECT file, line_no, code, CASE pos % 10 WHEN 1 THEN 'blank line; dataset must have one JSON object per line' WHEN 5 THEN 'dataset_version ''other'' does not match file version ''v-' || source || ''''
  WHEN 7 THEN 'duplicate id ''p' || (pos - 1) || '''; first seen at line ' || pos || '; ids must be unique within a file' ELSE CASE (pos // 10) % {len(_BROKEN)} {_BROKEN_SQL} END END AS reason FROM fv WHERE code <> 'valid'""",
        "files_tags": f"WITH {_FILES} SELECT file, lang AS tag, count(*) AS count FROM fv WHERE code = 'valid' GROUP BY ALL",
        "valid_tags": f"WITH {_VALID} SELECT tag, count(*) AS count FROM (SELECT lang AS tag FROM v WHERE code = 'valid' UNION ALL SELECT source FROM v WHERE code = 'valid') GROUP BY tag",
        "judge_parse": _said_sql(),
        "judge_overlap": f"WITH {_OVERLAP} SELECT doc_id, judge_score FROM ov",
        "calibration_run": f"""WITH {_OVERLAP}, b AS (SELECT *, CAST(human_score >= 0.5 AS INTEGER) AS h, CAST(judge_score >= 0.5 AS INTEGER) AS j FROM ov), s AS (SELECT count(*) AS n, avg(CAST(h = j AS INTEGER)) AS po, avg(h) AS pa, avg(j) AS pb,
  CASE WHEN var_pop(human_score) * var_pop(judge_score) = 0 THEN 0 ELSE covar_pop(human_score, judge_score) / sqrt(var_pop(human_score) * var_pop(judge_score)) END AS r FROM b), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s),
k AS (SELECT *, CASE WHEN pe = 1 THEN 0 ELSE (po - pe) / (1 - pe) END AS kappa FROM e)
SELECT n, round(po, 6) AS agreement, round(kappa, 6) AS kappa, {_KAPPA_LABEL} AS kappa_label, round(r, 6) AS r, {_R_LABEL} AS r_label, CASE WHEN kappa >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS status FROM k""",
        "length_judge": "SELECT doc_id, round(greatest(0.0, least(1.0, 1 - length(text) / 200.0::DOUBLE)), 6) AS score FROM documents",
        "needle_judge": f"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN contains(m, 'the') THEN 0.25::DOUBLE WHEN contains(m, 'an') THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS score FROM (SELECT *, concat('RUBRIC: r', chr(10), chr(10), 'PROMPT: ', input, chr(10), chr(10), 'RESPONSE: ', answer, chr(10)) AS m FROM ask)",
        "diff_markdown": f"WITH {_DIFF} SELECT suite, run_id, example_id, '| ' || status || ' | `' || example_id || '` | ' || coalesce(printf('%.3f', baseline_score), '—') || ' | ' || coalesce(printf('%.3f', current_score), '—') || ' | ' || coalesce(printf('%+.3f', delta), '—') || ' | ' || CASE WHEN flagged THEN ':warning:' ELSE '' END || ' |' AS line FROM diff",
        "diff_headline": f"WITH {_DIFF} SELECT suite, run_id, CASE WHEN n_flagged > 0 THEN '[X]' WHEN n_regressed > 0 THEN '[!]' WHEN n_improved > 0 THEN '[+]' ELSE '[=]' END || ' mean Δ **' || printf('%+.3f', round(mean_score - prior_mean, 9)) || '** · flagged **' || n_flagged || '** · regressed ' || n_regressed || ' · improved ' || n_improved || ' · unchanged ' || n_unchanged || ' · new ' || n_new || ' · removed ' || n_removed AS line FROM sums JOIN pair USING (suite, run_id)",
    }
