"""Run history below one folder: runs/attempt=..., rows/attempt=..., and a log of the attempts that count.

What a writer has written is seen from the moment on in which its attempt is in the log, all of it at once; a job that
broke off, and the writer that was second with a run_id, leave nothing that a reader sees. Many runs are one attempt.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources import scratch
from scorelake.sources.commits import Log, new_attempt

RUNS = "run_id string, started_at string, dataset_version string, judge_model string, judge_kappa double, mean_score double, n_rows long, git_sha string, suite string"
ROWS = "example_id string, score double, reasoning string, run_id string"
_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def new_run_id() -> str:
    return uuid.uuid4().hex


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _of(spark: SparkSession, base: str, what: str, attempts: list[str]) -> DataFrame:
    """The runs or rows of committed attempts; the folders of others are not even listed."""
    schema = RUNS if what == "runs" else ROWS
    if not attempts:
        return spark.createDataFrame([], schema + ", attempt string")
    folders = [f"{base}/{what}/attempt={a}" for a in attempts]
    return spark.read.schema(schema + ", attempt string").option("basePath", f"{base}/{what}").parquet(*folders)


def runs(spark: SparkSession, base: str) -> DataFrame:
    """All runs; none where nothing was written."""
    return _of(spark, base, "runs", Log(spark, base).attempts()).drop("attempt")


def rows(spark: SparkSession, base: str) -> DataFrame:
    """The rows of all runs."""
    return _of(spark, base, "rows", Log(spark, base).attempts()).drop("attempt")


def _drop(spark: SparkSession, base: str, attempt: str) -> None:
    scratch.delete(spark, f"{base}/runs/attempt={attempt}", f"{base}/rows/attempt={attempt}")


def write_run(scored: DataFrame, base: str, run_id: str, started_at: str, suite: str, dataset_version: str, judge_model: str | None = None, judge_kappa: float | None = None, git_sha: str | None = None) -> None:
    """Append one run of (example_id, score, reasoning) rows. A known run_id, a repeated or null example_id, a score
    that is null or not finite, or no rows at all raise before the run is seen; of two writers of one run_id the second
    to commit raises."""
    spark = scored.sparkSession
    log, attempt = Log(spark, base), new_attempt()

    def is_new(attempts: list[str]) -> None:
        if not _of(spark, base, "runs", attempts).where(F.col("run_id") == run_id).isEmpty():
            raise ValueError(f"failed to persist run {run_id!r}: run_id exists")

    is_new(log.attempts())  # before a judge is asked
    try:
        # judged rows are stored once and checked as stored, so that a judge is not asked again
        scored.select("example_id", F.col("score").cast("double").alias("score"), "reasoning", F.lit(run_id).alias("run_id")).write.parquet(f"{base}/rows/attempt={attempt}")
        stored = _of(spark, base, "rows", [attempt])
        twice = stored.groupBy("example_id").count().where("count > 1 or example_id is null")
        odd = stored.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
        if not twice.isEmpty() or not odd.isEmpty():
            raise ValueError(f"failed to persist run {run_id!r}: repeated or null example_id, or a score that is no number")
        n, mean = stored.agg(F.count("*"), F.avg("score")).first()
        if not n:
            raise ValueError(f"failed to persist run {run_id!r}: no rows")
        one = spark.createDataFrame([(run_id, started_at, dataset_version, judge_model, judge_kappa, mean, n, git_sha, suite)], RUNS)
        one.write.parquet(f"{base}/runs/attempt={attempt}")
        log.commit(attempt, is_new)
    except BaseException:
        _drop(spark, base, attempt)
        raise


def append_runs(made: DataFrame, base: str) -> DataFrame:
    """Append many runs as one attempt: of (file, reason, the columns of ``RUNS``, rows) those without a reason, verdicts as
    (file, run_id, reason), null for what is committed.

    Of files with the same run_id the first by name counts; a run_id that is there already stays as it is. If another
    writer commits some of the runs meanwhile, these get a verdict and the rest is tried again.
    """
    spark = made.sparkSession
    log = Log(spark, base)
    good = made.where("reason is null")
    first = good.groupBy("run_id").agg(F.min("file").alias("_first"))
    judged = good.join(first, "run_id")
    while True:
        seen = log.attempts()
        known = _of(spark, base, "runs", seen).select("run_id", F.lit(True).alias("_known"))
        verdicts = judged.join(known, "run_id", "left").withColumn(
            "reason",
            F.when(F.col("_known"), F.concat(F.lit("failed to persist run \'"), "run_id", F.lit("\': run_id exists"))).when(F.col("file") != F.col("_first"), F.concat(F.lit("run_id is that of "), "_first")),
        )
        verdicts = scratch.written(verdicts.drop("_known", "_first"), "verdicts")
        fresh = verdicts.where("reason is null")
        attempt = new_attempt()
        try:
            if not fresh.isEmpty():
                fresh.select("run_id", F.explode("rows").alias("r")).select("r.*", "run_id").write.parquet(f"{base}/rows/attempt={attempt}")
                fresh.select(*_NAMES).write.parquet(f"{base}/runs/attempt={attempt}")

                def still_new(attempts: list[str]) -> None:
                    later = [a for a in attempts if a not in seen]
                    if later and not _of(spark, base, "runs", later).join(fresh, "run_id", "left_semi").isEmpty():
                        raise _Overtaken

                log.commit(attempt, still_new)
            bad = made.where("reason is not null").select("file", "run_id", "reason")
            return verdicts.select("file", "run_id", "reason").unionByName(bad)
        except _Overtaken:
            _drop(spark, base, attempt)
        except BaseException:
            _drop(spark, base, attempt)
            raise


class _Overtaken(Exception):
    pass


def read_run(spark: SparkSession, base: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """The run's row of runs, and its rows; an unknown run raises KeyError."""
    found = _of(spark, base, "runs", Log(spark, base).attempts()).where(F.col("run_id") == run_id)
    one = found.first()
    if one is None:
        raise KeyError(run_id)
    return found.drop("attempt"), _of(spark, base, "rows", [one["attempt"]]).where(F.col("run_id") == run_id).drop("attempt")
