"""Judging texts: answers, what the judge is asked, the judge in Arrow batches, suite runs and calibration."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scorelake.functions import text as T
from scorelake.operators import runs
from scorelake.sources import history, scratch

SYSTEM = "Judge the response by the rubric. Reply with two lines only:\nSCORE: <a number from 0 to 1>\nREASONING: <one sentence>\n"
RUBRIC = "Score 1 if the response is a correct and complete answer to the prompt, 0 if it is wrong or unsupported."


class Backend(Protocol):
    """Answers a judge's question with a text that holds a SCORE and a REASONING line."""

    def complete(self, system: str, user: str) -> str: ...


@dataclass(frozen=True)
class ByColumn:
    """A judge that is a column expression of what is asked."""

    of: Callable[[Column], Column]


def echo() -> Column:
    """The answer that a data set gives itself: the first expected output, '' if there is none."""
    return F.coalesce(F.try_element_at(F.col("expected_outputs"), F.lit(1))["value"], F.lit(""))


def with_answers(examples: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``examples`` with a column answer: from a table (id, answer), whose ids must cover the examples, or echoed."""
    if answers is None:
        return examples.withColumn("answer", echo())
    both = examples.join(answers.select("id", F.col("answer").alias("_given")), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no answer for example "), F.col("id")))
    return both.withColumn("answer", F.when(F.col("_given").isNull(), missing).otherwise(F.col("_given"))).drop("_given")


def ask(rows: DataFrame, make: Callable[[], Backend], asked: str = "asked", name: str = "raw") -> DataFrame:
    """``rows`` with the backend's text for each question. A backend is made once a task. As a task may run again, write
    the rows down before they are used twice (``scratch.written``)."""
    schema = StructType([*rows.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        for b in batches:
            said = pa.array([backend.complete(SYSTEM, q) for q in b.column(asked).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, said], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Ledger:
    """A folder of a judge's answers by what was asked. ``judge`` names who answers: another judge's are not taken."""

    folder: str
    judge: str
    #: A broken job loses the answers of one block at most; a power of two up to 256.
    blocks: int = 16

    def key(self, asked: Column) -> Column:
        return F.sha2(F.to_json(F.struct(F.lit(self.judge), F.lit(SYSTEM), asked)), 256)

    def answers(self, spark: SparkSession) -> DataFrame:
        """(key, raw), one answer a question: the least, if two writers asked at the same time."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        rows = spark.read.schema("key string, raw string").parquet(self.folder) if there else spark.createDataFrame([], "key string, raw string")
        return rows.groupBy("key").agg(F.min("raw").alias("raw"))


def ask_once(rows: DataFrame, make: Callable[[], Backend], ledger: Ledger, asked: str = "asked", name: str = "raw") -> DataFrame:
    """``rows`` with the backend's text for each question, as ``ask``, but what the ledger holds is not asked again, and
    what rows share is asked once. Answers are stored block by block, so a job that breaks resumes where it was."""
    spark = rows.sparkSession
    key = next(f"_key{i}" for i in range(len(rows.columns) + 1) if f"_key{i}" not in rows.columns)
    rows = rows.withColumn(key, ledger.key(F.col(asked)))
    questions = rows.groupBy(F.col(key).alias("key")).agg(F.any_value(asked).alias("asked"))
    open_ = scratch.written(questions.join(ledger.answers(spark), "key", "left_anti"), "questions")
    block = (F.conv(F.substring("key", 1, 2), 16, 10).cast("int") % ledger.blocks).alias("block")
    for at in sorted(r["block"] for r in open_.select(block).distinct().collect()):  # as many as blocks
        ask(open_.where(block == at), make).select("key", "raw").write.mode("append").parquet(ledger.folder)
    return rows.join(ledger.answers(spark).select(F.col("key").alias(key), F.col("raw").alias(name)), key).drop(key)


#: Statuses after which a question may be asked again.
TRANSIENT = frozenset({408, 409, 429, 500, 502, 503, 504, 529})


@dataclass
class Patient:
    """A backend that asks again after a transient failure: a status of ``TRANSIENT``, a lost connection or a timeout. It
    waits twice as long each time, up to ``most`` seconds."""

    backend: Backend
    tries: int = 4
    first: float = 0.5
    most: float = 8.0
    sleep: Callable[[float], None] = time.sleep

    def complete(self, system: str, user: str) -> str:
        for n in range(1, self.tries + 1):
            try:
                return self.backend.complete(system, user)
            except Exception as e:
                passing = getattr(e, "status_code", None) in TRANSIENT or isinstance(e, ConnectionError | TimeoutError)
                if not passing or n == self.tries:
                    raise
                self.sleep(min(self.most, self.first * 2 ** (n - 1)))
        raise ValueError("tries must be at least 1")


def score(rows: DataFrame, prompt: Column, response: Column, rubric: Column, judge: Callable[[], Backend] | ByColumn, ledger: Ledger | None = None) -> DataFrame:
    """``rows`` with score and reasoning ('' where a column judges). A text without a SCORE or REASONING line, or a score
    that is not finite, fails the job. With a ledger a question is asked once, in this job and in later ones."""
    asked = rows.withColumn("asked", T.judge_prompt(rubric, prompt, response))
    if isinstance(judge, ByColumn):
        return asked.withColumns({"score": T.clamp01(judge.of(F.col("asked"))), "reasoning": F.lit("")}).drop("asked")
    out = (ask(asked, judge) if ledger is None else ask_once(asked, judge, ledger)).withColumn("_v", T.judged(F.col("raw")))
    return out.withColumns({"score": F.col("_v.score"), "reasoning": F.col("_v.reasoning")}).drop("_v", "raw", "asked")


def tagged(examples: DataFrame, tags: list[str] | None) -> DataFrame:
    """Examples with any of the tags, all without tags; if none has them, the error names those that exist."""
    if not tags:
        return examples
    some = examples.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if some.isEmpty():
        there = [r["tag"] for r in examples.select(F.explode("tags").alias("tag")).distinct().orderBy("tag").limit(1000).collect()]  # for the message
        raise ValueError(f"no example has any of the tags {sorted(tags)}; there are {there}")
    return some


def score_suite(examples: DataFrame, judge, tags: list[str] | None = None, answers: DataFrame | None = None, rubric: str = RUBRIC, ledger: Ledger | None = None) -> DataFrame:
    """(example_id, score, reasoning) of a data set's examples."""
    rows = with_answers(tagged(examples, tags), answers)
    return score(rows, F.col("input"), F.col("answer"), F.lit(rubric), judge, ledger).select(F.col("id").alias("example_id"), "score", "reasoning")


def run_suite(examples: DataFrame, judge, base: str, run_id: str, started_at: str, suite: str, tags: list[str] | None = None, answers: DataFrame | None = None, rubric: str = RUBRIC, ledger: Ledger | None = None, **about) -> tuple[DataFrame, DataFrame]:
    """Score a data set and append the run to the history below ``base``: (its row of runs, its rows). The judge is asked
    once: rows are stored, then checked and averaged as stored. With a ledger, a run that breaks and is begun anew asks
    only what has no answer yet."""
    version = examples.select("dataset_version").first()
    if version is None:
        raise ValueError("the data set is empty")
    history.write_run(score_suite(examples, judge, tags, answers, rubric, ledger), base, run_id, started_at, suite, version[0], **about)
    return history.read_run(examples.sparkSession, base, run_id)


def calibrate(rows: DataFrame, judge, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(judged rows, one row: n, kappa, kappa_label, r, r_label, status) of calibration rows, each judged by its own
    rubric. status is PASS from the threshold of kappa on. No rows are an error."""
    runs.checked_threshold(threshold, "threshold_kappa", 1.0, -1.0)
    own = rows.select("id", "prompt", "response", "rubric", "human_score")
    judged = scratch.written(score(own, F.col("prompt"), F.col("response"), F.col("rubric"), judge).withColumnRenamed("score", "judge_score"), "judged")
    judged = judged.withColumns({"human_class": runs.binarize(F.col("human_score")), "judge_class": runs.binarize(F.col("judge_score"))})
    kappa, r = runs.cohens_kappa(judged, "human_class", "judge_class"), runs.pearson_r(judged, "human_score", "judge_score")
    both = kappa.join(r, "n").select("n", "agreement", "kappa", runs.kappa_label(F.col("kappa")).alias("kappa_label"), "r", runs.pearson_label(F.col("r")).alias("r_label"))
    return judged, both.withColumn("status", F.when(F.col("kappa") >= threshold, "PASS").otherwise("FAIL"))
