"""Golden sets, calibration sets and text populations from JSON-lines files, and golden sets back to files."""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors.exceptions.captured import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions import text as T
from scorelake.operators import drift, validate
from scorelake.operators.judging import tagged
from scorelake.operators.ordinals import numbered
from scorelake.sources import history, scratch, workers

GOLDEN = "id string, input string, expected_outputs array<struct<kind:string,value:string>>, dataset_version string, provenance string, tags array<string>"
CALIBRATION = "id string, prompt string, response string, rubric string, human_score double, provenance string"
#: Keys of a text population's objects; the first one that holds a string counts.
TEXT_KEYS = ("input", "prompt", "text")
_RUN = pa.schema(
    [(n, pa.int64() if n == "n_rows" else pa.float64() if n in ("judge_kappa", "mean_score") else pa.string()) for n in (c.split()[0] for c in history.RUNS.split(", "))]
    + [("rows", pa.list_(pa.struct([("example_id", pa.string()), ("score", pa.float64()), ("reasoning", pa.string())])))]
)


class LoadError(ValueError):
    """A file's first bad line; line 0 stands for the file as a whole."""

    def __init__(self, line_no: int, reason: str):
        super().__init__(f"line {line_no}: {reason}")
        self.line_no, self.reason = line_no, reason


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line), numbered from 1 in each file, blank lines included.

    Files are split as Spark likes: lines are numbered within a split, and the sizes of the splits before it (one row
    a split) are added.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    within = Window.partitionBy("file", "block").orderBy("at")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = raw.withColumn("k", F.row_number().over(within)).join(sizes, ["file", "block"])
    return rows.select("file", (F.col("before") + F.col("k")).alias("line_no"), "line")


def _first_bad(outcomes: DataFrame) -> None:
    bad = outcomes.where("code <> 'valid'").orderBy("line_no").select("line_no", F.coalesce("reason", "code").alias("reason")).first()
    if bad is not None:
        raise LoadError(bad["line_no"], bad["reason"])


def _one_file(lines: DataFrame) -> DataFrame:
    """A data set is one file; two are an error, as their lines' numbers would mix."""
    files = [r["file"] for r in lines.select("file").distinct().limit(2).collect()]
    if len(files) > 1:
        raise LoadError(0, f"more than one file: {sorted(files)}")
    return lines.drop("file")


def validate_files(spark: SparkSession, path: str, what: str = "dataset") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, findings, tag counts), with the file in each row, of all files below a path in one job; ``what``:
    'dataset' or 'calibration'. Each file is a set by itself: its version, its ids, its line numbers; one without lines is
    a finding."""
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")  # the listing that a reader makes; scans leave empty files out
    plain = F.regexp_replace("file", "^file:/+", "file:/")  # the two write it in different ways
    outcomes = {"dataset": validate.outcomes, "calibration": validate.calibration_outcomes}[what]
    return validate.report(outcomes(numbered_lines(spark, path).withColumn("file", plain)), files.select(plain.alias("file")), what)


def load_golden(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """One file's examples with line_no. The first bad line raises, as does a file without lines, or tags that none has."""
    lines = _one_file(numbered_lines(spark, path))
    _first_bad(validate.outcomes(lines))
    rows = lines.select("line_no", F.from_json(T.stripped(F.col("line")), GOLDEN).alias("r")).select("line_no", "r.*").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    if rows.isEmpty():
        raise LoadError(0, "no rows in file")
    return tagged(rows, tags)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """One file's calibration rows with line_no; the first bad line raises, a file without lines gives no rows."""
    lines = _one_file(numbered_lines(spark, path))
    _first_bad(validate.calibration_outcomes(lines, validate.CALIBRATION_AS_LOADED))
    return lines.select("line_no", F.from_json("line", CALIBRATION).alias("r")).select("line_no", "r.*")


def _texts_of(file: str, n: int, line: str) -> Iterator[str]:
    """The texts of a line of a file; Unicode's other line ends part it again."""
    for part in line.splitlines():
        part = part.strip()
        if not part:
            continue
        try:
            value = json.loads(part)
        except ValueError as e:
            raise ValueError(f"{file}:{n}: invalid JSON: {e}") from e
        if isinstance(value, dict):
            value = next((value[k] for k in TEXT_KEYS if isinstance(value.get(k), str)), None)
        if not isinstance(value, str):
            raise ValueError(f"{file}:{n}: neither a string nor an object with one of {TEXT_KEYS}")
        yield value


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, part, text) of a text population: JSON strings or objects, blank lines skipped; other lines fail the
    job, a file without texts is an error. ``part`` tells texts apart that only Unicode's other line ends part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(f, n, k, t) for f, n, line in zip(*(b.column(c).to_pylist() for c in ("file", "line_no", "line")), strict=True) for k, t in enumerate(_texts_of(f, n, line))]
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "ord", "part", "text"])

    rows = numbered_lines(spark, path).mapInArrow(run, "file string, ord long, part int, text string")
    if rows.isEmpty():
        raise ValueError(f"{path}: no texts")
    return rows


def load_sides(spark: SparkSession, golden: str, candidate: str, order: str = "number") -> DataFrame:
    """(side, order, text) of two text populations, as ``drift.report`` takes them: each side's texts are numbered 0, 1, 2
    ... by file, line and part, whatever the number of files and splits."""
    rows = load_texts(spark, golden).withColumn("side", F.lit(drift.GOLDEN)).unionByName(load_texts(spark, candidate).withColumn("side", F.lit(drift.CANDIDATE)))
    return numbered(rows, ["side"], ["file", "ord", "part"], order).select("side", order, "text")


def _finite(value: object, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float | str) or not math.isfinite(float(value)):
        raise ValueError(f"{name} must be a finite number; got {value!r}")
    return float(value)


def _named(value: object, name: str) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} must be a non-empty string; got {value!r}")
    return value


def _run_of(text: str) -> dict:
    """The run that a JSON text holds, as a row of ``_RUN``."""
    r = json.loads(text)
    if not isinstance(r, dict) or not isinstance(r.get("rows", []), list):
        raise ValueError("a run is a JSON object whose rows are an array")
    rows = []
    for x in r.get("rows", []):
        if not isinstance(x, dict):
            raise ValueError(f"a run's row must be a JSON object; got {x!r}")
        rows.append({"example_id": _named(x.get("example_id"), "example_id"), "score": _finite(x.get("score"), "score"), "reasoning": str(x.get("reasoning", ""))})
    commonest = Counter(x["example_id"] for x in rows).most_common(1)
    if commonest and commonest[0][1] > 1:
        raise ValueError(f"example_id {commonest[0][0]!r} comes more than once")
    if int(_finite(r.get("n_rows", len(rows)), "n_rows")) != len(rows):
        raise ValueError(f"n_rows is {r['n_rows']}, but there are {len(rows)} rows")
    kappa = r.get("judge_kappa")
    return {n: _named(r.get(n), n) for n in ("run_id", "started_at", "suite")} | {
        "dataset_version": r.get("dataset_version", ""), "judge_model": r.get("judge_model"), "judge_kappa": kappa if kappa is None else _finite(kappa, "judge_kappa"),
        "mean_score": _finite(r.get("mean_score"), "mean_score"), "n_rows": len(rows), "git_sha": r.get("git_sha"), "rows": rows,
    }


def parsed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason, the columns of ``history.RUNS``, rows) of runs' JSON files, one object a file, written down. reason
    tells why a file holds no run, else it is null: an object must have a filled run_id, started_at and suite, a finite
    mean_score, and rows of a filled, unrepeated example_id and a finite score; n_rows must agree if it is there."""
    schema = pa.schema([("file", pa.string()), ("reason", pa.string()), *_RUN])
    workers.importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):  # a file's rows at a time
                try:
                    found = pa.RecordBatch.from_pylist([{"file": file} | _run_of(text)], schema=schema)
                except (ValueError, TypeError, pa.ArrowInvalid) as e:
                    found = pa.RecordBatch.from_pylist([{"file": file, "reason": f"{type(e).__name__}: {e}"}], schema=schema)
                yield found

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return scratch.written(text.mapInArrow(run, f"file string, reason string, {history.RUNS}, rows array<struct<example_id:string,score:double,reasoning:string>>"), "runs")


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(their rows of runs, their rows) of runs' JSON files, as ``runs.diff_runs`` takes them; a file that holds no run
    (``parsed_runs``) is an error with its reason."""
    made = parsed_runs(spark, path)
    bad = made.where("reason is not null").orderBy("file").select("file", "reason").first()
    if bad is not None:
        raise ValueError(f"{bad['file']}: {bad['reason']}")
    made = made.drop("file", "reason")
    return made.drop("rows"), made.select("run_id", F.explode("rows").alias("r")).select("r.*", "run_id")


def append_folder(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Check and append all runs of a folder's JSON files to the history below ``base`` in one job and one commit:
    (file, run_id, reason), reason null for what was appended."""
    return history.append_runs(parsed_runs(spark, path), base)


def canonical(rows: DataFrame) -> DataFrame:
    """(line_no, value): examples as JSON with sorted keys and no spaces; empty tags are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                r["provenance"] = json.loads(r["provenance"] or "{}")
                r = {k: v for k, v in r.items() if k != "line_no" and (k != "tags" or v)}
                out.append(json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([b.column("line_no"), pa.array(out, pa.string())], names=["line_no", "value"])

    names = ["id", "input", "expected_outputs", "dataset_version", "provenance", "tags"]
    return rows.select(F.col("line_no").cast("long").alias("line_no"), *names).mapInArrow(run, "line_no long, value string")


def write_golden(rows: DataFrame, path: str) -> None:
    """Canonical lines as text files in ``path``, in order of line_no over the part files."""
    canonical(rows).orderBy("line_no").select("value").write.text(path)


def write_golden_file(rows: DataFrame, path: str) -> None:
    """Canonical lines as one file, in order of line_no; an existing one is replaced when the new one is whole.

    The lines are sorted and written in parts beside it. Where the file system can concatenate files, as HDFS, the parts
    become the file without being read; elsewhere their bytes are copied one after another, a buffer at a time.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    whole = jvm.org.apache.hadoop.fs.Path(folder, "whole")
    try:
        write_golden(rows, folder.toString())
        parts = sorted((f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen() > 0), key=str)
        files.create(whole, False).close()
        try:
            listed = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
            for i, part in enumerate(parts):
                listed[i] = part
            if parts:
                files.concat(whole, listed)
        except UnsupportedOperationException:
            out = files.create(whole, True)
            for part in parts:
                held = files.open(part)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
                held.close()
            out.close()
        files.delete(target, True)
        if not files.rename(whole, target):
            raise OSError(f"could not put {path} in its place")
    finally:
        files.delete(folder, True)
