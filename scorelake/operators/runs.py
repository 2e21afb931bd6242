"""Run history, regression diff and judge agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import text as T

DROP = 0.1
STATUSES = ("regressed", "improved", "unchanged", "new", "removed")


def recent(runs: DataFrame, suite: str | None = None, limit: int = 20) -> DataFrame:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit must be a positive integer")
    rows = runs.where(F.col("suite") == suite) if suite is not None else runs
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def latest_per_suite(runs: DataFrame, exclude: str | None = None) -> DataFrame:
    """(suite, run_id): the latest run of each suite, ``exclude`` left out."""
    rows = runs if exclude is None else runs.where(F.col("run_id") != exclude)
    return rows.groupBy("suite").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def with_prior(runs: DataFrame) -> DataFrame:
    """Each run with the one before it in its suite."""
    return runs.withColumn("prior_run_id", F.lag("run_id").over(Window.partitionBy("suite").orderBy("started_at", "run_id")))


def baseline_id(runs: DataFrame, suite: str, run_id: str | None = None, exclude: str | None = None) -> str | None:
    """The run to compare with: the named one (KeyError if unknown), else the suite's latest but ``exclude``, else None."""
    if run_id is not None:
        if runs.where(F.col("run_id") == run_id).isEmpty():
            raise KeyError(run_id)
        return run_id
    latest = latest_per_suite(runs.where(F.col("suite") == suite), exclude).first()
    return latest["run_id"] if latest is not None else None


def with_rows(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each run's row beside its rows."""
    return runs.join(rows, "run_id")


def checked_threshold(value: object, name: str, most: float = float("inf"), least: float = 0.0) -> float:
    """A finite number within the bounds; a bool is none."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not least <= value <= most or value == float("inf"):
        raise ValueError(f"{name} must be a finite number within [{least}, {most}]; got {value!r}")
    return float(value)


def status(delta: Column) -> Column:
    return F.when(delta < 0, "regressed").when(delta > 0, "improved").otherwise("unchanged")


def diff(current: DataFrame, baseline: DataFrame, threshold: float = DROP, by: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of two sides' rows (*by, example_id, score): one row an example with its status and flag. ``by``
    lets one job compare many pairs of runs. A score that is null or not finite fails the job."""
    checked_threshold(threshold, "threshold_drop")
    keys = [*by, "example_id"]
    cur = current.select(*keys, T.finite(F.col("score"), "score").alias("current_score"), F.lit(True).alias("_c"))
    base = baseline.select(*keys, T.finite(F.col("score"), "score").alias("baseline_score"), F.lit(True).alias("_b"))
    delta = F.col("current_score") - F.col("baseline_score")
    both = cur.join(base, keys, "full_outer").withColumn("delta", delta)
    named = F.when(F.col("_b").isNull(), "new").when(F.col("_c").isNull(), "removed").otherwise(status(F.col("delta")))
    return both.select(*keys, "baseline_score", "current_score", "delta", named.alias("status"), F.coalesce(F.col("delta") < -threshold, F.lit(False)).alias("flagged"))


def summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a diff's statuses and flags."""
    return rows.groupBy(*by).agg(F.count_if("flagged").alias("n_flagged"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES))


def with_means(counts: DataFrame, current: DataFrame, baseline: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``summary`` with the means stored with the runs, (*by, mean_score) on each side, and their difference: nothing is
    averaged anew."""
    cur = current.select(*by, T.finite(F.col("mean_score"), "mean_score").alias("mean_score_current"))
    base = baseline.select(*by, T.finite(F.col("mean_score"), "mean_score").alias("mean_score_baseline"))
    both = cur.join(base, [*by]).withColumn("mean_delta", F.col("mean_score_current") - F.col("mean_score_baseline"))
    return both.join(counts, [*by], "left").na.fill(0)


def diff_runs(current: tuple[DataFrame, DataFrame], baseline: tuple[DataFrame, DataFrame], threshold: float = DROP) -> tuple[DataFrame, DataFrame]:
    """(rows by example_id, one-row summary) for two runs as (its row of runs, its rows); of different suites: an error."""
    suites = [side[0].select("suite", "run_id").first() for side in (current, baseline)]
    if suites[0]["suite"] != suites[1]["suite"]:
        raise ValueError(f"runs of different suites: {suites[0]['suite']} and {suites[1]['suite']}")
    rows = diff(current[1], baseline[1], threshold)
    one = F.lit(suites[0]["suite"]).alias("suite")
    sides = [side[0].select(one, "mean_score") for side in (current, baseline)]
    return rows.orderBy("example_id"), with_means(summary(rows.withColumn("suite", one), ("suite",)), *sides, ("suite",)).drop("suite")


def binarize(score: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on, else 0; a score outside [0, 1] fails the job."""
    checked_threshold(threshold, "threshold", 1.0)
    score = T.finite(score.cast("double"), "score")
    return F.when((score < 0) | (score > 1), F.raise_error(F.concat(F.lit("score must be in [0, 1]; got "), score.cast("string")))).otherwise((score >= threshold).cast("int"))


def cohens_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agreement, kappa) for two 0/1 columns; chance agreement of 1 gives 0; no rows are an error."""
    s = rows.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("po"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(F.col("n") == 0, F.raise_error(F.lit("no rows to compare"))).when(pe == 1, 0.0).otherwise(F.try_divide(F.col("po") - pe, 1 - pe))
    return s.select("n", F.col("po").alias("agreement"), kappa.alias("kappa"))


def pearson_r(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, r); zero variance gives 0; no rows, or a value that is null or not finite, are an error."""
    x, y = (T.finite(F.col(c).cast("double"), c) for c in (a, b))
    s = rows.select(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), (F.var_pop("x") * F.var_pop("y")).alias("v"), F.covar_pop("x", "y").alias("c"))
    r = F.when(F.col("n") == 0, F.raise_error(F.lit("no rows to compare"))).when(F.col("v") == 0, 0.0).otherwise(F.try_divide("c", F.sqrt("v")))
    return s.select("n", r.alias("r"))


def kappa_label(k: Column) -> Column:
    return F.when(k < 0, "worse than chance").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")


def pearson_label(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate").when(a < 0.7, "strong").otherwise("very strong")
