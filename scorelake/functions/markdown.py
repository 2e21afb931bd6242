"""Markdown cells and report lines as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def table_cell(text: Column) -> Column:
    return one_line(F.replace(text, F.lit("|"), F.lit("\\|")))


def code_span(text: Column) -> Column:
    return F.concat(F.lit("`"), one_line(F.replace(text, F.lit("`"), F.lit("'"))), F.lit("`"))


def code_cell(text: Column) -> Column:
    return F.concat(F.lit("`"), table_cell(F.replace(text, F.lit("`"), F.lit("'"))), F.lit("`"))


def numbers(columns: dict[str, str]) -> Column:
    """A struct of the named columns written in the given formats, '—' for null: Python's formats, in one Arrow pass,
    as Java's round the shortest decimal form (0.8895 would differ)."""
    names = [*columns]

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def shown(*values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: ["—" if v != v else columns[n] % v for v in x.astype(float).tolist()] for n, x in zip(names, values, strict=True)})

    return shown(*(F.col(n) for n in names))


def diff_rows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, example_id, line): a table row for each row of a diff; order by example_id to print."""
    rows = rows.withColumn("_n", numbers({"baseline_score": "%.3f", "current_score": "%.3f", "delta": "%+.3f"}))
    cells = [table_cell(F.col("status")), code_cell(F.col("example_id")), F.col("_n.baseline_score"), F.col("_n.current_score"), F.col("_n.delta"), F.when(F.col("flagged"), ":warning:").otherwise("")]
    return rows.select(*by, "example_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def headline(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, line): the mark of the worst that a diff's summary (``runs.with_means``) holds, its mean's change and its
    counts."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    mark = F.when(count("n_flagged") > 0, "[X]").when(count("n_regressed") > 0, "[!]").when(count("n_improved") > 0, "[+]").otherwise("[=]")
    form = "%s mean Δ **%s** · flagged **%d** · regressed %d · improved %d · unchanged %d · new %d · removed %d"
    shown = summary.withColumn("_n", numbers({"mean_delta": "%+.3f"}))
    return shown.select(*by, F.format_string(form, mark, F.col("_n.mean_delta"), *map(count, ("n_flagged", "n_regressed", "n_improved", "n_unchanged", "n_new", "n_removed"))).alias("line"))
