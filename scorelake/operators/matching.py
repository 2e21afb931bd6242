"""Do answers meet what is expected of them? An extension: data sets name kinds of expected outputs, and this compares.

An answer passes if any of its expected outputs does: 'exact' if both are equal after stripping white space and folding
case, a sharp s as ss; 'regex' if the expression, which may differ by row, is found in it; 'semantic' if the hashed embeddings' cosine is
at least a threshold. Embeddings are made of the rows with semantic outputs only, and each text's once a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scorelake.functions import hashed
from scorelake.functions import text as T
from scorelake.operators.runs import checked_threshold
from scorelake.sources import workers

SEMANTIC = 0.8


def _folded(text: Column) -> Column:
    """Equal for texts that differ in case only. Some letters' capitals are several letters or another's (a sharp s, a
    dotless i), so lower case alone does not tell. Lower case of capitals stands for lower case alone to Spark's optimizer,
    so the white space is taken off between the two."""
    return F.lower(T.stripped(F.upper(F.replace(text, F.lit("\u1e9e"), F.lit("\u00df")))))


def _similar(rows: DataFrame, expected: str, answer: str, name: str, dim: int) -> DataFrame:
    """``rows`` with the cosines of the answer with each semantic output, null for outputs of other kinds."""
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(DoubleType()))])
    workers.importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = hashed.Places(dim)
        unit = lambda t: hashed.unit(places.weights(t).astype(float)[None, :])[0]
        for b in batches:
            out = []
            for wanted, said in zip(b.column(expected).to_pylist(), b.column(answer).to_pylist(), strict=True):
                if said is None or not any(w and w["kind"] == "semantic" for w in wanted or ()):
                    out.append([None] * len(wanted or ()))
                    continue
                own = unit(said)
                out.append([float(np.dot(own, unit(w["value"]))) if w and w["kind"] == "semantic" and w["value"] is not None else None for w in wanted])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def regexes_are_sound(rows: DataFrame, expected: str = "expected_outputs") -> DataFrame:
    """(kind, value, reason) of regular expressions that do not compile, to be looked at before a run."""
    values = rows.select(F.explode(expected).alias("e")).where("e.kind = 'regex'").select("e.kind", "e.value").distinct()
    workers.importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = []
            for v in b.column("value").to_pylist():
                try:
                    re.compile(v or "")
                except re.error as e:
                    bad.append({"kind": "regex", "value": v, "reason": str(e)})
            yield pa.RecordBatch.from_pylist(bad, schema=pa.schema([("kind", pa.string()), ("value", pa.string()), ("reason", pa.string())]))

    return values.mapInArrow(run, "kind string, value string, reason string")


def matched(rows: DataFrame, expected: str = "expected_outputs", answer: str = "answer", least: float = SEMANTIC, dim: int = T.DIM) -> DataFrame:
    """``rows`` with matched, whether the answer meets any output of the array ``expected`` of (kind, value), and met, the
    places (from 0) of those that it meets. A null answer, a null value and a null or empty array meet nothing; an unknown
    kind is an error. Columns of these names are replaced."""
    checked_threshold(least, "least", 1.0, -1.0)
    rows = rows.drop("matched", "met")
    sims = next(f"_sims{i}" for i in range(len(rows.columns) + 1) if f"_sims{i}" not in rows.columns)
    wide = _similar(rows, expected, answer, sims, dim)
    said = F.col(answer)

    def meets(e: Column, i: Column) -> Column:
        kind = e["kind"]
        exact = _folded(e["value"]) == _folded(said)
        found = F.regexp_like(said, e["value"])
        near = F.round(F.get(sims, i), 12) >= least
        unknown = F.raise_error(F.concat(F.lit("unknown kind of expected output: "), F.coalesce(kind, F.lit("null")))).cast("boolean")
        hit = F.when(kind == "exact", exact).when(kind == "regex", found).when(kind == "semantic", near).otherwise(unknown)
        return F.when(F.coalesce(hit, F.lit(False)), i)

    met = F.filter(F.transform(F.coalesce(expected, F.array().cast(rows.schema[expected].dataType)), meets), lambda i: i.isNotNull())
    return wide.withColumn("met", met).withColumn("matched", F.size("met") > 0).drop(sims)
