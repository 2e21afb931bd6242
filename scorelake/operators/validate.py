"""Dataset validation that collects every finding in one pass.

What a record must look like is a table of rules; one evaluator reads it for golden and calibration records alike. It
runs in Arrow batches on Python's json, whose rules for JSON are part of the contract. The checked lines are written
down once; duplicate ids and version changes, which depend on line order, are joins and aggregates over them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.sources import scratch, workers

CHECKED = "line_no long, code string, reason string, id string, dataset_version string, tags array<string>"


@dataclass(frozen=True)
class Rule:
    """A test of one field; ``each``: rules for the members of a list, tested member by member."""

    field: str
    fits: Callable[[object], bool]
    message: str
    code: str = "schema"
    each: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Form:
    required: tuple[str, ...]
    optional: tuple[str, ...]
    rules: tuple[Rule, ...]
    missing: str
    unknown_first: bool
    blank: str
    #: What of a line is decoded.
    inner: Callable[[str], str] = str.strip


def _text(v: object) -> bool:
    return isinstance(v, str)


def _filled(v: object) -> bool:
    return isinstance(v, str) and v != ""


def _object(v: object) -> bool:
    return isinstance(v, dict)


def _number(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


# Field names, kinds, messages and the order of the tests are fixed values.
KINDS = ("exact", "semantic", "regex")
GOLDEN = Form(
    required=("id", "input", "expected_outputs", "dataset_version", "provenance"),
    optional=("tags",),
    rules=(
        Rule("id", _filled, "field 'id' must be a non-empty string"),
        Rule("input", _text, "field 'input' must be a string"),
        Rule("dataset_version", _filled, "field 'dataset_version' must be a non-empty string"),
        Rule("provenance", _object, "field 'provenance' must be an object"),
        Rule(
            "expected_outputs",
            lambda v: isinstance(v, list) and bool(v),
            "field 'expected_outputs' must be a non-empty list",
            each=(
                Rule("", _object, "{place} must be an object"),
                Rule("", lambda v: {"kind", "value"} <= v.keys(), "{place} missing 'kind' or 'value'"),
                Rule("kind", lambda v: _text(v) and v in KINDS, "{place}: invalid expected_output kind {value!r}"),
                Rule("value", _text, "{place}: expected_output value must be str, got {type}"),
            ),
        ),
        Rule("tags", lambda v: isinstance(v, list) and all(map(_text, v)), "field 'tags' must be a list of strings"),
    ),
    missing="missing required field(s): {}",
    unknown_first=False,
    blank="blank line; dataset must have one JSON object per line",
)
CALIBRATION = Form(
    required=("human_score", "id", "prompt", "provenance", "response", "rubric"),
    optional=(),
    rules=(
        Rule("id", _filled, "id must be a non-empty string"),
        Rule("prompt", _text, "prompt must be a string"),
        Rule("response", _text, "response must be a string"),
        Rule("rubric", lambda v: _text(v) and v.strip() != "", "rubric must be a non-empty string"),
        Rule("provenance", _object, "provenance must be an object"),
        Rule("human_score", _number, "human_score must be a number"),
        Rule("human_score", lambda v: 0 <= v <= 1, "human_score must be in [0, 1]; got {value}", "score_range"),
    ),
    missing="missing required fields: {}",
    unknown_first=True,
    blank="blank line; calibration must have one JSON object per line",
)
#: As a calibration set is loaded, not validated: a line of white space is bad JSON.
CALIBRATION_AS_LOADED = replace(CALIBRATION, inner=lambda line: line)


def broken(form: Form, record: object) -> tuple[str, str] | None:
    """(code, reason) of the first rule that a decoded record breaks, or None."""
    if not isinstance(record, dict):
        return "schema", f"top-level value must be JSON object, got {type(record).__name__}"
    unknown = sorted(record.keys() - {*form.required, *form.optional})

    def tests() -> Iterator[tuple[bool, str, str]]:
        absent = [k for k in form.required if k not in record]
        yield not absent, "schema", form.missing.format(absent)
        strange = (not unknown, "schema", f"unknown top-level field(s): {unknown}")
        if form.unknown_first:
            yield strange
        for rule in form.rules:
            if rule.field in record:
                value = record[rule.field]
                yield rule.fits(value), rule.code, rule.message.format(value=value)
                for i, member in enumerate(value if rule.each else ()):
                    for part in rule.each:
                        inner = member[part.field] if part.field else member
                        yield part.fits(inner), part.code, part.message.format(place=f"{rule.field}[{i}]", value=inner, type=type(inner).__name__)
        yield strange

    return next(((code, reason) for fits, code, reason in tests() if not fits), None)


def check_line(form: Form, line: str) -> tuple:
    """(code, reason, id, dataset_version, tags) of a line; code is null for a record of the right form."""
    inner = form.inner(line)
    if not inner:
        return "parse", form.blank, None, None, None
    try:
        r = json.loads(inner)
    except json.JSONDecodeError as e:
        return "parse", f"invalid JSON: {e.msg}", None, None, None
    if (found := broken(form, r)) is not None:
        return (*found, None, None, None)
    return None, None, r["id"], r.get("dataset_version"), r.get("tags", [])


def _keys(lines: DataFrame) -> list[str]:
    """Lines of several files are told apart by a column ``file``; without one they are one file's."""
    return [c for c in lines.columns if c == "file"]


def checked(lines: DataFrame, form: Form = GOLDEN) -> DataFrame:
    """(file,) line_no, code, reason, id, dataset_version, tags, id_shown, version_shown of (file,) line_no, line rows, each
    checked once; the shown ones are written as reasons write them."""
    keys = _keys(lines)
    names = [*keys, "line_no", "code", "reason", "id", "dataset_version", "tags", "id_shown", "version_shown"]
    workers.importable(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        shown = lambda v: None if v is None else repr(v)
        for b in batches:
            rows = [(*r, shown(r[2]), shown(r[3])) for r in (check_line(form, x) for x in b.column("line").to_pylist())]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("line_no"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = "".join(f"{k} string, " for k in keys) + CHECKED + ", id_shown string, version_shown string"
    return scratch.written(lines.select(*keys, F.col("line_no").cast("long").alias("line_no"), "line").mapInArrow(run, schema), "checked")


def _settled(rows: DataFrame, good: DataFrame, claimed: Column, drifts: bool) -> DataFrame:
    """``checked`` rows with the codes and reasons that hang on other lines of their file."""
    keys = _keys(rows)
    claims = good.groupBy(*keys, "id").agg(F.min(F.when(claimed, F.col("line_no"))).alias("claim"))
    judged = good.join(claims, [*keys, "id"])
    twice = F.col("claim") < F.col("line_no")
    reason = F.when(twice, F.format_string("duplicate id %s; first seen at line %d; ids must be unique within a file", "id_shown", "claim"))
    code = F.when(twice, "duplicate_id")
    if drifts:
        off = F.col("dataset_version") != F.col("version")
        code, reason = code.when(off, "version_drift"), reason.when(off, F.format_string("dataset_version %s does not match file version %s", "version_shown", "file_version_shown"))
    names = [*keys, "line_no", "code", "reason", "id", "dataset_version", "tags"]
    out = judged.withColumns({"code": code.otherwise("valid"), "reason": reason})
    return out.select(*names).unionByName(rows.where("code is not null").select(*names))


def outcomes(lines: DataFrame) -> DataFrame:
    """``checked`` with code 'valid', 'duplicate_id' or 'version_drift' for rows that have the right form.

    The first of them in a file sets the file's version; an id is claimed by the first row of that version that bears it.
    """
    rows = checked(lines)
    keys, good = _keys(rows), rows.where("code is null")
    version = good.groupBy(*keys).agg(F.min_by(F.struct("dataset_version", "version_shown"), "line_no").alias("_v")).select(*keys, F.col("_v.dataset_version").alias("version"), F.col("_v.version_shown").alias("file_version_shown"))
    good = good.join(version, keys) if keys else good.crossJoin(F.broadcast(version))  # one row, or one a file
    return _settled(rows, good, F.col("dataset_version") == F.col("version"), True)


def calibration_outcomes(lines: DataFrame, form: Form = CALIBRATION) -> DataFrame:
    """``checked`` for calibration rows; of a file's valid rows with the same id all but the first are 'duplicate_id'."""
    rows = checked(lines, form)
    return _settled(rows, rows.where("code is null"), F.lit(True), False)


def report(found: DataFrame, files: DataFrame | None = None, what: str = "dataset") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, findings, tag counts of the valid rows) of ``outcomes`` or ``calibration_outcomes``.

    summary: a row (ok, n_rows, n_valid, n_findings, dataset_version), or one a file; no rows at all are one finding,
    'empty' at line 0. ok: a valid row and no finding. ``files``: all files' names (file), as one without lines has no
    outcomes.
    """
    keys, valid = _keys(found), F.col("code") == "valid"
    sums = found.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(valid).alias("n_valid"), F.min_by("dataset_version", F.when(valid, F.col("line_no"))).alias("dataset_version"))
    if keys and files is not None:
        sums = files.select("file").distinct().join(sums, "file", "left").na.fill(0, ["n_rows", "n_valid"])
    empty = F.col("n_rows") == 0
    summary = sums.select(
        *keys, ((F.col("n_valid") > 0) & (F.col("n_valid") == F.col("n_rows"))).alias("ok"), "n_rows", "n_valid",
        F.when(empty, 1).otherwise(F.col("n_rows") - F.col("n_valid")).cast("long").alias("n_findings"), F.when(F.col("n_valid") > 0, F.col("dataset_version")).alias("dataset_version"),
    )
    name = F.concat(F.lit(f"{what} file "), F.col("file")) if keys else F.lit(f"{what} file")
    none = sums.where(empty).select(*keys, F.lit(0).cast("long").alias("line_no"), F.lit("empty").alias("code"), F.concat(name, F.lit(f" contains no {'examples' if what == 'dataset' else 'rows'}")).alias("reason"))
    findings = found.where(~valid).select(*keys, "line_no", "code", "reason").unionByName(none).orderBy(*keys, "line_no")
    return summary, findings, tag_histogram(found.where(valid), keys)


def tag_histogram(valid: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return valid.select(*by, F.explode("tags").alias("tag")).groupBy(*by, "tag").agg(F.count("*").alias("count")).orderBy(*by, F.desc("count"), "tag")
