"""Distribution drift between two text populations along lengths, embedding clusters and judge scores."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from scorelake.functions import hashed
from scorelake.functions import text as T
from scorelake.operators.runs import checked_threshold
from scorelake.sources import scratch, workers

THRESHOLD = 0.10
GOLDEN, CANDIDATE = "golden", "candidate"
#: Rows of a range within which k-means counts off its first centroids.
RANGE_ROWS = 50_000
#: Bits behind the point in the sums of a round of k-means.
FIXED = 52


def texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a population: a null text is none and is left out, on every axis."""
    return rows.where(F.col(text).isNotNull())


def counts(bucket: Column, buckets: int) -> Column:
    """An aggregate: how many rows lie in each of the buckets, as an array."""
    return F.array(*(F.count_if(bucket == i) for i in range(buckets)))


def histogram(rows: DataFrame, bucket: Column, buckets: int, side: str = "side") -> DataFrame:
    """Rows (side, bucket, n) with a row for each of the buckets of each side that has rows. One pass, summed in the tasks
    first; buckets are few."""
    return rows.groupBy(side).agg(counts(bucket, buckets).alias("c")).select(side, F.posexplode("c").alias("bucket", "n"))


def divergence(p: Column, q: Column) -> Column:
    """Base-2 Jensen-Shannon divergence of two arrays of counts, within [0, 1]. Null or all zero is empty: of two empty
    ones it is 0, of one 1."""
    total = lambda a: F.aggregate(F.coalesce(a, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, x: s + x)

    def half(x: Column, y: Column) -> Column:
        share, other = F.try_divide(x, total(p)), F.try_divide(y, total(q))
        own = lambda a: F.when(a > 0, a * F.log2(a / ((share + other) / 2))).otherwise(0.0)
        return own(share) + own(other)

    whole = F.aggregate(F.zip_with(p, q, half), F.lit(0.0), lambda s, x: s + x) / 2
    empty_p, empty_q = total(p) == 0, total(q) == 0
    return F.when(empty_p & empty_q, 0.0).when(empty_p | empty_q, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), whole)))


def jensen_shannon(hist: DataFrame, left: str, right: str, side: str = "side") -> DataFrame:
    """One row (drift_score): base-2 divergence of two sides of a histogram, within [0, 1].

    Both sides empty: 0; one side empty: 1.
    """
    of = lambda s: F.coalesce(F.sum(F.when(F.col(side) == s, F.col("n"))), F.lit(0).cast("long"))
    rows = hist.groupBy("bucket").agg(of(left).alias("p"), of(right).alias("q")).agg(F.array_sort(F.collect_list(F.struct("bucket", "p", "q"))).alias("b"))  # a row a bucket
    return rows.select(divergence(F.transform("b", lambda x: x["p"]), F.transform("b", lambda x: x["q"])).alias("drift_score"))


def axis_report(score: DataFrame, axis: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (axis, drift_score, threshold, status); drifted only above the threshold."""
    checked_threshold(threshold, f"{axis}_threshold", 1.0)
    return score.select(F.lit(axis).alias("axis"), "drift_score", F.lit(float(threshold)).alias("threshold"), F.when(F.col("drift_score") > threshold, "drifted").otherwise("ok").alias("status"))


def length_stats(rows: DataFrame, side: str = "side") -> DataFrame:
    n = F.length("text")
    q = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(side).agg(F.count("*").alias("n"), F.avg(n).alias("mean"), q[0].alias("median"), q[1].alias("p95"))


def _sims(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Dot products, each summed from the first component to the last, so that equal centroids tie exactly."""
    out = np.zeros((len(vectors), len(centroids)))
    for i in range(centroids.shape[1]):
        out += vectors[:, i : i + 1] * centroids[:, i]
    return out


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64())
    if len(values) != dim * len(column):
        raise ValueError(f"every vector must have {dim} components")
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, centroids: list[list[float]], name: str = "vector") -> DataFrame:
    """``vectors`` with cluster (ties: the lowest) and distance, 1 - the largest similarity."""
    if not centroids:
        raise ValueError("there are no centroids")
    own = [f for f in vectors.schema.fields if f.name not in ("cluster", "distance")]
    at = np.array(centroids, float)
    workers.importable(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = _sims(_matrix(b.column(name), at.shape[1]), at)
            more = [pa.array(sims.argmax(axis=1).astype(np.int32)), pa.array(1 - sims.max(axis=1))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in own), *more], names=[*(f.name for f in own), "cluster", "distance"])

    return vectors.select(*(f.name for f in own)).mapInArrow(run, StructType([*own, StructField("cluster", IntegerType()), StructField("distance", DoubleType())]))


def spaced(vectors: DataFrame, k: int, n: int, order: str) -> list[list[float]]:
    """The vectors of rows 0, s, 2s ... (s = n // k) in the order of a number, k of them. Ranges of the order are counted
    first, so rows are numbered only in the ranges that hold a wanted row, each by itself."""
    step = max(n // k, 1)
    ranges = min(1000, -(-n // RANGE_ROWS))
    cuts = sorted(set(vectors.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    cell = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = vectors.select(F.col(order).alias("_order"), "vector", cell.alias("_cell"))
    before, at = {}, 0
    for r in rows.groupBy("_cell").agg(F.count("*").alias("n")).orderBy("_cell").collect():  # a row a range
        before[r["_cell"]] = at
        at += r["n"]
    wanted = [i * step for i in range(k)]
    held = {max((b, c) for c, b in before.items() if b <= w)[1] for w in wanted}
    first = F.create_map(*(F.lit(x) for c in held for x in (c, before[c])))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_order")) - 1 + F.element_at(first, F.col("_cell"))
    picked = rows.where(F.col("_cell").isin(*held)).withColumn("_at", place).where(F.col("_at").isin(*wanted)).orderBy("_at")
    return [list(r["vector"]) for r in picked.select("vector").collect()]  # k rows


def _round(vectors: DataFrame, now: list[list[float]], before: list[list[float]] | None) -> tuple[int, dict[int, list[float]]]:
    """(rows whose cluster is not that of the round before, the sums of each cluster's vectors).

    A task adds up its vectors as whole multiples of 2**-52, exactly, and gives a row a cluster; these add up as decimals.
    So neither partitioning nor a repeated task moves a digit, and the plan is the same in each round.
    """
    at, last = np.array(now, float), None if before is None else np.array(before, float)
    k, dim = at.shape
    kind = pa.list_(pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, changed, seen = [[0] * dim for _ in range(k)], [0] * k, [0] * k
        for b in batches:
            v = _matrix(b.column("vector"), dim)
            put = _sims(v, at).argmax(axis=1)
            old = np.zeros_like(put) if last is None else _sims(v, last).argmax(axis=1)
            fixed = np.rint(v * 2.0**FIXED).astype(np.int64)
            high, low = fixed >> 26, fixed & ((1 << 26) - 1)
            for c in np.unique(put):
                mine = put == c
                seen[c] += int(mine.sum())
                changed[c] += int((old[mine] != c).sum())
                sums[c] = [s + (h << 26) + x for s, h, x in zip(sums[c], high[mine].sum(axis=0).tolist(), low[mine].sum(axis=0).tolist(), strict=True)]
        held = [c for c in range(k) if seen[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([changed[c] for c in held], pa.int64()), pa.array([[Decimal(x) for x in sums[c]] for c in held], kind)], names=["cluster", "changed", "sums"]
        )

    parts = vectors.select("vector").mapInArrow(run, "cluster int, changed long, sums array<decimal(38,0)>")
    whole = parts.groupBy("cluster").agg(F.sum("changed").alias("changed"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums")).collect()  # k rows
    return sum(r["changed"] for r in whole), {r["cluster"]: [float(x) / 2.0**FIXED for x in r["sums"]] for r in whole}


def kmeans(vectors: DataFrame, k: int, order: str, most_rounds: int = 25) -> list[list[float]]:
    """Spherical k-means centroids, started from evenly spaced rows in the order of the number ``order``.

    A round is one pass; k x dim numbers reach the driver. Components lie within [-1000, 1000]. An empty cluster keeps its
    centroid; a zero sum stays zero. All rows start in cluster 0, and it ends after the first round in which no row
    changes its cluster, with the centroids of that round. No rows, no centroids.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be at least 1")
    n, largest = vectors.agg(F.count("*"), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    k = min(k, n)
    if k == 0:
        return []
    if largest is None or not largest <= 1000:
        raise ValueError("components must lie within [-1000, 1000]")
    workers.importable(vectors.sparkSession)
    centroids, before = spaced(vectors, k, n, order), None
    for _ in range(most_rounds):
        changed, sums = _round(vectors, centroids, before)
        before, centroids = centroids, list(centroids)
        for c, v in sums.items():
            norm = sum(x * x for x in v) ** 0.5
            centroids[c] = [x / norm for x in v] if norm else v
        if changed == 0:
            break
    return centroids


def farthest(assigned: DataFrame, n: int, order: str) -> DataFrame:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("n must be at least 0")
    return assigned.orderBy(F.desc("distance"), order).limit(n)


def features(rows: DataFrame, order: str, judge: Column | None = None, dim: int = T.DIM) -> DataFrame:
    """(side, order, length, score, vector) of rows (side, order, text), written down: the one pass over the texts.

    A row is named by its side and its number; a number that comes twice on a side, or is null, is an error.
    """
    score = F.lit(None).cast("double") if judge is None else T.clamp01(judge)
    made = texts(rows).select("side", order, F.length("text").alias("length"), score.alias("score"), "text")
    made = scratch.written(hashed.with_vectors(made, "text", dim), "features")
    twice = made.groupBy("side", order).count().where((F.col("count") > 1) | F.col(order).isNull()).first()
    if twice is not None:
        raise ValueError(f"{order} {twice[order]} names {twice['count']} texts of side {twice['side']!r}")
    return made


def embedded(rows: DataFrame, k: int, order: str, dim: int = T.DIM) -> tuple[DataFrame, list[list[float]]]:
    """(``features`` of both sides, the golden side's centroids)."""
    made = features(rows, order, dim=dim)
    return made, kmeans(made.where(F.col("side") == GOLDEN).select(order, "vector"), k, order)


def report(rows: DataFrame, order: str, judge: Column | None = None, k: int = 8, n_examples: int = 5, dim: int = T.DIM, thresholds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(axes, examples) of rows (side, order, text), side 'golden' or 'candidate'; ``order`` numbers a side's texts, and
    both sides may have the same numbers.

    axes: (axis, drift_score, threshold, status, golden_counts, candidate_counts, golden_mean, candidate_mean); means are
    those of lengths and judge scores. The judge axis is there if a judge's column is. examples: the candidates farthest
    from the golden clusters (order, text, distance). Null texts are left out; a side without texts is an error, and so is
    a number that comes twice on its side. The texts are read once, and once more for the examples' own; all axes' counts
    and means are one aggregate of the written features.
    """
    limits = {a: checked_threshold((thresholds or {}).get(a, THRESHOLD), f"{a}_threshold", 1.0) for a in ("length", "embedding", "judge")}
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be at least 1")
    if isinstance(n_examples, bool) or not isinstance(n_examples, int) or n_examples < 0:
        raise ValueError("n_examples must be at least 0")
    made = features(rows.where(F.col("side").isin(GOLDEN, CANDIDATE)), order, judge, dim)
    there = {r["side"] for r in made.select("side").distinct().collect()}
    if not {GOLDEN, CANDIDATE} <= there:
        raise ValueError("both sides must have rows")
    centroids = kmeans(made.where(F.col("side") == GOLDEN).select(order, "vector"), k, order)
    assigned = scratch.written(nearest(made, centroids).drop("vector"), "assigned")
    axes = [("length", T.length_bucket_of(F.col("length")), len(T.LENGTH_BOUNDS), F.col("length")), ("embedding", F.col("cluster"), len(centroids), None)]
    if judge is not None:
        axes.append(("judge", T.judge_bucket(F.col("score")), T.JUDGE_BUCKETS, F.col("score")))
    sums = [c for axis, bucket, n, value in axes for c in (counts(bucket, n).alias(f"{axis}_counts"), (F.lit(None) if value is None else F.avg(value)).cast("double").alias(f"{axis}_mean"))]
    sides = assigned.groupBy("side").agg(*sums)  # two rows
    one = sides.agg(*(F.any_value(F.when(F.col("side") == s, F.struct(*(c for c in sides.columns if c != "side"))), True).alias(s) for s in (GOLDEN, CANDIDATE)))
    parts = []
    for axis, _, _, _ in axes:
        both = [F.col(s)[f"{axis}_{what}"].alias(f"{s}_{what}") for what in ("counts", "mean") for s in (GOLDEN, CANDIDATE)]
        score = divergence(F.col(GOLDEN)[f"{axis}_counts"], F.col(CANDIDATE)[f"{axis}_counts"])
        parts.append(F.struct(F.lit(axis).alias("axis"), score.alias("drift_score"), F.lit(limits[axis]).alias("threshold"), F.when(score > limits[axis], "drifted").otherwise("ok").alias("status"), *both))
    report_ = one.select(F.inline(F.array(*parts)))
    far = farthest(assigned.where(F.col("side") == CANDIDATE), n_examples, order).select(order, "distance")
    own = texts(rows).where(F.col("side") == CANDIDATE).select(order, "text")
    return report_, own.join(F.broadcast(far), order).select(order, "text", "distance").orderBy(F.desc("distance"), order)  # n_examples rows
