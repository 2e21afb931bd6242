"""The texts most like each of a set of texts, by cosine of their hashed embeddings; exact, without joining all pairs' cells.

Vectors are packed into blocks, the queries' as well, and tasks pair the two tables' few large rows. All of a pack's queries
meet a block in one product of matrices in single precision; only rows that may be among a query's k best, by what its
blocks so far hold and what the product's error allows, are scored in double precision. Of equal vectors only the k + 1
smallest ids go into blocks, as no others come among anyone's best.

A query by itself reads a block by lists of weights, from its heaviest bucket on; what it has read bounds what the rest can
add (the lengths that are left of both vectors), and rows that cannot come among its k best any more are read no further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import hashed
from scorelake.functions import text as T
from scorelake.sources import scratch, workers

BLOCK = 4096
#: Buckets that are read between two looks at the bound.
STEP = 8
#: Queries that meet a block at once, and columns into which a block's scores are dealt to find a bound of the k best.
STRIP, COLUMNS = 256, 64
#: More than the error of a product of unit vectors in single precision: 64 buckets' roundings are at most 5e-6.
SLACK = 1e-7
#: Digits of a score that count: beyond them the order of additions shows.
DIGITS = 12
FOUND = "query_id long, id long, score double"


class Lists:
    """A block's ids and its list of weights for each bucket."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.lists, self.read = ids, np.ascontiguousarray(vectors.T), 0
        self.single, self.order = self.lists.astype(np.float32), np.argsort(ids, kind="stable")

    def best(self, query_id: int, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows nearest to the query, but its own; fewer where no more can reach ``least``."""
        at = np.flatnonzero(self.ids != query_id)
        order = np.argsort(-np.abs(q), kind="stable")
        got, seen, left = np.zeros(len(at)), np.zeros(len(at)), float(q @ q)
        for lo in range(0, len(order), STEP):
            for b in order[lo : lo + STEP]:
                w = self.lists[b, at]
                got += q[b] * w
                seen += w * w
                left -= q[b] * q[b]
            self.read += STEP * len(at)
            if lo + STEP >= len(order):
                break
            bound = got + np.sqrt(max(left, 0.0) * np.maximum(1 - seen, 0.0))
            floor = least
            if len(at) > k:  # k rows reach at least this much
                sure = got - np.sqrt(max(left, 0.0) * np.maximum(1 - seen, 0.0))
                floor = max(floor, np.partition(sure, -k)[-k])
            near = bound >= floor - 1e-9
            if not near.all():
                at, got, seen = at[near], got[near], seen[near]
        scores = self.scores(q[None, :], np.zeros(len(at), np.int64), at)
        first = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][first], scores[first]

    def scores(self, q: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of queries ``rows`` with the block's rows ``at``."""
        out = np.zeros(len(at))
        for b in range(q.shape[1]):  # one order of additions for all pairs, so that equal texts have equal scores
            out += q[rows, b] * self.lists[b, at]
        return np.round(out, DIGITS) + 0.0

    def may_win(self, q_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of all rows but a query's own that can be among its k best; ``least`` is a bound of
        each query's k best so far."""
        slack, n = SLACK * q.shape[1], len(self.ids)
        sorted_ids, columns = self.ids[self.order], max(COLUMNS, 4 * k)
        out = []
        for lo in range(0, len(q), STRIP):
            part, own = q[lo : lo + STRIP], q_ids[lo : lo + STRIP]
            near = part.astype(np.float32) @ self.single
            first, behind = np.searchsorted(sorted_ids, own, "left"), np.searchsorted(sorted_ids, own, "right")
            for j in np.flatnonzero(behind > first):
                near[j, self.order[first[j] : behind[j]]] = -3
            bar = least[lo : lo + STRIP] - slack
            deep = n // columns
            if deep:  # the k largest of the columns' maxima are k rows, which bound the k best from below
                tops = near[:, : deep * columns].reshape(len(part), deep, columns).max(axis=1)
                bar = np.maximum(bar, np.partition(tops, columns - k, axis=1)[:, columns - k] - 2 * slack)
            flat = np.flatnonzero(near >= np.maximum(bar, -2)[:, None].astype(np.float32))
            rows, at = np.divmod(flat, n)
            out.append((rows + lo, self.ids[at], self.scores(part, rows, at)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Best:
    """The k best rows of each of a pack's queries so far."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k, self.least = q_ids, k, np.full(len(q_ids), -2.0)
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def meet(self, lists: Lists, q: np.ndarray) -> None:
        if len(q) == 1:
            ids, scores = lists.best(int(self.q_ids[0]), q[0], self.k, float(self.least[0]))
            more = (np.zeros(len(ids), np.int64), ids, scores)
        else:
            more = lists.may_win(self.q_ids, q, self.k, self.least)
        rows, ids, scores = (np.concatenate(x) for x in zip(self.found, more, strict=True))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        stay = rank < self.k
        self.found = rows[stay], ids[stay], scores[stay]
        last = rank == self.k - 1
        self.least[rows[last]] = scores[last]


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """(name, ids, vectors): up to ``BLOCK`` of a partition's (id, vector) rows a row, as little-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def given() -> pa.RecordBatch:
            ids = np.concatenate([b.column("id").to_numpy() for b in held]).astype("<i8")
            vectors = np.concatenate([b.column("vector").flatten().to_numpy() for b in held]).astype("<f8")
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["name", "ids", "vectors"])

        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, BLOCK - n))
                b = b.slice(held[-1].num_rows)
                n += held[-1].num_rows
                if n == BLOCK:
                    yield given()
                    held, n, number = [], 0, number + 1
        if held:
            yield given()

    return scratch.written(rows.select("id", "vector").mapInArrow(run, "name string, ids binary, vectors binary"), "packed")


def most_alike(rows: DataFrame, is_query: Column, id_col: str, text: str = "text", k: int = 5, dim: int = T.DIM) -> DataFrame:
    """(query_id, rank, id, score): of each query row's text the k most alike of all other rows' texts, ties to the smaller
    id; scores are rounded to 12 digits.

    A null or blank text has the zero vector, whose cosine with every text counts as 0. Rows with a null id take no part; a
    query leaves out all rows that bear its own id, and rows that share an id are one query, asked with each of their
    texts. Fewer than k other rows: all of them. An empty table gives no rows.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be at least 1")
    workers.importable(rows.sparkSession)
    wanted = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), is_query.alias("asked"))
    made = scratch.written(hashed.with_vectors(wanted, "text", dim), "vectors")
    copies = Window.partitionBy("hash", "vector").orderBy("id")  # cut to k + 1 ids before the shuffle as well
    told = made.select("id", "vector", F.xxhash64("vector").alias("hash")).withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1)
    blocks = _packed(told, dim)
    packs = _packed(made.where("asked").select("id", "vector").distinct(), dim)
    pairs = packs.select(F.col("name").alias("pack"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).crossJoin(blocks)  # rows of up to BLOCK vectors: a set of queries against all rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, Best] = {}
        last, lists = None, None

        def given() -> Iterator[pa.RecordBatch]:
            for own in best.values():
                rows, ids, scores = own.found
                yield pa.RecordBatch.from_arrays([pa.array(own.q_ids[rows]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])
            best.clear()

        for b in batches:
            for i in range(b.num_rows):
                number = lambda c, kind, b=b, i=i: np.frombuffer(b.column(c)[i].as_buffer(), kind)
                name, pack = b.column("name")[i].as_py(), b.column("pack")[i].as_py()
                if name != last:
                    last, lists = name, Lists(number("ids", "<i8").copy(), number("vectors", "<f8").reshape(-1, dim))
                if pack not in best and len(best) >= 64:
                    yield from given()
                if pack not in best:
                    best[pack] = Best(number("q_ids", "<i8").copy(), k)
                best[pack].meet(lists, number("q_vectors", "<f8").reshape(-1, dim))
        yield from given()

    found = pairs.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))  # k a task and query
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
