"""Multi-index hashing: learned rotated binary codes, split into substrings that are each indexed.

Codes: principal directions and iterative quantization (a rotation learned so that signs lose least) on a bounded
sample, once for each of ``ROTATIONS`` starts; the signs of all rotations together are a vector's code. A code is
split into bytes, and a block of the index has a table for each byte: from its value to the codes that have it. By
the pigeonhole principle a code within Hamming radius R of the query's is, in some byte j, within ``reaches(R)[j]``
bits of it (the reaches and one more each add up to R + 1), so the query looks up the byte values in reach and
gathers the codes listed there. Only codes so gathered are compared with the query's, and of them those within R are
reranked by cosine in double precision on the original vectors. R is learned from the sample: ``QUANTILE`` of the
distances of the sample's true neighbours (in the whole table neighbours are nearer still, so recall only grows).

Every row is indexed, where it lies, in blocks of ``BLOCK`` rows, each one row of a table; the queries are packed into
batches of ``QUERY_BATCH`` at most in the same way. Tasks pair the two tables' rows: a stated query set against all
rows, in blocks. Neither is collected: the index is not shuffled, no vector but the sample's passes the driver (Spark
broadcasts the packed queries only while they are smaller than its own threshold), and a task passes on the ``k`` best
of each query. Queries that found fewer than ``k`` in the radius are asked again without one, so they get what a search
of all rows gives. Norms and products are taken of vectors scaled by a power of two, so that very large and very small
components neither overflow nor vanish.

Defined cases: vectors that are null, of another length than the commonest of the sample (ties: the longest), zero,
or with null or non-finite components take no part, neither as queries nor as candidates; an empty table gives no
rows; rows with equal ids are candidates one by one, and a query leaves out every row that bears its own id; ties go
to the smaller id, candidates with the same id and score are both listed; query rows that repeat id and vector are
answered once, those that share the id only one by one; a null id takes no part. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm import common

#: The bound of the sample from which codes and radius are learned.
SAMPLE = 8192
SAMPLE_QUERIES = 256
ROTATIONS = 2
QUANTILE = 0.985
BLOCK = 4096
QUERY_BATCH = 16384
#: Looked-up codes, repeats included, that are held at a time.
HELD = 1 << 20
#: Neighbours found that a task holds before it passes on the best of them.
MOST_BEST = 1 << 21
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Bits in which two byte values differ.
_APART = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)]
FOUND = "query_id long, query_key long, vec_id long, score double"


@dataclass
class Coder:
    mean: np.ndarray
    rotations: list[np.ndarray]
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, bytes) of unit vectors ``x``."""
        bits = np.hstack([(x - self.mean) @ r > 0 for r in self.rotations])
        return np.packbits(bits, axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component into [0.5, 1): exact, but for what vanishes beside
    it."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(x: np.ndarray, seed: int = 3) -> Coder:
    """A coder from sampled vectors."""
    x = unit(x)
    mean = x.mean(0)
    c = x - mean
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    full = np.vstack([vt, np.zeros((0, x.shape[1]))])
    rotations, rng = [], np.random.default_rng(seed)
    for _ in range(ROTATIONS):
        v = c @ full.T
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(30):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        rotations.append(full.T @ r)
    coder = Coder(mean, rotations, 0)
    codes = coder.codes(x)
    q = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(5, len(x) - 1)]
    apart = _POPCOUNT[codes[q][:, None] ^ codes[near]].sum(2)
    coder.radius = int(np.ceil(np.quantile(apart, QUANTILE))) if apart.size else 8 * codes.shape[1]
    return coder


def reaches(radius: int, parts: int) -> np.ndarray:
    """Bits by which each substring may differ so that no code within the radius is missed; -1: not looked up."""
    spare = radius + 1 - parts
    return np.array([spare // parts + (j < spare % parts) for j in range(parts)])


class Tables:
    """The byte tables of a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[r, j], np.arange(257)).astype(np.int64) for j, r in enumerate(self.rows)]
        self.words = _words(codes)

    def within(self, query_codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(query numbers, row numbers, codes compared) of all pairs within the radius, some queries at a time."""
        reach, n = reaches(radius, self.codes.shape[1]), len(self.codes)
        near = [np.argwhere(_APART <= r)[:, 1].reshape(256, -1) if r >= 0 else None for r in reach]
        lists = [None if v is None else (self.starts[j][v], self.starts[j][v + 1] - self.starts[j][v]) for j, v in enumerate(near)]
        total = sum(x[1].sum(1)[query_codes[:, j]] for j, x in enumerate(lists) if x is not None)
        query_words, lo = _words(query_codes), 0
        while lo < len(query_codes):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(total[lo:]), HELD)) + lo)
            found = np.zeros((hi - lo, n), bool)
            for j, x in enumerate(lists):
                if x is None:
                    continue
                start, length = (t[query_codes[lo:hi, j]].ravel() for t in x)
                q = np.repeat(np.repeat(np.arange(hi - lo), near[j].shape[1]), length)
                at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
                found[q, self.rows[j][at]] = True
            q, r = np.nonzero(found)
            apart = np.zeros(len(q), np.uint16)
            for j in range(self.words.shape[1]):
                apart += np.bitwise_count(query_words[lo + q, j] ^ self.words[r, j])
            close = apart <= radius
            yield lo + q[close], r[close], len(q)
            lo = hi


def _words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def search_block(coder: Coder, q_ids, q, ids, x, k: int, radius: int | None = None) -> tuple[list[tuple[int, int, float]], int]:
    """(query number, id, score) of the k nearest of each query in one block, and how many codes were compared."""
    return searched(coder, Tables(coder.codes(unit(x))), q_ids, q, ids, x, k, radius)


def searched(coder: Coder, tables: Tables, q_ids, q, ids, x, k: int, radius: int | None) -> tuple[list[tuple[int, int, float]], int]:
    """``search_block`` of a block whose tables are there."""
    qc, q, x = coder.codes(unit(q)), scaled(q), scaled(x)
    q_norm, x_norm = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    out, compared = [], 0
    for qs, rows, n in tables.within(qc, coder.radius if radius is None else radius):
        compared += n
        other = ids[rows] != q_ids[qs]
        qs, rows = qs[other], rows[other]
        # the same order of additions for every pair, so that equal vectors have equal scores
        s = np.concatenate([(x[rows[a : a + 65536]] * q[qs[a : a + 65536]]).sum(1) for a in range(0, len(rows), 65536)] or [np.zeros(0)])
        s /= x_norm[rows] * q_norm[qs]
        order = np.lexsort((ids[rows], -s, qs))
        first = np.searchsorted(qs[order], qs[order])
        best = order[np.arange(len(order)) - first < k]
        out += zip(qs[best].tolist(), ids[rows[best]].tolist(), s[best].tolist(), strict=True)
    return out, compared


def _packed(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(name, ids, keys, vectors): up to ``size`` of a partition's (id, key, vector) rows a row, as little-endian numbers."""
    names = ["name", "ids", "keys", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, number, part = 0, 0, TaskContext.get().partitionId()

        def given() -> pa.RecordBatch:
            cols = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]).astype("<i8").tobytes() for c in ("id", "key")]
            vectors = np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False) for b in held]).astype("<f8")
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), *(pa.array([c], pa.binary()) for c in (*cols, vectors.tobytes()))], names=names)

        for b in batches:
            while b.num_rows:
                head = b.slice(0, size - n)
                held.append(head)
                n, b = n + head.num_rows, b.slice(head.num_rows)
                if n == size:
                    yield given()
                    held, n, number = [], 0, number + 1
        if held:
            yield given()

    return common.written(rows.select("id", "key", "vector").mapInArrow(run, "name string, ids binary, keys binary, vectors binary"), "packed")


def _search(blocks: DataFrame, queries: DataFrame, coder: Coder, width: int, k: int, radius: int | None) -> DataFrame:
    """Rows ``FOUND``, k at most a query and task; ``blocks``: the packed index; ``queries``: (id, key, vector), distinct
    keys, in the shared folder."""
    shared = blocks.sparkSession.sparkContext.broadcast(coder)  # two rotations
    batches = max(1, -(-queries.count() // QUERY_BATCH))
    packs = _packed(queries.repartition(batches, "key"), QUERY_BATCH, width)
    pairs = blocks.select("ids", "vectors", F.col("name").alias("block")).crossJoin(packs.select(F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("vectors").alias("q"), F.col("name").alias("pack")))

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, int, float]]] = {}
        asked: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        last, ids, x, tables = None, None, None, None

        def given() -> Iterator[pa.RecordBatch]:
            for pack, found in best.items():
                q_ids, keys = asked[pack]
                cols = list(zip(*_first(found, k), strict=True)) or [(), (), ()]
                at = np.array(cols[0], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at], pa.int64()), pa.array(keys[at], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "query_key", "vec_id", "score"])
            best.clear()
            asked.clear()

        for b in got:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                number = lambda c, kind="<i8", r=r: np.frombuffer(r[c].as_buffer(), kind)
                block, pack = r["block"].as_py(), r["pack"].as_py()
                if block != last:
                    last, ids, x = block, number("ids").copy(), number("vectors", "<f8").reshape(-1, width).copy()
                    tables = Tables(shared.value.codes(unit(x)))
                q_ids, q = number("q_ids").copy(), number("q", "<f8").reshape(-1, width)
                asked.setdefault(pack, (q_ids, number("q_keys").copy()))
                mine = best.setdefault(pack, [])
                mine += searched(shared.value, tables, q_ids, q, ids, x, k, radius)[0]
                if len(mine) > 8 * k * len(q_ids):
                    best[pack] = _first(mine, k)
                if sum(map(len, best.values())) > MOST_BEST:
                    yield from given()
        yield from given()

    return pairs.mapInArrow(run, FOUND)


def _first(found: list[tuple[int, int, float]], k: int) -> list[tuple[int, int, float]]:
    """The k best of each query."""
    found.sort(key=lambda r: (r[0], -r[2], r[1]))
    return [r for i, r in enumerate(found) if i < k or found[i - k][0] != r[0]]


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query row, against all rows but its own."""
    spark = table.sparkSession
    v = F.col(vector_col)
    if dict(table.dtypes)[vector_col] != "array<float>":
        v = v.cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), is_query.alias("is_query"))
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & good)
    sample = rows.orderBy(F.xxhash64("id", "vector"), "id", "vector").select("vector").limit(SAMPLE).collect()  # bounded
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = Counter(len(r["vector"]) for r in sample)
    width = max(widths, key=lambda w: (widths[w], w))
    rows = rows.where(F.size("vector") == width)
    coder = learn(np.array([r["vector"] for r in sample if len(r["vector"]) == width], np.float64))
    asked = rows.where("is_query").select("id", "vector", F.xxhash64("id", "vector").alias("key")).dropDuplicates(["key"])
    queries = common.written(asked, "queries")
    blocks = _packed(rows.withColumn("key", F.lit(0).cast("long")), BLOCK, width)
    found = common.written(_search(blocks, queries, coder, width, k, None), "found")
    enough = found.groupBy("query_key").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_key").alias("key"))
    few = common.written(queries.join(enough, "key", "left_anti"), "few")
    if not few.isEmpty():
        again = _search(blocks, few, coder, width, k, 8 * len(coder.rotations[0]) * len(coder.rotations))
        found = found.join(few.select(F.col("key").alias("query_key")), "query_key", "left_anti").unionByName(again)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
