"""Hashed embeddings of texts, made in Arrow batches: each distinct token of a batch is hashed once, nothing is shuffled."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scorelake.sources import workers

#: Letters and digits of any script.
TOKEN = re.compile(r"[^\W_]+")
#: Tokens whose places a task remembers; rows that are embedded at once. Neither grows with the table, and texts
#: become Python's one by one, so a worker's memory does not grow with it either.
REMEMBERED = 30_000
ROWS = 512


class Places:
    """Signed places of tokens: a number below 2 * dim, the upper half for plus."""

    def __init__(self, dim: int):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim, self.known = dim, {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) of a text's tokens."""
        counts = Counter(TOKEN.findall(text.lower())) if text else {}
        known, modulus = self.known, 2 * self.dim
        if len(known) > REMEMBERED:
            known.clear()
        places = np.empty(len(counts), np.int64)
        for i, token in enumerate(counts):
            at = known.get(token)
            if at is None:
                at = known[token] = int.from_bytes(hashlib.sha1(token.encode()).digest(), "big") % modulus
            places[i] = at
        return places, np.fromiter(counts.values(), np.int64, len(counts))

    def weights(self, text: str | None) -> np.ndarray:
        """Signed token counts by bucket; a blank or null text has none."""
        places, counts = self.of(text)
        both = np.bincount(places, counts, 2 * self.dim)
        return both[self.dim :] - both[: self.dim]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ``ROWS`` at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def unit(weights: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    norm = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
    return np.divide(weights, norm, out=np.zeros_like(weights), where=norm > 0)


def with_vectors(rows: DataFrame, text: str, dim: int, name: str = "vector") -> DataFrame:
    """``rows`` with the text's unit vector in the text's place. Rows are embedded one by one; a blank or null text has
    the zero vector."""
    Places(dim)
    kept = [f for f in rows.schema.fields if f.name not in (text, name)]
    workers.importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(dim)
        for b in parts(batches):
            made = np.array([places.weights(t.as_py()) for t in b.column(text)], float).reshape(-1, dim)
            vectors = pa.ListArray.from_arrays(np.arange(0, made.size + 1, dim, dtype=np.int32), unit(made).ravel())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), vectors], names=[*(f.name for f in kept), name])

    return rows.select(*(f.name for f in kept), text).mapInArrow(run, StructType([*kept, StructField(name, ArrayType(DoubleType()))]))


def cells(rows: DataFrame, id_col: str, text: str, dim: int) -> DataFrame:
    """Rows (id, bucket, weight): signed token counts by hash bucket; cells that cancel out stay as zero. Rows are
    embedded one by one."""
    Places(dim)
    workers.importable(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(dim)
        for b in parts(batches):
            at, buckets, weights = [], [], []
            for i, t in enumerate(b.column(text)):
                p, n = places.of(t.as_py())
                seen = np.unique(p % dim)
                both = np.bincount(p, n, 2 * dim)
                at.append(np.full(len(seen), i))
                buckets.append(seen)
                weights.append((both[dim:] - both[:dim])[seen])
            at, buckets, weights = (np.concatenate(x) if x else np.empty(0) for x in (at, buckets, weights))
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at, pa.int64())), pa.array(buckets.astype(np.int32)), pa.array(weights.astype(np.int64))], names=[id_col, "bucket", "weight"])

    return rows.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, bucket int, weight long")
