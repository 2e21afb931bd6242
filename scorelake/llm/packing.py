"""Packing by non-negative least squares: window recipes solved against the histogram of lengths.

1. Texts are encoded and cut: whole windows of ``WINDOW`` ids are sequences of their own, then at most one half
   window is cut off, and what is left of a text (under half a window) joins its neighbours in the task until the
   bundle holds a quarter of a window at least. Bundles are never longer than half a window and a text's end stays
   whole in its bundle, so every item to be packed is between a quarter and a half of a window long (but for the
   last bundle of each task).
2. Lengths are rounded up to ``GRID`` ids. The recipes, all ways of filling a window with up to four such lengths
   and at most ``SLACK`` grid steps left, are enumerated; non-negative least squares finds how often to use each so
   that the histogram of lengths is met. The repeat counts are rounded down, and then down further wherever a
   length would be used up twice.
3. Items of a length are numbered by counting salts first, so a very common length is no task of its own. An item's
   number gives its recipe, repeat and place.
4. Items that no recipe took are packed greedily: in blocks, longest first, each into the fullest sequence that has
   room.

Defined cases: a null text is an empty one and has the end id alone; no text is dropped; repeated rows are packed
one by one; an empty table gives no rows; extra columns are ignored. Long texts are cut as said, others lie whole
in one sequence. Ids are numbered from 0 in their document.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm import common
from scorelake.llm.word_table import ids_of_words, split_words, vocabulary_path

WINDOW = 4096
GRID = 16
SLACK = 1
END = 2
#: Words that a worker keeps encoded.
CACHED = 600_000
#: Items of a block that is packed greedily.
BLOCK = 4000
ITEMS = "item long, item_tokens long, pieces array<struct<doc_id:long,start:long,length:long,ids_crc32:long,doc_tokens:long>>"
_PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by way of the words the worker knows."""
    known = common.worker_cache(f"packing {path}")
    if len(known) > CACHED:
        # what came first is what comes most
        for w in list(itertools.islice(known, CACHED // 2, None)):
            del known[w]
    # the tokenizer lowers case; where that is plain it is done here, so that fewer words are distinct
    split = [split_words(t.lower() if t.isascii() and "<|" not in t else t) for t in texts]
    found = [list(map(known.get, words)) for words in split]
    short = [k for k, ids in enumerate(found) if None in ids]
    new = list({w for k in short for w, ids in zip(split[k], found[k], strict=True) if ids is None})
    known.update(zip(new, ids_of_words(new, path), strict=True))
    for k in short:
        found[k] = [known[w] if ids is None else ids for w, ids in zip(split[k], found[k], strict=True)]
    return [b"".join(ids) for ids in found]


def cut_items(docs: DataFrame, path: str) -> DataFrame:
    """Items to be packed, each with its pieces in order; an item is named by its task and running number."""
    half, quarter, end = WINDOW // 2, WINDOW // 4, np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rows, bundle, size = TaskContext.get().partitionId(), 0, [], [], 0

        def item(pieces: list[dict], length: int) -> None:
            nonlocal n
            rows.append((part << 33 | n, length, pieces))
            n += 1

        def batch() -> pa.RecordBatch:
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(_PIECE))], names=["item", "item_tokens", "pieces"])
            rows = []
            return out

        for b in batches:
            ids_of, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for first in range(0, len(texts), 500):
                for doc_id, ids in zip(ids_of[first : first + 500], encoded(texts[first : first + 500], path), strict=True):
                    ids += end
                    total = len(ids) // 4

                    def piece(start: int, length: int, doc_id=doc_id, ids=ids, total=total) -> dict:
                        return {"doc_id": doc_id, "start": start, "length": length, "ids_crc32": zlib.crc32(ids[4 * start : 4 * (start + length)]), "doc_tokens": total}

                    at = 0
                    while total - at >= WINDOW:
                        item([piece(at, WINDOW)], WINDOW)
                        at += WINDOW
                    if total - at >= half:
                        item([piece(at, half)], half)
                        at += half
                    rest = total - at
                    if rest:
                        if rest >= quarter:
                            item([piece(at, rest)], rest)
                        else:
                            bundle.append(piece(at, rest))
                            size += rest
                            if size >= quarter:
                                item(bundle, size)
                                bundle, size = [], 0
                if len(rows) >= 2000:
                    yield batch()
        if bundle:
            item(bundle, size)
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, ITEMS)


def recipes(lengths: list[int], window: int = WINDOW // GRID, slack: int = SLACK, depth: int = 4) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` of the lengths (in grid steps) that fill the window but for ``slack`` steps."""
    out = []
    for k in range(2, depth):
        for head in itertools.combinations_with_replacement(sorted(lengths), k - 1):
            left = window - sum(head)
            out += [(*head, x) for x in range(max(head[-1], left - slack), left + 1) if x in lengths]
    quarter = window // 4
    if quarter in lengths and depth >= 4:
        out.append((quarter,) * 4)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """min |ax - b| with x >= 0, by projected gradient steps with momentum."""
    if not a.shape[1]:
        return np.zeros(0)
    step = 1.0 / max(1e-9, np.linalg.norm(a @ a.T, 2))
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - b)))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / u * (new - x)
        if (new - x) @ (y - new) < 0:
            u = 1.0
        x, t = new, u
    return x


def solve(histogram: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """(recipe, repeats) that use no length (in grid steps) more often than the histogram has it."""
    left = {k: v for k, v in histogram.items() if v > 0}
    names = sorted(left)
    found = recipes(names)
    if not found:
        return []
    where = {k: i for i, k in enumerate(names)}
    a = np.zeros((len(names), len(found)))
    for j, r in enumerate(found):
        for k in r:
            a[where[k], j] += 1
    scale = max(left.values())
    x = nnls(a, np.array([left[k] for k in names]) / scale) * scale
    out = []
    for j in np.argsort(-x, kind="stable").tolist():
        need = {k: found[j].count(k) for k in found[j]}
        repeats = min(int(np.floor(x[j] + 1e-6)), *(left[k] // m for k, m in need.items()))
        if repeats > 0:
            out.append((found[j], repeats))
            for k, m in need.items():
                left[k] -= m * repeats
    # what rounding left: each recipe once more as often as it goes, likeliest first
    for j in np.argsort(-x, kind="stable").tolist():
        need = {k: found[j].count(k) for k in found[j]}
        if (repeats := min(left[k] // m for k, m in need.items())) > 0 and x[j] > 1e-6:
            out.append((found[j], repeats))
            for k, m in need.items():
                left[k] -= m * repeats
    return out


def _greedy(sizes: list[int]) -> list[int]:
    """Best fit, longest first: a sequence number for each size."""
    room: dict[int, list[int]] = {}
    free = np.zeros(WINDOW + 1, bool)
    out, n = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = np.flatnonzero(free[sizes[i] :])
        if len(fits):
            r = int(fits[0]) + sizes[i]
            s = room[r].pop()
            free[r] = bool(room[r])
        else:
            r, s, n = WINDOW, n, n + 1
        out[i] = s
        room.setdefault(r - sizes[i], []).append(s)
        free[r - sizes[i]] = True
    return out


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece."""
    spark = docs.sparkSession
    n_parts = common.partitions(spark)
    items = common.written(cut_items(docs, path or vocabulary_path()), "items")
    steps = F.ceil(F.col("item_tokens") / GRID).cast("int")
    salted = items.select("item", "item_tokens", "pieces", steps.alias("steps"), F.pmod(F.xxhash64("item"), F.lit(4 * n_parts)).cast("int").alias("salt"))
    # lengths x salts: a bounded number of lengths, a few salts a partition
    counts = salted.groupBy("steps", "salt").agg(F.count("*").alias("n"))
    counts = common.written(counts.withColumn("before", F.sum("n").over(Window.partitionBy("steps").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("steps", "salt", "n", F.coalesce("before", F.lit(0)).alias("before")), "counts")
    histogram = {r["steps"]: r["n"] for r in counts.groupBy("steps").agg(F.sum("n").alias("n")).collect()}  # at most WINDOW / GRID rows
    full = WINDOW // GRID
    plan = solve({k: v for k, v in histogram.items() if full // 4 <= k <= full // 2})
    # places of each length in the order of the plan: (first number, recipe's first sequence, place in the recipe)
    slots, used, sequences = [], {}, 0
    for r, repeats in plan:
        for place, k in enumerate(r):
            slots.append((k, used.get(k, 0), repeats, sequences, place))
            used[k] = used.get(k, 0) + repeats
        sequences += repeats
    slots += [(k, 0, histogram[k], sequences, 0) for k in [full] if k in histogram]
    sequences += histogram.get(full, 0)
    used[full] = histogram.get(full, 0)
    slot_table = spark.createDataFrame(slots, "steps int, first long, repeats long, sequence long, place int")
    # as many rows as the plan has places: bounded by the number of recipes, whatever the input
    numbered = salted.join(counts, ["steps", "salt"])
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("steps", "salt").orderBy("item")) - 1 + F.col("before"))
    numbered = common.written(numbered.select("item", "item_tokens", "pieces", "steps", "number"), "numbered")
    limit = F.create_map(*(F.lit(x) for k, v in used.items() for x in (int(k), int(v)))) if used else F.create_map().cast("map<int,bigint>")
    in_plan = F.col("number") < F.coalesce(F.try_element_at(limit, F.col("steps")), F.lit(0))
    placed = (
        numbered.where(in_plan)
        .join(F.broadcast(slot_table), "steps")
        .where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("repeats")))
        .select("item_tokens", "pieces", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), F.col("place").cast("long").alias("place"))
    )
    rest = numbered.where(~in_plan)
    left = sum(v for k, v in histogram.items()) - sum(min(v, used.get(k, 0)) for k, v in histogram.items())
    blocks = max(1, -(-left // BLOCK))

    def greedy(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = table.column("item_tokens").to_pylist()
        at = _greedy(sizes)
        return pa.Table.from_arrays(
            [table.column("item_tokens"), table.column("pieces"), pa.array([sequences + s * blocks + key[0].as_py() for s in at], pa.int64()), pa.array(range(len(at)), pa.int64())],
            names=["item_tokens", "pieces", "sequence_id", "place"],
        )

    rest = rest.withColumn("block", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(blocks)).cast("int"))
    out = ITEMS.split(", ", 1)[1]
    loose = rest.select("block", "item_tokens", "pieces").groupBy("block").applyInArrow(greedy, f"{out}, sequence_id long, place long")
    both = placed.unionByName(loose)
    # a sequence has a handful of items, so its window is small whatever the skew of the documents
    ahead = F.coalesce(F.sum("item_tokens").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = both.withColumn("ahead", ahead)
    zero = F.struct(F.col("ahead").alias("at"), F.array().cast("array<struct<p:struct<doc_id:long,start:long,length:long,ids_crc32:long,doc_tokens:long>,offset:long>>").alias("out"))
    laid = F.aggregate("pieces", zero, lambda acc, p: F.struct((acc["at"] + p["length"]).alias("at"), F.concat(acc["out"], F.array(F.struct(p.alias("p"), acc["at"].alias("offset")))).alias("out")), lambda acc: acc["out"])
    return spread.select("sequence_id", F.explode(laid).alias("x")).select("x.p.doc_id", "x.p.start", "x.p.length", "x.p.ids_crc32", "x.p.doc_tokens", "sequence_id", F.col("x.offset").alias("offset"))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
