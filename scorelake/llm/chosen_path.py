"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its runs of five words. Each distinct set is one record (copies of a set count,
but are not compared). A record's sketch has ``TOKENS`` minhash values; two records agree in a share of them that
estimates their Jaccard index.

Chosen paths: a run sends each record down a path named by the value of one sampled sketch token; records on the
same path form a bucket. Buckets of up to ``SMALL`` records are compared by brute force, sketch against sketch. A
larger bucket picks a pivot: records that agree with it well are linked to it, and all but its close likes are split
again on two more sampled tokens each, and so on for ``DEPTH`` levels; what is then still large is linked whole.
Runs repeat until a pair at the threshold has been missed with probability ``1 - RECALL`` at most.

The links only propose. A large component of them whose records are mostly unlike its first is parted where no two
records that could be within the threshold are torn apart (by their rarest shingles), as texts that merely share much
boilerplate are proposed as well. The components are then compared exactly, all pairs of each in blocks, by the true sets. So every pair of a component with Jaccard index >= ``threshold`` counts, whichever run found it.
Large components are spread over block pairs; counts leave a block pair, not pairs.

Result: one row per input row with class_id (the smallest doc_id that is linked to it by a chain of links, itself
included) and n_links (how many other rows are within the threshold, copies included).

The runs share one sketch, so a pair whose sketch is far off its Jaccard index is missed by all of them. That, and the
levels of a pivot, are why links are proposed well below the threshold.

Defined cases: a null text is an empty one. Texts of one to four words have one run, all their words; texts
without words have the empty set, and count as copies of one another (similarity 1). Rows that share a doc_id are
told apart in n_links, not in class_id. Rows with a null doc_id are returned with null class_id and n_links 0 and
take no part. An empty table gives no rows; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common

NGRAM = 5
THRESHOLD = 0.8
TOKENS = 64
RECALL = 0.9999
SMALL = 64
DEPTH = 4
#: Sketch agreement from which a pair in a small bucket, or a record and a pivot, are linked; and from which a
#: record is close enough to the pivot to leave the splitting: what is within the threshold of such a record is
#: at most 1 - CLOSE + 1 - 0.8 from the pivot, so it is linked to the pivot too. All allow for the sketch's error.
LINK, PIVOT_LINK, CLOSE = 0.58, 0.35, 0.65
#: Records of a block of a large component; smaller components have smaller blocks, at least SMALL_BLOCK.
BLOCK, SMALL_BLOCK, SPREAD = 1024, 128, 16
#: Records beyond which a component of proposed links is looked at before its pairs are compared (up to there comparing
#: its blocks costs less than moving its shingles), and the agreement with its first record from which on a record is
#: taken for one that has links.
LOOSE, ALIKE = 16 * BLOCK, 0.7
#: Words of 64 bits of a sieve, at least and at most: what is sent to all tasks does not grow beyond the latter.
SIEVE = (1 << 10, 1 << 18)
_WORD = re.compile(r"\w+")
#: Words whose hashes a worker keeps.
CACHED = 150_000
_MULT = np.random.default_rng(11).integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
_STEP = [np.uint64(x | 1) for x in np.random.default_rng(12).integers(1, 2**63, NGRAM, dtype=np.uint64)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of five words."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    known = common.worker_cache("shingles")
    if len(known) > CACHED:
        known.clear()
    try:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - NGRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(NGRAM, len(h))):
        out = (out ^ h[k : k + n]) * _STEP[k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(s: np.ndarray) -> bytes:
    """``TOKENS`` minhash values of 16 bits."""
    if not len(s):
        return bytes(2 * TOKENS)
    low = np.full(TOKENS, 2**64 - 1, np.uint64)
    for lo in range(0, len(s), 2048):
        x = s[lo : lo + 2048, None] * _MULT
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(0))
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2").tobytes()


def runs_needed(threshold: float) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - RECALL at most."""
    q = 1.0
    for _ in range(DEPTH - 1):  # a level splits on two tokens
        q = 1 - (1 - threshold * q) ** 2
    return math.ceil(math.log(1 - RECALL) / math.log(1 - threshold * q))


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())],
                    names=["doc_id", "set_hash", "n", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, set_hash binary, n int, sketch binary")


def _token(sketch_col: str, at: Column) -> Column:
    return F.substring(F.col(sketch_col), at * 2 + 1, F.lit(2))


def _first_paths(records: DataFrame, runs: int) -> DataFrame:
    """(path, rec): each record once a run, on the path of one sampled token."""
    order = np.random.default_rng(13).permutation(TOKENS)
    picks = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(int(order[r % TOKENS])).alias("at")) for r in range(runs)))
    return records.select("rec", "sketch", F.explode(picks).alias("p")).select(F.xxhash64("p.run", "p.at", F.expr("substring(sketch, p.at * 2 + 1, 2)")).alias("path"), "rec")


def _agreement(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given pairs of numbers under n."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _compare_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path: brute force by sketch in each bucket; the links that join what belongs together."""
    now, ids, sketches, out = None, [], [], ([], [])

    def bucket() -> None:
        m = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, TOKENS)
        i, j = np.triu_indices(len(ids), 1)
        alike = (m[i] == m[j]).mean(1) >= LINK
        for x, y in _forest(i[alike], j[alike], len(ids)):
            out[0].append(ids[x])
            out[1].append(ids[y])

    def batch() -> pa.RecordBatch:
        nonlocal out
        b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
        out = ([], [])
        return b

    for b in batches:
        for path, rec, s in zip(*(b.column(n).to_pylist() for n in ("path", "rec", "sketch")), strict=True):
            if path != now:
                if len(ids) > 1:
                    bucket()
                now, ids, sketches = path, [], []
            ids.append(rec)
            sketches.append(s)
        if len(out[0]) > 5000:
            yield batch()
    if len(ids) > 1:
        bucket()
    yield batch()


def _split_large(level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            paths, recs, pivots = (b.column(n).to_numpy() for n in ("path", "rec", "pivot"))
            m = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u2").reshape(-1, TOKENS)
            p = np.frombuffer(b"".join(b.column("pivot_sketch").to_pylist()), "<u2").reshape(-1, TOKENS)
            same = (m == p).mean(1)
            link = (recs != pivots) & ((same >= PIVOT_LINK) | last)
            ends, a, c = [np.zeros(link.sum(), np.int64)], [recs[link]], [pivots[link]]
            if not last:
                go = same < CLOSE
                for k in (0, 1):
                    # the token is sampled by the path, so all of a bucket split on the same one
                    at = np.array([xxhash.xxh32_intdigest(int(x).to_bytes(8, "little", signed=True), 2 * level + k) % TOKENS for x in paths[go].tolist()], np.int64)
                    value = m[go][np.arange(len(at)), at] if len(at) else np.zeros(0, np.uint16)
                    child = [xxhash.xxh64_intdigest(f"{x} {t} {v}", level) - 2**63 for x, t, v in zip(paths[go].tolist(), at.tolist(), value.tolist(), strict=True)]
                    ends.append(np.ones(len(child), np.int64))
                    a.append(np.array(child, np.int64))
                    c.append(recs[go])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ends, a, c)], names=["kind", "a", "b"])

    return run


def proposed(records: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between records that share buckets and look alike; records: (rec, sketch)."""
    spark = records.sparkSession
    rows = common.written(_first_paths(records, runs_needed(threshold)), "paths1")
    edges = None
    for level in range(1, DEPTH + 1):
        counts = rows.groupBy("path").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("rec", "path"), "rec"))["rec"].alias("pivot")).where("size > 1")
        counts = common.written(counts, f"buckets{level}")
        met = common.written(rows.join(counts, "path"), f"met{level}")
        small = met.where(F.col("size") <= SMALL).select("path", "rec").join(records, "rec")
        links = small.repartition(common.partitions(spark), "path").sortWithinPartitions("path", "rec").mapInArrow(_compare_small, "a long, b long")
        edges = links if edges is None else edges.union(links)
        large = met.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        pivots = records.select(F.col("rec").alias("pivot"), F.col("sketch").alias("pivot_sketch")).join(large.select("pivot").distinct(), "pivot", "left_semi")
        pivots = common.written(pivots, f"pivots{level}")
        faced = large.select("path", "rec", "pivot").join(records, "rec").join(pivots, "pivot")
        done = common.written(faced.mapInArrow(_split_large(level, level == DEPTH), "kind long, a long, b long"), f"split{level}")
        edges = edges.union(done.where("kind = 0").select("a", "b"))
        rows = done.where("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("rec"))
    return edges


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Shingles that occur in the same sets count as one with a weight."""
    n = len(sets)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    sign = np.random.default_rng(17).integers(0, 2**63, n, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(values)))
    if not len(first):
        return np.zeros((n, n), np.float32)
    pattern = np.add.reduceat(sign[owner], first)
    shared = times > 1
    _, at, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    starts, lengths = first[shared][at], times[shared][at]
    out = np.diag(np.array([len(s) for s in sets], np.float32))
    both = np.zeros((n, n), np.float32)
    for lo in range(0, len(starts), 1024):
        st, ln, w = starts[lo : lo + 1024], lengths[lo : lo + 1024], weight[lo : lo + 1024]
        a = np.zeros((n, len(st)), np.float32)
        col = np.repeat(np.arange(len(st)), ln)
        pos = np.repeat(st, ln) + np.arange(ln.sum()) - np.repeat(np.cumsum(ln) - ln, ln)
        a[owner[pos], col] = 1
        both += (a * w.astype(np.float32)) @ a.T
    np.fill_diagonal(both, np.diag(out))
    return both


def _block_links(threshold: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        recs, block = t.column("rec").to_numpy(), t.column("block").to_numpy()
        copies = t.column("copies").to_numpy().astype(np.int64)
        order = np.lexsort((recs, block))
        recs, block, copies = recs[order], block[order], copies[order]
        sets = t.column("shingles").to_pylist()
        sets = [np.frombuffer(sets[k], "<u8") for k in order.tolist()]
        both = _overlaps(sets)
        n = np.array([len(s) for s in sets], np.float64)
        near = np.zeros(both.shape, bool)
        for lo in range(0, len(n), 256):  # a strip at a time in double precision
            strip = both[lo : lo + 256].astype(np.float64)
            near[lo : lo + 256] = strip >= threshold * (n[lo : lo + 256, None] + n - strip) - 1e-9
        del both
        near &= n[:, None] + n > 0
        np.fill_diagonal(near, False)
        if i != j:  # within a block the pairs are counted by that block's own group
            near &= block[:, None] != block
        links = near @ copies
        r, c = np.nonzero(np.triu(near))
        edges = _forest(r, c, len(recs))
        linked = np.flatnonzero(links)
        kind = [0] * len(linked) + [1] * len(edges)
        a = [*recs[linked].tolist(), *(int(recs[x]) for x, _ in edges)]
        b = [*links[linked].tolist(), *(int(recs[y]) for _, y in edges)]
        return pa.Table.from_arrays([pa.array(kind, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    return run


def _sieved(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` parted: those whose number ``key`` may be among ``ids`` (id), by a few bits of its hash that all tasks are
    sent, and those where it is not. So only the former, with their texts, need to be moved to meet ``ids``; with more ids
    than ``SIEVE`` has bits for, more of them are moved in vain."""
    ids = common.written(ids.select(F.col("id").cast("long")), "ids")
    words = min(SIEVE[1], max(SIEVE[0], ids.count() // 4))  # 16 bits an id
    word = lambda c: F.pmod(F.xxhash64(c.cast("long"), F.lit(6)), F.lit(words))
    bit = lambda c: F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(63)), F.lit(-(1 << 63))), F.pmod(F.xxhash64(c.cast("long"), F.lit(7)), F.lit(64)).cast("int") + 1)
    bits = common.written(ids.groupBy(word(F.col("id")).alias("word")).agg(F.bit_or(bit(F.col("id"))).alias("bits")), "sieve")
    there = (word(rows[key]) == bits["word"]) & (bits["bits"].bitwiseAND(bit(rows[key])) != 0)
    return rows.join(F.broadcast(bits), there, "left_semi"), rows.join(F.broadcast(bits), there, "left_anti")


def _with_sets(rows: DataFrame) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name != "text"]
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
                # a doc_id may stand for several texts: only the record's own set goes on
                own = pa.array([xxhash.xxh3_128_digest(s) == h for s, h in zip(sets, part.column("set_hash").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(sets, pa.binary())], names=[*(f.name for f in kept), "shingles"]).filter(own)

    return rows.mapInArrow(run, StructType([*kept, StructField("shingles", BinaryType())]))


def _tightened(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """``members`` (rec, component, size) of loose components, parted so that no two records within the threshold are.

    Order a component's shingles by the number of its records that have them. Of two sets with Jaccard index t or more,
    the n - ceil(t n) + 1 rarest shingles of each have one in common. So records that share such a shingle stay together,
    and texts that share only what is common among them do not.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets = [np.frombuffer(x, "<i8") for x in part.column("shingles").to_pylist()]
                n = np.array([len(x) for x in sets])
                at = pa.array(np.repeat(np.arange(len(sets)), n))
                yield pa.RecordBatch.from_arrays([part.column("rec").take(at), part.column("component").take(at), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], names=["rec", "component", "n", "shingle"])

    spread_out = common.written(sets_of(members.select("rec", "component")).mapInArrow(spread, "rec long, component long, n long, shingle long"), "shingles")
    # a shingle that one record has comes first in the order and joins nothing
    held = spread_out.groupBy("component", "shingle").agg(F.count("*").alias("times"), F.min("rec").alias("head")).where("times > 1")
    shared = spread_out.join(held, ["component", "shingle"]).groupBy("rec", "n").agg(F.array_sort(F.collect_list(F.struct("times", "shingle", "head"))).alias("s"))  # a text's own shingles
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("s"))
    heads = shared.select("rec", F.explode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select(F.col("rec").alias("a"), F.col("x.head").alias("b")).where("a <> b")
    parts = common.connected_components(heads.distinct())
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return parts.join(sizes, "component").select(F.col("node").alias("rec"), "component", "size")


def _loose(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(component): those of more than ``LOOSE`` records less than half of which agree with their first record in
    ``ALIKE`` of the sketch: few of their pairs can be links. The others' pairs mostly are, and must be counted anyway."""
    large = members.where(F.col("size") > LOOSE)
    heads = sketches.join(large.select(F.col("component").alias("rec")).distinct(), "rec").select(F.col("rec").alias("component"), F.col("sketch").alias("head"))

    def agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, h = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, TOKENS) for c in ("sketch", "head"))
            yield pa.RecordBatch.from_arrays([b.column("component"), pa.array((a == h).mean(1) >= ALIKE)], names=["component", "alike"])

    faced = large.join(sketches, "rec").join(heads, "component").select("component", "sketch", "head")
    return faced.mapInArrow(agreement, "component long, alike boolean").groupBy("component").agg(F.avg(F.col("alike").cast("int")).alias("share")).where("share < 0.5").select("component")


def _records(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sketches, a row a row of ``docs``; records: rec, set_hash, first_id, copies, component, links)."""
    sketched = common.written(_sketched(docs), "sketches")
    known = sketched.where("doc_id is not null")
    # one record per distinct set, named by its smallest doc_id
    records = known.groupBy("set_hash").agg(F.min("doc_id").alias("rec"), F.count("*").alias("copies"))
    records = common.written(records, "records")
    # rows that share a doc_id can name several records; a record's sketch goes with its set
    with_sketch = records.join(known.select(F.col("doc_id").alias("rec"), "set_hash", "n", "sketch"), ["set_hash", "rec"]).groupBy("set_hash").agg(F.first("rec").alias("first_id"), F.first("copies").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("times"))
    with_sketch = common.written(with_sketch.select("set_hash", F.xxhash64("set_hash").alias("rec"), "first_id", "copies", "n", "sketch", "times"), "sets")
    edges = proposed(with_sketch.where("n > 0").select("rec", "sketch"), threshold)
    parts = common.written(common.connected_components(edges), "parts")
    sizes = common.written(parts.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = common.written(parts.join(sizes, "component").select(F.col("node").alias("rec"), "component", "size"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string").alias("text"))
    repeated = common.written(with_sketch.where("times > 1").select("first_id").distinct(), "repeated")
    if not repeated.isEmpty():  # of rows that repeat a doc_id and text one goes on, before a text is moved
        again = texts.join(repeated, "first_id", "left_semi").dropDuplicates(["first_id", "text"])
        texts = texts.join(repeated, "first_id", "left_anti").unionByName(again)

    def sets_of(rows: DataFrame) -> DataFrame:
        """``rows`` (rec, ...) with the record's shingles."""
        named = common.written(rows.join(with_sketch.select("rec", "first_id", "set_hash"), "rec"), "named")
        wanted = named.join(_sieved(texts, "first_id", named.select(F.col("first_id").alias("id")))[0], "first_id")
        found = _with_sets(wanted.select(*rows.columns, "set_hash", "text")).drop("set_hash")
        return found if repeated.isEmpty() else found.dropDuplicates(["rec"])  # texts that differ in white space only have one set

    if not members.where(F.col("size") > LOOSE).isEmpty():
        loose = common.written(_loose(members, with_sketch.select("rec", "sketch")), "loose")
        if not loose.isEmpty():
            tight = _tightened(members.join(loose, "component", "left_semi"), sets_of, threshold)
            members = common.written(members.join(loose, "component", "left_anti").select("rec", "component", "size").unionByName(tight), "tight")
    # a record goes to as many block pairs as there are blocks, so blocks grow with the component up to BLOCK
    n_blocks = F.greatest(F.least(F.ceil(F.col("size") / SMALL_BLOCK), F.lit(SPREAD)), F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = members.join(with_sketch.select("rec", "copies"), "rec").withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("rec", F.lit(5)), F.col("blocks")).cast("int"))
    placed = sets_of(placed.select("rec", "component", "copies", "blocks", "block"))
    placed = placed.select("rec", "component", "copies", "block", "shingles", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))).alias("p"))
    compared = placed.select("component", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "rec", "copies", "block", "shingles").groupBy("component", "i", "j").applyInArrow(_block_links(threshold), "kind long, a long, b long")
    compared = common.written(compared, "compared")
    links = compared.where("kind = 0").groupBy(F.col("a").alias("rec")).agg(F.sum("b").alias("links"))
    classes = common.connected_components(compared.where("kind = 1").select("a", "b"))
    named = with_sketch.select("rec", "set_hash", "first_id", "copies").join(classes.select(F.col("node").alias("rec"), "component"), "rec", "left").withColumn("component", F.coalesce("component", "rec"))
    return sketched, common.written(named.join(links, "rec", "left"), "named")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each row of ``docs``."""
    with common.scratch(docs.sparkSession):
        sketched, named = _records(docs, threshold)
        known = sketched.where("doc_id is not null")
        smallest = common.written(named.groupBy("component").agg(F.min("first_id").alias("class_id")), "smallest")
        result = common.written(named.join(smallest, "component").select("set_hash", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
        out = known.select("doc_id", "set_hash").join(result, "set_hash").select("doc_id", "class_id", "n_links")
        return common.kept(out.union(sketched.where("doc_id is null").select("doc_id", F.lit(None).cast("long"), F.lit(0).cast("long"))), "links")


def _with_set_hash(rows: DataFrame, mark: str) -> DataFrame:
    from pyspark.sql.types import BinaryType, StructField, StructType

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [xxhash.xxh3_128_digest(shingles(t).tobytes()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(hashes, pa.binary())], names=[*names, mark])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(mark, BinaryType())]))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` but for those that are like an earlier one: of each class the row with the smallest
    doc_id stays (one of them where rows repeat). A doc_id with texts of several classes can stay once for each.
    Rows with a null doc_id stay."""
    with common.scratch(docs.sparkSession):
        heads, repeated, gone = _heads(docs, threshold)
    may, stays = _sieved(docs, "doc_id", gone.select(F.col("doc_id").alias("id")))
    kept = stays.where("doc_id is not null").unionByName(may.where("doc_id is not null").join(gone, "doc_id", "left_anti")).unionByName(docs.where("doc_id is null"))
    if repeated.isEmpty():
        return kept
    # the doc_id alone doesn't tell the row: its set does
    mark = next(f"_set{i}" for i in range(len(docs.columns) + 1) if f"_set{i}" not in docs.columns)
    several = _with_set_hash(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns), mark).join(heads.withColumnRenamed("set_hash", mark), ["doc_id", mark], "left_semi")
    return kept.unionByName(several.dropDuplicates(["doc_id", mark]).select(*docs.columns))


def _heads(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id and set_hash of each class's row that stays, doc_ids that come more than once, those and the doc_ids of
    which no row stays)."""
    sketched, named = _records(docs, threshold)
    heads = named.groupBy("component").agg(F.min(F.struct("first_id", "set_hash")).alias("h")).select(F.col("h.first_id").alias("doc_id"), F.col("h.set_hash").alias("set_hash"))
    repeated = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    heads, repeated = common.kept(heads, "heads"), common.kept(repeated, "repeated")
    gone = sketched.where("doc_id is not null").select("doc_id").join(heads, "doc_id", "left_anti").union(repeated).distinct()
    return heads, repeated, common.kept(gone, "gone")


def query(docs: DataFrame) -> DataFrame:
    return join(docs)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM d),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(g, lambda x: hash(x)))) AS s FROM grams),
rec AS MATERIALIZED (SELECT s, row_number() OVER () AS sid, min(doc_id) AS first_id, count(*) AS copies FROM sets GROUP BY s),
tok AS (SELECT sid, len(s) AS n, unnest(s) AS h FROM rec),
joint AS (SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM tok a JOIN tok b ON a.h = b.h AND a.sid <> b.sid GROUP BY a.sid, b.sid),
near AS MATERIALIZED (SELECT a, b FROM joint WHERE c >= 0.8::DOUBLE * (na + nb - c) - 1e-9),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
class AS (SELECT rec.sid, least(rec.first_id, min(o.first_id)) AS class_id FROM rec LEFT JOIN reach ON reach.a = rec.sid LEFT JOIN rec o ON o.sid = reach.b GROUP BY rec.sid, rec.first_id),
links AS (SELECT rec.sid, rec.copies - 1 + coalesce(sum(o.copies), 0) AS n FROM rec LEFT JOIN near ON near.a = rec.sid LEFT JOIN rec o ON o.sid = near.b GROUP BY rec.sid, rec.copies)
SELECT sets.doc_id, class_id, CAST(links.n AS BIGINT) AS n_links FROM sets JOIN rec ON sets.s = rec.s JOIN class USING (sid) JOIN links USING (sid)
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE doc_id IS NULL
"""
