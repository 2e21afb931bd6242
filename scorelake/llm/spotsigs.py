"""SpotSigs: chains of content words that follow common-word anchors form a document's signatures.

A signature is an anchor with the next ``CHAIN`` content words (words that are no anchors), hashed to 32 bits. A
document's fingerprint is its set of signatures. Likeness is the Jaccard index of two sets. Where more than ``GAP``
words pass without an anchor (tables, lists, writing without the anchors), each word starts a chain of its own, and
words of more than ``LONG`` characters (writing without spaces) also give their runs of eight characters. Both rules
look at the neighbourhood only, so an edit elsewhere changes nothing. A text without a word gives its runs of five
signs. Two empty sets are alike (1.0), an empty and a full one are not (0.0).

``near_duplicates`` finds all texts whose likeness is at least ``LEAST``. Equal fingerprints are one record. Records are
partitioned by the length of their sets, so that those a pair can be alike to lie in the same or the next partition;
there, records that share one of their rarest signatures meet (a pair at the threshold always does), in blocks of
``BLOCK`` records, and are compared from the nearest length down, as far as the lengths allow. Records that are linked
already are not compared again, so a block sends links that span its groups, not pairs. No list of a signature is cut.

Defined cases: a null text is an empty one; whole texts are read whatever their length; repeated rows are
fingerprinted one by one; an empty table gives no rows; extra columns are ignored. In ``query`` a null doc_id comes last
in descending order, rows with the same doc_id follow one another by text. In ``near_duplicates`` rows with a null
doc_id are returned with a null class_id and take no part; texts with no signature are one class.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common

FINGERPRINTS = "doc_id long, digest binary, n int, sigs binary"
EDGES = "a long, b long"

#: Frequent function words of the corpus languages; fixed values.
ANCHORS = frozenset(
    "the of and to in is that for it was on are with this be by an at from or "
    "der die das und den ist nicht mit von ein eine zu im auf "
    "le la les et des du est un une que qui dans pour pas sur "
    "el los las en y que por con se una lo como".split()
)
CHAIN = 2
GAP = 8
LONG = 24
LEAST = 0.8
BLOCK = 1024
#: Signatures whose share of all postings is larger than one in this number count as frequent: never more than this.
MOST_FREQUENT = 100_000
_WORD = re.compile(r"\w+")
PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def signatures(text: str) -> np.ndarray:
    """Sorted distinct signatures (uint32) of a text."""
    words = _WORD.findall(text.lower())
    content = [w for w in words if w not in ANCHORS]
    found = set()
    k, since = 0, GAP + 1  # content words so far; words since the last anchor
    for w in words:
        if w in ANCHORS:
            found.add(f"{w} {' '.join(content[k : k + CHAIN])}")
            since = 0
        else:
            if since > GAP:
                found.add(f"- {' '.join(content[k : k + 1 + CHAIN])}")
            if len(w) > LONG:
                found.update(w[i : i + 8] for i in range(len(w) - 7))
            k += 1
            since += 1
    if not words:
        flat = "".join(text.split())
        found.update(flat[i : i + 5] for i in range(max(1, len(flat) - 4)) if flat)
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found)))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard index; 0.0 without a look at the members where the sizes alone rule out ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written_form(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def chunk_bounds(ids: DataFrame, chunks: int) -> list[int]:
    """Limits that cut the ids into about ``chunks`` ranges; as many numbers at most go to the driver."""
    if chunks < 2:
        return []
    return sorted({int(x) for x in ids.approxQuantile("doc_id", [i / chunks for i in range(1, chunks)], 0.25 / chunks)})


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (chunk, doc_id, text, guest) sorted so that each row's successor in descending doc_id follows it in its chunk.

    The ids are cut into ranges; the first row of the range below is a guest at the end of each range. Ids, not
    texts, find those guests, and each text moves once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunks = 4 * common.partitions(spark)
    bounds = chunk_bounds(rows.select("doc_id").where("doc_id is not null"), chunks)
    chunk = _chunk_of("doc_id", bounds)
    rows = rows.withColumn("chunk", chunk)
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    firsts = {r["chunk"]: r["top"] for r in rows.groupBy("chunk").agg(F.max(key).alias("top")).collect()}  # a row per chunk
    used = sorted(firsts)
    # the highest row of a chunk is guest in the next used chunk above; that of the topmost chunk in the lowest
    host = {c: (used[i + 1] if i + 1 < len(used) else used[0]) for i, c in enumerate(used)}
    tops = spark.createDataFrame([(c, firsts[c], host[c]) for c in used], "chunk int, top long, host int") if used else spark.createDataFrame([], "chunk int, top long, host int")
    marked = rows.join(F.broadcast(tops), "chunk")  # a row per chunk: as many as four times the partitions at most
    placed = marked.select(
        "doc_id",
        "text",
        F.explode(F.when(key == F.col("top"), F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("chunk"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("guest"))))).alias("p"),
    ).select("p.chunk", "doc_id", "text", "p.guest")
    return placed.repartition(common.partitions(spark), "chunk").sortWithinPartitions("chunk", "guest", F.desc_nulls_last("doc_id"), "text")


def _chunk_of(column: str, bounds: list[int]) -> Column:
    """Number of bounds at or below the value (null: 0)."""
    at = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    return F.coalesce(F.size(F.filter(at, lambda b: b <= F.col(column))), F.lit(0))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it; a guest only follows."""
    out, last = [], None

    def flush() -> pa.RecordBatch:
        nonlocal out
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in PAIRS.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)
        out = []
        return batch

    for b in batches:
        for chunk, doc_id, text, guest in zip(*(b.column(n).to_pylist() for n in ("chunk", "doc_id", "text", "guest")), strict=True):
            s = signatures(text)
            if last is not None and last[0] == chunk:
                _, prev_id, prev, mine = last
                half = len(prev) // 2
                edited = prev[: len(prev) - half] + text[:half]
                e = mine if edited == prev else signatures(edited)
                out.append((prev_id, len(prev), hashlib.sha256(edited.encode()).hexdigest(), written_form(mine), written_form(e), likeness(mine, e), likeness(mine, s), len(mine)))
                if len(out) >= 500:
                    yield flush()
            last = None if guest else (chunk, doc_id, text, s)
    if out:
        yield flush()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            sets = [signatures(t or "") for t in part.column("text").to_pylist()]
            raw = [s.astype("<u4").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(raw, pa.binary())],
                names=["doc_id", "digest", "n", "sigs"],
            )


def length_partitions(least: float, longest: int) -> list[int]:
    """Least lengths of the partitions: sets that can be alike lie in one partition or in two neighbouring ones."""
    starts = [1]
    while (end := int(starts[-1] / least + 1e-9)) < longest:
        starts.append(end + 1)
    return starts


def _postings(frequent, starts: list[int], least: float):
    """Rows (part, sig, rec, n, guest) of each record's rarest signatures: one of them is in every set alike.

    A record is at home in the partition of its length, and a guest in the next if a set there can be alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value
        begins = np.array(starts)
        out: list[tuple[int, int, int, int, bool]] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "sig", "rec", "n", "guest"])
            out.clear()
            return batch

        for b in batches:
            for rec, raw in zip(b.column("rec").to_pylist(), b.column("sigs").to_pylist(), strict=True):
                s = np.frombuffer(raw, "<u4")
                n = len(s)
                weight = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, often[at], 0)
                rarest = s[np.lexsort((s, weight))[: n - int(np.ceil(least * n - 1e-9)) + 1]].astype(np.int64)
                part = int(np.searchsorted(begins, n, "right")) - 1
                homes = [(part, False)]
                if part + 1 < len(begins) and n >= least * begins[part + 1] - 1e-9:
                    homes.append((part + 1, True))
                out += [(p, sig, rec, n, guest) for p, guest in homes for sig in rarest.tolist()]
                if len(out) > 100_000:
                    yield flush()
        if out:
            yield flush()

    return run


def links(recs: list[int], sets: list[np.ndarray], guest: list[bool], side: list[int] | None, least: float) -> list[tuple[int, int]]:
    """Pairs of records that span the groups of alike ones in a block; ``side``: only pairs across the two sides count."""
    order = sorted(range(len(recs)), key=lambda i: (len(sets[i]), recs[i]))
    recs, sets = [recs[i] for i in order], [sets[i] for i in order]
    away = np.array([guest[i] for i in order])
    half = np.array([side[i] for i in order]) if side else None
    sizes = np.array([len(s) for s in sets])
    group, out = np.arange(len(recs)), []

    def join(i: int, j: int) -> None:
        out.append((recs[i], recs[j]))
        group[group == group[j]] = group[i]

    for i in range(1, len(recs)):
        lo = int(np.searchsorted(sizes, least * sizes[i] - 1e-9))  # shorter sets cannot be alike
        near = np.arange(lo, i)
        near = near[(group[near] != group[i]) & ~(away[near] & away[i])]
        if half is not None:
            near = near[half[near] != half[i]]
        if not len(near):
            continue
        if likeness(sets[i], sets[near[-1]], least) >= least:
            join(i, int(near[-1]))
            near = near[group[near] != group[i]]
        else:
            near = near[:-1]
        if not len(near):
            continue
        flat = np.concatenate([sets[j] for j in near])
        at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
        both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[near])[:-1])))
        for j in near[both / (sizes[near] + sizes[i] - both) >= least].tolist():
            if group[j] != group[i]:
                join(i, j)
    return out


def _block_links(least: float):
    """Links of each block (rows sorted by block); a record that met others under several signatures is compared in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recs, sets, guest, side = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(recs) > 1:
                found = links(recs, sets, guest, side if now[2] != now[3] else None, least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for b in batches:
            for *key, block, rec, away, raw in zip(*(b.column(c).to_pylist() for c in ("part", "sig", "one", "two", "block", "rec", "guest", "sigs")), strict=True):
                if key != now:
                    yield from done()
                    now, recs, sets, guest, side = key, [], [], [], []
                recs.append(rec)
                sets.append(np.frombuffer(raw, "<u4"))
                guest.append(away)
                side.append(block)
        yield from done()

    return run


def near_duplicates(docs: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, class_id), one for each row of ``docs``: class_id is the smallest doc_id that a chain of texts,
    each with a likeness of at least ``least`` to the next, ties to the row."""
    spark = docs.sparkSession
    with common.scratch(spark):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        prints = common.written(rows.mapInArrow(_fingerprints, FINGERPRINTS), "prints")
        one = prints.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sigs").alias("sigs"))
        # numbered before it is written, so the numbers are fixed from then on
        records = common.written(one.withColumn("rec", F.monotonically_increasing_id()), "records")
        edges = _edges(records.select("rec", "n", "sigs").where("n > 0"), least, block)
        component = common.connected_components(edges)
        classed = records.select("digest", "rec", "first_id").join(component.withColumnRenamed("node", "rec"), "rec", "left").withColumn("component", F.coalesce("component", "rec"))
        least_id = classed.groupBy("component").agg(F.min("first_id").alias("class_id"))
        named = classed.join(least_id, "component").select("digest", "class_id")
        found = prints.select("doc_id", "digest").join(named, "digest", "left")
        return common.kept(found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "classes")


def _edges(records: DataFrame, least: float, block: int) -> DataFrame:
    spark = records.sparkSession

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("sigs").to_pylist()), "<u4")
            sig, often = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64)), pa.array(often.astype(np.int64))], names=["sig", "often"])

    size = records.agg(F.sum("n"), F.max("n")).first()
    counts = records.select("sigs").mapInArrow(each, "sig long, often long").groupBy("sig").agg(F.sum("often").alias("often"))
    frequent = counts.where(F.col("often") > max(1, (size[0] or 0) // MOST_FREQUENT)).orderBy("sig").collect()  # MOST_FREQUENT rows at most
    sent = spark.sparkContext.broadcast((np.array([r["sig"] for r in frequent], np.int64), np.array([r["often"] for r in frequent], np.int64)))
    posted = records.select("rec", "sigs").mapInArrow(_postings(sent, length_partitions(least, size[1] or 1), least), "part int, sig long, rec long, n int, guest boolean")
    posted = common.written(posted, "postings")
    met = posted.groupBy("part", "sig").agg(F.count("*").alias("m"), F.min("guest").alias("only_guests")).where("m > 1 and not only_guests")
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int")
    pairs = posted.join(met.withColumn("blocks", blocks), ["part", "sig"]).withColumn("block", own)
    placed = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("part", "sig", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rec", "guest")
    full = placed.join(records.select("rec", "sigs"), "rec")
    key = ["part", "sig", "one", "two"]
    return full.repartition(common.partitions(spark), *key).sortWithinPartitions(*key).select(*key, "block", "rec", "guest", "sigs").mapInArrow(_block_links(least), EDGES)


def query(docs: DataFrame) -> DataFrame:
    return with_next(docs).mapInArrow(_pairs, PAIRS)
