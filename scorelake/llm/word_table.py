"""BPE through a table of distinct words: each is encoded once, and its ids are joined back by position.

A word is a run between white space, as the tokenizer's normalizer sees white space, so the ids of a text are the
ids of its words one after another (the vocabulary drops white space and no merge crosses it). Steps:

1. Each task cuts its rows into chunks and lists each chunk's distinct words, dealt into buckets by hash; the list
   of a (chunk, bucket) is one packed row.
2. A bucket's rows of all chunks meet: each distinct word is encoded once, its ids are turned into pieces by
   look-up in the id-to-piece table (as large as the vocabulary, never larger), and the answers go back in the
   order of the packed words.
3. A chunk's answers meet its texts (moved once, compressed), and ids are joined back by the words' positions.

Steps 1 and 3 read the input twice and name chunks by partition and running number; ``docs`` must therefore give
the same partitions each time, as a table scan does. Pass ``stable=False`` for anything else: it is then written
to the shared folder first. A word that is missing in step 3 raises an error.

Defined cases: a null text is an empty one and has no ids; texts are encoded whole; repeated rows each give a row;
an empty table gives none; extra columns are ignored; equal doc_ids need not have equal texts.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common

CHUNK_CHARS = 12_000_000
MOST_BUCKETS = 2048
#: Distinct words that a task holds at once; beyond it the table of the bucket starts anew.
MOST_HELD = 1_000_000
#: Characters that Python splits at but the tokenizer keeps.
_KEPT_CONTROLS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
_loaded: dict[str, object] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _loaded[path] = t
    return _loaded[path]


def pieces(path: str) -> list[str | None]:
    """The id-to-piece table."""
    if (path, "pieces") not in _loaded:
        t = tokenizer(path)
        _loaded[path, "pieces"] = [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]
    return _loaded[path, "pieces"]


def split_words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _KEPT_CONTROLS.search(text) else text.split()


def _word_ends(path: str) -> np.ndarray:
    """Whether a token ends a word of the tokenizer, by id."""
    if (path, "ends") not in _loaded:
        _loaded[path, "ends"] = np.array([bool(p) and p.endswith("</w>") for p in pieces(path)])
    return _loaded[path, "ends"]


def ids_of_words(words: list[str], path: str) -> list[bytes]:
    """Ids of each word (as ``split_words`` gives them), as little-endian unsigned 32-bit integers.

    Plain words, letters with at most one sign behind, hold one or two words of the tokenizer, so many can be
    encoded as one text and told apart by the tokens that end words. The rest is encoded word by word.
    """
    t, ends = tokenizer(path), _word_ends(path)
    out: list[bytes] = [b""] * len(words)
    plain, held, odd = [], [], []
    for i, w in enumerate(words):
        if w.isalpha():
            plain.append(i)
            held.append(1)
        elif w[-1] in ".,!?;:" and w[:-1].isalpha():
            plain.append(i)
            held.append(2)
        else:
            odd.append(i)
    for lo in range(0, len(plain), 5000):
        part, n = plain[lo : lo + 5000], np.array(held[lo : lo + 5000])
        ids = np.array(t.encode_batch_fast([" ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != n.sum():  # a letter that falls apart in lower case
            odd += part
            continue
        raw, at = ids.tobytes(), 0
        for i, stop in zip(part, (4 * stops[np.cumsum(n) - 1]).tolist(), strict=True):
            out[i] = raw[at:stop]
            at = stop
    for i, e in zip(odd, t.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(chunk, doc_ids, texts); the chunk's name is the partition and a running number."""
    part, n = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1]) + 50
            if size >= CHUNK_CHARS:
                yield part << 32 | n, ids, texts
                ids, texts, size, n = [], [], 0, n + 1
    if ids:
        yield part << 32 | n, ids, texts


def _words_by_bucket(texts: list[str], buckets: int) -> dict[int, list[str]]:
    """The distinct words of a chunk in a fixed order in each bucket."""
    distinct = set()
    for t in texts:
        distinct.update(split_words(t))
    out: dict[int, list[str]] = {}
    for w in sorted(distinct):
        out.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
    return out


def _packed_ids(groups: list[bytes], path: str) -> tuple[bytes, bytes]:
    """(numbers of ids, ids) of the words, as little-endian arrays."""
    flat = np.frombuffer(b"".join(groups), "<u4")
    if len(pieces(path)) <= 65536:
        flat = flat.astype("<u2")
    return (np.fromiter(map(len, groups), "<u4", len(groups)) // 4).astype("<u4").tobytes(), flat.tobytes()


def _unpacked_ids(lengths: bytes, ids: bytes, path: str) -> list[list[int]]:
    ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
    flat = np.frombuffer(ids, "<u2" if len(pieces(path)) <= 65536 else "<u4").tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def word_answers(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows (chunk, bucket, lengths, ids): the ids of a packed word list's words, in the list's order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _chunks(batches):
            by = _words_by_bucket(texts, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(by), pa.int64()), pa.array(list(by), pa.int32()), pa.array(["\n".join(v) for v in by.values()], pa.string())],
                names=["chunk", "bucket", "words"],
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are sorted by bucket: what is held is one bucket's distinct words
        now, known = None, {}
        for b in batches:
            for chunk, bucket, words in zip(*(b.column(n).to_pylist() for n in ("chunk", "bucket", "words")), strict=True):
                if bucket != now or len(known) > MOST_HELD:
                    now, known = bucket, {}
                listed = words.split("\n")
                new = [w for w in listed if w not in known]
                known.update(zip(new, ids_of_words(new, path), strict=True))
                lengths, ids = _packed_ids([known[w] for w in listed], path)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([lengths], pa.binary()), pa.array([ids], pa.binary())], names=["chunk", "bucket", "lengths", "ids"])

    packed = docs.mapInArrow(pack, "chunk long, bucket int, words string")
    met = packed.repartition(common.partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "chunk")
    return met.mapInArrow(encode, "chunk long, bucket int, lengths binary, ids binary")


def encode(docs: DataFrame, path: str | None = None, stable: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded as the tokenizer
    decodes them (pieces with a space between; this vocabulary has no decoder of its own)."""
    path = path or vocabulary_path()
    return _joined(docs, path, stable, _whole, "doc_id long, n_tokens long, ids binary, decoded string")


def _whole(doc_id, ids: bytes, decoded: str) -> tuple:
    return doc_id, len(ids) // 4, ids, decoded


def _digests(doc_id, ids: bytes, decoded: str) -> tuple:
    return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _joined(docs: DataFrame, path: str, stable: bool, make, schema: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not stable:
        rows = common.written(rows, "texts")
    buckets = min(MOST_BUCKETS, 4 * common.partitions(spark))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for chunk, ids, texts in _chunks(batches):
            raw = [t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, raw))], pa.list_(pa.int32())), pa.array([squeeze.compress(b"".join(raw))], pa.binary())],
                names=["chunk", "doc_ids", "sizes", "texts"],
            )

    def assemble(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        piece = pieces(path)
        for b in blocks.to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(b["texts"]) if sum(b["sizes"]) else b""
            ends = np.cumsum(b["sizes"]).tolist()
            texts = [raw[x:y].decode() for x, y in zip([0, *ends], ends, strict=False)]
            by = _words_by_bucket(texts, buckets)
            coded, spelled = {}, {}
            for bucket, lengths, ids in zip(*(answers.column(n).to_pylist() for n in ("bucket", "lengths", "ids")), strict=True):
                words = by.pop(bucket)
                for w, g in zip(words, _unpacked_ids(lengths, ids, path), strict=True):
                    coded[w] = struct.pack(f"<{len(g)}I", *g)
                    spelled[w] = " ".join([piece[i] for i in g])
            if by:
                raise RuntimeError(f"chunk {b['chunk']} differs between two readings; use stable=False")
            for doc_id, t in zip(b["doc_ids"], texts, strict=True):
                words = split_words(t)
                decoded = " ".join(map(spelled.__getitem__, words))
                out.append(make(doc_id, b"".join(map(coded.__getitem__, words)), decoded))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    blocks = rows.mapInArrow(block, "chunk long, doc_ids array<long>, sizes array<int>, texts binary")
    answers = word_answers(rows, path, buckets)
    return blocks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, schema)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with a column ``decoded`` for its array of ids: an id-to-piece join, put together again by position.

    The piece table is as large as the vocabulary. A null array decodes to null, an empty one to the empty text,
    an unknown id is left out. Rows are told apart by a running number, so repeated rows stay.
    """
    spark = rows.sparkSession
    path = path or vocabulary_path()
    table = spark.createDataFrame([(i, p) for i, p in enumerate(pieces(path)) if p is not None], "piece_id long, piece string")
    numbered = common.written(rows.withColumn("row_no", F.monotonically_increasing_id()), "ids")
    at = numbered.select("row_no", F.posexplode(ids).alias("pos", "piece_id"))
    texts = at.join(F.broadcast(table), "piece_id").groupBy("row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
    out = numbered.join(texts, "row_no", "left").drop("row_no")
    return out.withColumn("decoded", F.when(F.col(ids).isNotNull(), F.coalesce("decoded", F.lit(""))))


def query(docs: DataFrame) -> DataFrame:
    return _joined(docs, vocabulary_path(), True, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
