"""What the queries of older operators give, held against the libraries and plain code."""

import hashlib
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scorelake.llm import common, packing, word_table

DATA = "/root/testdata/sf0.001"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "İIi ΑΣ it's don't'll <|endoftext|>"), (10**6 + 3, "é́ 　x\x1cy " * 3000), (10**6 + 4, "a"), (10**6 + 4, "b")]


@pytest.fixture(scope="module")
def table(spark):
    common.prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    return docs.withColumns({"chunk": F.lit("x"), "ids": F.lit(1), "sizes": F.lit(2), "sequence_id": F.lit(3), "words": F.lit("w")})


def test_decoded_texts_of_the_query_equal_the_tokenizer(table):
    t = word_table.tokenizer(word_table.vocabulary_path())

    def plain(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    want = sorted((r["doc_id"], *plain(r["text"])) for r in table.collect())
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_table.query(table).collect())
    assert got == want


@pytest.mark.parametrize("block", [3, 4000])
def test_packing_over_several_greedy_blocks(table, monkeypatch, block):
    """Every token once and in order, no gap and no sequence that is too long, whatever the number of blocks."""
    monkeypatch.setattr(packing, "BLOCK", block)
    t = word_table.tokenizer(word_table.vocabulary_path())
    rows = [r for r in table.collect() if r["doc_id"] != 10**6 + 4]
    want = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packing.query(table).collect():
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by_doc.pop(10**6 + 4)) == 2 and by_doc.keys() == want.keys()
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            ids = want[k][at : at + p["length"]]
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
            at += p["length"]
        assert at == len(want[k])
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
