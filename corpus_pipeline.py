"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, personal data is masked, and
the rest is packed into sequences. Each stage's rows are written as Parquet and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import chosen_path, common, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, with all their columns.

    A null text is scored as an empty one. Repeated rows have the same score, so all stay or go. An empty table gives no
    rows. Columns of any name are kept as they are. Without labels of both kinds nothing is learned, and all rows stay
    or go by the share of toxic labels.
    """
    labels = common.table(spark, sf_dir, "labels")
    name = next(f"_score{i}" for i in range(len(docs.columns) + 1) if f"_score{i}" not in docs.columns)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), name=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates, with all its columns.

    Null and empty texts are one class. Of repeated rows one stays; other texts that share its doc_id stay where they
    are the smallest of their own class. Rows with a null doc_id stay. An empty table gives no rows.
    """
    common.prepare(spark)
    return chosen_path.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; n_chars, where there is one, follows the text.

    A null text stays null, and its n_chars as well. Other columns, of whatever name, are kept.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text is an empty one, repeated rows are packed one by one."""
    common.prepare(spark)
    return packing.query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: A trained network and a randomised join are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
