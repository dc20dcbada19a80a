"""Corpus pipeline: toxic documents go, one of each group of near copies stays, documents that hold
benchmark items go, secrets are masked, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontamination, minhash, packing, secrets, toxicity
from wayfare.llm.common import forget, fresh, settled, ship, short_batches, stored, text_or_empty
from wayfare.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows of the tables, doesn't reject."""
    ship(spark)
    short_batches(spark)
    columns = docs.columns
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(known, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where("predicted = 0").select(*[F.col(f"`{c}`") for c in columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at 0.8. Rows without
    an id, and further texts of one id, are documents of their own that come after all others; rows
    alike in id and text are one. Blank rows without an id link with nothing and stay."""
    ship(spark)
    key, salt, again, low, gone = fresh(docs, "row_key", "row_salt", "again_id", "low_text", "gone_key")
    text = F.xxhash64(text_or_empty())
    texts = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(again)).agg(F.min(text).alias(low), F.max(text).alias("high"))
    mixed = stored(texts.where(F.col(low) < F.col("high")).select(again, low), "mixed-ids")
    named = F.col("doc_id").isNotNull() & (F.col(low).isNull() | (text == F.col(low)))
    other = F.shiftrightunsigned(F.xxhash64("doc_id", text_or_empty()), 2).bitwiseOR(F.lit(1 << 62))
    keyed = docs.join(mixed, F.col("doc_id") == F.col(again), "left").withColumn(key, F.when(named, F.col("doc_id").cast("long")).otherwise(other))
    found = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), width=5)
    lost = found.where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    blank = F.col("doc_id").isNull() & text_or_empty().rlike(r"^[\x20\x09-\x0D]*\z")
    left = keyed.join(lost, F.col(key) == F.col(gone), "left_anti").withColumn(salt, F.when(blank, F.monotonically_increasing_id()))
    return left.dropDuplicates([key, salt]).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontamination.find_leaks(docs, items)
    return found.where(F.size("leaks") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path(), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: A learned classifier, BM25 and a genetic algorithm: not SQL. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through every stage; each result is written and read again, and what the stages before
    have written is removed.

    Null and empty texts pass every stage and end as a piece that is their end id alone; a null id is
    carried through; an empty table gives no rows; extra columns stay up to the last stage, whatever
    their names. Rows alike in id and text become one in the second stage; texts alike but for their
    ids, the one of the smallest id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda own=docs, stage=stage: stage(spark, own, sf_dir), f"stage-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
