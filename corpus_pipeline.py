"""A corpus for training in five stages: classify, drop near copies, decontaminate, redact, encode.

Each function takes (spark, docs, sf_dir) and returns what the next stage gets; all but the last return the columns of documents.
Every stage keeps null and repeated ids apart by their rows or texts, takes columns of any further names along, passes null and
empty texts on unless it says otherwise, and gives an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import bpe, decontaminate, gbdt, pii, simhash
from crosspanel.llm._rows import documents, fresh, released, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects, which learns from the labelled documents of sf_dir.

    Copies share their fate; null and empty texts are scored like others.  Nothing is shuffled.
    """
    trees = gbdt.fit_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gbdt.good_documents(docs, trees)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the least id, nulls last, and of ties the least by the text's hash and then
    by the other columns.  Copies are told by their texts, so a text that shares its id with another one is not lost; rows without
    a word are one group."""
    key, no, id_, found = (fresh(docs, c) for c in ("copy_text", "copy_no_id", "copy_id", "copy_row"))
    rows = docs.select("*", F.xxhash64("text").alias(key), F.col("doc_id").isNull().alias(no), F.coalesce("doc_id", F.lit(0)).alias(id_))
    groups = simhash.similar_groups(rows, id_col=key).distinct().toDF(key, "group")
    least = rows.groupBy(key).agg(F.min(F.struct(no, id_)).alias("m")).select(key, "m.*")
    best = least.join(groups, key).groupBy("group").agg(F.min(F.struct(no, id_, key)).alias("m")).select("m.*")
    # Rows that are the same in id and text: the least by a digest of the other columns stays.
    # Columns of any type may come along, so rows are ordered by a digest of what they hold.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = F.min_by(whole, F.sha2(F.to_json(whole), 256))
    kept = rows.join(best, [key, no, id_], "left_semi").groupBy(key, no, id_).agg(one.alias(found))
    return kept.select(*[F.col(f"{found}.`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text has a passage of the benchmark.  Null and empty texts have none.  Nothing is shuffled."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows the text (null for null).  Copies are redacted alike."""
    clean = pii.redact_documents(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids_text_equal) of each row: the token ids' digest, that of the bytes that they
    stand for, and whether these are the text.  A null text has no tokens and equals an empty one."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_text_equal")


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminated", decontaminated), ("private", private), ("encoded", encoded)]

#: SQL can express none of the stages; they are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again, and the tables that a stage
    wrote on its way are removed then."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
