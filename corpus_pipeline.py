"""A corpus from raw documents to packed training sequences: five stages, each one operator of fieldweave.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import langid, minhash, packing, secrets, suffixes
from fieldweave.llm.common import Workspace, quoted
from fieldweave.operators.positions import with_positions


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or with a score below 0.5 go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of rows equal in id and text, one. Rows without id stay.

    Different texts of one id are documents of their own, in the order of their SHA-256.
    """
    names = quoted(docs.columns)
    own = docs.where("doc_id is not null")
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = minhash.near_duplicates(docs)
        return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*names)
    work = Workspace(spark, "near_duplicates")
    # The place of (id, text) in their order stands for the id. Inside, columns are named by their place, so that no name can clash.
    given = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    key, text = (F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    given = given.select(key.alias("key"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("sum"), "*")
    numbers = work.save(with_positions(given.where("key is not null").select("key", "sum").distinct(), "key", ("sum",), "nr"), "numbers")
    numbered = work.save(given.join(numbers, ["key", "sum"], "left").drop("key", "sum"), "numbered")
    found = minhash.near_duplicates(numbered, "nr", f"_{docs.columns.index('text')}")
    kept = numbered.where("nr is not null").dropDuplicates(["nr"]).join(found.where("not kept").select("nr").distinct(), "nr", "left_anti")
    kept = kept.unionByName(numbered.where("nr is null"))
    return kept.select(*[f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 100 that start earlier; characters go only whole."""
    return secrets.with_length(suffixes.without_repeats(docs), "text", "n_chars")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secret_scan), ("packing", pack)]

#: SQL can't express tokenizers, learned models or redaction; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
