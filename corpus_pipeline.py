"""The corpus pipeline: stages over `documents`, each on what the one before kept.

Stages take (spark, docs, sf_dir) and return docs' columns, but for the last.
Nulls, empty texts and repeated rows are handled as the operators say; a row with
a null doc_id passes the stages that remove by doc_id as it is.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import langid, nearjoin, packing, secrets, substrings
from orbweave.llm.common import checkpointed, matching, removed, shared_folder, stored

#: Documents whose language is less sure than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or with a score under LEAST_SCORE go."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs.where(~langid.held_out()), path, "lang", "text", "doc_id")
    told = langid.predict(docs, model, path)
    return told.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates."""
    groups = nearjoin.near_duplicates(docs)
    gone = checkpointed(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return matching(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated windows; documents that lose all their words go."""
    found = substrings.deduplicate(docs)
    changed = checkpointed(found.where((F.col("n_removed") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n_words", "n_removed", "kept").dropDuplicates(["doc_id"]))
    ids = changed.select("doc_id")
    cut = matching(docs, ids, "doc_id").join(changed.where("n_removed < n_words").select("doc_id", "kept"), "doc_id")
    cut = cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))
    return matching(docs, ids, "doc_id", "left_anti").select(*docs.columns).unionByName(cut.select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark."""
    clean = secrets.redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What each keeps is written to the shared folder and
    read as the next one's docs; the table before it is then removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{home}/{name}")
        if before:
            removed(spark, before)
        before = f"{home}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
