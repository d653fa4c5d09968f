"""The corpus pipeline: five stages over documents, each written and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.bpe import bpe_encode, digests
from trackloom.llm.classifier import classify
from trackloom.llm.common import Scratch, held_out
from trackloom.llm.curriculum import curriculum_mix
from trackloom.llm.secrets import redact, scan_secrets
from trackloom.llm.trie_join import ngram_join

#: SQL for run()'s rows: none, as a trained network decides which rows there are.
ORACLE_SQL = None
#: Near copies: texts whose sets of words in a row, so many, link at this percentage.
COPY_WORDS, COPY_PERCENT = 5, 80


def _key(docs: DataFrame) -> Column:
    """What tells rows apart: the id where every row has one of its own, else a hash of id and text.

    Rows that share id and text share the key, and so every decision but that
    on copies, of which one stays.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    own = not ids.where("id is null").limit(1).count() and not ids.groupBy("id").count().where("count > 1").limit(1).count()
    return F.col("doc_id").cast("long") if own else F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    """The columns that operators read, the key as their id."""
    more = [c for c in ("source",) if c in docs.columns]
    return docs.select(key.alias("doc_id"), "text", *more)


def _without(docs: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """Rows whose key is not among ``ids`` (column _id)."""
    return docs.withColumn("_stage_key", key).join(ids, F.col("_stage_key") == F.col("_id"), "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; its labels are those of op7.

    Null and empty texts are judged as texts without words. Rows of one id with
    different texts, and rows without an id, are judged each by its own text.
    Empty table: no rows. All columns of the table are kept as they are.
    """
    scratch, key = Scratch(spark, "stage-quality"), _key(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(held_out() != 0)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("_key")).distinct()
    labels = labels.join(named, "doc_id").select(F.col("_key").alias("doc_id"), "quality")
    scored = classify(_keyed(docs, key), labels, F.lit(True))
    rejected = scored.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0")
    return _without(docs, key, scratch.write(rejected.select(F.col("doc_id").alias("_id")), "rejected"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    A document without an id stays only where none of its group has one. Of rows
    that share id and text one stays. Texts without words have no copies but
    such rows. Empty table: no rows. All columns are kept as they are.
    """
    scratch, key = Scratch(spark, "stage-copies"), _key(docs)
    joined = scratch.write(ngram_join(_keyed(docs, key), scratch, percent=COPY_PERCENT, size=COPY_WORDS).select("doc_id", "component_id"), "joined")
    groups = joined.where("component_id is not null").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    if str(key) != str(F.col("doc_id").cast("long")):  # keys are hashes: the smallest is not that of the smallest id
        ids = docs.select(key.alias("_key"), F.col("doc_id").cast("long").alias("_doc")).distinct()
        first = groups.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "_key")).alias("first"))
        groups = groups.join(first, "component_id").select("_key", F.col("first._key").alias("component_id"))
    dropped = scratch.write(groups.where("_key <> component_id").select(F.col("_key").alias("_id")), "dropped")
    kept = _without(docs, key, dropped)
    if not joined.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return kept
    return kept.withColumn("_stage_key", key).dropDuplicates(["_stage_key"]).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark.

    Null and empty texts stay as they are, as do texts without secrets; n_chars
    follows the text where it changed. Rows are redacted each by its own text.
    Empty table: no rows.
    """
    scratch, key = Scratch(spark, "stage-secrets"), _key(docs)
    found = scan_secrets(_keyed(docs, key), scratch).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_id")).agg(F.first("spans").alias("_spans"))
    joined = docs.withColumn("_stage_key", key).join(scratch.write(found, "findings"), F.col("_stage_key") == F.col("_id"), "left")
    clean = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("_spans")))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", chars)
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row for each pass that takes words of a document, in order of position.

    Null and empty texts have no words to take and are not in it. A null source
    is one of its own. Rows that share id and text each come with all the passes
    of the first of them (near_copies leaves no such rows). Empty table: no rows.
    """
    scratch, key = Scratch(spark, "stage-mixture"), _key(docs)
    mixed = curriculum_mix(_keyed(docs, key), scratch).where(F.size("positions") > 0).groupBy(F.col("doc_id").alias("_id")).agg(F.min("positions").alias("_positions"))
    rows = docs.withColumn("_stage_key", key).join(scratch.write(mixed, "positions"), F.col("_stage_key") == F.col("_id"))
    passes = rows.select(*(docs[c] for c in docs.columns), F.explode("_positions").alias("_position"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return passes.repartitionByRange(parts, "_position", "doc_id").sortWithinPartitions("_position", "doc_id").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row of the stream, as counts and digests.

    A null text has no ids. A null id is kept. Repeated rows: one row each.
    Empty table: no rows.
    """
    return digests(bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixture", mixture),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are a table of the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
